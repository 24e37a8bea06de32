import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strataq.llm import token_shards as T

from .conftest import prose

LIBRARY = Tokenizer.from_file(T.tokenizer_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [T.END_ID]


STRANGE = [
    "It's the user's, they're I'd we'll... don't! THE End?", "Don't.'s 's", "ÀÉ é ﬁ İstanbul ΣΑΣ ς 1234 a1b2", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|> <| |>", "a b c\u0085d \x1c\x1f", "tab\there\x0bnew\x0cline\r\n", "word.,;:!? .start 5.,5 ü.",
    "🎉🎉 ́x", ".", "'", "", None, "日本語のテキスト。", "á.", "́.", "²³ Ⅷ."
]


def test_encoder_equals_the_library():
    encode = T.Encoder(T.tokenizer_path())
    rng = random.Random(4)
    mixed = ["".join(rng.choice("aB'.,!? \né́<|>1ſİ") for _ in range(40)) for _ in range(300)]
    texts = [*STRANGE, *mixed, prose(1, 500)]
    for part in (texts, [t for t in texts if "<|" not in (t or "")]):
        got = encode(pa.array(part, pa.string()))
        assert [np.frombuffer(x, f"<u{encode.width}").tolist() for x in got] == [ids_of(t) for t in part]


def test_shards_equal_brute_force(spark, table):
    rows = [(i * 7 - 50, t, None, None, None) for i, t in enumerate([*STRANGE, *(prose(k, 50) for k in range(200))])]
    docs = table(random.Random(1).sample(rows, len(rows)))
    want, start = [], 0
    for key, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = ids_of(text)
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, T.shard_documents(docs).collect())) == want


def test_lookup(spark, table):
    docs = table([(i, f"text number {i} " + prose(i, 40), None, None, None) for i in range(0, 3000, 3)])
    shards = T.write_shards(docs)
    assert [s["first"] for s in shards] == sorted(s["first"] for s in shards)
    found = 0
    for s in shards:
        with T.Shard(s["path"]) as shard:
            assert shard.entries == s["entries"] and sum(1 for _ in shard.scan()) == s["entries"]
            for i in (0, 3, 1500, 2997):
                for ids in shard.get(i):
                    found += 1
                    assert ids.tolist() == ids_of(f"text number {i} " + prose(i, 40))
            assert shard.get(1) == [] and shard.get(None) == []
            assert sum(shard.may_hold(T.key_of(i)) for i in range(1, 3000, 3)) < 60
    assert found == 4


def test_damage_is_found(spark, table, tmp_path):
    (s, *_) = T.write_shards(table([(1, "some text", None, None, None)]))
    raw = bytearray(open(s["path"].removeprefix("file://"), "rb").read())
    raw[3] ^= 1
    (tmp_path / "bad").write_bytes(raw)
    with pytest.raises(ValueError), T.Shard(str(tmp_path / "bad")) as shard:
        list(shard.scan())


def test_keys_sort_as_numbers():
    numbers = [-(1 << 63), -5, -1, 0, 1, 255, 256, (1 << 63) - 1]
    assert sorted(map(T.key_of, numbers)) == list(map(T.key_of, numbers)) and [T.identifier_of(T.key_of(n)) for n in numbers] == numbers
    assert T.identifier_of(T.key_of(None)) is None and T.key_of(None) < T.key_of(-(1 << 63))


def test_odd_rows(spark, odd, table):
    got = T.shard_documents(odd).collect()
    want = sorted((len(ids_of(r["text"])) for r in odd.collect()))
    assert sorted(r["n_tokens"] for r in got) == want
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert T.shard_documents(table([])).count() == 0


def test_texts_are_encoded_whole_under_unknown_rules(tmp_path):
    rules = json.loads(LIBRARY.to_str())
    assert T.by_pieces(rules)
    rules["normalizer"] = {"type": "NFC"}
    path = str(tmp_path / "other.json")
    Tokenizer.from_str(json.dumps(rules)).save(path)
    library, encode = Tokenizer.from_file(path), T.Encoder(path)
    assert not encode.pieces
    texts = [t or "" for t in STRANGE] + ["Some  TEXT with CASE"]
    assert [np.frombuffer(x, f"<u{encode.width}").tolist() for x in encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids + [T.END_ID] for t in texts]
