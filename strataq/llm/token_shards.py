"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifiers.  Layout, all
numbers little-endian::

    blocks   zstd frames; inside, entries: varint shared key bytes, varint
             other key bytes, varint value bytes, the other key bytes, the value
    index    for each block: u64 offset, u32 bytes, u32 crc32, u32 entries,
             u64 tokens before it in the shard, u16 key bytes, first key
    filter   Bloom filter bits over the distinct keys
    footer   u64 index offset, u64 filter offset, u64 entries, u64 tokens,
             u32 hashes of the filter, u8 bytes of an id, 3 zero bytes, "SQSST\\x01\\0\\0"

Keys are identifiers as 8 big-endian bytes with the sign bit turned, so bytes
sort as numbers do; values are ids of 2 bytes if the vocabulary fits, else 4.
A lookup asks the filter, bisects the index and decodes one block.

An order, if the documents have one (that of rows in the files they are read
from), is kept in shards of its own: the key is a row's place, file and row, and
the value its document's key.  So documents can be looked up by identifier and
read in the order of a mixture.

Documents are dealt by ranges of (identifier, hash of the text) and sorted in
their partition; each partition streams its shard to the shared folder under a
name that its number fixes, so a repeated task writes the same file again.
Only one row a shard reaches the driver, for the shards' starting positions.

Pieces are encoded by the tokenizers library, and a worker remembers up to
``PIECES`` of them.  A text falls into pieces where the tokenizer's own rules,
if they are the known ones, never join (texts are encoded whole otherwise): at space and 0x09-0x0D, and between a letter and the marks that end
a word.  The tokenizer lower-cases, so pieces are remembered in lower case, but
for texts with "<|", which may name a special token.

Defined cases: a null text is empty and has the end id alone; a null identifier
has the empty key, which sorts first; rows that repeat an identifier are all
kept, in the order of their texts' hashes; an empty table makes one empty shard
or none; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm._store import new_dir, opened, put
from strataq.llm._text import slices, texts, words_of

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_BYTES = 64 << 10
FILTER_BITS, FILTER_HASHES = 10, 7
PIECES = 800_000
ENCODED_BYTES = 8 << 20  # of texts at once: the more, the fewer pieces come again
TAIL = ".,;:!?"
MAGIC = b"SQSST\x01\0\0"
FOOTER = struct.Struct("<QQQQIB3x8s")
INDEX = struct.Struct("<QIIIQH")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The vocabulary file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- keys, blocks, files -------------------------------------------------------------------------


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else struct.pack(">Q", identifier + (1 << 63))


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _filter_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = h >> 32 | 1
    return [(h + k * step) % bits for k in range(hashes)]


class ShardWriter:
    """Makes a shard's bytes from (key, value) in ascending key order."""

    def __init__(self, width: int) -> None:
        self.width, self.entries, self.tokens = width, 0, 0
        self.first: bytes | None = None
        self.last: bytes | None = None

    def chunks(self, items: Iterable[tuple[bytes, bytes]]) -> Iterator[bytes]:
        pack = zstandard.ZstdCompressor(level=1)
        index, hashes, at = [], [], 0
        block, inside, before, start, last = bytearray(), 0, 0, b"", b""

        def closed() -> bytes:
            data = pack.compress(bytes(block))
            index.append(INDEX.pack(at, len(data), zlib.crc32(data), inside, before, len(start)) + start)
            return data

        for key, value in items:
            if self.last is not None and key < self.last:
                raise ValueError("keys must ascend")
            shared = len(os.path.commonprefix((last, key))) if inside else 0
            if not inside:
                start, before = key, self.tokens
            block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
            if key != self.last:
                hashes.append(key)
            self.first = key if self.first is None else self.first
            self.last = last = key
            inside += 1
            self.entries += 1
            self.tokens += len(value) // self.width
            if len(block) >= BLOCK_BYTES:
                data = closed()
                yield data
                at += len(data)
                block, inside = bytearray(), 0
        if inside:
            data = closed()
            yield data
            at += len(data)
        yield b"".join(index)
        size = sum(map(len, index))
        bits = max(64, FILTER_BITS * len(hashes))
        marks = np.zeros(bits, np.bool_)
        for key in hashes:
            marks[_filter_places(key, bits, FILTER_HASHES)] = True
        packed = np.packbits(marks, bitorder="little").tobytes()
        yield struct.pack("<Q", bits) + packed
        yield FOOTER.pack(at, at + size, self.entries, self.tokens, FILTER_HASHES, self.width, MAGIC)


class Shard:
    """A shard for lookups and scans."""

    def __init__(self, uri: str) -> None:
        self.file = opened(uri)
        end = self.file.seek(0, 2)
        self.file.seek(end - FOOTER.size)
        self.index_at, filter_at, self.entries, self.tokens, self.hashes, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.file.seek(self.index_at)
        raw = self.file.read(filter_at - self.index_at)
        self.keys, self.blocks, at = [], [], 0
        while at < len(raw):
            *place, n = INDEX.unpack_from(raw, at)
            at += INDEX.size + n
            self.blocks.append(tuple(place))
            self.keys.append(raw[at - n : at])
        self.file.seek(filter_at)
        bits = self.file.read(end - FOOTER.size - filter_at)
        self.bits, self.filter = struct.unpack_from("<Q", bits)[0], bits[8:]

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def may_hold(self, key: bytes) -> bool:
        return all(self.filter[p >> 3] >> (p & 7) & 1 for p in _filter_places(key, self.bits, self.hashes))

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, size, crc, entries, _ = self.blocks[k]
        self.file.seek(at)
        data = self.file.read(size)
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(data), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key = key_of(identifier)
        if not self.blocks or not self.may_hold(key):
            return []
        first, last = max(0, bisect_left(self.keys, key) - 1), bisect_right(self.keys, key)
        return [self.ids(v) for k in range(first, last) for found, v in self.block(k) if found == key]


# --- encoding ------------------------------------------------------------------------------------


# The rules of the tokenizer for which texts may be encoded by pieces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_pieces(rules: dict) -> bool:
    """Whether a tokenizer's file has the rules that never join pieces; texts are encoded whole by any other."""
    special = all(t["content"].startswith("<|") and not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"])
    return special and rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == SPLITTING


class Encoder:
    """Ids of whole texts, by pieces where the tokenizer's rules allow it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pieces = by_pieces(json.loads(self.library.to_str()))
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.known))
        if len(self.known) + len(new) > PIECES:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        code = "H" if self.width == 2 else "I"
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for p, x in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                self.known[p] = array(code, x.ids).tobytes()

    def __call__(self, column: pa.Array) -> list[bytes]:
        """Each text's ids and the end id, as bytes."""
        column = texts(column)
        if not self.pieces:
            found = self.library.encode_batch_fast(column.to_pylist(), add_special_tokens=False)
            return [np.array([*x.ids, END_ID], f"<u{self.width}").tobytes() for x in found]
        lower = not pc.any(pc.match_substring(column, "<|")).as_py()
        words, counts = words_of(column, lower=lower)
        coded = pc.dictionary_encode(words)
        codes, stems, tails = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), {}
        if lower:  # marks at the end are pieces of their own, behind a letter
            bare = pc.utf8_rtrim(coded.dictionary, characters=TAIL)
            marked = np.flatnonzero(pc.less(pc.binary_length(bare), pc.binary_length(coded.dictionary)).to_numpy(zero_copy_only=False))
            for i, stem in zip(marked.tolist(), bare.take(pa.array(marked)).to_pylist()):
                if stem[-1:].lower().isalpha():
                    tails[i], stems[i] = stems[i][len(stem) :], stem
        self._learn({*stems, *tails.values()})
        pieces = list(map(self.known.__getitem__, stems))
        for i, tail in tails.items():
            pieces[i] += self.known[tail]
        kind = np.dtype(f"<u{self.width}")
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        flat, starts = np.frombuffer(b"".join(pieces), kind), np.cumsum(size) - size
        lengths = size[codes]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate(([0], ends))[np.cumsum(counts)]
        tail = np.array([END_ID], kind).tobytes()
        return [ids[a:b].tobytes() + tail for a, b in zip(np.concatenate(([0], total[:-1])), total)]


@functools.cache
def encoder(path: str) -> Encoder:
    """The worker's encoder, kept for its later tasks."""
    return Encoder(path)


def _writing(folder: str, path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        encode = encoder(path)
        writer = ShardWriter(encode.width)

        def items() -> Iterator[tuple[bytes, bytes]]:
            for batch in batches:
                for part in slices(batch, "text", ENCODED_BYTES):
                    yield from zip(map(key_of, part.column(key).to_pylist()), encode(part.column("text")))

        uri = f"{folder}/shard-{number:06d}.sst"
        size = put(uri, writer.chunks(items()))
        row = {"shard": number, "path": uri, "entries": writer.entries, "tokens": writer.tokens, "bytes": size, "first": writer.first, "last": writer.last}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]))

    return run


def write_shards(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, key: str = "doc_id") -> list[dict]:
    """Writes the shards and lists them in ascending order: shard, path, entries, tokens, start, bytes, first and last key."""
    folder = folder or new_dir(docs.sparkSession, "token-shards")
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(key, "tie").sortWithinPartitions(key, "tie", "text")
    written = dealt.select(key, "text").mapInArrow(_writing(folder, tokenizer or tokenizer_path(), key), "shard long, path string, entries long, tokens long, bytes long, first binary, last binary")
    out, start = [], 0
    for r in sorted(written.collect(), key=lambda r: r["shard"]):  # a row a shard
        out.append(r.asDict() | {"start": start})
        start += r["tokens"]
    return out


def _reading(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # the worker has written its shards
        names = [key, "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with Shard(uri) as shard:
                    for k in range(len(shard.blocks)):
                        out = []
                        for found, value in shard.block(k):
                            ids = shard.ids(value)
                            out.append((identifier_of(found), start, len(ids), zlib.crc32(ids)))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return run


def read_shards(spark: SparkSession, shards: list[dict], key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids_crc32 of every document in the shards."""
    rows = [(s["path"], s["start"]) for s in shards if s["entries"]]
    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "path string, start long")
    return listed.mapInArrow(_reading(key), f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def _ordering(folder: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        writer = ShardWriter(8)

        def items() -> Iterator[tuple[bytes, bytes]]:
            for batch in batches:
                for file, row, identifier in zip(*(batch.column(c).to_pylist() for c in ("file", "row", key))):
                    yield struct.pack(">QQ", file, row), key_of(identifier)

        uri = f"{folder}/order-{number:06d}.sst"
        put(uri, writer.chunks(items()))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([uri]), pa.array([writer.entries], pa.int64())], ["shard", "path", "entries"])

    return run


def write_order(docs: DataFrame, folder: str, key: str = "doc_id") -> list[dict]:
    """Writes the order of rows in their files to shards, and lists them in that order. ``docs`` is read from files whose names begin with part-, a number, and perhaps c and another one."""
    name = F.col("_metadata.file_name")
    part = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long"), F.lit(0))
    file = part("^part-([0-9]+)") * (1 << 20) + part("[.-]c([0-9]+)[.]")
    rows = docs.select(file.alias("file"), F.col("_metadata.row_index").alias("row"), F.col(key).cast("long").alias(key))
    dealt = rows.repartitionByRange("file", "row").sortWithinPartitions("file", "row")
    written = dealt.mapInArrow(_ordering(folder, key), "shard long, path string, entries long").collect()  # a row a shard
    return [r.asDict() for r in sorted(written, key=lambda r: r["shard"])]


def read_order(order: list[dict]) -> Iterator[int | None]:
    """The identifiers in order."""
    for part in order:
        with Shard(part["path"]) as shard:
            for _, value in shard.scan():
                yield identifier_of(value)


def shard_documents(docs: DataFrame, ordered: bool = False, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` and gives what the files hold; ``ordered``: with the order of rows in the files they are read from."""
    folder = folder or new_dir(docs.sparkSession, "token-shards")
    if ordered:
        write_order(docs, folder)
    return read_shards(docs.sparkSession, write_shards(docs, folder))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids' checksum, from the shards."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op2_token_shards": op2_token_shards}
ORACLE_SQL: dict[str, str] = {}
