"""Encoded records, hashes, and quantiles."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from strataq.functions import records as R
from strataq.functions.quantiles import exact_quantiles


def plain(keys, values):
    body = struct.pack(">h", len(keys)) + b"".join(struct.pack(">h", len(k)) + k for k in keys) + struct.pack(">h", len(values)) + b"".join(struct.pack(">i", len(v)) + v for v in values)
    return struct.pack(">i", len(body) + 4) + body


def test_records_both_ways(spark):
    rows = [("key", "ünï", b"value"), ("", "x", b""), ("a" * 300, "\u20ac", bytes(range(256)))]
    df = spark.createDataFrame(rows, "a string, b string, v binary").withColumn("r", R.encoded([F.col("a"), F.col("b")], [F.col("v")])).withColumn("d", R.decoded("r"))
    for r in df.collect():
        keys, values = [r["a"].encode(), r["b"].encode()], [bytes(r["v"])]
        assert bytes(r["r"]) == plain(keys, values)
        assert [bytes(x) for x in r["d"]["keys"]] == keys and [bytes(x) for x in r["d"]["values"]] == values
    assert R.decode(plain([], [])) == ([], [])
    with pytest.raises(ValueError):
        R.decode(plain([b"k"], [b"v"])[:-1])


def by_hand(key):
    """One step after the other, with numbers cut to 32 bits."""
    cut = lambda x: x & 0xFFFFFFFF
    n, data = len(key.encode("utf-16-le")) // 2, key.encode()
    h = n
    for i in range(0, n // 4 * 4, 4):
        k = cut(int.from_bytes(data[i : i + 4], "little") * R.MULTIPLIER)
        h = cut(h * R.MULTIPLIER) ^ cut((k ^ k >> 24) * R.MULTIPLIER)
    signed = lambda b: b - 256 if b > 127 else b
    if left := n % 4:
        for back in range(left, 0, -1):
            h = cut(h ^ signed(data[n - back]) << 8 * (back - 1))
        h = cut(h * R.MULTIPLIER)
    h = cut((h ^ h >> 13) * R.MULTIPLIER)
    h ^= h >> 15
    return h - (1 << 32) if h >> 31 else h


def test_hash_equals_the_plain_form(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choice("abcäß€🎉09") for _ in range(rng.randrange(20))) for _ in range(200)] + ["", "a", "key1"]
    assert R.murmur32(keys).tolist() == [by_hand(k) for k in keys]
    df = spark.createDataFrame([("key1",), (None,)], "k string").select(R.murmur("k").alias("h"))
    assert [r["h"] for r in df.collect()] == [by_hand("key1"), None]
    assert len(R.murmur32([])) == 0


def test_quantiles_equal_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, rng.random(), 1e6 * rng.random(), -5.0])) for _ in range(3000)] + [("same", 2.5)] * 100 + [("nulls", None)] * 3 + [("one", 7.0)]
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p99": 0.99, "p1": 0.01}).collect()}
    for g in {g for g, _ in rows}:
        values = sorted(v for x, v in rows if x == g and v is not None)
        at = lambda q: values[-int(-(q * len(values)) // 1) - 1] if values else None  # noqa: E731, B023
        assert (got[g]["n"], got[g]["p50"], got[g]["p99"], got[g]["p1"], got[g]["top"]) == (len(values), at(0.5), at(0.99), at(0.01), values[-1] if values else None)


def test_sparse_index_in_ranges_equals_numbering(spark, monkeypatch):
    from strataq.operators import segments as S

    monkeypatch.setattr(S, "RANGES", 8)
    monkeypatch.setattr(S, "SAMPLE", 4)
    rng = random.Random(3)
    rows = [(s, f"k{k:05d}") for s, n in ((1, 500), (2, 1), (7, 33)) for k in rng.sample(range(10_000), n)]
    got = sorted(map(tuple, S.sparse_index(spark.createDataFrame(rows, "segment_id int, key string"), 16).collect()))
    want = []
    for s in (1, 2, 7):
        keys = sorted(k for x, k in rows if x == s)
        want += [(s, k, i + 1) for i, k in enumerate(keys) if i % 16 == 0 or i == len(keys) - 1]
    assert got == want
    assert S.sparse_index(spark.createDataFrame([], "segment_id int, key string"), 16).count() == 0
