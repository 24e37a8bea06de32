"""The B+ tree: shape, the leaves that writes and reads touch, and what it holds."""

import random

from pyspark.sql import functions as F

from strataq.plans.query import KeyQuery
from strataq.sources import tree
from strataq.store import Store

BATCH = "key string, value binary, at long"


def make(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "LEAF", 10)  # 30 records a leaf, 3 children a node
    store = Store(spark, str(tmp_path / "store"))
    store.create_database("db")
    return store.create_table("db", "t", "bplus", {"BPLUS_TREE_ORDER": 3})


def check(table, model):
    """The tree's rules, and that its leaves hold the model."""
    t = table.segments
    levels, leaves = t.nodes(t.manifest.root), t.leaves(t.manifest.root)
    held = []
    for low, name, n in leaves:
        keys = [r["key"] for r in table.spark.read.parquet(f"{t.path}/data/{name}").select("key").collect()]
        assert keys == sorted(keys) and len(keys) == n and keys[0] >= low
        assert len(leaves) == 1 or 15 <= n <= 30
        held += keys
    assert held == sorted(model)
    for level in levels.values():
        assert all(2 <= len(below) <= 3 for _, below in level) or len(level) == 1
    assert {r["key"]: bytes(r["value"]) for r in table.scan().collect()} == model


def test_random_batches_equal_a_dictionary(spark, tmp_path, monkeypatch):
    table, rng, model = make(spark, tmp_path, monkeypatch), random.Random(3), {}
    for size, span, removed in ((400, 1000, 0.0), (5, 40, 0.2), (60, 1200, 0.5), (300, 700, 0.95)):
        rows = []
        for i in range(size):
            key = f"k{rng.randrange(span):04d}ü"
            value = b"" if rng.random() < removed else f"{size}-{i}".encode()
            rows.append((key, value, i))
            model[key] = value
        model = {k: v for k, v in model.items() if v}
        table.put_batch(spark.createDataFrame(rows, BATCH), order="at")
        check(table, model)
    assert max(table.segments.nodes(table.segments.manifest.root)) >= 1
    table.remove_batch(spark.createDataFrame([(k,) for k in model], "key string"))
    assert table.segments.manifest.root == "" and table.count() == 0
    table.put("again", b"1")
    table.flush()
    check(table, {"again": b"1"})


def test_a_write_leaves_other_leaves_and_a_read_opens_only_its_own(spark, tmp_path, monkeypatch):
    table = make(spark, tmp_path, monkeypatch)
    table.put_batch(spark.range(500).select(F.format_string("k%04d", "id").alias("key"), F.lit(b"v").alias("value")))
    names = lambda: {c[1] for c in table.segments.leaves(table.segments.manifest.root)}
    before, nodes = names(), table.segments._names(table.segments.manifest.root)
    table.put("k0250", b"w")
    table.remove("k0100")
    table.flush()
    assert len(before - names()) <= 4 and len(before & names()) >= 10
    assert (nodes - before) & table.segments._names(table.segments.manifest.root)  # nodes beside the path stay
    check(table, {f"k{i:04d}": b"w" if i == 250 else b"v" for i in range(500) if i != 100})
    assert len(table.scan(KeyQuery("k0250", True, "k0250", True)).inputFiles()) == 1
    assert len(table.multi_get(spark.createDataFrame([("k0001",), ("k0499",), ("none",)], "key string")).inputFiles()) == 2
    assert table.get("k0250") == b"w" and table.get("k0100") is None and table.get("a") is None
    old = table.scan()
    table.put("k0250", b"x")
    table.checkpoint()
    assert old.where("key = 'k0250'").first()["value"] == b"w"  # a reader keeps its tree
    table.checkpoint(retain=0)
    files = table.segments.files
    assert {*files.names(f"{table.segments.path}/data"), *files.names(f"{table.segments.path}/nodes")} == table.segments._names(table.segments.manifest.root)
    found = table.statistics()
    assert found["segments"] == 1 and found["records"] == 499 and found["bytes_on_disk"] > 0


def test_two_writers_and_segments_of_before(spark, tmp_path, monkeypatch):
    from strataq.sources.table import SegmentTable

    one = make(spark, tmp_path, monkeypatch)
    SegmentTable.flush(one.segments, spark.createDataFrame([("a", b"0", False, 0), ("b", b"0", False, 1)], "key string, value binary, is_deleted boolean, seq long"), 0, 2, [])
    assert {r["key"] for r in one.scan().collect()} == {"a", "b"}
    two = Store(spark, str(tmp_path / "store")).table("db", "t")
    one.put_batch(spark.createDataFrame([("a", b"1", 0), ("c", b"1", 1)], BATCH), order="at")
    two.put_batch(spark.createDataFrame([("a", b"2", 0), ("d", b"2", 1)], BATCH), order="at")
    for table in (one, two):
        assert {r["key"]: bytes(r["value"]) for r in table.scan().collect()} == {"a": b"2", "b": b"0", "c": b"1", "d": b"2"}
    assert one.segments.manifest.segments == []
