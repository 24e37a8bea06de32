import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataq.llm import mixture as M

from .conftest import WORD, prose


def rows():
    out, i = [], 0
    for source, n in (("big", 300), ("mid", 60), ("small", 12), (None, 5)):
        for _ in range(n):
            out.append((i, prose(i, 20 + i % 30), "en", source, 1))
            i += 1
    return out


def limits(shares, a):
    z = sum(p**a for p in shares)
    w = [p**a / z for p in shares]
    return -sum(x * math.log(x) for x in w), max(x / p for x, p in zip(w, shares)), w


@pytest.mark.parametrize("entropy,repeats", [(0.9, 50.0), (0.99, 3.0), (0.2, 4.0), (0.999, 1.0)])
def test_exponent_equals_bisection(spark, table, entropy, repeats):
    tokens = [13000, 2500, 500, 200]
    sources = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "__sq_source string, tokens long")
    shares = [t / sum(tokens) for t in tokens]
    got, norm = M.exponent(sources, None, entropy, repeats)

    def fits(a):
        h, r, _ = limits(shares, a)
        return h >= entropy * math.log(4)

    low, high = 0.0, 1.0
    for _ in range(60):
        low, high = (m, high) if fits(m := (low + high) / 2) else (low, m)
    want = 1.0 if fits(1.0) else low
    if limits(shares, want)[1] > repeats:
        low, high = want, 1.0
        for _ in range(60):
            low, high = (m, high) if limits(shares, m := (low + high) / 2)[1] > repeats else (low, m)
        want = high
    assert math.isclose(got, want, abs_tol=1e-5) and math.isclose(norm, sum(p**got for p in shares), rel_tol=1e-9)


def test_realised_weights_and_epochs(spark, table):
    docs = table(rows())
    got = M.mixed(docs, repeats=3.0).select("doc_id", F.col("__sq_source").alias("s"), F.col("__sq_tokens").alias("t"), F.col("__sq_epoch").alias("e"), F.col("__sq_weight").alias("w"), F.col("__sq_block").alias("b"), F.col("__sq_place").alias("p")).collect()
    size = {r[0]: len(WORD.findall(r[1])) for r in rows()}
    by_source, total = defaultdict(list), sum(size.values())
    for r in rows():
        by_source[r[3] or ""].append(r[0])
    assert all(r["t"] == size[r["doc_id"]] for r in got)
    assert max(Counter((r["doc_id"], r["e"]) for r in got).values()) == 1
    for s, ids in by_source.items():
        mine = [r for r in got if r["s"] == s]
        quota, have = mine[0]["w"] * total, sum(r["t"] for r in mine)
        assert quota - 60 < have <= quota + 1
        whole = int(quota // sum(size[i] for i in ids))
        for e in range(whole):
            assert sorted(r["doc_id"] for r in mine if r["e"] == e) == sorted(ids)
        assert max(r["e"] for r in mine) <= whole <= 3
    assert math.isclose(sum({r["s"]: r["w"] for r in got}.values()), 1.0, rel_tol=1e-9)


def test_blocks_are_permuted_in_each_epoch(spark, table, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 200)
    docs = table([(i, "w " * 50, "en", "a" if i < 40 else "b", 1) for i in range(400)])
    got = M.mixed(docs, entropy=1.0, repeats=9.0).select("source", "__sq_epoch", "__sq_place", "__sq_block").distinct().collect()
    orders = defaultdict(list)
    for r in sorted(got, key=lambda r: r["__sq_place"]):
        orders[r["source"], r["__sq_epoch"]].append(r["__sq_block"])
    assert orders["a", 0] != orders["a", 1] and sorted(orders["a", 0]) == sorted(orders["a", 1])
    assert all(len(set(x)) == len(x) for x in orders.values())


def test_budget(spark, table):
    docs = table(rows())
    tokens = lambda df: df.agg(F.sum(M.tokens_of(F.col("text")))).first()[0]
    total = tokens(docs)
    for part in (0.5, 2.0):
        have = tokens(M.mix_documents(docs, epochs=part, repeats=100.0))
        assert abs(have - total * part) < 300


def test_the_query_bites_on_its_data(spark):
    """The exponent is below 1, weights are as even as asked, and small sources come again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sources = docs.groupBy("source").agg(F.sum(M.tokens_of(F.col("text"))).alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0]
    power, norm = M.exponent(sources, int(1.25 * total), 0.999)
    assert 0.1 < power < 0.9
    want = {r["source"]: (r["tokens"] / total) ** power / norm for r in sources.collect()}
    assert abs(-sum(w * math.log(w) for w in want.values()) / math.log(len(want)) - 0.999) < 1e-6
    got = M.op4_source_mixture(spark, "/root/testdata/sf0.01").groupBy("source").agg(F.first("weight").alias("w"), F.sum("n_tokens").alias("t"), F.max("epoch").alias("e")).collect()
    assert max(r["e"] for r in got) >= 1
    for r in got:
        assert math.isclose(r["w"], want[r["source"]], abs_tol=1e-8) and 0 <= r["w"] * 1.25 * total - r["t"] < 21_000


def test_rows_come_in_the_order_of_the_mixture(spark, table, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 200)
    docs = table([(i, "w " * (40 + i % 20), "en", "a" if i % 5 == 0 else "b", 1) for i in range(300)])
    order = ("__sq_progress", "__sq_source", "__sq_epoch", "__sq_hash")
    want = M.mixed(docs, entropy=1.0, epochs=1.5).orderBy(*order).select("doc_id", "source", "__sq_epoch", "__sq_place").collect()
    assert [r["doc_id"] for r in M.mix_documents(docs, entropy=1.0, epochs=1.5).collect()] == [r["doc_id"] for r in want]
    for source in "ab":  # a source's blocks follow each other epoch by epoch
        mine = [(r["__sq_epoch"], r["__sq_place"]) for r in want if r["source"] == source]
        assert mine == sorted(mine)
    half = [r["source"] for r in want[: len(want) // 2]]
    assert 0.4 < half.count("a") / len(half) < 0.6  # an even mixture from the start


def test_intermediate_tables_go(spark, table):
    from strataq.llm import _store

    docs = table(rows())
    files = spark._jvm.org.apache.hadoop.fs.Path(_store.shared_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(_store.shared_dir(spark)))}
    before = names()
    M.mixed(docs)
    assert {n.rsplit("-", 1)[0] for n in names() - before} == {"mix-plan", "mix-sizes"}


def test_stage_keeps_columns_and_odd_rows(odd, table):
    mixed = M.mix_documents(odd)
    assert mixed.columns == odd.columns
    assert {r["text"] for r in mixed.collect()} <= {r["text"] for r in odd.collect()}
    assert M.mix_documents(table([])).count() == 0
    assert M.mix_documents(table([(1, None, None, None, None)])).count() == 0
    one = table([(i, prose(i, 30), "en", "only", 1) for i in range(20)])
    assert sorted(r["doc_id"] for r in M.mix_documents(one).collect()) == list(range(20))
