"""Version resolution, segments and query descriptions on hand-made logs and against a dictionary."""

import random

import pytest

from strataq.operators import segments as S
from strataq.operators import versions as V
from strataq.plans.query import KeyQuery

# Newest first; None is a removal, a missing letter no change.
SOURCES = {
    4: {"a": "4"},
    3: {"a": "3", "b": None, "c": "3", "d": None, "e": None, "f": "3", "g": "3", "j": "3", "k": None, "l": None, "m": "3", "n": "3", "o": "3", "p": None},
    2: {"b": "2", "c": None, "f": None, "g": "2", "i": "2", "j": None, "k": None, "l": None, "m": None, "n": "2"},
    1: {"a": "1", "b": "1", "c": "1", "d": "1", "e": None, "f": "1", "g": "1", "h": "1", "j": "1", "k": None, "l": "1", "m": "1", "n": None},
}


def four_way(spark):
    rows = [(k, (v or "").encode(), v is None, s) for s, x in SOURCES.items() for k, v in x.items()]
    return spark.createDataFrame(rows, V.LOG)


def pairs(df):
    return [(r["key"], bytes(r["value"]).decode()) for r in df.collect()]


def test_four_way_merge(spark):
    want = {"a": "4", "c": "3", "f": "3", "g": "3", "h": "1", "i": "2", "j": "3", "m": "3", "n": "3", "o": "3"}
    assert pairs(V.scan(four_way(spark))) == sorted(want.items())


@pytest.mark.parametrize(
    "query,want",
    [(KeyQuery("2", False, "7", False), "3456"), (KeyQuery(max_key="5", max_inclusive=False), "1234"), (KeyQuery("3", True, "5", True), "345"), (KeyQuery("7", False), "8"), (KeyQuery("6", True, "2", True), ""), (KeyQuery("0", True, "9", True, 3), "123")],
)
def test_bounds_and_limit(spark, query, want):
    log = V.from_records(spark, [(str(i), b"x") for i in range(1, 9)], 0)
    assert "".join(k for k, _ in pairs(V.scan(log, query))) == want
    assert V.count(log, query).first()["cnt"] == len(want)


def test_limit_counts_only_what_exists(spark):
    log = V.from_records(spark, [("a", b"1"), ("b", b"1"), ("a", b""), ("c", b"1"), ("d", b"1")], 0)
    assert pairs(V.scan(log, KeyQuery(limit=2))) == [("b", "1"), ("c", "1")]


def test_partial_merge_drops_removals_only_with_the_oldest(spark):
    log = four_way(spark).withColumnRenamed("seq", "segment_id").selectExpr("key", "value", "is_deleted", "cast(segment_id as bigint) as seq", "cast(segment_id as int) as segment_id")
    merged = S.merge_oldest(log, [1, 2])
    assert sorted(r[0] for r in merged.select("segment_id").distinct().collect()) == [2, 3, 4]
    assert not merged.where("segment_id = 2 and is_deleted").count()
    assert pairs(V.scan(merged.drop("segment_id"))) == pairs(V.scan(four_way(spark)))


def test_all_removed_merge_is_empty(spark):
    log = spark.createDataFrame([("a", b"1", False, 1, 1), ("a", b"", True, 2, 2)], "key string, value binary, is_deleted boolean, seq long, segment_id int")
    assert S.merge_oldest(log, [1, 2]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_changes_equal_a_dictionary(spark, seed):
    rng, model, records = random.Random(seed), {}, []
    for i in range(400):
        key, value = f"key{rng.randrange(60):03d}", b"" if rng.random() < 0.3 else str(i).encode()
        records.append((key, value))
        model.pop(key, None) if not value else model.__setitem__(key, value.decode())
    log = V.from_records(spark, records, 0)
    assert pairs(V.scan(log)) == sorted(model.items())
    low, high = "key010", "key030"
    assert pairs(V.scan(log, KeyQuery(low, False, high, True))) == sorted((k, v) for k, v in model.items() if low < k <= high)
    key = sorted(model)[0]
    assert V.get(log, key).first()["value"].decode() == model[key]
    cut = V.replay(V.latest(log.where("seq < 200")), log.where("seq >= 200"))
    assert sorted(pairs(cut)) == sorted(model.items())


@pytest.mark.parametrize("low", [None, ("10", True), ("10", False)])
@pytest.mark.parametrize("high", [None, ("10", True), ("11", False)])
def test_query_json_round_trip(low, high):
    q = KeyQuery()
    q = q.with_min_key(*low) if low else q
    q = q.with_max_key(*high) if high else q
    for query in (q, q.with_limit(5)):
        assert KeyQuery.from_json(query.to_json()) == query


def test_bad_queries():
    with pytest.raises(ValueError):
        KeyQuery(limit=0)
    with pytest.raises(TypeError):
        KeyQuery(min_key=3)
    with pytest.raises(ValueError):
        KeyQuery.from_json("{}")
