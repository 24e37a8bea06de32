"""Version resolution: from a change log to the current state.

A change log has key, value, is_deleted and seq (unique, ascending with time).
The latest change of a key counts; a key whose latest change is a removal does
not exist.  The order of steps matters: bounds on the key may go before the
resolution (Catalyst moves them below it by itself), removals and limits only
after it.

A removed value is never looked at, so its column is pruned from counts, and
only ``seq`` and the row's payload go through the shuffle, pre-aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.plans.query import ALL, KeyQuery

LOG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType()), T.StructField("is_deleted", T.BooleanType()), T.StructField("seq", T.LongType())])


def latest(log: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The last change of each key (or each combination of ``by``), removals included."""
    rest = [c for c in log.columns if c not in (*by, "seq")]
    last = F.max_by(F.struct(*rest), "seq").alias("last") if rest else F.lit(None).alias("last")
    found = log.groupBy(*by).agg(F.max("seq").alias("seq"), last)
    return found.select(*by, *(F.col(f"last.{c}").alias(c) for c in rest), "seq").select(*log.columns)


def live(resolved: DataFrame) -> DataFrame:
    """Resolved rows without removals."""
    return resolved.where(~F.col("is_deleted"))


def current(log: DataFrame, resolved: bool = False) -> DataFrame:
    """Key and value of every key that exists. A ``resolved`` log has each key once, as a single segment does, and needs no shuffle."""
    return live(log if resolved else latest(log)).select("key", "value")


def scan(log: DataFrame, query: KeyQuery = ALL, resolved: bool = False) -> DataFrame:
    """Key and value within the query's bounds, ascending, up to its limit."""
    return query.limited(current(query.bound(log), resolved))


def get(log: DataFrame, key: str, resolved: bool = False) -> DataFrame:
    """The value of one key; no row if it is missing or removed."""
    return current(log.where(F.col("key") == key), resolved).select("value")


def multi_get(log: DataFrame, keys: DataFrame, resolved: bool = False) -> DataFrame:
    """Key and value of those of ``keys`` that exist."""
    return current(log.join(keys.select("key").distinct(), "key", "left_semi"), resolved)


def count(log: DataFrame, query: KeyQuery = ALL, resolved: bool = False) -> DataFrame:
    """One row, cnt: the records that the query gives. Values are not read."""
    rows = query.bound(log.select("key", "is_deleted", "seq"))
    rows = live(rows if resolved else latest(rows)).select("key")
    if query.limit < 1 << 31:
        rows = rows.limit(query.limit)
    return rows.agg(F.count("*").alias("cnt"))


def merged(*logs: DataFrame) -> DataFrame:
    """Several logs as one."""
    return reduce(lambda a, b: a.unionByName(b), logs)


def replay(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """The state after a log's tail on a snapshot (both with key, value, is_deleted, seq)."""
    return current(merged(snapshot, tail))


def removals(keys: DataFrame, seq: str = "seq") -> DataFrame:
    """Changes that remove ``keys`` (key and seq)."""
    return keys.select("key", F.lit(b"").alias("value"), F.lit(True).alias("is_deleted"), F.col(seq).alias("seq"))


def from_records(spark: SparkSession, records: list[tuple[str, bytes]], seq: int) -> DataFrame:
    """Changes from records in order; an empty value is a removal."""
    return spark.createDataFrame([(k, v, len(v) == 0, seq + i) for i, (k, v) in enumerate(records)], LOG)
