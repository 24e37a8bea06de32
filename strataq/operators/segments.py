"""Segments: immutable parts of a change log, each resolved within itself.

``segment_id`` ascends with time.  All operators here keep the segments apart
by grouping on it, so that one pass serves any number of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.operators.versions import latest, live


def flushed(log: DataFrame) -> DataFrame:
    """What each segment keeps of its changes: a key's last, removals included."""
    return latest(log, ("segment_id", "key"))


def metadata(segments: DataFrame) -> DataFrame:
    """Counts and key bounds of each segment (of flushed rows)."""
    removed = F.sum(F.col("is_deleted").cast("long"))
    return segments.groupBy("segment_id").agg(
        F.count("*").alias("records_with_deleted"), removed.alias("deleted_records"), (F.count("*") - removed).alias("records"), F.min("key").alias("min_key"), F.max("key").alias("max_key")
    )


def live_by_segment(segments: DataFrame) -> DataFrame:
    """One row, live_sum: records that are no removals, summed without resolving across segments."""
    return metadata(segments).agg(F.sum("records").alias("live_sum"))


def merge_oldest(segments: DataFrame, ids: list[int]) -> DataFrame:
    """The segments ``ids``, the oldest ones in ascending order, as one, which takes the last of their ids; others are untouched.

    The oldest segment takes part, so nothing older can be uncovered and removals go. Which segments there are is for a
    manifest to know; ``segments`` is not read for it."""
    if len(ids) < 2:
        return segments
    old = segments.where(F.col("segment_id").isin(ids))
    merged = live(latest(old)).withColumn("segment_id", F.lit(ids[-1]).cast(segments.schema["segment_id"].dataType))
    return merged.select(*segments.columns).unionByName(segments.where(~F.col("segment_id").isin(ids)))


RANGES, SAMPLE = 256, 16


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the ascending ``bounds`` are not above the key, by bisection."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bounds[middle], within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(bounds))


def sparse_index(segments: DataFrame, every: int) -> DataFrame:
    """Each segment's first key and every ``every``-th after it; and its last key if the last block has more than one.

    Keys are numbered within ``RANGES`` ranges of a segment, each from what the ranges before it hold, so that no task
    has a whole segment. The ranges' bounds are taken from the keys of least hash, which are the same whenever a task is
    repeated."""
    keys = segments.select("segment_id", "key")
    some = keys.select("key", F.xxhash64("key").alias("h")).distinct().orderBy("h", "key").limit(SAMPLE * RANGES).collect()  # as many at most
    found = sorted((r["key"] for r in some), key=str.encode)
    several = len(found) == SAMPLE * RANGES  # fewer keys than that are one range
    bounds = sorted({found[SAMPLE * k] for k in range(1, RANGES)}, key=str.encode) if several else []
    placed = keys.withColumn("range", _range_of(F.col("key"), bounds))
    held = placed.groupBy("segment_id", "range").agg(F.count("*").alias("held"))
    ranges = Window.partitionBy("segment_id")
    starts = held.select("segment_id", "range", (F.sum("held").over(ranges.orderBy("range")) - F.col("held")).alias("before"), F.sum("held").over(ranges).alias("n"))
    rows = placed.withColumn("rn", F.row_number().over(Window.partitionBy("segment_id", "range").orderBy("key")))
    rows = rows.join(starts, ["segment_id", "range"]).withColumn("rn", F.col("rn") + F.col("before"))
    first = (F.col("rn") - 1) % every == 0
    return rows.where(first | (F.col("rn") == F.col("n"))).select("segment_id", "key", F.col("rn").cast("long").alias("position"))


def sparse_floor(index: DataFrame, probes: list[str]) -> DataFrame:
    """For each segment and probe the greatest indexed key not above it, or the segment's first."""
    floors = [F.struct(F.lit(p).alias("probe"), F.coalesce(F.max(F.when(F.col("key") <= p, F.col("key"))), F.min("key")).alias("floor_key")) for p in probes]
    return index.groupBy("segment_id").agg(F.array(*floors).alias("floors")).select("segment_id", F.explode("floors").alias("x")).select("segment_id", "x.probe", "x.floor_key")


def totals(segments: DataFrame, size: Column) -> DataFrame:
    """One row: segments, records, removals and bytes of values."""
    return segments.agg(F.countDistinct("segment_id").alias("segments"), F.count("*").alias("records_with_deleted"), F.sum(F.col("is_deleted").cast("long")).alias("deleted_records"), F.sum(size).alias("value_bytes"))
