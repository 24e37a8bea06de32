"""Times the headline queries and bulk operations; prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of threads.  Every
query runs once to warm up and then twice; the smaller time counts.  Bulk
operations also give records a second, to hold against published figures.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strataq import queries as Q  # noqa: E402
from strataq.plans.query import KeyQuery  # noqa: E402
from strataq.store import Store  # noqa: E402

HEADLINE = ("kv_scan_all", "kv_range_ii", "kv_scan_limit", "kv_count_range", "kv_multi_get", "kv_memtable_flush", "kv_segment_metadata", "kv_optimize", "kv_recovery_replay", "kv_sparse_index", "kv_bloom_md5_bits", "kv_put_overwrite_orders", "kv_remove_batch_orders")


def timed(work, times: int = 2) -> float:
    work()
    best = float("inf")
    for _ in range(times):
        start = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - start)
    return round(best, 4)


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def bulk(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], dict[str, int]]:
    """Batch put, full scan, batched lookups and compaction over lineitem, with keys of 20 and distinct values of 500 bytes, for both engines."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))
    value = F.concat(*(F.sha2(F.concat(key, F.lit(str(k)), F.col("l_linenumber").cast("string")), 512) for k in range(4)))
    source = tempfile.mkdtemp(prefix="strataq-bench-")
    items.select(key.alias("key"), F.substring(value, 1, 500).cast("binary").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at")).write.mode("overwrite").parquet(source)
    keyed = spark.read.parquet(source)  # making the values is no part of a put
    n = keyed.count()
    path = tempfile.mkdtemp(prefix="strataq-bench-")
    out, rate = {}, {}

    def once(name: str, work, records: int) -> None:
        start = time.perf_counter()
        work()
        out[name] = round(time.perf_counter() - start, 4)
        rate[name] = round(records / out[name])

    try:
        store = Store(spark, path)
        store.create_database("bench")
        table = store.create_table("bench", "items")
        once("bulk_put", lambda: table.put_batch(keyed, "at"), n)
        once("bulk_put_again", lambda: table.put_batch(keyed, "at"), n)
        some = keyed.where(F.pmod(F.xxhash64("key"), F.lit(100)) < 20).select("key").distinct()
        asked = some.count()
        for phase in ("two_segments", "compacted"):
            out[f"scan_{phase}"] = timed(lambda: noop(table.scan()))
            rate[f"scan_{phase}"] = round(n / out[f"scan_{phase}"])
            out[f"multi_get_{phase}"] = timed(lambda: noop(table.multi_get(some)))
            rate[f"multi_get_{phase}"] = round(asked / out[f"multi_get_{phase}"])
            out[f"range_{phase}"] = timed(lambda: noop(table.scan(KeyQuery("000000001000", True, "000000002000", True))))
            if phase == "two_segments":
                once("compaction", table.optimize, 2 * n)
        tree = store.create_table("bench", "tree", "bplus")
        once("bplus_put", lambda: tree.put_batch(keyed, "at"), n)
        out["bplus_multi_get"] = timed(lambda: noop(tree.multi_get(some)))
        rate["bplus_multi_get"] = round(asked / out["bplus_multi_get"])
        every = keyed.select("key")
        out["bplus_multi_get_all"] = timed(lambda: noop(tree.multi_get(every)))
        rate["bplus_multi_get_all"] = round(n / out["bplus_multi_get_all"])
        singles = [(f"single{i:08d}", b"v" * 500) for i in range(20_000)]
        once("single_puts_logged", lambda: [tree.put(k, v) for k, v in singles], len(singles))
    finally:
        shutil.rmtree(path, ignore_errors=True)
        shutil.rmtree(source, ignore_errors=True)
    return out, rate


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("strataq-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(lambda name=name: noop(Q.QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    bulk_times, rates = bulk(spark, sf_dir)
    times |= bulk_times
    spark.stop()
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "records_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
