"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its token share to an exponent, normalised.  The exponent
is the largest of 0 to 1 at which the weights' entropy reaches ``ENTROPY`` of
the evenly spread one and no source of weight is repeated more than
``REPEATS`` times; if the two conflict, the repetition limit wins.  Both limits
are monotone in the exponent, so it is found by bisection, four bits a job:
each job sums fifteen exponents' powers over the table of sources, which never
leaves the executors.

The budget (``EPOCHS`` times all tokens) times a weight is a source's quota.  It
is realised in epochs.  A source's documents are hashed into blocks; each
epoch is a permutation of the blocks, drawn by a hash of source, epoch and
block.  All epochs but the last are whole; the last takes blocks in order until
the quota is met, and of the block that would exceed it the documents in hash
order that still fit.  A source has at most ``BLOCKS`` blocks, so running sums
never gather a source's documents in one task, but for one block's narrow rows.

Defined cases: tokens are words (runs of characters other than space and
0x09-0x0D); a null text has none; a null source is the empty one; documents
without tokens are in every epoch that holds their block; a source without any
token has no weight and gives no row; rows of the same hash (such as repeated
rows) are taken or left together; with one source its weight is one; an empty
table gives an empty result; other columns pass through, and working columns
start with ``__sq_`` and are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.llm._store import Scope, kept

ENTROPY, REPEATS, EPOCHS = 0.98, 4.0, 1.0
BLOCK_TOKENS, BLOCKS = 1 << 16, 4096
ROUNDS, STEPS = 6, 16
SEED = 17


def tokens_of(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _measures(sources: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy and largest repetition (for a budget of all tokens) at each exponent."""
    share = F.col("tokens") / F.lit(float(total))
    power = lambda a: F.pow(share, F.lit(a))
    row = sources.agg(*(x for k, a in enumerate(exponents) for x in (F.sum(power(a)).alias(f"z{k}"), F.sum(power(a) * F.log(share)).alias(f"s{k}"), F.max(F.pow(share, F.lit(a - 1.0))).alias(f"r{k}")))).first()
    return [(math.log(row[f"z{k}"]) - a * row[f"s{k}"] / row[f"z{k}"], row[f"r{k}"] / row[f"z{k}"]) for k, a in enumerate(exponents)]


def exponent(sources: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> tuple[float, float]:
    """The exponent, and the sum of all powers of shares. ``sources`` has tokens, all above 0."""
    whole = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total, n = whole["t"], whole["n"]
    scale = (total if budget is None else budget) / total
    goal = entropy * math.log(n) - 1e-12

    def bisect(low: float, high: float, left) -> tuple[float, float]:
        """Narrows the range down to where ``left`` turns from true to false."""
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / STEPS for k in range(1, STEPS)]
            k = sum(map(left, _measures(sources, total, grid)))
            low, high = ([low, *grid][k], [*grid, high][k])
        return low, high

    if _measures(sources, total, [1.0])[0][0] >= goal:
        spread = 1.0
    else:
        spread, _ = bisect(0.0, 1.0, lambda m: m[0] >= goal)
    if _measures(sources, total, [spread])[0][1] * scale > repeats:
        # repetition falls as the exponent rises
        _, spread = bisect(spread, 1.0, lambda m: m[1] * scale > repeats)
    return spread, sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(spread)))).first()[0]


def plan(docs: DataFrame, epochs: float = EPOCHS, entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = SEED) -> tuple[DataFrame, str]:
    """For each source and block the epochs that hold it: __sq_source, __sq_blocks, __sq_block, epoch, place, progress, weight, and __sq_cut (null, or the last hash taken); and its folder.

    ``docs`` has __sq_source, __sq_tokens and __sq_hash."""
    spark = docs.sparkSession
    narrow, _ = kept(docs.select("__sq_source", "__sq_tokens", "__sq_hash"), "mix-rows")
    sources, _ = kept(narrow.groupBy("__sq_source").agg(F.sum("__sq_tokens").alias("tokens")).where("tokens > 0"), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    schema = "__sq_source string, __sq_blocks long, __sq_block long, epoch long, place long, progress double, weight double, __sq_cut long"
    if not total:
        return kept(spark.createDataFrame([], schema), "mix-plan")
    wanted = int(total * epochs)
    power, norm = exponent(sources, wanted, entropy, repeats)
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(power)) / F.lit(norm)
    quotas = sources.select("__sq_source", "tokens", weight.alias("weight"), F.floor(weight * wanted + 1e-6).alias("quota"), F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS))).cast("long").alias("__sq_blocks"))
    quotas, _ = kept(quotas.withColumn("whole", F.floor(F.col("quota") / F.col("tokens"))).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens")), "mix-quotas")

    placed = narrow.join(quotas, "__sq_source").withColumn("__sq_block", F.pmod("__sq_hash", F.col("__sq_blocks")))
    blocks, _ = kept(placed.groupBy("__sq_source", "__sq_blocks", "__sq_block", "weight", "whole", "rest").agg(F.sum("__sq_tokens").alias("tokens")), "mix-blocks")
    drawn = lambda epoch: F.xxhash64(F.lit(seed), "__sq_source", epoch, "__sq_block")
    order = Window.partitionBy("__sq_source", "epoch").orderBy("draw", "__sq_block")
    held = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("epoch")).withColumn("draw", drawn(F.col("epoch")))
    held = held.withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    last = F.col("epoch") == F.col("whole")
    held = held.where(~last | (F.col("before") < F.col("rest")))
    edge = last & (F.col("before") + F.col("tokens") > F.col("rest"))
    held, _ = kept(held.withColumn("edge", edge), "mix-epochs")
    # in the block that the quota ends in, the last hash whose documents still fit
    inside = Window.partitionBy("__sq_source").orderBy("__sq_hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = held.where("edge").select("__sq_source", "__sq_block", (F.col("rest") - F.col("before")).alias("room"))
    near = placed.select("__sq_source", "__sq_block", "__sq_hash", "__sq_tokens").join(ends, ["__sq_source", "__sq_block"]).withColumn("sum", F.sum("__sq_tokens").over(inside))
    cuts, _ = kept(near.where("sum <= room").groupBy("__sq_source", "__sq_block").agg(F.max("__sq_hash").alias("cut")), "mix-cuts")
    out = held.join(cuts, ["__sq_source", "__sq_block"], "left").where("not edge or cut is not null")
    # how far the source is through its quota at the middle of a block, so that sources advance together
    through = Window.partitionBy("__sq_source").orderBy("epoch", "place")
    progress = (F.row_number().over(through) - 0.5) / F.count("*").over(Window.partitionBy("__sq_source"))
    out = out.select("__sq_source", "__sq_blocks", "__sq_block", "epoch", "place", progress.alias("progress"), "weight", F.when(F.col("edge"), F.col("cut")).alias("__sq_cut"))
    return kept(out, "mix-plan")


def mixed(docs: DataFrame, key: str = "doc_id", **limits) -> DataFrame:
    """``docs`` once for each time that the mixture holds it, with __sq_tokens, __sq_hash, and epoch, place, progress and weight as __sq_epoch and so on."""
    marked = docs.withColumn("__sq_source", _source()).withColumn("__sq_tokens", tokens_of(F.col("text"))).withColumn("__sq_hash", F.xxhash64(F.lit(SEED), F.col(key), "__sq_source", "__sq_tokens"))
    with Scope(docs.sparkSession) as scope:
        chosen = scope.keep(plan(marked, **limits)).withColumnsRenamed({c: f"__sq_{c}" for c in ("epoch", "place", "progress", "weight")})
        sizes = scope.keep(kept(chosen.groupBy("__sq_source").agg(F.first("__sq_blocks").alias("__sq_blocks")), "mix-sizes"))
    placed = marked.join(sizes, "__sq_source").withColumn("__sq_block", F.pmod("__sq_hash", F.col("__sq_blocks"))).drop("__sq_blocks")
    return placed.join(chosen.drop("__sq_blocks"), ["__sq_source", "__sq_block"]).where("__sq_cut is null or __sq_hash <= __sq_cut")


def mix_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of the mixture in its order, with the columns of ``docs``; documents of later epochs come again.

    The order is by progress through the sources' quotas, so that each source goes through its permuted blocks epoch by
    epoch, and at any point sources stand in the ratio of their weights. Partitions ascend and are sorted."""
    order = ("__sq_progress", "__sq_source", "__sq_epoch", "__sq_hash")
    return mixed(docs, **limits).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def op4_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of the mixture, for each epoch that holds it: nearly even sources, a quarter more tokens than there are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs, entropy=0.999, epochs=1.25).select("doc_id", "source", F.col("__sq_tokens").alias("n_tokens"), F.col("__sq_epoch").alias("epoch"), F.col("__sq_block").alias("block"), F.col("__sq_place").alias("place"), F.round("__sq_weight", 9).alias("weight"))


QUERIES = {"op4_source_mixture": op4_source_mixture}
ORACLE_SQL: dict[str, str] = {}
