"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = 4096


def exact_quantiles(rows: DataFrame, group: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """``group``, n, top (the greatest value), and for each name of ``wanted`` the least value with at least that share of the group's values up to it.

    Two rounds, so that no task holds a group: a histogram of at most ``CLASSES`` equal classes between a group's least
    and greatest value finds the class of each quantile; then only that class's values are counted, one row for each
    distinct value. Null values are left out; a group of nulls has n = 0 and null quantiles."""
    numbers = rows.select(F.col(group), F.col(value).cast("double").alias("v"))
    ends = numbers.groupBy(group).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("top"))
    here = F.col("r.grp").eqNullSafe(F.col("e.grp"))
    known = ends.withColumnRenamed(group, "grp")
    # a few groups or many: the sizes decide how this is joined
    placed = numbers.where("v is not null").withColumnRenamed(group, "grp").alias("r").join(known.alias("e"), here).select("r.grp", "v", "n", "low", "top")
    width = (F.col("top") - F.col("low")) / CLASSES
    placed = placed.withColumn("class", F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(CLASSES - 1))).otherwise(0).cast("int"))
    counted = placed.groupBy("grp", "class").agg(F.count("*").alias("held"), F.first("n").alias("n"))
    ranks = {name: F.ceil(F.col("n") * F.lit(q)) for name, q in wanted.items()}
    order = Window.partitionBy("grp").orderBy("class")
    counted = counted.withColumn("upto", F.sum("held").over(order))  # CLASSES rows a group at most
    holds = lambda name: (F.col("upto") >= ranks[name]) & (F.col("upto") - F.col("held") < ranks[name])
    found = [counted.where(holds(name)).select("grp", F.lit(name).alias("name"), "class", (ranks[name] - F.col("upto") + F.col("held")).alias("rank")) for name in wanted]
    classes = reduce(DataFrame.unionAll, found).alias("c")
    values = placed.alias("p").join(classes, F.col("p.grp").eqNullSafe(F.col("c.grp")) & (F.col("p.class") == F.col("c.class")))
    values = values.groupBy("c.grp", "name", "rank", "v").agg(F.count("*").alias("held"))
    values = values.withColumn("upto", F.sum("held").over(Window.partitionBy("grp", "name").orderBy("v"))).where("upto >= rank and upto - held < rank")
    picked = values.groupBy("grp").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted)).alias("q")
    out = known.alias("e").join(picked, F.col("e.grp").eqNullSafe(F.col("q.grp")), "left")
    return out.select(F.col("e.grp").alias(group), "n", *wanted, "top")
