"""Exact quantiles of large groups, as order statistics of range partitions.

Equal values are counted first, and the distinct ones are dealt to range partitions, written once. A group's number of values
and the counts of its partitions say in which partition, and where in it, a quantile's two neighbours lie; only those
partitions are looked into. No task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut


def quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """_g and a column for each name in wanted: (column, q), linear between neighbours; nulls are left out. Groups without any
    value have no row. _g is `group_key(by)`."""
    columns = sorted({c for c, _ in wanted.values()})
    long = rows.select(group_key(by), F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v is not null")
    placed = cut(long.groupBy("_g", "c", "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("_g", "c", "v").withColumn("_p", F.spark_partition_id()))
    parts = placed.groupBy("_g", "c", "_p").agg(F.sum("n").alias("t"))  # as many as partitions and groups
    w = Window.partitionBy("_g", "c")
    parts = parts.withColumn("all", F.sum("t").over(w)).withColumn("before", F.coalesce(F.sum("t").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("of"), F.lit(float(q)).alias("q")) for n, (c, q) in wanted.items()])
    asked = parts.select("*", F.inline(names)).where("of = c").withColumn("h", (F.col("all") - 1) * F.col("q"))
    asked = asked.select("_g", "c", "_p", "name", "before", "t", "h", F.explode(F.array(F.floor("h"), F.floor("h") + 1)).alias("k")).withColumn("k", F.col("k") - F.col("before")).where("k >= 0 and k < t")
    inside = placed.join(asked.select("_g", "c", "_p").distinct(), ["_g", "c", "_p"], "left_semi")
    upto = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("_g", "c", "_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    found = upto.join(asked, ["_g", "c", "_p"]).where("k < upto and k >= upto - n")
    low = F.min("v")  # of the two neighbours, or the last value alone
    value = low + (F.max("v") - low) * F.max(F.col("h") - F.floor("h"))
    each = found.groupBy("_g", "name").agg(value.alias("value"))
    return each.groupBy("_g").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted])


def group_key(by: list[str]) -> Column:
    return F.to_json(F.struct(F.lit(0).alias("_"), *by)).alias("_g")


def aggregated(rows: DataFrame, by: list[str], aggregates: list[Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by, the aggregates and the quantiles, a row for each group; rows are read twice. Without `by` one row, nulls if it is
    empty."""
    base = rows.groupBy(*by).agg(*aggregates, F.count(F.lit(1)).alias("_rows")).withColumn("_g", group_key(by))
    return base.join(quantiles(rows, by, wanted), "_g", "left").drop("_g", "_rows")
