"""Column helpers: NaN to NULL, safe correlations, average ranks, ids, hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut

#: Standard deviations at or below this count as constant; anchors closer than this as collapsed.
EPS = 1e-12


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def r6(x: Column) -> Column:
    """Rounded for comparison with other engines; negative zero becomes zero."""
    return F.round(x, 6) + F.lit(0.0)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation over complete pairs; NULL if either side is constant."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.stddev_pop(a) > EPS) & (F.stddev_pop(b) > EPS), F.covar_pop(a, b) / spread)


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks with ties averaged inside each group (groups of bounded size: trajectories, scenarios, models)."""
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) + (ties - 1) / 2.0))


def spearman(df: DataFrame, x: str, y: str, by: list[str], name: str) -> DataFrame:
    """One row for each group: Pearson correlation of average ranks over complete pairs."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(pairs, x, by, "_rx"), y, by, "_ry")
    return ranked.groupBy(*by).agg(safe_corr("_rx", "_ry").alias(name))


def global_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average ranks over a whole table without one task holding it: ranks are computed on the distinct values, whose
    cumulative counts come from range partitions' totals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    parts = cut(counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id()))  # written, so that both reads see the same ranges
    totals = parts.groupBy("_p").agg(F.sum("_n").alias("_t"))  # one row for each partition
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    own = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = parts.join(F.broadcast(before), "_p").select(value, (F.col("_before") + own + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, value, "left")


def hex8(x: Column) -> Column:
    """The first 32 bits of a text's MD5 as a number: a draw that any engine can repeat."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint")


def stable_id(prefix: str, *parts: Column, bits: int = 256, length: int = 20) -> Column:
    """prefix_ and the first hex digits of SHA-256 (or SHA-1 for 160 bits) of the parts joined by two colons."""
    joined = F.concat_ws("::", *[p.cast("string") for p in parts])
    digest = F.sha1(joined) if bits == 160 else F.sha2(joined, bits)
    return F.concat(F.lit(prefix + "_"), F.substring(digest, 1, length)) if prefix else F.substring(digest, 1, length)


def ratio_key(alpha: Column) -> Column:
    return F.round(alpha, 10)
