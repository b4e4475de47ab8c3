"""Aggregations above the scenario rows: ablations, curves, attraction, smoothness, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.functions.quantiles import aggregated


def curve(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, its standard error, and the mean with 1.96 errors on both sides."""
    mean, sem = F.avg(value), F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(*by).agg(mean.alias("mean"), sem.alias("sem"), (mean - 1.96 * sem).alias("lower"), (mean + 1.96 * sem).alias("upper"))


def wide_summary(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Bootstrap rows as columns {metric}_{estimate, ci_lower, ci_upper}."""
    return rows.groupBy(*by).pivot("metric", metrics).agg(*[F.first(c).alias(c) for c in ("estimate", "ci_lower", "ci_upper")])


def endpoint_inclusion(samples: DataFrame, by: list[str]) -> DataFrame:
    inner = F.avg(F.when(F.col("is_interior"), F.col("projection_error_raw")))
    every = F.avg("projection_error_raw")
    return samples.groupBy(*by).agg(every.alias("all_points"), inner.alias("interior"), F.avg("projection_error_clipped").alias("all_clipped"), (1 - every / F.nullif(inner, F.lit(0.0))).alias("underestimate"))


def low_separation(rows: DataFrame, encoder: str, separation: str) -> DataFrame:
    """All rows, and those strictly above their encoder's 10th and 20th percentile of separation, named in `cut`."""
    rows = cut(rows)
    cuts = aggregated(rows, [encoder], [F.count(F.lit(1)).alias("_n")], {"p10": (separation, 0.1), "p20": (separation, 0.2)}).drop("_n")
    tagged = rows.join(F.broadcast(cuts), encoder)  # a row for each encoder
    keep = F.array(F.lit("full"), F.when(F.col(separation) > F.col("p10"), "p10"), F.when(F.col(separation) > F.col("p20"), "p20"))
    return tagged.select("*", F.explode(F.array_compact(keep)).alias("cut")).drop("p10", "p20")


def drop_one(rows: DataFrame, key: str) -> DataFrame:
    """The rows once for each value of key that they don't have, named in `excluded`."""
    values = rows.select(F.col(key).alias("excluded")).distinct()
    return rows.join(F.broadcast(values), F.col(key) != F.col("excluded"))  # a row for each axis


def smoothness(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Mean absolute second difference of the means by x; null with fewer than three."""
    w = Window.partitionBy(*by).orderBy(x)
    means = rows.groupBy(*by, x).agg(F.avg(y).alias("m"))
    return means.select(*by, F.abs(F.col("m") - 2 * F.lag("m").over(w) + F.lag("m", 2).over(w)).alias("z")).groupBy(*by).agg(F.avg("z").alias("smoothness"))


def attraction(rows: DataFrame, by: list[str], measured: str, ratios: list[float] | Column, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Share of rows near either end among those at the given ratios (a list, or a condition)."""
    at_end = ((F.col(measured) < low) | (F.col(measured) > high)).cast("double")
    middle = ratios if isinstance(ratios, Column) else F.round("target_ratio", 10).isin([round(r, 10) for r in ratios])
    return rows.where(middle).groupBy(*by).agg(F.avg(at_end).alias("attraction"))


def projection_groups(rows: DataFrame) -> DataFrame:
    """Overall, by model, and by model and axis in one pass."""
    sets = rows.groupingSets([[], ["model_id"], ["model_id", "style_axis"]], "model_id", "style_axis").agg(
        F.count(F.lit(1)).alias("n"), F.avg("projection_error_clipped").alias("mae"), F.avg(F.col("projection_clipped") - F.col("target_ratio")).alias("bias"), F.avg(F.col("out_of_range").cast("double")).alias("oor")
    )
    return sets.select(F.coalesce("model_id", F.lit("ALL")).alias("model_id"), F.coalesce("style_axis", F.lit("ALL")).alias("style_axis"), "n", "mae", "bias", "oor")


def shoot_rates(rows: DataFrame, by: list[str], margin: float = 0.15) -> DataFrame:
    a, p = F.col("target_ratio"), F.col("projection_raw")
    return rows.groupBy(*by).agg(F.avg(F.when(a < 0.5, (p > a + margin).cast("double"))).alias("overshoot"), F.avg(F.when(a > 0.5, (p < a - margin).cast("double"))).alias("undershoot"))


def pick_by_hash(rows: DataFrame, stratum: str, unit: str, n: int, seed: str) -> DataFrame:
    """n units of each stratum, those with the smallest SHA-256 of seed, stratum and unit."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), stratum, unit), 256)
    each = rows.select(stratum, unit).distinct()
    return each.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(key))).where(F.col("_r") <= n).drop("_r")


def first_groups(rows: DataFrame, stratum: str, unit: str, n: int) -> DataFrame:
    """All rows of the first n units of each stratum by name."""
    ranked = rows.select(stratum, unit).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(unit)))
    return rows.join(ranked.where(F.col("_r") <= n), [stratum, unit], "left_semi")


def two_and_three(rows: DataFrame, chosen: list[str], value: str) -> DataFrame:
    """By model: the mean over chosen encoders and over all, of the encoders' model means; ranks by the least place, means
    equal to twelve decimals being ties."""
    means = rows.groupBy("model_id", "encoder_id").agg(F.avg(value).alias("m"))
    wide = means.groupBy("model_id").agg(F.round(F.avg(F.when(F.col("encoder_id").isin(chosen), F.col("m"))), 12).alias("two_mean"), F.round(F.avg("m"), 12).alias("three_mean"))
    place = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(c))  # noqa: E731  a row for each model
    return wide.select("*", (F.col("three_mean") - F.col("two_mean")).alias("difference"), place("two_mean").alias("two_rank"), place("three_mean").alias("three_rank"))


def compliant(rows: DataFrame, violation: str) -> DataFrame:
    """Rows without a violation under two rules, named in `rule`: unknown ones are violations (strict) or not (lenient)."""
    rules = F.array_compact(F.array(F.when(~F.coalesce(violation, F.lit(True)), "strict"), F.when(~F.coalesce(violation, F.lit(False)), "lenient")))
    return rows.select("*", F.explode(rules).alias("rule"))
