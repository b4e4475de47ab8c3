"""Baselines: scenario folds, cross-validated length and isotonic fits; seed-averaged cells and scenario rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.numeric import safe_corr, spearman
from axisgauge.operators import isotonic

FOLDS, SEED = 5, 20260916


def scenario_folds(rows: DataFrame, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """scenario_id, style_axis, fold: scenarios in hash order inside their axis, dealt in turn. A scenario under two axes
    would be in two folds, so it fails the job."""
    twice = F.raise_error(F.concat(F.lit("a scenario has several axes: "), F.col("scenario_id").cast("string"))).cast("string")
    each = rows.groupBy("scenario_id").agg(F.min("style_axis").alias("_a"), F.max("style_axis").alias("_z"))
    each = each.select("scenario_id", F.when(F.col("_a") == F.col("_z"), F.col("_a")).when(F.col("_a").isNotNull(), twice).alias("style_axis"))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), "style_axis", "scenario_id"), 256)
    return each.select("scenario_id", "style_axis", F.pmod(F.row_number().over(Window.partitionBy("style_axis").orderBy(key)) - 1, F.lit(folds)).alias("fold"))


def length_coordinate(rows: DataFrame, by: list[str], length: str = "character_length") -> DataFrame:
    """Endpoint-normalised length; 0.5 where both endpoints are equally long."""
    w = Window.partitionBy(*by)
    a, b = (F.max(F.when(F.col("target_ratio") == r, F.col(length))).over(w) for r in (0.0, 1.0))
    return rows.withColumn("length_coordinate", F.when(a.isNull() | b.isNull(), None).when(a == b, 0.5).otherwise((F.col(length) - a) / (b - a)))


def cross_validated_line(rows: DataFrame, by: list[str], x: str, y: str, name: str) -> DataFrame:
    """Least squares of y on x in each group, fitted without the row's own fold, from sums by fold over complete pairs. A
    constant x takes the minimum-norm fit, whose prediction at that x is the mean."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    X, Y = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    sums = rows.groupBy(*by, "fold").agg(F.count(X).alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in (("sx", X), ("sy", Y), ("sxx", X * X), ("sxy", X * Y))])
    w = Window.partitionBy(*by)
    n, sx, sy, sxx, sxy = (F.sum(c).over(w) - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    fit = sums.select(*by, "fold", n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"))
    spread = F.expr("sxx - sx * sx / n")
    flat = spread <= 1e-12 * F.greatest(F.col("sxx"), F.lit(1.0))
    c, m = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    slope = F.when(flat, m * c / (1 + c * c)).otherwise(F.expr("sxy - sx * sy / n") / F.when(~flat, spread))
    fit = fit.where("n > 0").select(*by, "fold", slope.alias("_s"), F.when(flat, m / (1 + c * c)).otherwise(m - slope * c).alias("_i"))
    return rows.join(fit, [*by, "fold"], "left").withColumn(name, F.col("_i") + F.col("_s") * F.col(x)).drop("_s", "_i")


def cross_validated_isotonic(rows: DataFrame, by: list[str], x: str, y: str, name: str) -> DataFrame:
    """Non-decreasing fit of y on x without the row's own fold, interpolated in between and held at the ends; null without
    x, fold or other folds. Rows are reduced to the distinct x of a group and fold, which are fitted over range partitions."""
    points = isotonic.folded_points(rows, by, x, y)
    return rows.join(isotonic.fitted(points, [*by, "fold"], x, name), [*by, "fold", x], "left")


CELL_KEYS = ["scenario_id", "style_axis", "model_id", "encoder_id"]


def seed_cells(samples: DataFrame, metrics: list[str], keys: list[str] = CELL_KEYS) -> DataFrame:
    """Means over seeds; the square of the interpolation distance is averaged before any root."""
    square = [F.avg(F.col("interpolation_distance_normalized") ** 2).alias("interpolation_distance_squared")] if "interpolation_distance_normalized" in metrics else []
    return samples.groupBy(*keys, "target_ratio").agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics], *square).withColumn("is_interior", (F.col("target_ratio") > 0) & (F.col("target_ratio") < 1))


def scenario_rows(cells: DataFrame, keys: list[str] = CELL_KEYS) -> DataFrame:
    inner = cells.where("is_interior")
    rows = inner.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("interior_point_count"), F.avg("projection_error_raw").alias("interior_calibration_error"),
        F.percentile("projection_error_raw", F.lit(0.5)).alias("median_absolute_error"), F.avg("off_axis_drift_normalized").alias("normalized_off_axis_drift"),
        F.sqrt(F.avg("interpolation_distance_squared")).alias("interpolation_distance_rms"), F.avg("out_of_range").alias("out_of_range_rate"),
        F.avg("nearest_neighbor_rank").alias("nearest_neighbor_mean_rank"), safe_corr("target_ratio", "projection_raw").alias("pearson_correlation"),
        F.regr_slope("projection_raw", "target_ratio").alias("calibration_slope"), F.regr_intercept("projection_raw", "target_ratio").alias("calibration_intercept"),
        F.avg(F.abs(F.lit(0.5) - F.col("target_ratio"))).alias("constant_half_mae"), F.avg(F.abs(F.col("distance_ratio_estimate") - F.col("target_ratio"))).alias("endpoint_distance_ratio_mae"),
    )
    all_points = cells.groupBy(*keys).agg(F.avg("separation").alias("endpoint_separation"))
    return rows.join(spearman(inner, "target_ratio", "projection_raw", keys, "spearman_monotonicity"), keys, "left").join(all_points, keys)


STATISTICS = ["mae", "median_error", "spearman", "pearson", "slope", "intercept"]


def method_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, target_ratio, estimate, absolute_error): one row for each scenario and method with its six statistics;
    correlations are null where the estimates are constant."""
    rows = cells.groupBy(*keys).agg(
        F.avg("absolute_error").alias("mae"), F.percentile("absolute_error", F.lit(0.5)).alias("median_error"), safe_corr("target_ratio", "estimate").alias("pearson"),
        F.regr_slope("estimate", "target_ratio").alias("slope"), F.regr_intercept("estimate", "target_ratio").alias("intercept"), F.stddev_pop("estimate").alias("_sd"),
    )
    rho = spearman(cells, "target_ratio", "estimate", keys, "spearman")
    return rows.join(rho, keys, "left").withColumn("spearman", F.when(F.col("_sd") > 1e-12, F.col("spearman"))).drop("_sd")


def method_table(samples: DataFrame, estimates: dict[str, str], judged: DataFrame | None = None, replicates: int = 10_000) -> DataFrame:
    """By model, encoder, method and statistic: mean over scenarios with its stratified interval. samples: interior rows with a
    column for each estimate, fitted on them before seeds are averaged; estimate and error are averaged over seeds apart.
    judged (scenario_id, style_axis, model_id, target_ratio, estimate) adds a judge's own estimates as encoder 'judge'."""
    from axisgauge.operators.statistics import bootstrap_means

    keys = [*CELL_KEYS, "method"]
    pick = F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).cast("double").alias("estimate")) for n, c in estimates.items()])
    long = samples.select(*CELL_KEYS, "target_ratio", F.inline(pick))
    if judged is not None:
        long = long.unionByName(judged.select("scenario_id", "style_axis", "model_id", F.lit("judge").alias("encoder_id"), "target_ratio", F.lit("llm_scalar_judge").alias("method"), F.col("estimate").cast("double").alias("estimate")))
    cells = long.groupBy(*keys, "target_ratio").agg(F.avg("estimate").alias("estimate"), F.avg(F.abs(F.col("estimate") - F.col("target_ratio"))).alias("absolute_error"))
    cells = cells.withColumn("estimate", F.round("estimate", 12))  # equal but for rounding: ties in ranks
    return bootstrap_means(method_rows(cells, keys), ["model_id", "encoder_id", "method"], STATISTICS, "style_axis", "scenario_id", replicates)
