"""Anchor protocols side by side: samples, trajectories, model summaries, comparisons with the self-anchored protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisgauge.functions.numeric import average_rank, spearman
from axisgauge.operators import geometry, statistics

SCENARIO = ["scenario_id", "style_axis", "model_id", "encoder_id", "protocol"]
METRICS = ["ice", "drift", "distance", "oor", "mean_rank"]
SELF = "self"


def samples(points: DataFrame, anchors: dict[str, tuple[DataFrame, list[str]]], complete: int = 7) -> DataFrame:
    """Geometry of every point under each protocol's anchors (name -> anchors, their keys), with neighbour ranks where a
    trajectory is complete. A protocol has rows only where it has anchors."""
    out = None
    for name, (pairs, by) in anchors.items():
        part = geometry.with_geometry(points, pairs, by).withColumn("protocol", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return geometry.with_neighbour_rank(out, [*geometry.TRAJECTORY, "protocol"], complete)


def trajectories(rows: DataFrame, complete: int = 7) -> DataFrame:
    """One row for each trajectory and protocol: interior means, separation, collapse, and how much of it there is."""
    inner = F.col("is_interior")
    only = lambda c: F.avg(F.when(inner, F.col(c).cast("double")))
    return rows.groupBy(*geometry.TRAJECTORY, "protocol").agg(
        only("projection_error_raw").alias("ice"), only("off_axis_drift_normalized").alias("drift"), only("interpolation_distance_normalized").alias("distance"),
        F.avg(F.when(inner & F.col("projection_raw").isNotNull(), F.col("out_of_range").cast("double"))).alias("oor"), only("nearest_neighbor_rank").alias("mean_rank"),
        F.avg("separation").alias("separation"), F.bool_or("endpoint_unstable").alias("unstable"), (F.count(F.lit(1)) == complete).alias("complete"), F.count_if(inner & F.col("projection_raw").isNotNull()).alias("valid_points"),
    )


def epsilon_table(rows: DataFrame) -> DataFrame:
    """By protocol and model: outputs, collapsed ones, interior error, and how far the guarded division is from the exact one."""
    exact = F.when(F.col("separation") > 1e-12, F.col("off_axis") / F.when(F.col("separation") > 1e-12, F.col("separation")))
    return rows.groupBy("protocol", "model_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("endpoint_unstable").alias("collapsed"), F.avg(F.when(F.col("is_interior"), F.col("projection_error_raw"))).alias("ice"), F.max(F.abs(exact - F.col("off_axis_drift_normalized"))).alias("epsilon_difference"))


def scenario_rows(paths: DataFrame) -> DataFrame:
    return paths.groupBy(*SCENARIO).agg(
        *[F.avg(m).alias(m) for m in METRICS], F.avg("separation").alias("separation"), F.bool_or("unstable").alias("unstable"), F.count(F.lit(1)).alias("trajectories"),
        F.count_if("complete").alias("complete_trajectories"), F.sum("valid_points").alias("valid_points"),
    )


def model_summary(scenarios: DataFrame, replicates: int = statistics.REPLICATES) -> DataFrame:
    """By encoder, protocol, model and metric: mean with interval, denominators, and the model's average rank by error."""
    by = ["encoder_id", "protocol", "model_id"]
    size = scenarios.groupBy(*by).agg(
        F.countDistinct("scenario_id").alias("scenarios"), F.sum("trajectories").alias("trajectories"), F.sum("complete_trajectories").alias("complete_trajectories"),
        F.sum("valid_points").alias("valid_points"), (F.sum("trajectories") * 5).alias("expected_points"), F.count_if("unstable").alias("collapsed"), F.round(F.avg("ice"), 12).alias("_ice"),
    )
    ranked = average_rank(size, "_ice", by[:2], "ice_rank").drop("_ice")
    return statistics.bootstrap_means(scenarios, by, [*METRICS, "separation"], "style_axis", "scenario_id", replicates).join(ranked, by)


def against_self(scenarios: DataFrame, others: list[str], confirmatory: Column, metrics: list[str] = METRICS, replicates: int = statistics.REPLICATES, permutations: int = statistics.PERMUTATIONS) -> DataFrame:
    """Protocol minus self on each scenario that has both, by encoder, model, metric and protocol: mean with interval,
    effect size, and, where `confirmatory` (a condition on these columns) holds, a permutation p with Holm's adjustment."""
    keys, by = ["scenario_id", "style_axis", "model_id", "encoder_id"], ["encoder_id", "model_id", "metric", "protocol"]
    long = scenarios.unpivot([*keys, "protocol"], metrics, "metric", "value")
    own = long.where(F.col("protocol") == SELF).select(*keys, "metric", F.col("value").alias("own"))
    d = long.where(F.col("protocol").isin(others)).join(own, [*keys, "metric"]).withColumn("difference", F.col("value") - F.col("own")).where("difference is not null")
    sd = d.groupBy(*by).agg(F.stddev_samp("difference").alias("_sd"))
    out = _named(d, by, replicates)
    p = statistics.sign_flip(d.where(confirmatory), by, "scenario_id", "difference", permutations).drop("mean")
    out = out.join(sd, by).join(p, by, "left").withColumn("dz", F.when(F.col("_sd") > 0, F.col("estimate") / F.col("_sd"))).drop("_sd")
    return statistics.holm(out, [])


def _named(d: DataFrame, by: list[str], replicates: int) -> DataFrame:
    """Bootstrap rows where `metric` is a key of its own."""
    renamed = ["_metric" if c == "metric" else c for c in by]
    found = statistics.bootstrap_means(d.withColumnRenamed("metric", "_metric"), renamed, ["difference"], "style_axis", "scenario_id", replicates)
    return found.drop("metric").withColumnRenamed("_metric", "metric")


def rank_sensitivity(summary: DataFrame, others: list[str]) -> DataFrame:
    """By encoder and protocol: rank agreement of the models' mean errors with those of the self-anchored protocol, null
    with fewer than three models, and ranking flips. summary: encoder_id, protocol, model_id, ice."""
    own = summary.where(F.col("protocol") == SELF).select("encoder_id", "model_id", F.col("ice").alias("x"))
    both = summary.where(F.col("protocol").isin(others)).select("encoder_id", "protocol", "model_id", F.col("ice").alias("y")).join(own, ["encoder_id", "model_id"]).where("x is not null and y is not null")
    by = ["encoder_id", "protocol"]
    n = both.groupBy(*by).agg(F.count(F.lit(1)).alias("models"))
    out = n.join(spearman(both, "x", "y", by, "spearman"), by).join(statistics.rank_agreement(both, by, "model_id", "x", "y"), by, "left")
    few = F.col("models") < 3
    return out.withColumn("spearman", F.when(~few, F.col("spearman"))).withColumn("kendall", F.when(~few, F.col("kendall")))


def content_pass_subset(external: DataFrame, quality: DataFrame, replicates: int = statistics.REPLICATES) -> DataFrame:
    """Mean error with interval over all scenarios with external anchors, and over those whose references both pass."""
    j = external.join(quality.select("scenario_id", "both_content_pass"), "scenario_id", "left")
    sets = F.array_compact(F.array(F.lit("all_pairs"), F.when(F.coalesce("both_content_pass", F.lit(False)), F.lit("both_pass"))))
    found = statistics.bootstrap_means(j.withColumn("subset", F.explode(sets)), ["encoder_id", "model_id", "subset"], ["ice"], "style_axis", "scenario_id", replicates).drop("metric")
    return found.join(j.groupBy("encoder_id", "model_id").agg(F.countDistinct("scenario_id").alias("denominator")), ["encoder_id", "model_id"])


def cross_family(scenarios: DataFrame, judged: DataFrame, metrics: list[str], replicates: int = statistics.REPLICATES) -> DataFrame:
    """Geometry beside judge scenario means, by model and protocol, each metric with its interval."""
    j = scenarios.join(judged, ["scenario_id", "style_axis", "model_id"], "left")
    found = statistics.bootstrap_means(j, ["model_id", "protocol"], metrics, "style_axis", "scenario_id", replicates)
    return found.join(j.groupBy("model_id", "protocol").agg(F.countDistinct("scenario_id").alias("denominator")), ["model_id", "protocol"])


def reference_pairs(references: DataFrame, low: int, high: int) -> DataFrame:
    """One row for each scenario from its references at endpoints A and B (length, passed, intensity): lengths in bounds,
    passes, span of the judged intensity, and whether both were screened. A scenario that lacks an endpoint has nulls there."""
    at = lambda e, c: F.max(F.when(F.col("endpoint") == e, F.col(c)))
    wide = references.groupBy("scenario_id").agg(*[at(e, c).alias(f"{c}_{e.lower()}") for c in ("length", "passed", "intensity") for e in ("A", "B")])
    fits = lambda e: F.coalesce(F.col(f"length_{e}").between(low, high), F.lit(False))
    passes = lambda e: F.coalesce(F.col(f"passed_{e}"), F.lit(False))
    return wide.select(
        "*", (F.col("intensity_b") - F.col("intensity_a")).alias("style_span"), (passes("a") & passes("b")).alias("both_content_pass"), (fits("a") & fits("b")).alias("both_length_pass"),
        (F.col("intensity_a").isNotNull() & F.col("intensity_b").isNotNull()).alias("both_screened"),
    )


def reference_summary(references: DataFrame, pairs: DataFrame, low: int, high: int) -> DataFrame:
    """One row of counts and rates over the references and their pairs."""
    one = references.agg(F.count(F.lit(1)).alias("texts"), F.count("intensity").alias("judged"), F.count_if(F.col("intensity").isNull()).alias("unjudged"), F.avg(F.col("length").between(low, high).cast("double")).alias("length_pass_rate"), F.avg(F.col("passed").cast("double")).alias("content_pass_rate"))
    two = pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("both_length_pass").alias("both_length_pass"), F.count_if("both_content_pass").alias("both_content_pass"), F.count_if("both_screened").alias("both_screened"),
        F.avg("style_span").alias("span_mean"), F.percentile("style_span", F.lit(0.5)).alias("span_median"), F.count_if(F.col("style_span") <= 0).alias("nonpositive_spans"),
    )
    return one.crossJoin(F.broadcast(two))  # one row each
