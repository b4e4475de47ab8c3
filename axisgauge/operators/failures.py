"""Failure flags of scenario trajectories, their counts, and picked cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.functions.numeric import safe_corr, spearman
from axisgauge.functions.quantiles import aggregated

KEYS = ["scenario_id", "style_axis", "model_id", "encoder_id"]
FLAGS = ["early_overshoot", "late_under_response", "non_monotonic_reversal", "near_constant_response", "out_of_range_extrapolation", "endpoint_collapse", "high_off_axis_drift", "curved_trajectory", "length_dominated_control", "content_style_entanglement"]
#: Thresholds (fixed values).
LIMITS = {"early": 0.20, "late": -0.20, "reversal": -0.10, "constant": 0.15, "collapse": 10, "drift": 90, "path": 90, "cosine": 0.80, "length": 0.80, "entangled": 0.10}


def flags(samples: DataFrame, shapes: DataFrame, lengths: DataFrame, judged: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Seed-averaged cells first; percentiles by encoder, medians by model and encoder. judged (run_id, passed): an
    interior output that fails the content check although its error is small marks its trajectory as entangled."""
    cells = samples.join(lengths, "run_id", "left").groupBy(*KEYS, "target_ratio").agg(
        F.avg("projection_raw").alias("p"), F.avg("projection_error_raw").alias("e"), F.avg("off_axis_drift_normalized").alias("d"),
        F.avg("character_length").alias("l"), F.max("out_of_range").alias("o"), F.avg("separation").alias("s"),
    )
    step = F.col("p") - F.lag("p").over(Window.partitionBy(*KEYS).orderBy("target_ratio"))
    inner = (F.col("target_ratio") > 0) & (F.col("target_ratio") < 1)
    at, miss = F.round("target_ratio", 10), F.col("p") - F.col("target_ratio")
    cells = cells.withColumn("step", step)
    mixed = samples.where("is_interior").join(judged.select("run_id", "passed"), "run_id").groupBy(*KEYS).agg(
        F.bool_or(~F.col("passed") & (F.col("projection_error_raw") < limits["entangled"])).alias("entangled")
    )
    rows = cells.groupBy(*KEYS).agg(
        F.avg(F.when(inner, F.col("e"))).alias("ice"), F.avg(F.when(inner, F.col("d"))).alias("drift"), F.avg("s").alias("separation"), safe_corr("target_ratio", "l").alias("length_correlation"),
        F.coalesce(F.bool_or(at.isin(round(1 / 6, 10), round(2 / 6, 10)) & (miss >= limits["early"])), F.lit(False)).alias("early_overshoot"),
        F.coalesce(F.bool_or(at.isin(round(4 / 6, 10), round(5 / 6, 10)) & (miss <= limits["late"])), F.lit(False)).alias("late_under_response"),
        F.coalesce(F.bool_or(F.col("step") < limits["reversal"]), F.lit(False)).alias("non_monotonic_reversal"),
        F.coalesce(F.max(F.when(inner, F.col("p"))) - F.min(F.when(inner, F.col("p"))) <= limits["constant"], F.lit(False)).alias("near_constant_response"),
        F.coalesce(F.bool_or(inner & F.col("o")), F.lit(False)).alias("out_of_range_extrapolation"),
    )
    shape = shapes.groupBy(*KEYS).agg(F.avg("path_length_ratio").alias("path"), F.avg("pc1_abs_cosine").alias("cosine"))
    rows = rows.join(shape, KEYS, "left").join(mixed, KEYS, "left")
    rows = cut(rows)
    cuts = aggregated(rows, ["encoder_id"], [F.count(F.lit(1)).alias("_n")], {f"{c}_cut": (c, limits[k] / 100) for c, k in (("separation", "collapse"), ("drift", "drift"), ("path", "path"))}).drop("_n")
    median = aggregated(rows, ["model_id", "encoder_id"], [F.count(F.lit(1)).alias("_n")], {"median": ("ice", 0.5)}).drop("_n")
    rows = rows.join(F.broadcast(cuts), "encoder_id").join(median, ["model_id", "encoder_id"])  # cuts: a row for each encoder
    no = F.lit(False)
    return rows.select(
        *KEYS, "ice", *FLAGS[:5], (F.col("separation") <= F.col("separation_cut")).alias("endpoint_collapse"), F.coalesce(F.col("drift") >= F.col("drift_cut"), no).alias("high_off_axis_drift"),
        F.coalesce((F.col("path") >= F.col("path_cut")) | (F.col("cosine") < limits["cosine"]), no).alias("curved_trajectory"),
        F.coalesce((F.abs("length_correlation") >= limits["length"]) & (F.col("ice") > F.col("median")), no).alias("length_dominated_control"),
        F.coalesce("entangled", no).alias("content_style_entanglement"),
    )


def counts(rows: DataFrame, names: list[str] = FLAGS) -> DataFrame:
    """Overall, by model, by axis and by encoder."""
    long = rows.unpivot(KEYS, names, "flag", "value")
    sets = long.groupingSets([["flag"], ["flag", "model_id"], ["flag", "style_axis"], ["flag", "encoder_id"]], "flag", "model_id", "style_axis", "encoder_id")
    return sets.agg(F.count_if("value").alias("n"), F.avg(F.col("value").cast("double")).alias("share"))


def worst_and_best(rows: DataFrame, severity: str, names: list[str] = FLAGS, k: int = 2) -> DataFrame:
    """For each flag the k worst rows that have it and the k best that don't."""
    long = rows.unpivot([*KEYS, severity], names, "flag", "value")
    order = F.when(F.col("value"), -F.col(severity)).otherwise(F.col(severity))
    return long.withColumn("nth", F.row_number().over(Window.partitionBy("flag", "value").orderBy(order, *KEYS))).where(F.col("nth") <= k)


#: Severity limits of single outputs (fixed values).
SEVERE = {"style_mae": 0.25, "nonmonotonic_spearman": 0.50, "judge_intensity_difference": 25.0, "anchor_coordinate_difference": 0.25}


def severities(rows: DataFrame, limits: dict = SEVERE) -> DataFrame:
    """run_id, category, severity: outputs under the categories that they fall in. rows: one for each output, with the
    coordinates under its own and the external anchors (own, external), the external error and range flag, two judges'
    passes, coverages and intensities (a_, b_), length and its bounds. A trajectory's rank correlation goes to its
    interior output with the largest external error; it needs all five interior outputs."""
    keys = ["scenario_id", "model_id", "seed"]
    inner = rows.where("target_ratio > 0 and target_ratio < 1 and external is not null")
    rho = spearman(inner, "target_ratio", "external", keys, "rho").join(inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min_by("run_id", F.struct(-F.col("external_error"), F.col("run_id"))).alias("run_id")), keys)
    r = rows.join(rho.select("run_id", F.when(F.col("k") == 5, F.round("rho", 12)).alias("rho")), "run_id", "left")
    c, zero = F.col, F.lit(0)
    mae = F.greatest(*[F.abs(c(f"{j}_intensity") / 100.0 - c("target_ratio")) for j in ("a", "b")])
    outside = F.greatest(zero, c("length_min") - c("length")) + F.greatest(zero, c("length") - c("length_max"))
    apart, moved = F.abs(c("a_intensity") - c("b_intensity")), F.abs(c("own") - c("external"))
    cases = {
        "content_failure": (~F.coalesce("a_passed", F.lit(True)) | ~F.coalesce("b_passed", F.lit(True)), 2 - F.coalesce("a_coverage", F.lit(1.0)) - F.coalesce("b_coverage", F.lit(1.0))),
        "style_under_or_overshoot": (mae >= limits["style_mae"], mae), "external_out_of_range": (c("external_out"), F.greatest(-c("external"), c("external") - 1)),
        "non_monotonic": (c("rho") < limits["nonmonotonic_spearman"], limits["nonmonotonic_spearman"] - c("rho")), "length_violation": (outside > 0, outside),
        "judge_disagreement": (apart >= limits["judge_intensity_difference"], apart), "anchor_disagreement": (moved >= limits["anchor_coordinate_difference"], moved),
    }
    found = F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("category"), F.lit(n).alias("_n"), size.cast("double").alias("severity"), F.lit(i).alias("place"))) for i, (n, (ok, size)) in enumerate(cases.items())])
    return r.select("run_id", F.inline(F.array_compact(found))).drop("_n")


def picked_cases(found: DataFrame, each: int = 2, total: int = 12) -> DataFrame:
    """category, run_id, severity, nth: in `each` passes over the categories in their order, the most severe output
    that no category has taken yet, `total` at most. Only each * categories candidates of a category can be reached,
    so the pick itself runs over a bounded table."""
    reach = each * 7
    w = Window.partitionBy("category").orderBy(F.desc("severity"), "run_id")
    top = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= reach)
    schema = top.select("category", "run_id", "severity", F.lit(0).alias("nth")).schema

    def pick(pdf):
        lists = [(name, g.sort_values("_r")) for (_, name), g in pdf.groupby(["place", "category"])]
        used, taken, out = set(), {}, []
        for _ in range(each):
            for name, g in lists:
                free = g[~g["run_id"].isin(used)]
                if len(out) < total and taken.get(name, 0) < each and len(free):
                    r = free.iloc[0]
                    used.add(r["run_id"])
                    taken[name] = taken.get(name, 0) + 1
                    out.append((name, r["run_id"], r["severity"], len(out) + 1))
        return pd.DataFrame(out, columns=["category", "run_id", "severity", "nth"])

    return top.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(pick, schema)  # a few rows for each category
