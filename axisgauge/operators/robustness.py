"""Two-by-two robustness: joined samples, cells, condition means, factorial effects with intervals, matched effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisgauge.functions.numeric import spearman
from axisgauge.operators import statistics

CONDITIONS = ["p1_high", "p1_low", "p2_high", "p2_low"]
EFFECTS = ["prompt_effect", "temperature_effect", "interaction"]
KEYS = ["scenario_id", "style_axis", "model_id"]


def sample(outputs: DataFrame, judgments: DataFrame, lengths: DataFrame, key: list[str], templates: dict[str, str], low: float = 0.2) -> DataFrame:
    """Outputs joined to judgments and lengths one to one, with the levels of their prompt and temperature."""
    from axisgauge.operators.audit import checked_join

    j = checked_join(checked_join(outputs, judgments, key, "1:1"), lengths, key, "1:1")
    prompt = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    level = F.when(F.abs(F.col("temperature") - low) <= 1e-8 + 1e-5 * abs(low), "low").otherwise("high")
    j = j.withColumn("prompt_level", F.element_at(prompt, F.col("prompt_template_id"))).withColumn("temperature_level", level)
    return j.withColumn("condition", F.lower(F.concat_ws("_", "prompt_level", "temperature_level"))).withColumn("style_mae", F.abs(F.col("intensity") / 100.0 - F.col("target_ratio"))).withColumn("content_pass", F.col("passed").cast("double"))


def cells(rows: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Means over seeds and whatever `by` leaves out, and how many distinct outputs they rest on."""
    return rows.groupBy(*by).agg(F.countDistinct("run_id").alias("outputs"), *[F.avg(m).alias(m) for m in metrics])


def effects(rows: DataFrame, keys: list[str], metrics: list[str], expected: int | None = None) -> DataFrame:
    """keys, metric, prompt_effect, temperature_effect, interaction of groups that have all four conditions; where a number
    of outputs is expected, whether every condition has it."""
    long = rows.unpivot([*keys, "condition", "outputs"], metrics, "metric", "value")
    wide = long.groupBy(*keys, "metric").pivot("condition", CONDITIONS).agg(F.first("value").alias("v"), F.first("outputs").alias("n"))
    wide = wide.dropna(subset=[f"{c}_v" for c in CONDITIONS])
    a, b, c, d = (F.col(f"{c}_v") for c in CONDITIONS)  # P1 high, P1 low, P2 high, P2 low
    full = F.lit(True)
    for name in CONDITIONS:
        full = full & (F.col(f"{name}_n") == F.lit(expected))
    more = [] if expected is None else [full.alias("complete")]
    return wide.select(*keys, "metric", ((c + d - a - b) / 2).alias("prompt_effect"), ((b + d - a - c) / 2).alias("temperature_effect"), ((d - c) - (b - a)).alias("interaction"), *more)


def _summary(rows: DataFrame, by: list[str], replicates: int) -> DataFrame:
    """Interval and effect size of the effects by metric and `by`; rows: one for each scenario."""
    renamed = rows.withColumnRenamed("metric", "_m")
    found = statistics.bootstrap_means(renamed, [*by, "_m"], EFFECTS, "style_axis", "scenario_id", replicates).withColumnRenamed("metric", "effect").withColumnRenamed("_m", "metric")
    sd = rows.groupBy(*by, "metric").agg(*[F.stddev_samp(e).alias(e) for e in EFFECTS]).unpivot([*by, "metric"], EFFECTS, "effect", "_sd")
    return found.join(sd, [*by, "metric", "effect"]).withColumn("dz", F.when(F.col("_sd") > 0, F.col("estimate") / F.col("_sd"))).drop("_sd")


def factorial_summary(rows: DataFrame, metrics: list[str], replicates: int = statistics.REPLICATES) -> DataFrame:
    """scope, style_axis, metric, effect with interval and effect size over scenarios: all models (their mean in each
    scenario), each model, and each model and axis. rows: cells by scenario, model, ratio and condition."""
    each = effects(rows, [*KEYS, "target_ratio"], metrics).groupBy(*KEYS, "metric").agg(*[F.avg(e).alias(e) for e in EFFECTS])
    every = each.groupBy("scenario_id", "style_axis", "metric").agg(*[F.avg(e).alias(e) for e in EFFECTS]).withColumn("scope", F.lit("all_models"))
    by_model = each.withColumnRenamed("model_id", "scope")
    sets = every.unionByName(by_model).withColumn("axis", F.lit("all")).unionByName(by_model.withColumn("axis", F.col("style_axis")))
    return _summary(sets, ["scope", "axis"], replicates).withColumnRenamed("axis", "style_axis")


def condition_ranks(rows: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """Means by model and condition; and for each metric and pair of conditions the rank correlation over models. Means
    that are equal to twelve decimals tie, so ranks don't hang on the order in which rows were added up."""
    means = rows.groupBy("model_id", "condition").agg(*[F.avg(m).alias(m) for m in metrics])
    long = means.unpivot(["model_id", "condition"], metrics, "metric", "value").withColumn("value", F.round("value", 12))
    a, b = long.select("metric", "model_id", F.col("condition").alias("first"), F.col("value").alias("x")), long.select("metric", "model_id", F.col("condition").alias("second"), F.col("value").alias("y"))
    both, by = a.join(b, ["metric", "model_id"]).where("first < second"), ["metric", "first", "second"]
    return means, both.groupBy(*by).agg(F.count(F.lit(1)).alias("models")).join(spearman(both, "x", "y", by, "spearman"), by, "left")


def with_source_scores(geometry: DataFrame, mapping: DataFrame, scores: DataFrame) -> DataFrame:
    """Samples with the last scores of the run whose judgment they reuse: the source run where there is one, else their
    own. scores: source_run_id, input_ord and values."""
    from axisgauge.operators.judges import keep_last

    source = mapping.select("run_id", F.coalesce("source_run_id", "run_id").alias("_source"))
    last = keep_last(scores, ["source_run_id"], "input_ord").drop("input_ord").withColumnRenamed("source_run_id", "_source")
    return geometry.join(source, "run_id", "left").join(last, "_source", "left").drop("_source")


def condition_means(rows: DataFrame, metrics: list[str], replicates: int = statistics.REPLICATES) -> DataFrame:
    """By condition, metric and model, with intervals; `ALL` averages a scenario's models first, whichever it has."""
    every = rows.groupBy("scenario_id", "style_axis", "condition").agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("model_id", F.lit("ALL"))
    return statistics.bootstrap_means(rows.select(*every.columns).unionByName(every), ["condition", "model_id"], metrics, "style_axis", "scenario_id", replicates)


def effect_summary(matched: DataFrame, confirmatory: list[str], replicates: int = statistics.REPLICATES, permutations: int = statistics.PERMUTATIONS) -> DataFrame:
    """model_id, style_axis, metric, effect with interval: each model, each model and axis, and `ALL`, the equally weighted
    mean over models of scenarios that have them all. ALL's effects on confirmatory metrics get a permutation p, with
    Holm's adjustment inside each metric. complete: scenarios whose conditions all have the expected outputs."""
    models = matched.select("model_id").distinct().agg(F.count(F.lit(1)).alias("_k"))  # one row
    equal = matched.groupBy("scenario_id", "style_axis", "metric").agg(*[F.avg(e).alias(e) for e in EFFECTS], F.count(F.lit(1)).alias("_n"), F.bool_and("complete").alias("complete"))
    equal = equal.crossJoin(F.broadcast(models)).where("_n = _k").drop("_n", "_k").withColumn("model_id", F.lit("ALL"))
    sets = matched.unionByName(equal)
    sets = sets.withColumn("axis", F.lit("ALL")).unionByName(sets.withColumn("axis", F.col("style_axis")))
    by = ["model_id", "axis", "metric"]
    done = sets.groupBy(*by).agg(F.count_if("complete").alias("complete_scenarios"))
    out = _summary(sets, ["model_id", "axis"], replicates).join(done, by)
    long = equal.where(F.col("metric").isin(confirmatory)).unpivot(["scenario_id", "metric"], EFFECTS, "effect", "value")
    p = statistics.sign_flip(long, ["metric", "effect"], "scenario_id", "value", permutations).drop("mean")
    p = statistics.holm(p, ["metric"]).withColumn("model_id", F.lit("ALL")).withColumn("axis", F.lit("ALL"))
    return out.join(p, [*by, "effect"], "left").withColumnRenamed("axis", "style_axis")
