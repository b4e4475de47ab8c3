"""Leaf reports: judge associations and retests, anchor spans, length tables, indexes, human ratings, run windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.numeric import average_rank, global_rank, safe_corr
from axisgauge.functions.lineage import cut
from axisgauge.functions.quantiles import aggregated


def estimator_comparison(rows: DataFrame, by: list[str], errors: list[str]) -> DataFrame:
    """The error columns as methods, with their means."""
    return rows.unpivot(by, errors, "method", "error").groupBy(*by, "method").agg(F.avg("error").alias("mean_error"), F.count("error").alias("n"))


def generation_summary(rows: DataFrame, by: list[str], text: str, finish: str | None = None) -> DataFrame:
    cut = [] if finish is None else [F.count_if(F.col(finish) == "length").alias("length_finished")]
    counts = [F.countDistinct(c).alias(f"n_{c}") for c in ("scenario_id", "style_axis", "target_ratio", "seed") if c not in by]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("outputs"), *counts, F.avg(F.char_length(text)).alias("mean_length"), F.count_if(F.coalesce(F.char_length(F.trim(text)), F.lit(0)) == 0).alias("empty"), *cut)


def neighbour_table(rows: DataFrame, by: list[str]) -> DataFrame:
    r = F.col("nearest_neighbor_rank")
    return rows.groupBy(*by).agg(F.avg((r == 1).cast("double")).alias("top_1"), F.avg(r).alias("mean_rank"), F.percentile(r, F.lit(0.5)).alias("median_rank"), F.stddev_samp(r).alias("std_rank"))


def range_table(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.col("out_of_range").cast("double")).alias("rate"), F.min("projection_raw").alias("least"), F.max("projection_raw").alias("greatest"), F.avg("projection_raw").alias("mean"))


def error_by_violation(projections: DataFrame, lengths: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean errors of projection and judge, split by a length violation; unmatched rows keep a null split."""
    j = projections.join(lengths, "run_id", "left").join(scores, "run_id", "left")
    return j.groupBy(*by, "violation").agg(F.count(F.lit(1)).alias("n"), F.avg("projection_error_raw").alias("projection_error"), F.avg("judge_error").alias("judge_error"))


def trajectory_association(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman of two measures in each trajectory, null where one is constant; and how many pairs there were."""
    p = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(p, x, keys, "_rx"), y, keys, "_ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr(x, y).alias("pearson"), safe_corr("_rx", "_ry").alias("spearman"))


def retest_stability(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: matched items, MAE and Pearson of intensity, MAE of naturalness, and agreement of the pass flag."""
    j = first.select(key, F.col("intensity").alias("i1"), F.col("naturalness").alias("n1"), F.col("passed").alias("p1")).join(second.select(key, F.col("intensity").alias("i2"), F.col("naturalness").alias("n2"), F.col("passed").alias("p2")), key)
    return j.agg(F.count(F.lit(1)).alias("matched"), F.avg(F.abs(F.col("i1") - F.col("i2"))).alias("mae"), safe_corr("i1", "i2").alias("pearson"), F.avg(F.abs(F.col("n1") - F.col("n2"))).alias("naturalness_mae"), F.avg((F.col("p1") == F.col("p2")).cast("double")).alias("pass_agreement"))


def anchor_span(anchors: DataFrame, separation: str, eps: float = 1e-12) -> DataFrame:
    s = F.col(separation)
    return aggregated(cut(anchors.select(separation)), [], [F.avg(s).alias("mean"), F.count_if(s > eps).alias("computable"), F.count_if(s <= eps).alias("collapsed")], {"median": (separation, 0.5)})


def pair_spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return aggregated(cut(rows.select(*by, value)), by, [F.avg(value).alias("mean")], {f"p{q}": (value, q / 100) for q in (10, 50, 90)})


def evaluation_index(sources: dict[str, DataFrame], key: Column, text: str = "text") -> DataFrame:
    """Projections of several sources under each other, non-empty texts only, with the source's name and an item id."""
    out = None
    for name, df in sources.items():
        part = df.where(F.coalesce(F.char_length(F.trim(text)), F.lit(0)) > 0).withColumn("source_type", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("evaluation_item_id", F.substring(F.sha2(F.concat_ws("::", "source_type", key.cast("string")), 256), 1, 24))


def evaluation_sources(main: DataFrame, external: DataFrame, robustness: DataFrame, references: DataFrame, reused: str) -> dict[str, DataFrame]:
    """What of each source is indexed: external rows that ended well, robustness rows that did and are not the condition
    reused from main, and reference texts, whose ends A and B have ratio 0 and 1."""
    fresh = ~F.col("condition").eqNullSafe(F.lit(reused)) & F.coalesce(F.col("status") == "ok", F.lit(True))
    ends = references.withColumn("target_ratio", F.when(F.col("endpoint") == "A", 0.0).when(F.col("endpoint") == "B", 1.0)).drop("endpoint")
    return {"main": main, "external": external.where(F.col("status").isin("ok", "truncated")).drop("status"), "robustness": robustness.where(fresh).drop("status"), "reference": ends}


def index_counts(index: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """source_type, given, indexed, excluded; an item id that comes twice is an error."""
    if not index.groupBy("evaluation_item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("item ids are not unique")
    given = None
    for name, df in sources.items():
        one = df.agg(F.count(F.lit(1)).alias("given")).withColumn("source_type", F.lit(name))
        given = one if given is None else given.unionByName(one)
    n = index.groupBy("source_type").agg(F.count(F.lit(1)).alias("indexed"))
    return given.join(n, "source_type", "left").select("source_type", "given", F.coalesce("indexed", F.lit(0)).alias("indexed"), (F.col("given") - F.coalesce("indexed", F.lit(0))).alias("excluded"))


def usable_ratings(ratings: DataFrame, checks: DataFrame, rater: str, most_failures: int = 1) -> DataFrame:
    """Ratings less those of raters with more failed attention checks than allowed, and less incomplete ones."""
    bad = checks.groupBy(rater).agg(F.count_if(~F.col("ok")).alias("_f")).where(F.col("_f") > most_failures)
    return ratings.join(bad, rater, "left_anti").dropna()


def consensus(ratings: DataFrame, item: str, value: str, yes: str) -> DataFrame:
    return ratings.groupBy(item).agg(F.avg(value).alias("mean_value"), (F.avg(F.col(yes).cast("double")) >= 0.5).alias("majority"), F.count(F.lit(1)).alias("raters"))


def run_windows(rows: DataFrame, by: list[str], start: str, end: str, full: Column, good: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(F.when(full, F.col(start))).alias("start"), F.max(F.when(good, F.col(end))).alias("stop"))


def rating_seed(seeds: int = 3) -> Column:
    """1 to `seeds`, from the first eight hex digits of a hash of the cell."""
    h = F.sha2(F.concat_ws(":", "scenario_id", "model_id", F.col("ratio_idx").cast("string")), 256)
    return (1 + F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(seeds))).cast("int")


def worst_and_best(rows: DataFrame, by: list[str], value: str, ties: list[str]) -> DataFrame:
    """The lowest and the highest row of each group."""
    w = Window.partitionBy(*by)
    low, high = F.row_number().over(w.orderBy(value, *ties)), F.row_number().over(w.orderBy(F.desc(value), *ties))
    r = rows.withColumn("_l", low).withColumn("_h", high).where("_l = 1 or _h = 1")
    return r.withColumn("pick", F.when(F.col("_l") == 1, "low").otherwise("high")).drop("_l", "_h")


def model_table(rows: DataFrame, registry: DataFrame, text: str, finish: str) -> DataFrame:
    """generation_summary by model with the registry's columns; each model once on both sides."""
    from axisgauge.operators.audit import checked_join

    return checked_join(generation_summary(rows, ["model_id"], text, finish), registry, ["model_id"], "1:1")


def anchor_pair_diagnostics(ends: DataFrame, by: list[str]) -> DataFrame:
    """One row for each pair of endpoint outputs: separation, lengths, judgments of both and the judge's span and errors. ends:
    target_ratio 0 or 1, separation, length, coverage, passed, contradiction, task_changed, intensity."""
    at = lambda r, c: F.max(F.when(F.col("target_ratio") == r, F.col(c).cast("double")))
    wide = ends.groupBy(*by).agg(F.max("separation").alias("separation"), *[at(r, c).alias(f"{c}_{e}") for c in ("length", "coverage", "passed", "contradiction", "task_changed", "intensity") for r, e in ((0.0, "a"), (1.0, "b"))])
    c = F.col
    return wide.where("length_a is not null and length_b is not null").select(
        *by, "separation", (c("length_b") - c("length_a")).alias("length_difference"), F.abs(c("length_b") - c("length_a")).alias("length_absolute_difference"), ((c("coverage_a") + c("coverage_b")) / 2).alias("coverage_mean"),
        ((c("passed_a") + c("passed_b")) / 2).alias("pass_rate"), F.greatest("contradiction_a", "contradiction_b").alias("contradiction_any"), F.greatest("task_changed_a", "task_changed_b").alias("task_changed_any"),
        "intensity_a", "intensity_b", (c("intensity_b") - c("intensity_a")).alias("judge_span"), ((F.abs(c("intensity_a") / 100) + F.abs(c("intensity_b") / 100 - 1)) / 2).alias("judge_end_error"),
    )


PAIR_METRICS = ["separation", "length_difference", "length_absolute_difference", "coverage_mean", "pass_rate", "contradiction_any", "task_changed_any", "intensity_a", "intensity_b", "judge_span", "judge_end_error"]


def pair_table(pairs: DataFrame, by: list[str], metrics: list[str] = PAIR_METRICS) -> DataFrame:
    """Mean, median, p10, p90 and number of pairs of each metric."""
    long = cut(pairs).select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(by, metrics, "metric", "v")
    return aggregated(long, [*by, "metric"], [F.avg("v").alias("mean"), F.count(F.lit(1)).alias("pairs")], {n: ("v", q / 100) for n, q in (("median", 50), ("p10", 10), ("p90", 90))})


def wide_comparison(tables: list[DataFrame], key: str) -> DataFrame:
    """Model-level tables side by side by an outer join; of columns that several have the first stays."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.select(key, *[c for c in t.columns if c not in out.columns]), key, "full_outer")
    return out


def judge_association(projections: DataFrame, judged: DataFrame, x: str, y: str, most: int | None = None) -> DataFrame:
    """One row: Pearson and Spearman of two measures of the runs that both have; where `most` is given, of the runs with
    the smallest SHA-256 of their ids only (the sample that a scatter plot can show)."""
    j = projections.select("run_id", F.col(x).cast("double").alias("x")).join(judged.select("run_id", F.col(y).cast("double").alias("y")), "run_id").where("x is not null and y is not null")
    j = j if most is None else j.orderBy(F.sha2(F.col("run_id").cast("string"), 256)).limit(most)
    r = global_rank(global_rank(j, "x", "rx"), "y", "ry")
    return r.agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman"))


def yes_no(answer: Column) -> Column:
    """1 or 0 from yes, no, their Chinese words, booleans or digits; null from anything else."""
    t = F.lower(F.btrim(answer.cast("string")))
    return F.when(t.isin("yes", "是", "true", "1", "1.0"), 1.0).when(t.isin("no", "否", "false", "0", "0.0"), 0.0)


def formal_ratings(ratings: DataFrame, required: list[str], most_failures: int = 1, fast: float = 5.0) -> DataFrame:
    """Ratings proper: without attention items, raters with more failed attention items than allowed (an item is passed by
    the answer that it cannot be judged), answers of inability and incomplete ones; adds and contradicts as numbers, and a
    flag for answers given too fast. A rater's second answer to an item fails the job."""
    r = ratings.withColumn("unable", yes_no(F.col("unable")))
    attention = F.col("attention_check") == "yes"
    bad = r.where(attention).groupBy("rater_slot").agg(F.count_if(~F.coalesce(F.col("unable") == 1, F.lit(False))).alias("_f")).where(F.col("_f") > most_failures)
    formal = r.where(F.col("attention_check") == "no").join(bad.select("rater_slot"), "rater_slot", "left_anti").where("unable is null or unable != 1").dropna(subset=required)
    formal = formal.withColumn("adds", yes_no(F.col("adds"))).withColumn("contradicts", yes_no(F.col("contradicts"))).withColumn("speed_anomaly", F.coalesce(F.col("seconds").try_cast("double") < fast, F.lit(False)))
    n = F.count(F.lit(1)).over(Window.partitionBy("rater_id", "item_id"))
    twice = F.raise_error(F.lit("a rater has rated an item twice")).cast("string")
    return formal.withColumn("item_id", F.when(n == 1, F.col("item_id").cast("string")).otherwise(twice))


def reliability(formal: DataFrame, scales: list[str], flags: list[str]) -> DataFrame:
    """metric, statistic, estimate, items: ICC and Krippendorff's alpha of scales over items that all raters rated, Fleiss'
    kappa of flags."""
    from axisgauge.operators import statistics

    slots = formal.agg(F.countDistinct("rater_slot").alias("_k"))  # one row
    long = formal.unpivot(["item_id", "rater_slot"], scales, "metric", "v").where("v is not null")
    full = long.join(long.groupBy("metric", "item_id").agg(F.countDistinct("rater_slot").alias("_n")).crossJoin(F.broadcast(slots)).where("_n = _k").select("metric", "item_id"), ["metric", "item_id"])
    i = statistics.icc(full, ["metric"], "item_id", "rater_slot", "v").select("metric", F.inline(F.array(F.struct(F.lit("icc_a1").alias("statistic"), F.col("icc_a1").alias("estimate"), F.col("n").cast("long").alias("items")), F.struct(F.lit("icc_ak").alias("statistic"), F.col("icc_ak").alias("estimate"), F.col("n").cast("long").alias("items")))))
    items = full.groupBy("metric").agg(F.countDistinct("item_id").alias("items"))
    k = statistics.krippendorff(full, ["metric"], "item_id", "v").join(items, "metric").select("metric", F.lit("krippendorff").alias("statistic"), F.col("alpha").alias("estimate"), "items")
    marks = formal.select("item_id", *[F.col(f).cast("double").alias(f) for f in flags]).unpivot(["item_id"], flags, "metric", "v").where("v is not null")
    f = statistics.fleiss(marks, ["metric"], "item_id", "v").select("metric", F.lit("fleiss_kappa").alias("statistic"), F.col("fleiss_kappa").alias("estimate"), "items")
    return i.unionByName(k).unionByName(f)


def human_geometry(items: DataFrame, samples: DataFrame, replicates: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(by encoder and metric, with scenario bootstrap intervals; by axis and encoder): rank correlation, correlation and mean
    distance of human style ratios and coordinates. items: run_id, human_ratio, one row each; samples: encoder_id too."""
    from axisgauge.functions.numeric import spearman
    from axisgauge.operators import statistics
    from axisgauge.operators.audit import checked_join

    j = checked_join(items, samples, ["run_id"], "1:m").where("human_ratio is not null and projection_raw is not null").withColumn("gap", F.abs(F.col("projection_raw") - F.col("human_ratio"))).withColumn("_all", F.lit("all"))
    rank = statistics.bootstrap_spearman(j, ["encoder_id"], [("human_ratio", "projection_raw")], "_all", "scenario_id", replicates, seed).select("encoder_id", F.lit("spearman").alias("metric"), "estimate", "ci_lower", "ci_upper")
    drawn = j.groupBy("encoder_id", "_all", "scenario_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(a) for a, e in (("sx", F.col("human_ratio")), ("sy", F.col("projection_raw")), ("sxx", F.col("human_ratio") ** 2), ("syy", F.col("projection_raw") ** 2), ("sxy", F.col("human_ratio") * F.col("projection_raw")), ("sg", F.col("gap")))])
    again = statistics.drawn_sums(drawn, ["encoder_id"], ["n", "sx", "sy", "sxx", "syy", "sxy", "sg"], "_all", "scenario_id", replicates, seed)
    again = again.selectExpr("encoder_id", "try_divide(sxy - sx * sy / n, sqrt(greatest(sxx - sx * sx / n, 0D) * greatest(syy - sy * sy / n, 0D))) r", "sg / n g")
    limits = again.groupBy("encoder_id").agg(*[F.percentile(c, F.lit(q)).alias(f"{c}{k}") for c in ("r", "g") for k, q in ((0, 0.025), (1, 0.975))])
    at = j.groupBy("encoder_id").agg(safe_corr("human_ratio", "projection_raw").alias("r"), F.avg("gap").alias("g")).join(limits, "encoder_id")
    rest = at.select("encoder_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("estimate"), F.col(c + "0").alias("ci_lower"), F.col(c + "1").alias("ci_upper")) for m, c in (("pearson", "r"), ("mae", "g"))])))
    by = ["style_axis", "encoder_id"]
    axis = j.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), safe_corr("human_ratio", "projection_raw").alias("pearson"), F.avg("gap").alias("mae")).join(spearman(j, "human_ratio", "projection_raw", by, "spearman"), by, "left")
    return rank.unionByName(rest), axis


def rating_package(runs: DataFrame, seed: str, slots: list[str], checks: int) -> tuple[DataFrame, DataFrame]:
    """(items, assignments): the hash-chosen runs with public ids and a display order, and for each rater slot all items in an
    order of its own and attention checks after them. Orders are hash orders, ranked over the whole table by range."""
    chosen = runs.where(F.col("seed") == rating_seed()).withColumn("item_id", F.concat(F.lit("HE_"), F.upper(F.substring(F.sha2(F.concat_ws("::", F.lit("human_eval"), F.col("run_id").cast("string")), 256), 1, 12))))
    place = lambda df, key, name: global_rank(df.withColumn("_h", key), "_h", name).withColumn(name, F.col(name).cast("long")).drop("_h")
    items = place(chosen, F.sha2(F.concat_ws(":", F.lit(seed), "item_id"), 256), "display_order")
    out = None
    for s in slots:
        dealt = place(items.select("item_id"), F.sha2(F.concat_ws(":", F.lit(seed), F.lit(s), "item_id"), 256), "position").select(F.format_string("%s_%03d", F.lit(s), "position").alias("assignment_id"), "item_id", F.lit(s).alias("rater_slot"), F.lit("no").alias("attention_check"))
        out = dealt if out is None else out.unionByName(dealt)
    spark = runs.sparkSession
    extra = spark.createDataFrame([(f"{s}_AC{k:02d}", f"ATTENTION_{s}_{k:02d}", s, "yes") for s in slots for k in range(1, checks + 1)], "assignment_id string, item_id string, rater_slot string, attention_check string")
    return items, out.unionByName(extra)


def error_picks(errors: DataFrame, by: list[str], k: int = 1) -> DataFrame:
    """The k lowest and k highest rows of each group by the mean of the encoders' errors, numbered; ties by scenario and seed,
    of which the highest takes the last. errors: by, scenario_id, seed, encoder_id, error."""
    mean = errors.groupBy(*by, "scenario_id", "seed").agg(F.avg("error").alias("error")).where("error is not null")
    w = Window.partitionBy(*by)
    r = mean.withColumn("_l", F.row_number().over(w.orderBy("error", "scenario_id", "seed"))).withColumn("_h", F.row_number().over(w.orderBy(F.desc("error"), F.desc("scenario_id"), F.desc("seed"))))
    picks = F.array_compact(F.array(F.when(F.col("_l") <= k, F.struct(F.lit("low").alias("pick"), F.col("_l").alias("nth"))), F.when(F.col("_h") <= k, F.struct(F.lit("high").alias("pick"), F.col("_h").alias("nth")))))
    return r.select(*by, "scenario_id", "seed", "error", F.inline(picks))


def gated(anchors: DataFrame, approved: Column, texts: list[str]) -> DataFrame:
    """One row: status complete or pending, approved and required pairs. A pair counts if it is approved and no text is blank."""
    ok = F.coalesce(approved, F.lit(False))
    for t in texts:
        ok = ok & (F.coalesce(F.char_length(F.trim(t)), F.lit(0)) > 0)
    n = anchors.agg(F.count_if(ok).alias("approved_pairs"), F.count(F.lit(1)).alias("required_pairs"))
    return n.select(F.when(F.col("approved_pairs") == F.col("required_pairs"), "complete").otherwise("pending").alias("status"), "approved_pairs", "required_pairs")
