"""Judge records: parsing and normalising, summaries, pairwise audits, agreement between two judges, retests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.functions.numeric import safe_corr, spearman
from axisgauge.operators import ladder
from axisgauge.operators.statistics import REPLICATES, bootstrap_means, bootstrap_pearson, cohen_kappa, fixed_effect_residual, holm, line_residual, paired_differences, wilcoxon

#: The nine pairs of ratio positions that are compared (fixed values).
PAIRS = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (0, 3), (3, 6), (2, 4)]


def _fields(raw: Column) -> Column:
    """The text as JSON, or else its outermost braces; null if neither parses."""
    return F.coalesce(F.try_parse_json(F.trim(raw)), F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))))


def parse_scalar(raw: Column) -> Column:
    """Struct of ratio, preservation and naturalness from a judge's free text: whole text, embedded object, or single
    fields by pattern; and whether a ratio was found."""
    v = _fields(raw)

    def number(name: str) -> Column:
        found = F.regexp_extract(raw, rf'(?i)"?{name}"?\s*[:=]\s*"?(-?\d+(?:\.\d+)?)', 1)
        return F.coalesce(F.try_variant_get(v, f"$.{name}", "double"), F.nullif(found, F.lit("")).try_cast("double"))

    ratio = number("style_b_ratio")
    return F.struct(ratio.alias("style_b_ratio"), number("content_preservation").alias("content_preservation"), number("style_mixture_naturalness").alias("style_mixture_naturalness"), ratio.isNotNull().alias("parse_ok"))


def parse_winner(raw: Column) -> Column:
    v = _fields(raw)
    word = F.lower(F.coalesce(F.try_variant_get(v, "$.winner", "string"), F.nullif(F.regexp_extract(raw, r'(?i)"?winner"?\s*[:=]\s*"?(1|2|tie)', 1), F.lit(""))))
    winner = F.when(word.isin("1", "2", "tie"), word)
    return F.struct(winner.alias("winner"), F.try_variant_get(v, "$.confidence", "double").alias("confidence"), winner.isNotNull().alias("parse_ok"))


STRICT = ["covered", "added_key_information", "factual_contradiction", "task_result_changed", "unjudgeable", "style_B_intensity", "naturalness"]


def normalise_content(raw: Column, checks: Column) -> Column:
    """Struct of a content judgment and an error reason: exact fields, as many booleans as there are checks, numbers
    that are numbers and in range. Coverage, and the pass rule: 0.9 covered or more, judgeable, no contradiction and
    no changed task."""
    v = _fields(raw)
    kind = {f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) for f in STRICT}
    covered = F.try_variant_get(v, "$.covered", "array<boolean>")
    flags = {f: F.try_variant_get(v, f"$.{f}", "boolean") for f in STRICT[1:5]}
    numbers = {f: F.try_variant_get(v, f"$.{f}", "double") for f in STRICT[5:]}
    real = [kind[f].rlike("^(BIGINT|DOUBLE|DECIMAL)") for f in STRICT[5:]]
    names = F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    error = (
        F.when(v.isNull(), "no object").when(checks == 0, "no checkpoints").when(~names.eqNullSafe(F.array(*[F.lit(n) for n in sorted(STRICT)])), "fields")
        .when(~kind["covered"].eqNullSafe(F.lit("ARRAY<BOOLEAN>")) | (F.size(covered) != checks), "covered")
        .when(~(F.coalesce(kind["added_key_information"] == "BOOLEAN", F.lit(False)) & F.coalesce(kind["task_result_changed"] == "BOOLEAN", F.lit(False)) & F.coalesce(kind["factual_contradiction"] == "BOOLEAN", F.lit(False)) & F.coalesce(kind["unjudgeable"] == "BOOLEAN", F.lit(False))), "flags")
        .when(~(F.coalesce(real[0], F.lit(False)) & F.coalesce(real[1], F.lit(False))), "numbers")
        .when(~(numbers["style_B_intensity"].between(0, 100) & numbers["naturalness"].between(1, 5)), "range")
    )
    coverage = F.size(F.filter(covered, lambda c: c)) / F.nullif(checks, F.lit(0))
    passed = (coverage >= 0.9) & ~flags["factual_contradiction"] & ~flags["task_result_changed"] & ~flags["unjudgeable"]
    fine = error.isNull()
    return F.struct(F.when(fine, coverage).alias("coverage"), F.when(fine, passed).alias("passed"), F.when(fine, numbers["style_B_intensity"]).alias("intensity"), F.when(fine, numbers["naturalness"]).alias("naturalness"), error.alias("error"))


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def build_pairs(runs: DataFrame, group: list[str], position: str = "ratio_idx", pairs=PAIRS) -> DataFrame:
    """Both orders of each wanted pair of ratio positions inside a group."""
    spark = runs.sparkSession
    wanted = spark.createDataFrame(pairs, "left_idx long, right_idx long")
    left = runs.select(*group, F.col(position).cast("long").alias("left_idx"), F.col("run_id").alias("left_run_id"), F.col("target_ratio").alias("left_alpha"))
    right = runs.select(*group, F.col(position).cast("long").alias("right_idx"), F.col("run_id").alias("right_run_id"), F.col("target_ratio").alias("right_alpha"))
    both = left.join(F.broadcast(wanted), "left_idx").join(right, [*group, "right_idx"])  # wanted: nine rows
    return both.withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True))))


def outcome(rows: DataFrame) -> DataFrame:
    """winner ('1', '2', 'tie' by position, null unparsed) to higher, lower, tie or invalid, and its preference score."""
    left_won = (F.col("winner") == "1") != F.col("swapped")
    higher = F.when(F.col("winner").isNull() | ~F.col("winner").isin("1", "2", "tie"), "invalid").when(F.col("winner") == "tie", "tie").when(left_won == (F.col("left_alpha") > F.col("right_alpha")), "higher").otherwise("lower")
    rows = rows.withColumn("outcome", F.when((F.col("left_alpha") == F.col("right_alpha")) & F.col("winner").isin("1", "2"), "tie").otherwise(higher))
    return rows.withColumn("score", F.when(F.col("outcome") == "higher", 1.0).when(F.col("outcome") == "tie", 0.5).when(F.col("outcome") == "lower", 0.0))


def pairwise_rates(rows: DataFrame, by: list[str], confidence: str | None = None) -> DataFrame:
    """Rates over all, over parsed, and over parsed pairs that aren't ties; on request the mean confidence of parsed ones,
    where what is no number counts as missing."""
    o, n = F.col("outcome"), F.count(F.lit(1)).cast("double")
    parsed, decided = F.count_if(o != "invalid"), F.count_if(o.isin("higher", "lower"))
    first, second = F.count_if(F.col("winner") == "1"), F.count_if(F.col("winner") == "2")
    sure = [F.avg(F.when(o != "invalid", F.col(confidence).try_cast("double"))).alias("confidence")] if confidence else []
    return rows.groupBy(*by).agg(
        *sure, F.count(F.lit(1)).alias("n"), (F.count_if(o == "higher") / n).alias("win_all"), F.try_divide(F.count_if(o == "higher"), parsed).alias("win_parsed"), F.try_divide(F.count_if(o == "higher"), decided).alias("win_decided"),
        F.try_divide(F.count_if(o == "lower"), decided).alias("violation"), F.try_divide(F.count_if(o == "tie"), parsed).alias("tie"), F.try_divide(first - second, first + second).alias("position_bias"),
    )


def swap_consistency(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Normal and swapped presentations joined; shares of consistent pairs, contradictions and same-position wins."""
    a = rows.where("not swapped").select(*keys, F.col("outcome").alias("o1"), F.col("winner").alias("w1"))
    b = rows.where("swapped").select(*keys, F.col("outcome").alias("o2"), F.col("winner").alias("w2"))
    j = a.join(b, keys).where("o1 != 'invalid' and o2 != 'invalid'")
    rate = lambda c: F.avg(c.cast("double"))
    same, opposite = F.col("o1") == F.col("o2"), ((F.col("o1") == "higher") & (F.col("o2") == "lower")) | ((F.col("o1") == "lower") & (F.col("o2") == "higher"))
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rate(same).alias("consistent"), rate(opposite).alias("contradiction"), rate((F.col("w1") == F.col("w2")) & F.col("w1").isin("1", "2")).alias("same_position"), rate((F.col("o1") == "higher") & (F.col("o2") == "higher")).alias("both_higher"), rate((F.col("o1") == "tie") & (F.col("o2") == "tie")).alias("both_tie"))


def position_gaps(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates of the swapped order less those of the normal one."""
    wide = rows.groupBy(*by).pivot("swapped", [False, True]).agg(F.avg("score").alias("score"), F.avg((F.col("winner") == "1").cast("double")).alias("first"))
    return wide.select(*by, (F.col("true_score") - F.col("false_score")).alias("score_gap"), (F.col("true_first") - F.col("false_first")).alias("first_gap"))


def two_judges(index: DataFrame, first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """The index with each judge's columns under its prefix; judgments that are missing stay null."""
    for prefix, rows in (("a_", first), ("b_", second)):
        index = index.join(rows.select(*key, *[F.col(c).alias(prefix + c) for c in rows.columns if c not in key]), key, "left")
    return index


def agreement(rows: DataFrame, x: str, y: str, strata: dict[str, Column]) -> DataFrame:
    """By stratum: n, mean difference, MAE, Pearson and Spearman; correlations are null with two pairs or fewer."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("stratum")) for k, v in strata.items()])
    long = pairs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.inline(kinds))
    # judge scores have few distinct values: ranks come from a table of value counts in each stratum
    for c in ("x", "y"):
        counts = long.groupBy("kind", "stratum", c).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy("kind", "stratum").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        ranks = counts.select("kind", "stratum", c, (F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2.0).alias("r" + c))
        long = long.join(ranks, ["kind", "stratum", c])
    many = F.count(F.lit(1)) > 2
    return long.groupBy("kind", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("y")).alias("mean_difference"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), F.when(many, safe_corr("x", "y")).alias("pearson"), F.when(many, safe_corr("rx", "ry")).alias("spearman"))


def demeaned_agreement(rows: DataFrame, x: str, y: str, within: list[str]) -> DataFrame:
    w = Window.partitionBy(*within)
    p = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    p = p.select((F.col(x) - F.avg(x).over(w)).alias("x"), (F.col(y) - F.avg(y).over(w)).alias("y"))
    return p.agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("pearson"))


def content_confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the four cells (zeros kept), raw agreement, kappa, and both pass rates."""
    x, y = F.col(a), F.col(b)
    cell = {f"{i}{j}": F.count_if((x if i else ~x) & (y if j else ~y)) for i in (0, 1) for j in (0, 1)}
    return rows.where(x.isNotNull() & y.isNotNull()).agg(*[v.alias("c" + k) for k, v in cell.items()], *cohen_kappa(x, y), F.avg(x.cast("double")).alias("rate_a"), F.avg(y.cast("double")).alias("rate_b"))


def judge_ranking(rows: DataFrame, judge: str, model: str, scenario: str, value: str) -> DataFrame:
    """Scenario means first, then model means; rank 1 is the least."""
    means = rows.groupBy(judge, model, scenario).agg(F.avg(value).alias("m")).groupBy(judge, model).agg(F.avg("m").alias("mean"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(judge).orderBy("mean", model)))


def retest_items(runs: DataFrame, by: list[str], seed: str) -> DataFrame:
    """One run of each group: the one with the smallest SHA-256 of seed and id."""
    key = F.sha2(F.concat_ws("::", F.lit(seed), F.col("run_id").cast("string")), 256)
    return runs.withColumn("_k", key).groupBy(*by).agg(F.min_by("run_id", "_k").alias("run_id"))




LENIENT_FLAGS = ["added_key_information", "task_result_changed_by_addition", "factual_contradiction"]


def normalise_lenient(raw: Column, checks: Column) -> Column:
    """As normalise_content, but forgiving: a fenced or embedded object, further fields, one boolean field whose name only
    begins like factual_contradiction in its place, and missing flags where the text could not be judged."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?s)^```(?:json)?\s*", ""), r"(?s)\s*```$", "")
    v = _fields(bare)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    held = F.try_variant_get(v, "$", "map<string,variant>")
    alias = F.map_filter(held, lambda k, x: k.startswith("factual_contrad") & F.coalesce(F.schema_of_variant(x) == "BOOLEAN", F.lit(False)))
    only = F.when(F.size(alias) == 1, F.try_variant_get(F.get(F.map_values(alias), F.lit(0)), "$", "boolean"))
    covered, unjudgeable = F.try_variant_get(v, "$.covered", "array<boolean>"), F.try_variant_get(v, "$.unjudgeable", "boolean")
    is_flag = lambda f: F.coalesce(kind(f) == "BOOLEAN", F.lit(False))
    there = lambda f: F.array_contains(F.map_keys(held), f)
    flags = {f: F.when(is_flag(f), F.try_variant_get(v, f"$.{f}", "boolean")) for f in LENIENT_FLAGS}
    flags["factual_contradiction"] = F.coalesce(flags["factual_contradiction"], F.when(~there("factual_contradiction"), only))
    fine = F.lit(True)
    for f in LENIENT_FLAGS:
        fine = fine & (flags[f].isNotNull() | (F.coalesce(unjudgeable, F.lit(False)) & ~there(f)))
    numbers = {f: F.when(F.coalesce(kind(f).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False)), F.try_variant_get(v, f"$.{f}", "double")) for f in ("style_B_intensity", "naturalness")}
    error = (
        F.when(v.isNull() | held.isNull(), "no object").when(~(F.coalesce(kind("covered") == "ARRAY<BOOLEAN>", F.lit(False)) | ((checks == 0) & F.coalesce(F.size(covered) == 0, F.lit(False)))) | (F.size(covered) != checks), "covered")
        .when(~is_flag("unjudgeable"), "unjudgeable").when(~F.coalesce(fine, F.lit(False)), "flags")
        .when(~F.coalesce(numbers["style_B_intensity"].between(0, 100), F.lit(False)), "style_B_intensity").when(~F.coalesce(numbers["naturalness"].between(1, 5), F.lit(False)), "naturalness")
    )
    coverage = F.coalesce(F.try_divide(F.size(F.filter(covered, lambda c: c)).cast("double"), checks), F.lit(0.0))
    passed = (coverage >= 0.9) & ~F.coalesce(flags["factual_contradiction"], F.lit(False)) & ~F.coalesce(flags["task_result_changed_by_addition"], F.lit(False)) & ~unjudgeable
    ok = error.isNull()
    return F.struct(F.when(ok, coverage).alias("coverage"), F.when(ok, passed).alias("passed"), *[F.when(ok, x).alias(f) for f, x in flags.items()], *[F.when(ok, x).alias(f) for f, x in numbers.items()], error.alias("error"))


def scalar_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Older scalar judgments (style_b_ratio, content_preservation, style_mixture_naturalness as text or numbers, alpha,
    parse_ok) by any keys: MAE, bias, Spearman, means, end attraction, smoothness and parse rate."""
    num = {c: F.col(c).try_cast("double") for c in ("style_b_ratio", "content_preservation", "style_mixture_naturalness", "alpha")}
    r = rows.withColumns({**num, "parse_ok": F.col("parse_ok").cast("double")}).withColumn("target_ratio", F.col("alpha"))
    d = F.col("style_b_ratio") - F.col("alpha")
    base = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.avg("content_preservation").alias("content"), F.avg("style_mixture_naturalness").alias("naturalness"), F.avg("parse_ok").alias("parse_ok_rate"),
    )
    middle = (F.col("alpha") > 0.2) & (F.col("alpha") < 0.8)
    parts = [spearman(r, "alpha", "style_b_ratio", by, "spearman"), ladder.smoothness(r.where("style_b_ratio is not null"), by, "alpha", "style_b_ratio"), ladder.attraction(r.where("style_b_ratio is not null"), by, "style_b_ratio", middle)]
    for p in parts:
        base = base.join(p, by, "left")
    return base


def monotonic_violations(rows: DataFrame, by: list[str]) -> DataFrame:
    """Older pairwise records (left_alpha, right_alpha, winner text_1, text_2 or tie, swap_order, parse_ok): pairs of equal
    ratios are left out; violation and tie rates over valid ones, parse rate over all."""
    r = rows.where("left_alpha != right_alpha").withColumn("_valid", F.coalesce("parse_ok", F.lit(True)) & F.coalesce(F.col("winner").isin("text_1", "text_2", "tie"), F.lit(False)))
    second = (F.col("right_alpha") > F.col("left_alpha")) != F.coalesce("swap_order", F.lit(False))
    wrong = (F.col("winner") != "tie") & (F.col("winner") != F.when(second, "text_2").otherwise("text_1"))
    rate = lambda c: F.avg(F.when(F.col("_valid"), c.cast("double")))
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rate(wrong).alias("violation"), rate(F.col("winner") == "tie").alias("tie"), F.avg(F.col("parse_ok").cast("double")).alias("parse_ok_rate"))


def quality_sample(judgments: DataFrame, quality: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """Judgments joined to text quality one to one; flags as numbers, and the scalar error."""
    from axisgauge.operators.audit import checked_join

    j = checked_join(judgments, quality, keys, "1:1").withColumns({f: F.col(f).cast("double") for f in flags})
    return j.withColumn("scalar_ratio", F.col("intensity") / 100.0).withColumn("scalar_error", F.abs(F.col("scalar_ratio") - F.col("target_ratio")))


def scalar_calibration(rows: DataFrame, by: list[str]) -> DataFrame:
    """Seed-averaged cells of scalar_ratio and scalar_error by model and axis: MAE, correlations, slope and intercept."""
    cells = rows.groupBy("scenario_id", *by, "target_ratio").agg(F.avg("scalar_ratio").alias("r"), F.avg("scalar_error").alias("e"))
    fit = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.avg("e").alias("mae"), safe_corr("target_ratio", "r").alias("pearson"), F.regr_slope("r", "target_ratio").alias("slope"), F.regr_intercept("r", "target_ratio").alias("intercept"))
    return fit.join(spearman(cells.withColumn("r", F.round("r", 12)), "target_ratio", "r", by, "spearman"), by, "left")  # equal means tie


def coupling(rows: DataFrame, axes: list[str], values: dict[str, str]) -> DataFrame:
    """Means of values (name -> column) by axis and model on the chosen axes."""
    return rows.where(F.col("style_axis").isin(axes)).groupBy("style_axis", "model_id").agg(*[F.avg(F.col(c).cast("double")).alias(n) for n, c in values.items()])


def judge_summary(rows: DataFrame, metrics: list[str], replicates: int = REPLICATES) -> DataFrame:
    """By judge, model and axis, with `ALL` for all axes: cluster means with intervals, and valid output rows."""
    r = rows.withColumn("axis", F.explode(F.array(F.lit("ALL"), F.col("style_axis"))))
    by = ["judge", "model_id", "axis"]
    valid = r.groupBy(*by).agg(F.count("intensity").alias("valid_rows"))
    return bootstrap_means(r, by, metrics, "style_axis", "scenario_id", replicates).join(valid, by)


def paired_style_tests(rows: DataFrame, value: str, replicates: int = REPLICATES) -> DataFrame:
    """For each judge, all pairs of models on scenario means: difference with interval, dz, signed-rank p (zeros dropped),
    and Holm's adjustment inside the judge."""
    means = rows.groupBy("judge", "scenario_id", "style_axis", "model_id").agg(F.avg(value).alias("m")).where("m is not null")
    d = paired_differences(means.drop("style_axis"), ["judge"], "model_id", "scenario_id", "m").join(means.select("scenario_id", "style_axis").distinct(), "scenario_id")
    by = ["judge", "model_a", "model_b"]
    d = cut(d.withColumn("difference", F.round("difference", 12)))  # equal but for rounding: ties
    sd = d.groupBy(*by).agg(F.stddev_samp("difference").alias("_sd"))
    out = bootstrap_means(d, by, ["difference"], "style_axis", "scenario_id", replicates).drop("metric").join(sd, by).join(wilcoxon(d, by, zeros="drop"), by, "left")
    out = out.withColumn("dz", F.when(F.col("_sd") > 0, F.col("estimate") / F.col("_sd"))).drop("_sd")
    return holm(out, ["judge"])


def condition_differences(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Differences of two judges by any keys; null keys are groups of their own."""
    d = F.col(a) - F.col(b)
    return rows.where(d.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_difference"), F.avg(F.abs(d)).alias("mean_absolute_difference"))


def length_sensitivity(rows: DataFrame, judges: list[str], checkpoint, replicates: int = REPLICATES) -> DataFrame:
    """judge, and the correlation of geometry and judge with its interval, before and after length is taken out of both.
    rows: outputs with coordinate, length and an intensity column for each judge; they are averaged over seeds, and fixed
    effects of ratio, model and scenario (which holds its axis) are removed first. checkpoint cuts the lineage."""
    keys = ["scenario_id", "style_axis", "model_id", "target_ratio"]
    cells = checkpoint(rows.groupBy(*keys).agg(F.avg("coordinate").alias("coordinate"), F.avg("length").alias("length"), *[F.avg(j).alias(j) for j in judges]))
    for c in ("coordinate", "length", *judges):
        cells = checkpoint(fixed_effect_residual(cells, c, "scenario_id", ["target_ratio", "model_id"], f"_{c}"))
    cells = checkpoint(line_residual(cells, "_coordinate", "_length", "g"))
    out = None
    for j in judges:
        r = checkpoint(line_residual(cells, f"_{j}", "_length", "j"))
        base = bootstrap_pearson(r, "_coordinate", f"_{j}", "scenario_id", replicates)
        after = bootstrap_pearson(r, "g", "j", "scenario_id", replicates).select(F.col("estimate").alias("controlled"), F.col("ci_lower").alias("controlled_lower"), F.col("ci_upper").alias("controlled_upper"))
        one = base.crossJoin(F.broadcast(after)).withColumn("judge", F.lit(j))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def rank_of_rankings(ranking: DataFrame) -> DataFrame:
    """Rank correlation of the two judges' model means; ranking: judge, model_id, mean (judge_ranking)."""
    first = ranking.agg(F.min("judge").alias("_a"))  # one row
    r = ranking.crossJoin(F.broadcast(first)).groupBy("model_id").agg(F.max(F.when(F.col("judge") == F.col("_a"), F.col("mean"))).alias("x"), F.max(F.when(F.col("judge") != F.col("_a"), F.col("mean"))).alias("y"))
    return spearman(r.withColumn("g", F.lit(1)), "x", "y", ["g"], "spearman").drop("g")


def worst_axes(rates: DataFrame, k: int = 3) -> DataFrame:
    """The k axes of each model with the highest violation rates."""
    w = Window.partitionBy("model_id").orderBy(F.desc_nulls_last("violation"), "style_axis")
    return rates.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
