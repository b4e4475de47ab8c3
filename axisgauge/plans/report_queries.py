"""Leaf reports over the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from axisgauge.operators import geometry, reports, textq
from axisgauge.plans.calibration_queries import rounded, scenario
from axisgauge.plans.fixtures import WITH, points, samples, scores, table, texts
from axisgauge.plans.judge_queries import RATSQL, ratings

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if plain else WITH + sql
        return f

    return add


@query("SELECT model_id, encoder_id, method, round(avg(e), 6) AS mean_error, count(*) AS n FROM (SELECT model_id, encoder_id, 'half' AS method, abs(0.5 - target_ratio) AS e FROM cells WHERE is_interior UNION ALL SELECT model_id, encoder_id, 'ratio', abs(distance_ratio_estimate - target_ratio) FROM cells WHERE is_interior UNION ALL SELECT model_id, encoder_id, 'projection', projection_error_raw FROM cells WHERE is_interior) GROUP BY ALL")
def ag5_estimator_comparison(spark, sf):
    from axisgauge.plans.calibration_queries import cells

    c = cells(spark, sf, True).where("is_interior").select("model_id", "encoder_id", F.abs(F.lit(0.5) - F.col("target_ratio")).alias("half"), F.abs(F.col("distance_ratio_estimate") - F.col("target_ratio")).alias("ratio"), F.col("projection_error_raw").alias("projection"))
    return rounded(reports.estimator_comparison(c, ["model_id", "encoder_id"], ["half", "ratio", "projection"]))


@query("SELECT model_id, style_axis, count(*) AS outputs, count(DISTINCT scenario_id) AS n_scenario_id, count(DISTINCT target_ratio) AS n_target_ratio, count(DISTINCT seed) AS n_seed, round(avg(length(text)), 6) AS mean_length, count(*) FILTER (trim(text) = '') AS empty FROM txt GROUP BY ALL")
def ag12_generation_summary(spark, sf):
    return rounded(reports.generation_summary(texts(spark, sf), ["model_id", "style_axis"], "text"))


@query(", nb AS (SELECT i.run_id, i.model_id, 1 + count(*) FILTER (j.run_id <> i.run_id AND j.from_a ** 2 - 2 * i.target_ratio * j.along + (i.target_ratio * i.separation) ** 2 < i.from_a ** 2 - 2 * i.target_ratio * i.along + (i.target_ratio * i.separation) ** 2 - 1e-13) AS r FROM geo i JOIN geo j USING (scenario_id, model_id, seed, encoder_id) WHERE i.is_interior AND encoder_id = 'full' GROUP BY ALL) SELECT model_id, round(avg((r = 1)::INT), 6) AS top_1, round(avg(r), 6) AS mean_rank, round(quantile_cont(r, 0.5), 6)::DOUBLE AS median_rank, round(stddev_samp(r), 6) AS std_rank FROM nb GROUP BY 1")
def ag16_neighbour_table(spark, sf):
    return rounded(reports.neighbour_table(samples(spark, sf).where("is_interior"), ["model_id"]))


@query("SELECT model_id, style_axis, round(avg(out_of_range::INT), 6) AS rate, round(min(projection_raw), 6) AS least, round(max(projection_raw), 6) AS greatest, round(avg(projection_raw), 6) + 0.0 AS mean FROM geo WHERE is_interior AND encoder_id = 'full' GROUP BY ALL")
def ag16_range_table(spark, sf):
    return rounded(reports.range_table(samples(spark, sf).where("is_interior"), ["model_id", "style_axis"]))


@query("SELECT model_id, round(target_ratio, 6) AS target_ratio, round(avg((character_length NOT BETWEEN 200 AND 2000)::INT), 6) AS violation_rate, round(avg(greatest(200 - character_length, character_length - 2000, 0)), 6) AS mean_deviation FROM txt GROUP BY ALL")
def ag17_length_table(spark, sf):
    t = texts(spark, sf).select("model_id", F.round("target_ratio", 6).alias("target_ratio"), *textq.length_compliance(F.col("character_length"), F.lit(200), F.lit(2000)))
    return rounded(t.groupBy("model_id", "target_ratio").agg(F.avg(F.col("violation").cast("double")).alias("violation_rate"), F.avg("deviation").alias("mean_deviation")))


@query("SELECT g.model_id, l.violation, count(*) AS n, round(avg(projection_error_raw), 6) AS projection_error, round(avg(abs(intensity / 100.0 - g.target_ratio)), 6) AS judge_error FROM geo g LEFT JOIN (SELECT run_id, character_length NOT BETWEEN 200 AND 2000 AS violation FROM txt WHERE run_id % 5 <> 0) l USING (run_id) LEFT JOIN (SELECT run_id, intensity FROM jud WHERE judge = 'j1' AND NOT missing) j USING (run_id) WHERE is_interior AND encoder_id = 'full' GROUP BY ALL")
def ag18_error_by_violation(spark, sf):
    lengths = texts(spark, sf).where("run_id % 5 != 0").select("run_id", (~F.col("character_length").between(200, 2000)).alias("violation"))
    judged = scores(spark, sf).where("judge = 'j1' and not missing").select("run_id", F.abs(F.col("intensity") / 100.0 - F.col("target_ratio")).alias("judge_error"))
    return rounded(reports.error_by_violation(samples(spark, sf).where("is_interior").select("run_id", "model_id", "projection_error_raw"), lengths, judged, ["model_id"]))


@query(", t AS (SELECT g.scenario_id, g.model_id, g.seed, projection_raw AS x, intensity AS y FROM geo g JOIN jud j USING (run_id) WHERE judge = 'j1' AND NOT missing AND encoder_id = 'full') SELECT scenario_id, model_id, seed, count(*) AS n, round(CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN corr(x, y) END, 6) AS pearson FROM t GROUP BY ALL")
def ju21_trajectory_association(spark, sf):
    j = samples(spark, sf).join(scores(spark, sf).where("judge = 'j1' and not missing").select("run_id", F.col("intensity").cast("double").alias("intensity")), "run_id")
    return rounded(reports.trajectory_association(j, ["scenario_id", "model_id", "seed"], "projection_raw", "intensity").drop("spearman"))


@query("SELECT count(*) AS matched, round(avg(abs(a.intensity - b.intensity)), 6) AS mae, round(corr(a.intensity, b.intensity), 6) AS pearson, round(avg(abs(a.naturalness - b.naturalness)), 6) AS naturalness_mae, round(avg((a.passed = b.passed)::INT), 6) AS pass_agreement FROM jud a JOIN jud b USING (run_id) WHERE a.judge = 'j1' AND b.judge = 'j2' AND NOT a.missing AND NOT b.missing")
def ju25_retest_stability(spark, sf):
    s = scores(spark, sf).where("not missing")
    return rounded(reports.retest_stability(s.where("judge = 'j1'"), s.where("judge = 'j2'"), "run_id"))


@query("SELECT model_id, round(target_ratio, 6) AS target_ratio, round(avg(intensity), 6) AS mean, round(stddev_samp(intensity) / sqrt(count(*)), 6) AS sem FROM jud WHERE judge = 'j1' AND NOT missing GROUP BY ALL")
def ju26_intensity_curve(spark, sf):
    from axisgauge.operators import ladder

    s = scores(spark, sf).where("judge = 'j1' and not missing").withColumn("target_ratio", F.round("target_ratio", 6))
    return rounded(ladder.curve(s, ["model_id", "target_ratio"], "intensity").select("model_id", "target_ratio", "mean", "sem"))


@query("SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, count(*) AS computable, 0::BIGINT AS collapsed FROM (SELECT DISTINCT scenario_id, model_id, seed, separation AS d FROM geo WHERE encoder_id = 'full')")
def ge17_anchor_span(spark, sf):
    return rounded(reports.anchor_span(samples(spark, sf).where("ratio_idx = 0"), "separation"))


@query("SELECT model_id, encoder_id, round(avg(separation), 6) AS mean, round(quantile_cont(separation, 0.1), 6) AS p10, round(quantile_cont(separation, 0.5), 6) AS p50, round(quantile_cont(separation, 0.9), 6) AS p90 FROM geo WHERE ratio_idx = 0 GROUP BY ALL")
def ge18_anchor_pairs(spark, sf):
    return rounded(reports.pair_spread(samples(spark, sf, True).where("ratio_idx = 0"), ["model_id", "encoder_id"], "separation"))


@query("SELECT 'main' AS source_type, doc_id AS source_id, substr(sha256('main::' || doc_id), 1, 24) AS evaluation_item_id FROM documents WHERE doc_id % 2 = 0 AND trim(text) <> '' UNION ALL SELECT 'external', doc_id, substr(sha256('external::' || doc_id), 1, 24) FROM documents WHERE doc_id % 2 = 1 AND trim(text) <> ''", plain=True)
def id11_evaluation_index(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return reports.evaluation_index({"main": d.where("source_id % 2 = 0"), "external": d.where("source_id % 2 = 1")}, F.col("source_id")).select("source_type", "source_id", "evaluation_item_id")


@query(RATSQL + "SELECT item, round(avg(v), 6) AS mean_value, avg(yes::INT) >= 0.5 AS majority, count(*) AS raters FROM rat WHERE rater NOT IN (SELECT rater FROM rat WHERE item % 50 = 1 GROUP BY rater HAVING count(*) FILTER (NOT yes) > 1) GROUP BY item")
def hu3_item_consensus(spark, sf):
    r = ratings(spark, sf).select("item", "rater", "intensity", "yes")
    checks = r.where("item % 50 = 1").select("rater", F.col("yes").alias("ok"))
    return rounded(reports.consensus(reports.usable_ratings(r, checks, "rater"), "item", "intensity", "yes"))


@query("SELECT user_id % 4 AS model_id, min(ts) FILTER (event_type = 'signup') AS start, max(ts) FILTER (event_type <> 'error') AS stop FROM events GROUP BY 1", plain=True)
def ef1_run_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("model_id", F.col("user_id") % 4)
    return reports.run_windows(e, ["model_id"], "ts", "ts", F.col("event_type") == "signup", F.col("event_type") != "error")


@query("SELECT scenario_id, model_id, ratio_idx, run_id FROM points WHERE seed = 1 + ('0x' || substr(sha256(scenario_id || ':' || model_id || ':' || ratio_idx), 1, 8))::BIGINT % 3")
def sa4_rating_package(spark, sf):
    return points(spark, sf).where(F.col("seed") == reports.rating_seed()).select("scenario_id", "model_id", "ratio_idx", "run_id")


@query("SELECT model_id, pick, scenario_id FROM (SELECT model_id, scenario_id, CASE WHEN row_number() OVER (PARTITION BY model_id ORDER BY ice, scenario_id) = 1 THEN 'low' WHEN row_number() OVER (PARTITION BY model_id ORDER BY ice DESC, scenario_id) = 1 THEN 'high' END AS pick FROM scen WHERE encoder_id = 'full') WHERE pick IS NOT NULL")
def sa3_low_and_high_error(spark, sf):
    return reports.worst_and_best(scenario(spark, sf), ["model_id"], "interior_calibration_error", ["scenario_id"]).select("model_id", "pick", "scenario_id")


SOURCES = "WITH d AS (SELECT doc_id, trim(text) <> '' AS filled, doc_id % 4 AS kind, CASE WHEN doc_id % 5 = 0 THEN 'p1_high' ELSE 'p2_low' END AS condition, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated' ELSE 'failed' END AS es, CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN NULL ELSE 'ok' END AS rs FROM documents), k AS (SELECT *, CASE kind WHEN 0 THEN 'main' WHEN 1 THEN 'external' WHEN 2 THEN 'robustness' ELSE 'reference' END AS source_type, coalesce(filled, false) AND CASE kind WHEN 1 THEN es <> 'failed' WHEN 2 THEN condition <> 'p1_high' AND coalesce(rs = 'ok', true) ELSE true END AS used FROM d) "


def sources(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text")
    kind = lambda k: d.where(F.col("source_id") % 4 == k)
    external = kind(1).withColumn("status", F.expr("case source_id % 3 when 0 then 'ok' when 1 then 'truncated' else 'failed' end"))
    robustness = kind(2).withColumn("condition", F.expr("if(source_id % 5 = 0, 'p1_high', 'p2_low')")).withColumn("status", F.expr("case source_id % 7 when 0 then 'failed' when 1 then null else 'ok' end"))
    return kind(0), external, robustness, kind(3).withColumn("endpoint", F.expr("if(source_id % 8 = 3, 'A', 'B')"))


@query(SOURCES + "SELECT source_type, doc_id AS source_id, CASE WHEN kind = 2 THEN condition END AS condition, CASE WHEN kind = 3 THEN (doc_id % 8 <> 3)::INT::DOUBLE END AS target_ratio, substr(sha256(source_type || '::' || doc_id), 1, 24) AS evaluation_item_id FROM k WHERE used", plain=True)
def id11_four_sources(spark, sf):
    return reports.evaluation_index(reports.evaluation_sources(*sources(spark, sf), "p1_high"), F.col("source_id")).select("source_type", "source_id", "condition", "target_ratio", "evaluation_item_id")


@query(SOURCES + "SELECT source_type, count(*) AS given, count(*) FILTER (used) AS indexed, count(*) FILTER (NOT used) AS excluded FROM k GROUP BY 1", plain=True)
def id11_source_counts(spark, sf):
    given = sources(spark, sf)
    index = reports.evaluation_index(reports.evaluation_sources(*given, "p1_high"), F.col("source_id"))
    return reports.index_counts(index, dict(zip(("main", "external", "robustness", "reference"), given, strict=True)))


@query(", e AS (SELECT model_id, style_axis, ratio_idx, scenario_id, seed, avg(round(projection_error_clipped, 9)) AS error FROM geo WHERE is_interior GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model_id, style_axis, ratio_idx ORDER BY error, scenario_id, seed) AS l, row_number() OVER (PARTITION BY model_id, style_axis, ratio_idx ORDER BY error DESC, scenario_id DESC, seed DESC) AS h FROM e) SELECT model_id, style_axis, ratio_idx, scenario_id, seed, round(error, 6) AS error, 'low' AS pick, l::INT AS nth FROM r WHERE l = 1 UNION ALL SELECT model_id, style_axis, ratio_idx, scenario_id, seed, round(error, 6), 'high', h::INT FROM r WHERE h = 1")
def sa3_error_picks(spark, sf):
    errors = samples(spark, sf, True).where("is_interior").withColumn("error", F.round("projection_error_clipped", 9))
    return rounded(reports.error_picks(errors, ["model_id", "style_axis", "ratio_idx"]))


CHOSEN = ", ch AS (SELECT run_id, scenario_id, model_id, ratio_idx, 'HE_' || upper(substr(sha256('human_eval::' || run_id), 1, 12)) AS item_id FROM points WHERE seed = 1 + ('0x' || substr(sha256(scenario_id || ':' || model_id || ':' || ratio_idx), 1, 8))::BIGINT % 3) "


def package(spark, sf):
    return reports.rating_package(points(spark, sf).drop("v"), "rate", ["A", "B", "C"], 8)


@query(CHOSEN + "SELECT run_id, scenario_id, model_id, ratio_idx, item_id, row_number() OVER (ORDER BY sha256('rate:' || item_id)) AS display_order FROM ch")
def sa4_items(spark, sf):
    return package(spark, sf)[0].select("run_id", "scenario_id", "model_id", "ratio_idx", "item_id", "display_order")


@query(CHOSEN + "SELECT s || '_' || format('{:03d}', row_number() OVER (PARTITION BY s ORDER BY sha256('rate:' || s || ':' || item_id))) AS assignment_id, item_id, s AS rater_slot, 'no' AS attention_check FROM ch, (VALUES ('A'), ('B'), ('C')) t(s) UNION ALL SELECT s || '_AC' || format('{:02d}', k), 'ATTENTION_' || s || '_' || format('{:02d}', k), s, 'yes' FROM (VALUES ('A'), ('B'), ('C')) t(s), range(1, 9) r(k)")
def sa4_assignments(spark, sf):
    return package(spark, sf)[1].select("assignment_id", "item_id", "rater_slot", "attention_check")
