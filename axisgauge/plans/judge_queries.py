"""Judges, pairwise audits, robustness conditions, raters and serving telemetry over the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.functions.numeric import hex8
from axisgauge.operators import failures, geometry, judges, reports, serving, statistics
from axisgauge.plans.calibration_queries import ERF, rounded
from axisgauge.plans.fixtures import WITH, boot, corr_sql, draw, draws_sql, points, rank_sql, samples, scores, table, texts

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if plain else WITH + sql
        return f

    return add


def both(spark, sf):
    s = scores(spark, sf).where("not missing").select("run_id", "judge", "intensity", "naturalness", "passed")
    index = points(spark, sf).select("run_id", "scenario_id", "style_axis", "model_id", "seed", "target_ratio", "ratio_idx")
    one, two = (s.where(F.col("judge") == j).drop("judge") for j in ("j1", "j2"))
    return judges.two_judges(index, one, two, ["run_id"])


TWO = ", two AS (SELECT p.run_id, p.scenario_id, p.style_axis, p.model_id, p.ratio_idx, a.intensity AS a, b.intensity AS b, a.passed AS pa, b.passed AS pb FROM points p LEFT JOIN (SELECT * FROM jud WHERE judge = 'j1' AND NOT missing) a USING (run_id) LEFT JOIN (SELECT * FROM jud WHERE judge = 'j2' AND NOT missing) b USING (run_id)) "


@query("SELECT judge, model_id, count(*) AS n, round(avg(abs(intensity / 100.0 - target_ratio)), 6) AS mae, round(avg(intensity / 100.0 - target_ratio), 6) + 0.0 AS bias, round(avg(naturalness), 6) AS naturalness, round(avg(passed::INT), 6) AS pass_rate FROM jud WHERE NOT missing AND ratio_idx BETWEEN 1 AND 5 GROUP BY ALL")
def ju15_judge_summary(spark, sf):
    s = scores(spark, sf).where("not missing and ratio_idx between 1 and 5").withColumn("d", F.col("intensity") / 100.0 - F.col("target_ratio"))
    return rounded(s.groupBy("judge", "model_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("d")).alias("mae"), F.avg("d").alias("bias"), F.avg("naturalness").alias("naturalness"), F.avg(F.col("passed").cast("double")).alias("pass_rate")))


@query(TWO + """, s AS (SELECT 'overall' AS kind, 'all' AS stratum, a, b FROM two UNION ALL SELECT 'axis', style_axis, a, b FROM two UNION ALL SELECT 'ratio', ratio_idx::VARCHAR, a, b FROM two), c AS (SELECT * FROM s WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY kind, stratum ORDER BY a) + (count(*) OVER (PARTITION BY kind, stratum, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY kind, stratum ORDER BY b) + (count(*) OVER (PARTITION BY kind, stratum, b) - 1) / 2.0 AS rb FROM c)
SELECT kind, stratum, count(*) AS n, round(avg(a - b), 6) + 0.0 AS mean_difference, round(avg(abs(a - b)), 6) AS mae, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY ALL""")
def ju16_agreement_by_stratum(spark, sf):
    strata = {"overall": F.lit("all"), "axis": F.col("style_axis"), "ratio": F.col("ratio_idx")}
    return rounded(judges.agreement(both(spark, sf), "a_intensity", "b_intensity", strata))


@query(TWO + "SELECT count(*) AS n, round(corr(x, y), 6) AS pearson FROM (SELECT a - avg(a) OVER w AS x, b - avg(b) OVER w AS y FROM (SELECT * FROM two WHERE a IS NOT NULL AND b IS NOT NULL) WINDOW w AS (PARTITION BY ratio_idx, style_axis))")
def ju17_demeaned_agreement(spark, sf):
    return rounded(judges.demeaned_agreement(both(spark, sf), "a_intensity", "b_intensity", ["ratio_idx", "style_axis"]))


@query(TWO + "SELECT count(*) FILTER (NOT pa AND NOT pb) AS c00, count(*) FILTER (NOT pa AND pb) AS c01, count(*) FILTER (pa AND NOT pb) AS c10, count(*) FILTER (pa AND pb) AS c11, count(*) AS n, round(avg((pa = pb)::INT), 6) AS raw_agreement, round((avg((pa = pb)::INT) - avg(pa::INT) * avg(pb::INT) - (1 - avg(pa::INT)) * (1 - avg(pb::INT))) / (1 - avg(pa::INT) * avg(pb::INT) - (1 - avg(pa::INT)) * (1 - avg(pb::INT))), 6) AS kappa, round(avg(pa::INT), 6) AS rate_a, round(avg(pb::INT), 6) AS rate_b FROM two WHERE pa IS NOT NULL AND pb IS NOT NULL")
def ju18_content_confusion(spark, sf):
    return rounded(judges.content_confusion(both(spark, sf), "a_passed", "b_passed"))


@query("SELECT judge, model_id, round(m, 6) AS mean, row_number() OVER (PARTITION BY judge ORDER BY m, model_id)::INT AS rank FROM (SELECT judge, model_id, avg(m) AS m FROM (SELECT judge, model_id, scenario_id, avg(abs(intensity - 100 * target_ratio)) AS m FROM jud WHERE NOT missing GROUP BY ALL) GROUP BY ALL)")
def ju19_judge_rankings(spark, sf):
    s = scores(spark, sf).where("not missing").withColumn("e", F.abs(F.col("intensity") - 100 * F.col("target_ratio")))
    return rounded(judges.judge_ranking(s, "judge", "model_id", "scenario_id", "e"))


@query("SELECT style_axis, model_id, round(target_ratio, 6) AS target_ratio, arg_min(run_id, sha256('5::' || run_id)) AS run_id FROM points WHERE ratio_idx BETWEEN 1 AND 5 GROUP BY ALL")
def ju24_retest_selection(spark, sf):
    p = points(spark, sf).where("ratio_idx between 1 and 5").withColumn("target_ratio", F.round("target_ratio", 6))
    return judges.retest_items(p, ["style_axis", "model_id", "target_ratio"], "5")


def pairs(spark, sf):
    built = judges.build_pairs(points(spark, sf), ["scenario_id", "style_axis", "model_id", "seed"])
    h = F.pmod(hex8(F.concat_ws(":", F.col("left_run_id").cast("string"), F.col("right_run_id").cast("string"), F.col("swapped").cast("int").cast("string"))), F.lit(10))
    return judges.outcome(built.withColumn("winner", F.when(h < 4, "1").when(h < 8, "2").when(h < 9, "tie")))


PAIRSQL = """, prs AS (SELECT l.scenario_id, l.style_axis, l.model_id, l.seed, l.run_id AS lr, r.run_id AS rr, swapped, ('0x' || substr(md5(l.run_id || ':' || r.run_id || ':' || swapped), 1, 8))::BIGINT % 10 AS h FROM points l JOIN points r USING (scenario_id, style_axis, model_id, seed) JOIN (VALUES (0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (0, 3), (3, 6), (2, 4)) w(i, j) ON l.ratio_idx = i AND r.ratio_idx = j, (VALUES (0), (1)) s(swapped)),
outc AS (SELECT *, CASE WHEN h < 4 THEN '1' WHEN h < 8 THEN '2' WHEN h < 9 THEN 'tie' END AS winner, CASE WHEN h = 9 THEN 'invalid' WHEN h = 8 THEN 'tie' WHEN (h < 4) <> (swapped = 1) THEN 'lower' ELSE 'higher' END AS outcome FROM prs) """


@query(PAIRSQL + "SELECT model_id, outcome, count(*) AS n FROM outc GROUP BY ALL")
def ju3_pair_outcomes(spark, sf):
    return pairs(spark, sf).groupBy("model_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(PAIRSQL + "SELECT model_id, style_axis, count(*) AS n, round(count(*) FILTER (outcome = 'higher') / count(*)::DOUBLE, 6) AS win_all, round(count(*) FILTER (outcome = 'higher') / count(*) FILTER (outcome <> 'invalid')::DOUBLE, 6) AS win_parsed, round(count(*) FILTER (outcome = 'higher') / count(*) FILTER (outcome IN ('higher', 'lower'))::DOUBLE, 6) AS win_decided, round(count(*) FILTER (outcome = 'lower') / count(*) FILTER (outcome IN ('higher', 'lower'))::DOUBLE, 6) AS violation, round(count(*) FILTER (outcome = 'tie') / count(*) FILTER (outcome <> 'invalid')::DOUBLE, 6) AS tie, round((count(*) FILTER (winner = '1') - count(*) FILTER (winner = '2')) / count(*) FILTER (winner IN ('1', '2'))::DOUBLE, 6) + 0.0 AS position_bias FROM outc GROUP BY ALL")
def ju5_pairwise_rates(spark, sf):
    return rounded(judges.pairwise_rates(pairs(spark, sf), ["model_id", "style_axis"]))


@query(PAIRSQL + "SELECT model_id, count(*) AS n, round(avg((a.outcome = b.outcome)::INT), 6) AS consistent, round(avg((a.outcome <> b.outcome AND a.outcome <> 'tie' AND b.outcome <> 'tie')::INT), 6) AS contradiction, round(avg((a.winner = b.winner AND a.winner <> 'tie')::INT), 6) AS same_position, round(avg((a.outcome = 'higher' AND b.outcome = 'higher')::INT), 6) AS both_higher, round(avg((a.outcome = 'tie' AND b.outcome = 'tie')::INT), 6) AS both_tie FROM outc a JOIN outc b USING (model_id, lr, rr) WHERE a.swapped = 0 AND b.swapped = 1 AND a.outcome <> 'invalid' AND b.outcome <> 'invalid' GROUP BY ALL")
def ju6_swap_consistency(spark, sf):
    return rounded(judges.swap_consistency(pairs(spark, sf), ["model_id", "left_run_id", "right_run_id"], ["model_id"]))


@query(PAIRSQL + ", s AS (SELECT *, CASE outcome WHEN 'higher' THEN 1.0 WHEN 'tie' THEN 0.5 WHEN 'lower' THEN 0.0 END AS score FROM outc) SELECT model_id, round(avg(score) FILTER (swapped = 1) - avg(score) FILTER (swapped = 0), 6) + 0.0 AS score_gap, round(avg((winner = '1')::INT) FILTER (swapped = 1) - avg((winner = '1')::INT) FILTER (swapped = 0), 6) + 0.0 AS first_gap FROM s GROUP BY ALL")
def ju7_position_gaps(spark, sf):
    return rounded(judges.position_gaps(pairs(spark, sf), ["model_id"]))


def ratings(spark, sf):
    p = points(spark, sf).where("ratio_idx between 1 and 5").select(F.col("run_id").alias("item"), "target_ratio", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rater"))
    h = hex8(F.concat_ws(":", F.col("rater").cast("string"), F.col("item").cast("string")))
    return p.select("item", "rater", (F.round(F.col("target_ratio") * 100).cast("int") + F.pmod(h, F.lit(31)).cast("int")).alias("intensity"), F.pmod(h, F.lit(4)).cast("int").alias("h4")).withColumn("yes", F.col("h4") > 0)


RATSQL = ", rat AS (SELECT run_id AS item, rater, round(target_ratio * 100)::INT + (('0x' || substr(md5(rater || ':' || run_id), 1, 8))::BIGINT % 31)::INT AS v, ('0x' || substr(md5(rater || ':' || run_id), 1, 8))::BIGINT % 4 > 0 AS yes FROM points, range(1, 4) r(rater) WHERE ratio_idx BETWEEN 1 AND 5) "


@query(RATSQL + ", g AS (SELECT avg(v) AS m, sum(v * v) AS ss, count(DISTINCT item) AS n, 3.0 AS k FROM rat), i AS (SELECT sum(x * x) AS si FROM (SELECT avg(v) AS x FROM rat GROUP BY item)), r AS (SELECT sum(x * x) AS sr FROM (SELECT avg(v) AS x FROM rat GROUP BY rater)), q AS (SELECT n, k, k * (si - n * m * m) / (n - 1) AS msr, n * (sr - k * m * m) / (k - 1) AS msc, (ss - k * si - n * sr + n * k * m * m) / ((n - 1) * (k - 1)) AS mse FROM g, i, r) SELECT n, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc_a1, round((msr - mse) / (msr + (msc - mse) / n), 6) AS icc_ak FROM q")
def st20_icc(spark, sf):
    return rounded(statistics.icc(ratings(spark, sf).withColumn("g", F.lit(1)), ["g"], "item", "rater", "intensity").select("n", "icc_a1", "icc_ak"))


@query(RATSQL + "SELECT (SELECT count(*) FROM rat) AS n, round(1 - (SELECT sum(d) FROM (SELECT 2 * (count(*) * sum(v * v) - sum(v) ** 2) / (count(*) - 1) AS d FROM rat GROUP BY item)) / (SELECT count(*) FROM rat) / (SELECT 2 * var_samp(v) FROM rat), 6) AS alpha")
def st21_krippendorff(spark, sf):
    return rounded(statistics.krippendorff(ratings(spark, sf).withColumn("g", F.lit(1)), ["g"], "item", "intensity").select("n", "alpha"))


@query(RATSQL + ", f AS (SELECT count(*) AS k, count(*) FILTER (yes) AS a FROM rat GROUP BY item), h AS (SELECT count(*) AS items, avg((a * (a - 1) + (k - a) * (k - a - 1)) / (k * (k - 1))::DOUBLE) AS p, sum(a) / sum(k)::DOUBLE AS q FROM f) SELECT items, round((p - q * q - (1 - q) * (1 - q)) / (1 - q * q - (1 - q) * (1 - q)), 6) AS fleiss_kappa FROM h")
def st22_fleiss(spark, sf):
    return rounded(statistics.fleiss(ratings(spark, sf).withColumn("g", F.lit(1)), ["g"], "item", "yes").select("items", "fleiss_kappa"))


@query("SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS raw_agreement, round((avg((quality = toxic)::INT) - avg(quality) * avg(toxic) - (1 - avg(quality)) * (1 - avg(toxic))) / (1 - avg(quality) * avg(toxic) - (1 - avg(quality)) * (1 - avg(toxic))), 6) AS kappa FROM labels", plain=True)
def st23_cohen_kappa(spark, sf):
    return rounded(table(spark, sf, "labels").agg(*statistics.cohen_kappa(F.col("quality") == 1, F.col("toxic") == 1)))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, round(avg((quality = toxic)::INT), 6) AS accuracy, round(count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (toxic = 1)::DOUBLE, 6) AS precision, round(count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (quality = 1)::DOUBLE, 6) AS recall, round(2 * count(*) FILTER (quality = 1 AND toxic = 1) / (count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 1))::DOUBLE, 6) AS f1 FROM labels", plain=True)
def st24_confusion(spark, sf):
    return rounded(table(spark, sf, "labels").agg(*statistics.confusion(F.col("quality") == 1, F.col("toxic") == 1)))


@query("""WITH w AS (SELECT user_id % 4 AS m, min(ts) AS s, max(ts) AS e FROM events WHERE event_type = 'signup' GROUP BY 1), t AS (SELECT m, user_id % 8 AS device, max(value) AS peak FROM events JOIN w ON ts BETWEEN s AND e AND (user_id % 8) // 2 = m GROUP BY ALL)
SELECT 'm' || m AS model_id, count(*) AS devices, round(CASE WHEN count(*) = 2 THEN sum(peak) END, 6) AS peak_sum FROM t GROUP BY m""", plain=True)
def ef2_telemetry_peaks(spark, sf):
    e = table(spark, sf, "events")
    windows = e.where("event_type = 'signup'").groupBy((F.col("user_id") % 4).alias("m")).agg(F.min("ts").alias("start"), F.max("ts").alias("stop")).select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model_id"), "start", "stop", F.array(2 * F.col("m"), 2 * F.col("m") + 1).alias("devices"))
    return rounded(serving.window_peaks(e.select("ts", (F.col("user_id") % 8).alias("device"), "value"), windows))


@query("SELECT event_type AS model_id, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value), 3) AS total FROM events GROUP BY 1", plain=True)
def ef3_latency(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "model_id")
    return serving.latency(e, ["model_id"], "value").select("model_id", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("total", 3).alias("total"))


@query("WITH c AS (SELECT user_id, round(avg(value), 4) AS a, count(*) AS b FROM events GROUP BY 1) SELECT user_id FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))", plain=True)
def ef4_pareto(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("a"), F.count(F.lit(1)).alias("b"))
    return serving.pareto(c, "a", "b").select("user_id")


def interior_scores(spark, sf):
    return scores(spark, sf).where("not missing and ratio_idx between 1 and 5").withColumn("style_mae", F.abs(F.col("intensity") / 100.0 - F.col("target_ratio"))).withColumn("pass_rate", F.col("passed").cast("double"))


INNER = ", js AS (SELECT *, abs(intensity / 100.0 - target_ratio) AS style_mae, passed::INT AS pass_rate FROM jud WHERE NOT missing AND ratio_idx BETWEEN 1 AND 5)"


@query(INNER + ", ja AS (SELECT *, 'ALL' AS axis FROM js UNION ALL SELECT *, style_axis FROM js)" + boot("ja", ["judge", "model_id", "axis"], ["style_mae", "naturalness", "pass_rate"]) + " SELECT bt.*, valid_rows FROM bt JOIN (SELECT judge, model_id, axis, count(*) AS valid_rows FROM ja GROUP BY ALL) USING (judge, model_id, axis)")
def ju15_judge_intervals(spark, sf):
    return rounded(judges.judge_summary(interior_scores(spark, sf), ["style_mae", "naturalness", "pass_rate"]))


@query(", jm AS (SELECT judge, model_id, avg(m) AS m FROM (SELECT judge, model_id, scenario_id, avg(abs(intensity - 100 * target_ratio)) AS m FROM jud WHERE NOT missing GROUP BY ALL) GROUP BY ALL), jr AS (SELECT rank() OVER (ORDER BY a.m) AS x, rank() OVER (ORDER BY b.m) AS y FROM jm a JOIN jm b USING (model_id) WHERE a.judge = 'j1' AND b.judge = 'j2') SELECT round(corr(x, y), 6) + 0.0 AS spearman FROM jr")
def ju19_rank_correlation(spark, sf):
    s = scores(spark, sf).where("not missing").withColumn("e", F.abs(F.col("intensity") - 100 * F.col("target_ratio")))
    return rounded(judges.rank_of_rankings(judges.judge_ranking(s, "judge", "model_id", "scenario_id", "e")))


@query(INNER + ", sm AS (SELECT judge, scenario_id, style_axis, model_id, avg(style_mae) AS m FROM js GROUP BY ALL), d AS (SELECT a.judge, a.scenario_id, a.style_axis, a.model_id AS model_a, b.model_id AS model_b, round(a.m - b.m, 12) AS difference FROM sm a JOIN sm b USING (judge, scenario_id) WHERE a.model_id < b.model_id)" + boot("d", ["judge", "model_a", "model_b"], ["difference"]) +
       ", r AS (SELECT *, " + rank_sql("abs(difference)", "judge, model_a, model_b") + " AS r FROM d WHERE difference <> 0), w AS (SELECT judge, model_a, model_b, least(sum(CASE WHEN difference > 0 THEN r ELSE 0 END), sum(CASE WHEN difference < 0 THEN r ELSE 0 END)) AS statistic FROM r GROUP BY ALL), z AS (SELECT judge, model_a, model_b, avg(difference) / stddev_samp(difference) AS dz FROM d GROUP BY ALL) SELECT bt.* EXCLUDE metric, round(statistic, 4)::DOUBLE AS statistic, round(dz, 6) + 0.0 AS dz FROM bt JOIN w USING (judge, model_a, model_b) JOIN z USING (judge, model_a, model_b)")
def ju20_paired_style_tests(spark, sf):
    return rounded(judges.paired_style_tests(interior_scores(spark, sf), "style_mae").drop("p_value", "p_holm"))


G = "judge, model_a, model_b"


@query(INNER + ", sm AS (SELECT judge, scenario_id, model_id, avg(style_mae) AS m FROM js GROUP BY ALL), d AS (SELECT a.judge, a.scenario_id, a.model_id AS model_a, b.model_id AS model_b, round(a.m - b.m, 12) AS d FROM sm a JOIN sm b USING (judge, scenario_id) WHERE a.model_id < b.model_id), "
       f"r AS (SELECT *, {rank_sql('abs(d)', G)} AS r, count(*) OVER (PARTITION BY {G}, abs(d)) AS t FROM d WHERE d <> 0), s AS (SELECT {G}, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS minus, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY ALL), "
       f"u AS (SELECT *, n * (n + 1) * (2 * n + 1) / 24 - ties / 48 AS v FROM s), x AS (SELECT *, abs(least(plus, minus) - n * (n + 1) / 4) / sqrt(v) / sqrt(2) AS x FROM u WHERE v > 0), y AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM x), p AS (SELECT {G}, least(1.0, ({ERF}) * exp(-x * x)) AS p FROM y), "
       f"h AS (SELECT *, row_number() OVER w AS k, (count(*) OVER (PARTITION BY judge) - row_number() OVER w + 1) * p AS q FROM p WINDOW w AS (PARTITION BY judge ORDER BY p, model_a, model_b)), f AS (SELECT {G}, p, least(1.0, max(q) OVER (PARTITION BY judge ORDER BY k)) AS p_holm FROM h) "
       f"SELECT {G}, round(p, 6) AS p_value, round(p_holm, 6) AS p_holm FROM (SELECT DISTINCT {G} FROM d) LEFT JOIN f USING ({G})")
def ju20_adjusted_p_values(spark, sf):
    return rounded(judges.paired_style_tests(interior_scores(spark, sf), "style_mae").select("judge", "model_a", "model_b", "p_value", "p_holm"))


def lengthy(spark, sf):
    s = samples(spark, sf).where("is_interior").select("run_id", "scenario_id", "style_axis", "model_id", "target_ratio", F.col("projection_raw").alias("coordinate"))
    j = scores(spark, sf).where("not missing").groupBy("run_id").agg(*[F.max(F.when(F.col("judge") == k, F.col("intensity").cast("double"))).alias(k) for k in ("j1", "j2")])
    return s.join(texts(spark, sf).select("run_id", F.col("character_length").cast("double").alias("length")), "run_id", "left").join(j, "run_id", "left")


@query()
def ju22_length_sensitivity(spark, sf):
    return rounded(judges.length_sensitivity(lengthy(spark, sf), ["j1", "j2"], cut))


@query(TWO + ", s AS (SELECT two.*, CASE WHEN run_id % 3 = 0 THEN NULL ELSE 'c' || run_id % 3 END AS condition, CASE WHEN run_id % 2 = 0 THEN 'main' ELSE 'other' END AS source_type FROM two WHERE a IS NOT NULL AND b IS NOT NULL) SELECT model_id, source_type, condition, count(*) AS n, round(avg(a - b), 6) + 0.0 AS mean_difference, round(avg(abs(a - b)), 6) AS mean_absolute_difference FROM s GROUP BY ALL")
def ju23_condition_differences(spark, sf):
    b = both(spark, sf).withColumn("condition", F.when(F.col("run_id") % 3 != 0, F.concat(F.lit("c"), (F.col("run_id") % 3).cast("string")))).withColumn("source_type", F.when(F.col("run_id") % 2 == 0, "main").otherwise("other"))
    return rounded(judges.condition_differences(b, "a_intensity", "b_intensity", ["model_id", "source_type", "condition"]))


@query(", sv AS (SELECT *, target_ratio AS alpha, intensity / 100.0::DOUBLE AS ratio FROM jud), sn AS (SELECT * FROM sv WHERE NOT missing), rk AS (SELECT judge, model_id, " + rank_sql("alpha", "judge, model_id") + " AS x, " + rank_sql("ratio", "judge, model_id") + " AS y FROM sn), sp AS (SELECT judge, model_id, corr(x, y) AS spearman FROM rk GROUP BY ALL), sm AS (SELECT judge, model_id, avg(abs(z)) AS smoothness FROM (SELECT judge, model_id, m - 2 * lag(m) OVER w + lag(m, 2) OVER w AS z FROM (SELECT judge, model_id, ratio_idx, avg(ratio) AS m FROM sn GROUP BY ALL) WINDOW w AS (PARTITION BY judge, model_id ORDER BY ratio_idx)) GROUP BY ALL), "
       "att AS (SELECT judge, model_id, avg((ratio < 0.15 OR ratio > 0.85)::INT) AS attraction FROM sn WHERE ratio_idx BETWEEN 2 AND 4 GROUP BY ALL), b AS (SELECT judge, model_id, count(*) AS n, avg(CASE WHEN NOT missing THEN abs(ratio - alpha) END) AS mae, avg(CASE WHEN NOT missing THEN ratio - alpha END) AS bias, avg(naturalness) AS content, avg(naturalness) AS naturalness, avg((NOT missing)::INT) AS parse_ok_rate FROM sv GROUP BY ALL) SELECT judge, model_id, n, round(mae, 6) AS mae, round(bias, 6) + 0.0 AS bias, round(content, 6) AS content, round(naturalness, 6) AS naturalness, round(parse_ok_rate, 6) AS parse_ok_rate, round(spearman, 6) AS spearman, round(smoothness, 6) AS smoothness, round(attraction, 6) AS attraction FROM b JOIN sp USING (judge, model_id) JOIN sm USING (judge, model_id) JOIN att USING (judge, model_id)")
def ju1_scalar_summary(spark, sf):
    s = scores(spark, sf).select("judge", "model_id", F.col("target_ratio").alias("alpha"), F.when(F.col("missing"), "?").otherwise((F.col("intensity") / 100.0).cast("string")).alias("style_b_ratio"), F.col("naturalness").cast("string").alias("content_preservation"), F.col("naturalness").alias("style_mixture_naturalness"), (~F.col("missing")).alias("parse_ok"))
    return rounded(judges.scalar_summary(s, ["judge", "model_id"]))


@query(PAIRSQL + ", v AS (SELECT model_id, h < 9 AS ok, h = 8 AS tie, h < 8 AND (h < 4) <> (swapped = 1) AS wrong FROM outc) SELECT model_id, count(*) AS n, round(avg(wrong::INT) FILTER (ok), 6) AS violation, round(avg(tie::INT) FILTER (ok), 6) AS tie, round(avg(ok::INT), 6) AS parse_ok_rate FROM v GROUP BY ALL")
def ju4_monotonic_violations(spark, sf):
    p = pairs(spark, sf).select("model_id", "left_alpha", "right_alpha", F.when(F.col("winner") == "tie", "tie").otherwise(F.concat(F.lit("text_"), "winner")).alias("winner"), F.col("swapped").alias("swap_order"), F.col("winner").isNotNull().alias("parse_ok"))
    return rounded(judges.monotonic_violations(p, ["model_id"]))


@query(PAIRSQL + "SELECT model_id, round(avg((h + 1) / 10.0) FILTER (outcome <> 'invalid' AND h <> 3), 6) AS confidence FROM outc GROUP BY 1")
def ju5_confidence(spark, sf):
    h = F.pmod(hex8(F.concat_ws(":", F.col("left_run_id").cast("string"), F.col("right_run_id").cast("string"), F.col("swapped").cast("int").cast("string"))), F.lit(10))
    p = pairs(spark, sf).withColumn("confidence", F.when(h == 3, "unsure").otherwise(((h + 1) / 10.0).cast("string")))
    return rounded(judges.pairwise_rates(p, ["model_id"], "confidence").select("model_id", "confidence"))


@query(PAIRSQL + ", q AS (SELECT model_id, style_axis, round(count(*) FILTER (outcome = 'lower') / count(*) FILTER (outcome IN ('higher', 'lower'))::DOUBLE, 6) AS violation FROM outc GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY violation DESC NULLS LAST, style_axis)::INT AS nth FROM q QUALIFY nth <= 3")
def ju5_worst_axes(spark, sf):
    rates = rounded(judges.pairwise_rates(pairs(spark, sf), ["model_id", "style_axis"]))
    return judges.worst_axes(rates).select("model_id", "style_axis", "violation", "nth")


FLAGS9 = ["passed", "added"]
NINE = ", q9 AS (SELECT j.run_id, j.scenario_id, j.style_axis, j.model_id, j.target_ratio, passed::INT AS passed, (naturalness = 2)::INT AS added, naturalness, character_length, intensity / 100.0::DOUBLE AS scalar_ratio, abs(intensity / 100.0 - j.target_ratio) AS scalar_error FROM jud j JOIN txt t ON t.run_id = j.run_id WHERE judge = 'j1' AND NOT missing)"


def quality(spark, sf):
    j = scores(spark, sf).where("judge = 'j1' and not missing").select("run_id", "scenario_id", "style_axis", "model_id", "target_ratio", "intensity", "naturalness", "passed", (F.col("naturalness") == 2).alias("added"))
    return judges.quality_sample(j, texts(spark, sf).select("run_id", "character_length"), ["run_id"], FLAGS9)


@query(NINE + " SELECT run_id, passed::DOUBLE AS passed, added::DOUBLE AS added, round(scalar_error, 6) AS scalar_error, character_length FROM q9")
def ju9_quality_sample(spark, sf):
    return rounded(quality(spark, sf).select("run_id", "passed", "added", "scalar_error", "character_length"))


TEN = ["passed", "added", "naturalness", "character_length", "scalar_error"]


@query(NINE + boot("q9", ["model_id"], TEN) + " SELECT * FROM bt")
def ju10_quality_summary(spark, sf):
    return rounded(statistics.bootstrap_means(quality(spark, sf), ["model_id"], TEN, "style_axis", "scenario_id"))


@query(NINE + ", c AS (SELECT scenario_id, model_id, style_axis, target_ratio, avg(scalar_ratio) AS r, avg(scalar_error) AS e FROM q9 GROUP BY ALL), k AS (SELECT *, " + rank_sql("target_ratio", "model_id, style_axis") + " AS x, " + rank_sql("round(r, 12)", "model_id, style_axis") + " AS y FROM c) SELECT model_id, style_axis, count(*) AS cells, round(avg(e), 6) AS mae, " + corr_sql("target_ratio", "r") + " AS pearson, round(regr_slope(r, target_ratio), 6) AS slope, round(regr_intercept(r, target_ratio), 6) + 0.0 AS intercept, " + corr_sql("x", "y") + " AS spearman FROM k GROUP BY ALL")
def ju11_scalar_calibration(spark, sf):
    return rounded(judges.scalar_calibration(quality(spark, sf), ["model_id", "style_axis"]))


@query("SELECT encoder_id, a.model_id, a.style_axis, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, count(*) AS n FROM (SELECT a.encoder_id, a.model_id, a.style_axis, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s FROM enc a JOIN enc b USING (scenario_id, model_id, seed, encoder_id) WHERE b.ratio_idx = 0) a GROUP BY ALL")
def ju12_semantic_similarity(spark, sf):
    p = points(spark, sf, True)
    keys = ["scenario_id", "model_id", "seed", "encoder_id"]
    s = p.join(p.where("ratio_idx = 0").select(*keys, F.col("v").alias("s")), keys).select("encoder_id", "model_id", "style_axis", geometry.cosine_similarity("v", "s").alias("x"))
    return rounded(s.groupBy("encoder_id", "model_id", "style_axis").agg(F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.count("x").alias("n")))


@query(NINE + " SELECT style_axis, model_id, round(avg(passed), 6) AS pass_rate, round(avg(added), 6) AS added_rate, round(avg(character_length), 6) AS mean_length, round(avg(scalar_error), 6) AS mae FROM q9 WHERE style_axis = 'a1' GROUP BY ALL")
def ju12_coupling(spark, sf):
    return rounded(judges.coupling(quality(spark, sf), ["a1"], {"pass_rate": "passed", "added_rate": "added", "mean_length": "character_length", "mae": "scalar_error"}))


@query(", ic AS (SELECT scenario_id, style_axis, model_id, round(target_ratio, 6) AS ratio, intensity AS i FROM jud WHERE judge = 'j1' AND NOT missing)" + boot("ic", ["model_id", "ratio"], ["i"]) + " SELECT * EXCLUDE metric FROM bt")
def ju26_intensity_intervals(spark, sf):
    s = scores(spark, sf).where("judge = 'j1' and not missing").select("scenario_id", "style_axis", "model_id", F.round("target_ratio", 6).alias("ratio"), F.col("intensity").alias("i"))
    return rounded(statistics.bootstrap_means(s, ["model_id", "ratio"], ["i"], "style_axis", "scenario_id").drop("metric"))


# --- human ratings

def human(spark, sf):
    """Three slots rate every interior run; the items of a few runs are attention items, and answers repeat hash draws."""
    t = texts(spark, sf).where("ratio_idx between 1 and 5").select("run_id", "scenario_id", "style_axis", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("rater_slot"))
    h = hex8(F.concat_ws(":", "rater_slot", F.col("run_id").cast("string")))
    check = F.col("run_id") % 100 == 1
    lax = (F.col("rater_slot") == "C") & (F.col("run_id") < 300)
    return t.select(
        F.col("run_id").cast("string").alias("item_id"), "run_id", "scenario_id", "style_axis", "rater_slot", F.concat(F.lit("r"), "rater_slot").alias("rater_id"), F.when(check, "yes").otherwise("no").alias("attention_check"),
        F.when(check, F.when(lax, "no").otherwise(" Yes")).when(F.pmod(h, F.lit(50)) == 0, "yes").otherwise("no").alias("unable"), F.pmod(h, F.lit(101)).cast("double").alias("style"), (1 + F.pmod(h, F.lit(5))).cast("double").alias("content"),
        F.when(F.pmod(h, F.lit(3)) == 0, "是").otherwise("No").alias("adds"), F.when(F.pmod(h, F.lit(7)) == 0, "yes").otherwise("否").alias("contradicts"), F.pmod(h, F.lit(60)).cast("string").alias("seconds"),
    )


HUM = """, hu0 AS (SELECT run_id, scenario_id, style_axis, slot, run_id % 100 = 1 AS chk, ('0x' || substr(md5(slot || ':' || run_id), 1, 8))::BIGINT AS h FROM txt, (VALUES ('A'), ('B'), ('C')) s(slot) WHERE ratio_idx BETWEEN 1 AND 5),
bad AS (SELECT slot FROM hu0 WHERE chk AND slot = 'C' AND run_id < 300 GROUP BY slot HAVING count(*) > 1),
hu AS (SELECT run_id AS item_id, run_id, scenario_id, style_axis, slot, h, (h % 101)::DOUBLE AS style, (1 + h % 5)::DOUBLE AS content, (h % 3 = 0)::INT AS adds, (h % 7 = 0)::INT AS contradicts, h % 60 < 5 AS fast FROM hu0 WHERE NOT chk AND slot NOT IN (SELECT slot FROM bad) AND h % 50 <> 0)"""
REQUIRED = ["rater_id", "style", "content", "adds", "contradicts"]


@query(HUM + " SELECT item_id::VARCHAR AS item_id, slot AS rater_slot, adds::DOUBLE AS adds, contradicts::DOUBLE AS contradicts, fast AS speed_anomaly FROM hu")
def hu1_formal_ratings(spark, sf):
    return reports.formal_ratings(human(spark, sf), REQUIRED).select("item_id", "rater_slot", "adds", "contradicts", "speed_anomaly")


def alpha_sql(m: str) -> str:
    return f"SELECT '{m}' AS metric, 'krippendorff' AS statistic, round(1 - (SELECT sum(d) FROM (SELECT 2 * (count(*) * sum({m} * {m}) - sum({m}) ** 2) / (count(*) - 1) AS d FROM fu GROUP BY item_id)) / count(*) / (2 * var_samp({m})), 6) AS estimate, count(DISTINCT item_id) AS items FROM fu"


def kappa_sql(m: str) -> str:
    return f"SELECT '{m}', 'fleiss_kappa', round((avg(p) - q * q - (1 - q) * (1 - q)) / (1 - q * q - (1 - q) * (1 - q)), 6), count(*) FROM (SELECT (a * (a - 1) + (k - a) * (k - a - 1)) / (k * (k - 1))::DOUBLE AS p, sum(a) OVER () / sum(k) OVER ()::DOUBLE AS q FROM (SELECT count(*) AS k, sum({m}) AS a FROM hu GROUP BY item_id HAVING count(*) > 1)) GROUP BY q"


@query(HUM + ", fu AS (SELECT * FROM hu WHERE item_id IN (SELECT item_id FROM hu GROUP BY 1 HAVING count(DISTINCT slot) = (SELECT count(DISTINCT slot) FROM hu))) " + " UNION ALL ".join([alpha_sql("style"), alpha_sql("content"), kappa_sql("adds"), kappa_sql("contradicts")]))
def hu1_reliability(spark, sf):
    """Without the ICC rows, which st20_icc compares."""
    return rounded(reports.reliability(reports.formal_ratings(human(spark, sf), REQUIRED), ["style", "content"], ["adds", "contradicts"]).where("statistic not like 'icc%'"))


def human_items(spark, sf):
    f = reports.formal_ratings(human(spark, sf), REQUIRED)
    return f.groupBy("run_id").agg((F.avg("style") / 100).alias("human_ratio"))


HGEO = HUM + ", hi AS (SELECT run_id, avg(style) / 100 AS h FROM hu GROUP BY 1), hg AS (SELECT g.encoder_id, g.scenario_id, g.style_axis, h, projection_raw AS p, abs(projection_raw - h) AS gap FROM hi JOIN geo g USING (run_id))"


@query(HGEO + ", hk AS (SELECT *, " + rank_sql("round(h, 12)", "style_axis, encoder_id") + " AS x, " + rank_sql("p", "style_axis, encoder_id") + " AS y FROM hg) SELECT style_axis, encoder_id, count(*) AS items, " + corr_sql("h", "p") + " AS pearson, round(avg(gap), 6) AS mae, " + corr_sql("x", "y") + " AS spearman FROM hk GROUP BY ALL")
def hu4_agreement_by_axis(spark, sf):
    return rounded(reports.human_geometry(human_items(spark, sf), samples(spark, sf, True).select("run_id", "scenario_id", "style_axis", "encoder_id", "projection_raw"), 100)[1])


def weighted(c: str) -> str:
    w = "OVER (PARTITION BY encoder_id, b"
    return f"sum(times) {w} ORDER BY {c}) - sum(times) {w}, {c}) + (sum(times) {w}, {c}) + 1) / 2.0"


def weighted_corr(x: str, y: str) -> str:
    s = lambda u, v: f"(sum(times * {u} * {v}) - sum(times * {u}) * sum(times * {v}) / sum(times))"
    return f"{s(x, y)} / nullif(sqrt({s(x, x)} * {s(y, y)}), 0)"


@query(HGEO + ", ha AS (SELECT encoder_id, scenario_id, round(h, 12) AS h, p, gap, 'all' AS _all FROM hg), " + draws_sql("ha", "hb", "_all") + f", al AS (SELECT ha.*, 0 AS b, 1 AS times FROM ha UNION ALL SELECT ha.*, b, times FROM ha JOIN hb_r USING (_all, scenario_id)), rk AS (SELECT *, {weighted('h')} AS rh, {weighted('p')} AS rp FROM al), "
       f"cr AS (SELECT encoder_id, b, {weighted_corr('rh', 'rp')} AS spearman, {weighted_corr('h', 'p')} AS pearson, sum(times * gap) / sum(times) AS mae FROM rk GROUP BY ALL), lo AS (UNPIVOT cr ON spearman, pearson, mae INTO NAME metric VALUE v) "
       "SELECT encoder_id, metric, round(max(v) FILTER (b = 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (b > 0), 6) AS ci_lower, round(quantile_cont(v, 0.975) FILTER (b > 0), 6) AS ci_upper FROM lo GROUP BY ALL")
def hu4_human_geometry(spark, sf):
    return rounded(reports.human_geometry(human_items(spark, sf), samples(spark, sf, True).select("run_id", "scenario_id", "style_axis", "encoder_id", "projection_raw"), 10_000)[0])


# --- single failures

def failure_rows(spark, sf):
    from axisgauge.plans.fixtures import external

    own = samples(spark, sf).select("run_id", "scenario_id", "style_axis", "model_id", "seed", "target_ratio", F.col("projection_raw").alias("own"))
    ext = geometry.with_geometry(points(spark, sf), external(spark, sf), ["scenario_id", "encoder_id"]).select("run_id", F.col("projection_raw").alias("external"), F.col("projection_error_raw").alias("external_error"), F.col("out_of_range").alias("external_out"))
    j = scores(spark, sf).where("not missing").groupBy("run_id").agg(*[F.max(F.when(F.col("judge") == k, F.col(c))).alias(f"{n}_{c}") for k, n in (("j1", "a"), ("j2", "b")) for c in ("intensity", "passed")], *[F.max(F.when(F.col("judge") == k, F.col("naturalness") / 5.0)).alias(f"{n}_coverage") for k, n in (("j1", "a"), ("j2", "b"))])
    length = texts(spark, sf).select("run_id", F.col("character_length").alias("length"), F.lit(200).alias("length_min"), F.lit(2000).alias("length_max"))
    return own.join(ext, "run_id").join(j, "run_id", "left").join(length, "run_id", "left")


FAILSQL = """, fx0 AS (SELECT g.run_id, g.scenario_id, g.model_id, g.seed, g.ratio_idx, g.target_ratio, CASE WHEN g.separation > 1e-12 THEN g.projection_raw END AS own, v = a OR v = b AS at_end, CASE WHEN list_distance(a, b) > 1e-12 THEN (list_dot_product(v, b) - list_dot_product(v, a) - list_dot_product(a, b) + list_dot_product(a, a)) / list_distance(a, b) ** 2 END AS external FROM geo g JOIN points p USING (run_id) JOIN (SELECT x.vec_id // 2 AS n, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0) ON substr(g.scenario_id, 2)::BIGINT = n WHERE g.encoder_id = 'full'),
fx AS (SELECT fx0.*, abs(external - target_ratio) AS ee, a.intensity AS ai, b.intensity AS bi, a.passed AS ap, b.passed AS bp, a.naturalness / 5.0::DOUBLE AS ac, b.naturalness / 5.0::DOUBLE AS bc, character_length AS len FROM fx0 LEFT JOIN (SELECT run_id, intensity, passed, naturalness FROM jud WHERE judge = 'j1' AND NOT missing) a USING (run_id) LEFT JOIN (SELECT run_id, intensity, passed, naturalness FROM jud WHERE judge = 'j2' AND NOT missing) b USING (run_id) LEFT JOIN (SELECT run_id, character_length FROM txt) USING (run_id)),
fr AS (SELECT scenario_id, model_id, seed, CASE WHEN stddev_pop(y) > 1e-12 THEN corr(x, y) END AS rho, arg_min(run_id, (-ee, run_id)) AS run_id FROM (SELECT *, rank() OVER (PARTITION BY scenario_id, model_id, seed ORDER BY ratio_idx) AS x, """ + rank_sql("external", "scenario_id, model_id, seed") + """ AS y FROM fx WHERE ratio_idx BETWEEN 1 AND 5 AND external IS NOT NULL) GROUP BY ALL HAVING count(*) = 5),
fy AS (SELECT fx.*, rho, greatest(abs(ai / 100.0 - target_ratio), abs(bi / 100.0 - target_ratio)) AS mae, greatest(0, 200 - len) + greatest(0, len - 2000) AS outside FROM fx LEFT JOIN fr USING (run_id)),
sev AS (SELECT run_id, 'content_failure' AS category, 0 AS place, 2 - coalesce(ac, 1.0) - coalesce(bc, 1.0) AS severity FROM fy WHERE NOT coalesce(ap, true) OR NOT coalesce(bp, true) UNION ALL SELECT run_id, 'style_under_or_overshoot', 1, mae FROM fy WHERE mae >= 0.25 UNION ALL SELECT run_id, 'external_out_of_range', 2, greatest(-external, external - 1) FROM fy WHERE NOT at_end AND (external < 0 OR external > 1)
  UNION ALL SELECT run_id, 'non_monotonic', 3, 0.5 - rho FROM fy WHERE rho < 0.5 - 1e-12 UNION ALL SELECT run_id, 'length_violation', 4, outside FROM fy WHERE outside > 0 UNION ALL SELECT run_id, 'judge_disagreement', 5, abs(ai - bi) FROM fy WHERE abs(ai - bi) >= 25 UNION ALL SELECT run_id, 'anchor_disagreement', 6, abs(own - external) FROM fy WHERE abs(own - external) >= 0.25)"""


@query(FAILSQL + " SELECT run_id, category, round(severity, 5)::DOUBLE AS severity FROM sev")
def fa4_severities(spark, sf):
    s = failures.severities(failure_rows(spark, sf))
    return s.select("run_id", "category", F.round("severity", 5).alias("severity"))


@query()
def fa5_picked_cases(spark, sf):
    return rounded(failures.picked_cases(failures.severities(failure_rows(spark, sf))))


# --- serving

@query("WITH w AS (SELECT event_type AS model_id, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1) SELECT event_type AS model_id, count(*) AS n, round(sum(user_id) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS tokens_per_second, round(avg(user_id / (value + 1)), 6) AS mean_request_rate, sum(user_id)::BIGINT AS tokens, sum(event_id % 3)::BIGINT AS retries, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, CASE WHEN event_type < 'p' THEN 'g1' ELSE 'g2' END AS comparison_group FROM events GROUP BY event_type", plain=True)
def ef3_throughput(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("model_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") + 1).alias("seconds"), "value", F.col("user_id").alias("output_tokens"), (F.col("event_id") % 3).alias("retries"))
    groups = spark.createDataFrame([("click", "g1"), ("error", "g1"), ("purchase", "g2"), ("signup", "g2"), ("view", "g2")], "model_id string, comparison_group string")
    t = serving.throughput(e, groups, "value")
    return t.select("model_id", "n", F.round("tokens_per_second", 9).alias("tokens_per_second"), F.round("mean_request_rate", 6).alias("mean_request_rate"), "tokens", "retries", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "comparison_group")


@query("WITH c AS (SELECT user_id, user_id % 5 AS g, round(avg(value), 4) AS a, count(*) AS b FROM events GROUP BY 1) SELECT user_id, g FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.g = x.g AND y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))", plain=True)
def ef4_pareto_in_groups(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("a"), F.count(F.lit(1)).alias("b")).withColumn("g", F.col("user_id") % 5)
    return serving.pareto(c, "a", "b", ["g"]).select("user_id", "g")
