"""Anchor protocols, robustness designs, method tables and model statistics over the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from axisgauge.functions.numeric import spearman
from axisgauge.operators import audit, baselines, geometry, judges, ladder, protocols, reports, robustness, statistics, textq
from axisgauge.plans.calibration_queries import FOLDS, HELD, LINE_METRICS, LOSO, PIECE_METRICS, cells, isotonic_sql, rounded, scenario
from axisgauge.plans.fixtures import MATCHED, PROTOCOLS, ROBUST, WITH, boot, corr_sql, draw, draws_sql, external, flips_sql, matched_runs, once, pair_id, points, protocol_samples, rank_sql, robust, samples, scores, table, texts

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if plain else WITH + sql
        return f

    return add


METRICS, OTHERS = protocols.METRICS, ["pooled", "external"]


def protocol_scenarios(spark, sf, encoders=True):
    return once(protocols.scenario_rows(protocols.trajectories(protocol_samples(spark, sf, encoders))))


def r(*names, d=6):
    return ", ".join(f"round({n}, {d}) + 0.0 AS {n}" for n in names)


@query(PROTOCOLS + f" SELECT scenario_id, style_axis, model_id, encoder_id, protocol, {r(*METRICS, 'separation')}, trajectories, trajectories AS complete_trajectories, trajectories * 5 AS valid_points FROM ps")
def an1_protocol_scenarios(spark, sf):
    return rounded(protocol_scenarios(spark, sf).drop("unstable"))


@query(PROTOCOLS + boot("ps", ["encoder_id", "protocol", "model_id"], [*METRICS, "separation"]) + f", z AS (SELECT encoder_id, protocol, model_id, count(DISTINCT scenario_id) AS scenarios, sum(trajectories)::BIGINT AS trajectories, round(avg(ice), 12) AS i FROM ps GROUP BY ALL), z2 AS (SELECT *, {rank_sql('i', 'encoder_id, protocol')} AS ice_rank FROM z) SELECT bt.*, scenarios, trajectories, trajectories AS complete_trajectories, trajectories * 5 AS valid_points, trajectories * 5 AS expected_points, 0::BIGINT AS collapsed, ice_rank FROM bt JOIN z2 USING (encoder_id, protocol, model_id)")
def an1_protocol_summary(spark, sf):
    return rounded(protocols.model_summary(protocol_scenarios(spark, sf)))


@query(PROTOCOLS + ", dd AS (SELECT scenario_id, style_axis, model_id, encoder_id, p.protocol, " + ", ".join(f"p.{m} - s.{m} AS {m}" for m in METRICS) + " FROM ps p JOIN ps s USING (scenario_id, style_axis, model_id, encoder_id) WHERE s.protocol = 'self' AND p.protocol <> 'self')"
       + boot("dd", ["encoder_id", "model_id", "protocol"], METRICS) + ", sd AS (" + " UNION ALL ".join(f"SELECT encoder_id, model_id, protocol, '{m}' AS metric, avg({m}) / nullif(stddev_samp({m}), 0) AS dz FROM dd GROUP BY ALL" for m in METRICS) + "), pp AS (SELECT encoder_id, model_id, protocol, 'ice' AS metric, (1 + count(*) FILTER (abs(f) >= abs(m) - 1e-15)) / 100001.0 AS p FROM (SELECT encoder_id, model_id, protocol, b, avg(ice * "
       + flips_sql("scenario_id") + ") AS f, avg(ice) AS m FROM dd, range(0, 100000) r(b) WHERE encoder_id = 'full' AND protocol = 'external' GROUP BY ALL) GROUP BY ALL), hh AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, encoder_id, model_id) + 1) * p AS q, row_number() OVER (ORDER BY p, encoder_id, model_id) AS k FROM pp) "
       "SELECT bt.*, round(dz, 6) + 0.0 AS dz, round(p, 6) AS p_value, CASE WHEN p IS NOT NULL THEN round(least(1.0, max(q) OVER (PARTITION BY p IS NULL ORDER BY k)), 6) END AS p_holm FROM bt JOIN sd USING (encoder_id, model_id, protocol, metric) LEFT JOIN hh USING (encoder_id, model_id, protocol, metric)")
def an2_protocol_differences(spark, sf):
    sure = (F.col("encoder_id") == "full") & (F.col("metric") == "ice") & (F.col("protocol") == "external")
    return rounded(protocols.against_self(protocol_scenarios(spark, sf), OTHERS, sure))


@query(PROTOCOLS + f", m AS (SELECT encoder_id, protocol, model_id, round(avg(ice), 12) AS y FROM ps GROUP BY ALL), b AS (SELECT m.encoder_id, m.protocol, m.model_id, s.y AS x, m.y, {rank_sql('s.y', 'm.encoder_id, m.protocol')} AS rx, {rank_sql('m.y', 'm.encoder_id, m.protocol')} AS ry FROM m JOIN m s USING (encoder_id, model_id) WHERE s.protocol = 'self' AND m.protocol <> 'self'), k AS (SELECT a.encoder_id, a.protocol, sum(sign(a.x - c.x) * sign(a.y - c.y)) / nullif(sqrt(count(*) FILTER (a.x <> c.x) * count(*) FILTER (a.y <> c.y)), 0) AS kendall, count(*) FILTER (sign(a.x - c.x) <> sign(a.y - c.y)) AS flips, count(*) AS pairs FROM b a JOIN b c USING (encoder_id, protocol) WHERE a.model_id < c.model_id GROUP BY ALL) SELECT encoder_id, protocol, count(*) AS models, CASE WHEN count(*) >= 3 THEN {corr_sql('rx', 'ry')} END AS spearman, CASE WHEN count(*) >= 3 THEN round(any_value(kendall), 6) + 0.0 END AS kendall, any_value(flips) AS flips, any_value(pairs) AS pairs FROM b LEFT JOIN k USING (encoder_id, protocol) GROUP BY ALL")
def an3_rank_sensitivity(spark, sf):
    m = protocol_scenarios(spark, sf).groupBy("encoder_id", "protocol", "model_id").agg(F.round(F.avg("ice"), 12).alias("ice"))  # equal but for rounding: ties
    return rounded(protocols.rank_sensitivity(m, OTHERS))


def references(spark, sf):
    """Documents 2n and 2n + 1 as the references of scenario n at A and B, judged by hash draws, a few not at all."""
    d = table(spark, sf, "documents")
    h = draw("ref", "doc_id")
    near = F.when(F.col("doc_id") % 2 == 0, 10).otherwise(60) + F.pmod(h, F.lit(41)).cast("int") - 10
    seen = F.pmod(h, F.lit(23)) > 0
    return d.select(pair_id("doc_id").alias("scenario_id"), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("endpoint"), F.char_length("text").alias("length"), F.when(seen, F.pmod(h, F.lit(7)) > 1).alias("passed"), F.when(seen, near).alias("intensity"))


REF = """, rh AS (SELECT doc_id, length(text) AS len, ('0x' || substr(md5('ref:' || doc_id), 1, 8))::BIGINT AS h FROM documents),
rr AS (SELECT 's' || lpad((doc_id // 2)::VARCHAR, greatest(4, length((doc_id // 2)::VARCHAR))::INT, '0') AS scenario_id, doc_id % 2 AS e, len, CASE WHEN h % 23 > 0 THEN h % 7 > 1 END AS ok, CASE WHEN h % 23 > 0 THEN 10 + 50 * (doc_id % 2) + h % 41 - 10 END AS i FROM rh),
rp AS (SELECT scenario_id, a.len AS length_a, b.len AS length_b, a.ok AS passed_a, b.ok AS passed_b, a.i AS intensity_a, b.i AS intensity_b, b.i - a.i AS style_span, coalesce(a.ok, false) AND coalesce(b.ok, false) AS both_content_pass, coalesce(a.len BETWEEN 200 AND 2000, false) AND coalesce(b.len BETWEEN 200 AND 2000, false) AS both_length_pass, a.i IS NOT NULL AND b.i IS NOT NULL AS both_screened FROM (SELECT * FROM rr WHERE e = 0) a FULL JOIN (SELECT * FROM rr WHERE e = 1) b USING (scenario_id))"""


@query(REF + " SELECT * FROM rp")
def an6_reference_pairs(spark, sf):
    p = protocols.reference_pairs(references(spark, sf), 200, 2000)
    return p.select("scenario_id", "length_a", "length_b", "passed_a", "passed_b", *[F.col(c).cast("long").alias(c) for c in ("intensity_a", "intensity_b", "style_span")], "both_content_pass", "both_length_pass", "both_screened")


@query(REF + " SELECT (SELECT count(*) FROM rr) AS texts, (SELECT count(i) FROM rr) AS judged, (SELECT count(*) - count(i) FROM rr) AS unjudged, (SELECT round(avg((len BETWEEN 200 AND 2000)::INT), 6) FROM rr) AS length_pass_rate, (SELECT round(avg(ok::INT), 6) FROM rr) AS content_pass_rate, count(*) AS pairs, count(*) FILTER (both_length_pass) AS both_length_pass, count(*) FILTER (both_content_pass) AS both_content_pass, count(*) FILTER (both_screened) AS both_screened, round(avg(style_span), 6) AS span_mean, round(quantile_cont(style_span, 0.5), 6)::DOUBLE AS span_median, count(*) FILTER (style_span <= 0) AS nonpositive_spans FROM rp")
def an6_reference_summary(spark, sf):
    ref = references(spark, sf)
    return rounded(protocols.reference_summary(ref, protocols.reference_pairs(ref, 200, 2000), 200, 2000))


@query(PROTOCOLS + REF + ", x AS (SELECT ps.*, coalesce(both_content_pass, false) AS ok FROM ps LEFT JOIN rp USING (scenario_id) WHERE protocol = 'external'), y AS (SELECT *, 'all_pairs' AS subset FROM x UNION ALL SELECT *, 'both_pass' FROM x WHERE ok)" + boot("y", ["encoder_id", "model_id", "subset"], ["ice"]) + " SELECT bt.* EXCLUDE metric, denominator FROM bt JOIN (SELECT encoder_id, model_id, count(DISTINCT scenario_id) AS denominator FROM x GROUP BY ALL) USING (encoder_id, model_id)")
def an4_content_pass_subset(spark, sf):
    ext = protocol_scenarios(spark, sf).where("protocol = 'external'")
    return rounded(protocols.content_pass_subset(ext, protocols.reference_pairs(references(spark, sf), 200, 2000)))


def judge_scenarios(spark, sf):
    s = scores(spark, sf).where("not missing and ratio_idx between 1 and 5").withColumn("e", F.abs(F.col("intensity") / 100.0 - F.col("target_ratio")))
    at = lambda j, c: F.avg(F.when(F.col("judge") == j, F.col(c).cast("double")))
    return s.groupBy("scenario_id", "style_axis", "model_id").agg(*[at(j, c).alias(f"{j}_{n}") for j in ("j1", "j2") for n, c in (("mae", "e"), ("naturalness", "naturalness"), ("pass", "passed"))])


FAMILY = ["ice", "drift", "distance", "oor", "j1_mae", "j1_naturalness", "j1_pass", "j2_mae", "j2_naturalness", "j2_pass"]
JSCEN = ", js AS (SELECT scenario_id, style_axis, model_id, " + ", ".join(f"avg(abs(intensity / 100.0 - target_ratio)) FILTER (judge = '{j}') AS {j}_mae, avg(naturalness) FILTER (judge = '{j}') AS {j}_naturalness, avg(passed::INT) FILTER (judge = '{j}') AS {j}_pass" for j in ("j1", "j2")) + " FROM jud WHERE NOT missing AND ratio_idx BETWEEN 1 AND 5 GROUP BY ALL)"


@query(PROTOCOLS + JSCEN + ", cf AS (SELECT * FROM ps LEFT JOIN js USING (scenario_id, style_axis, model_id) WHERE encoder_id = 'full' AND protocol <> 'pooled')" + boot("cf", ["model_id", "protocol"], FAMILY) + " SELECT bt.*, denominator FROM bt JOIN (SELECT model_id, protocol, count(DISTINCT scenario_id) AS denominator FROM cf GROUP BY ALL) USING (model_id, protocol)")
def an5_cross_family(spark, sf):
    s = protocol_scenarios(spark, sf, False).where("protocol in ('self', 'external')")
    return rounded(protocols.cross_family(s, judge_scenarios(spark, sf), FAMILY))


@query(PROTOCOLS + " SELECT protocol, model_id, count(*) AS n, 0::BIGINT AS collapsed, round(avg(ice) FILTER (is_interior), 6) AS ice, 0.0::DOUBLE AS epsilon_difference FROM pg WHERE encoder_id = 'full' GROUP BY ALL")
def ge12_protocol_samples(spark, sf):
    """Self, pooled and external protocols side by side."""
    return rounded(protocols.epsilon_table(protocol_samples(spark, sf, False)))


def conditioned(spark, sf):
    grid = F.explode(F.array(*[F.lit(c) for c in robustness.CONDITIONS])).alias("condition")
    return points(spark, sf).where("ratio_idx between 1 and 5").select("*", grid)


@query(PROTOCOLS + " SELECT condition, CASE protocol WHEN 'self' THEN 'baseline_self' ELSE protocol END AS protocol, model_id, count(*) AS n, round(avg(ice), 6) AS ice, round(avg(drift), 6) AS drift FROM pg, (VALUES ('p1_high'), ('p1_low'), ('p2_high'), ('p2_low')) c(condition) WHERE is_interior AND encoder_id = 'full' GROUP BY ALL")
def ge13_robustness_protocols(spark, sf):
    """Robustness outputs under external, pooled and the main runs' own anchors."""
    p, main = conditioned(spark, sf), points(spark, sf)
    sets = {"external": (external(spark, sf), ["scenario_id", "encoder_id"]), "pooled": (geometry.pooled_anchors(main, ["scenario_id", "encoder_id"]), ["scenario_id", "encoder_id"]), "baseline_self": (geometry.self_anchors(main, ["scenario_id", "model_id", "seed", "encoder_id"]), ["scenario_id", "model_id", "seed", "encoder_id"])}
    out = None
    for name, (anchors, by) in sets.items():
        part = geometry.with_geometry(p, anchors, by).withColumn("protocol", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out.groupBy("condition", "protocol", "model_id").agg(F.count(F.lit(1)).alias("n"), F.avg("projection_error_raw").alias("ice"), F.avg("off_axis_drift_normalized").alias("drift")))


# --- robustness

RM = ["style_mae", "naturalness", "content_pass", "character_length"]
TEMPLATES = {"P1": "P1", "P2": "P2"}


def robust_sample(spark, sf):
    return robustness.sample(*robust(spark, sf), ["run_id"], TEMPLATES)


def robust_cells(spark, sf):
    return once(robustness.cells(robust_sample(spark, sf), RM, [*robustness.KEYS, "target_ratio", "condition"]))


@query(ROBUST + f" SELECT scenario_id, style_axis, model_id, round(target_ratio, 6) AS target_ratio, condition, outputs, {r(*RM)} FROM rcell")
def rb1_robustness_cells(spark, sf):
    return rounded(robust_cells(spark, sf))


def effect_sql(source: str, metrics: list[str], keys: str, more: str = "") -> str:
    """Long effects by keys and metric from cells with a condition column."""
    v = lambda m: [f"max({m}) FILTER (condition = '{c}')" for c in robustness.CONDITIONS]
    one = lambda m: f"SELECT {keys}, '{m}' AS metric, ({v(m)[2]} + {v(m)[3]} - {v(m)[0]} - {v(m)[1]}) / 2 AS prompt_effect, ({v(m)[1]} + {v(m)[3]} - {v(m)[0]} - {v(m)[2]}) / 2 AS temperature_effect, ({v(m)[3]} - {v(m)[2]}) - ({v(m)[1]} - {v(m)[0]}) AS interaction{more} FROM {source} GROUP BY {keys} HAVING count({m}) = 4"
    return " UNION ALL ".join(one(m) for m in metrics)


EFF = robustness.EFFECTS
MEAN_EFF = ", ".join(f"avg({e}) AS {e}" for e in EFF)
DZ = lambda src, by: " UNION ALL ".join(f"SELECT {by}, '{e}' AS effect, avg({e}) / nullif(stddev_samp({e}), 0) AS dz FROM {src} GROUP BY {by}" for e in EFF)


@query(ROBUST + ", e0 AS (" + effect_sql("rcell", RM, "scenario_id, style_axis, model_id, target_ratio") + f"), e1 AS (SELECT scenario_id, style_axis, model_id, metric AS m, {MEAN_EFF} FROM e0 GROUP BY ALL), e2 AS (SELECT scenario_id, style_axis, 'all_models' AS scope, m, {MEAN_EFF} FROM e1 GROUP BY ALL), e3 AS (SELECT scope, 'all' AS axis, scenario_id, style_axis, m, prompt_effect, temperature_effect, interaction FROM e2 UNION ALL SELECT model_id, 'all', scenario_id, style_axis, m, prompt_effect, temperature_effect, interaction FROM e1 UNION ALL SELECT model_id, style_axis, scenario_id, style_axis, m, prompt_effect, temperature_effect, interaction FROM e1)"
       + boot("e3", ["scope", "axis", "m"], EFF) + f", dz AS ({DZ('e3', 'scope, axis, m')}) SELECT scope, axis AS style_axis, m AS metric, metric AS effect, estimate, ci_lower, ci_upper, n, round(dz, 6) + 0.0 AS dz FROM bt JOIN dz USING (scope, axis, m) WHERE bt.metric = dz.effect")
def rb2_factorial_effects(spark, sf):
    return rounded(robustness.factorial_summary(robust_cells(spark, sf), RM))


@query(ROBUST + f", cm AS (SELECT model_id, condition, {', '.join(f'round(avg({m}), 12) AS {m}' for m in RM)} FROM rcell GROUP BY ALL), l AS (UNPIVOT cm ON {', '.join(RM)} INTO NAME metric VALUE value), p AS (SELECT a.metric, a.condition AS first, b.condition AS second, {rank_sql('a.value', 'a.metric, a.condition, b.condition')} AS x, {rank_sql('b.value', 'a.metric, a.condition, b.condition')} AS y FROM l a JOIN l b USING (metric, model_id) WHERE a.condition < b.condition) SELECT metric, first, second, count(*) AS models, {corr_sql('x', 'y')} AS spearman FROM p GROUP BY ALL")
def rb3_condition_rankings(spark, sf):
    return rounded(robustness.condition_ranks(robust_cells(spark, sf), RM)[1])


MM = ["external_ice", "judge_mae"]


def matched_sample(spark, sf):
    g, mapping, s = matched_runs(spark, sf)
    return robustness.with_source_scores(g, mapping, s).withColumn("judge_mae", F.abs(F.col("intensity") / 100.0 - F.col("target_ratio")))


@query(PROTOCOLS + MATCHED + f" SELECT run_id, condition, {r(*MM)} FROM ms")
def rb4_source_scores(spark, sf):
    return rounded(matched_sample(spark, sf).select("run_id", "condition", *MM))


def matched_cells(spark, sf):
    return once(robustness.cells(matched_sample(spark, sf), MM, [*robustness.KEYS, "condition"]))


@query(PROTOCOLS + MATCHED + f" SELECT scenario_id, style_axis, model_id, condition, outputs, {r(*MM)} FROM mc")
def rb5_condition_cells(spark, sf):
    return rounded(matched_cells(spark, sf))


@query(PROTOCOLS + MATCHED + ", ma AS (SELECT condition, model_id, scenario_id, style_axis, external_ice, judge_mae FROM mc UNION ALL SELECT condition, 'ALL', scenario_id, style_axis, avg(external_ice), avg(judge_mae) FROM mc GROUP BY ALL)" + boot("ma", ["condition", "model_id"], MM) + " SELECT * FROM bt")
def rb6_condition_means(spark, sf):
    return rounded(robustness.condition_means(matched_cells(spark, sf), MM))


def matched_effects(spark, sf):
    return once(robustness.effects(matched_cells(spark, sf), robustness.KEYS, MM, 15))


MEFF = PROTOCOLS + MATCHED + ", me AS (" + effect_sql("mc", MM, "scenario_id, style_axis, model_id", ", bool_and(outputs = 15) AS complete") + ")"


@query(MEFF + f" SELECT scenario_id, style_axis, model_id, metric, {r(*EFF)}, complete FROM me")
def rb7_matched_effects(spark, sf):
    return rounded(matched_effects(spark, sf))


@query(MEFF + f", eq AS (SELECT scenario_id, style_axis, 'ALL' AS model_id, metric, {MEAN_EFF}, bool_and(complete) AS complete FROM me GROUP BY scenario_id, style_axis, metric HAVING count(*) = (SELECT count(DISTINCT model_id) FROM me)), s0 AS (SELECT scenario_id, style_axis, model_id, metric AS m, {', '.join(EFF)}, complete FROM me UNION ALL SELECT scenario_id, style_axis, model_id, metric, {', '.join(EFF)}, complete FROM eq), s1 AS (SELECT *, 'ALL' AS axis FROM s0 UNION ALL SELECT *, style_axis FROM s0)"
       + boot("s1", ["model_id", "axis", "m"], EFF) + f", dz AS ({DZ('s1', 'model_id, axis, m')}), cs AS (SELECT model_id, axis, m, count(*) FILTER (complete) AS complete_scenarios FROM s1 GROUP BY ALL), lo AS (UNPIVOT (SELECT scenario_id, m, {', '.join(EFF)} FROM s0 WHERE model_id = 'ALL') ON {', '.join(EFF)} INTO NAME effect VALUE value), pp AS (SELECT m, effect, (1 + count(*) FILTER (abs(f) >= abs(a) - 1e-15)) / 100001.0 AS p FROM (SELECT m, effect, b, avg(value * " + flips_sql("scenario_id") + ") AS f, avg(value) AS a FROM lo, range(0, 100000) r(b) GROUP BY ALL) GROUP BY ALL), hh AS (SELECT *, row_number() OVER w AS k, (count(*) OVER (PARTITION BY m) - row_number() OVER w + 1) * p AS q FROM pp WINDOW w AS (PARTITION BY m ORDER BY p, effect)), h2 AS (SELECT m, effect, 'ALL' AS model_id, 'ALL' AS axis, round(p, 6) AS p_value, round(least(1.0, max(q) OVER (PARTITION BY m ORDER BY k)), 6) AS p_holm FROM hh) "
       "SELECT bt.model_id, bt.axis AS style_axis, bt.m AS metric, bt.metric AS effect, estimate, ci_lower, ci_upper, n, round(dz, 6) + 0.0 AS dz, complete_scenarios, p_value, p_holm FROM bt JOIN dz ON dz.model_id = bt.model_id AND dz.axis = bt.axis AND dz.m = bt.m AND dz.effect = bt.metric JOIN cs ON cs.model_id = bt.model_id AND cs.axis = bt.axis AND cs.m = bt.m LEFT JOIN h2 ON h2.model_id = bt.model_id AND h2.axis = bt.axis AND h2.m = bt.m AND h2.effect = bt.metric")
def rb8_effect_summary(spark, sf):
    return rounded(robustness.effect_summary(matched_effects(spark, sf), MM))


# --- statistics over models

SCEN = ", sc AS (SELECT scenario_id, style_axis, model_id, encoder_id, ice, drift, separation FROM scen)"


def short(spark, sf, encoders=True):
    return once(scenario(spark, sf, encoders)).select("scenario_id", "style_axis", "model_id", "encoder_id", F.col("interior_calibration_error").alias("ice"), F.col("normalized_off_axis_drift").alias("drift"), F.col("endpoint_separation").alias("separation"))


def weighted_rank_sql(c: str) -> str:
    return f"sum(times) OVER (PARTITION BY encoder_id, b ORDER BY {c}) - sum(times) OVER (PARTITION BY encoder_id, b, {c}) + (sum(times) OVER (PARTITION BY encoder_id, b, {c}) + 1) / 2.0 AS {c}"


def weighted_corr_sql(x: str, y: str) -> str:
    s = lambda u, v: f"(sum(times * {u} * {v}) - sum(times * {u}) * sum(times * {v}) / sum(times))"
    return f"{s(x, y)} / nullif(sqrt({s(x, x)} * {s(y, y)}), 0)"


NINE = SCEN + ", " + draws_sql("sc", "nd") + f", al AS (SELECT sc.*, 0 AS b, 1 AS times FROM sc UNION ALL SELECT sc.*, b, times FROM sc JOIN nd_r USING (style_axis, scenario_id)), rk AS (SELECT encoder_id, b, times, {', '.join(map(weighted_rank_sql, ('ice', 'drift', 'separation')))} FROM al), cr AS (SELECT encoder_id, b, {weighted_corr_sql('separation', 'ice')} AS c1, {weighted_corr_sql('separation', 'drift')} AS c2, {weighted_corr_sql('ice', 'drift')} AS c3 FROM rk GROUP BY ALL), nine AS (" + " UNION ALL ".join(f"SELECT encoder_id, '{x}' AS x, '{y}' AS y, max({c}) FILTER (b = 0) AS estimate, quantile_cont({c}, 0.025) FILTER (b > 0) AS ci_lower, quantile_cont({c}, 0.975) FILTER (b > 0) AS ci_upper FROM cr GROUP BY encoder_id" for c, x, y in (("c1", "separation", "ice"), ("c2", "separation", "drift"), ("c3", "ice", "drift"))) + ")"


@query(NINE + f" SELECT encoder_id, x, y, {r('estimate', 'ci_lower', 'ci_upper')} FROM nine")
def st9_bootstrap_spearman(spark, sf):
    return rounded(statistics.bootstrap_spearman(short(spark, sf), ["encoder_id"], [("separation", "ice"), ("separation", "drift"), ("ice", "drift")], "style_axis", "scenario_id"))


@query(NINE + ", h AS (SELECT *, ice - ice * (5.0::DOUBLE / 7.0::DOUBLE) AS difference FROM sc)" + boot("h", ["encoder_id", "model_id"], ["difference"]) + f" SELECT 'H1' AS hypothesis, encoder_id, model_id, 'interior minus all points' AS test, estimate, ci_lower, ci_upper, supported FROM bt JOIN (SELECT encoder_id, model_id, bool_and(difference > 0) AS supported FROM h GROUP BY ALL) USING (encoder_id, model_id) UNION ALL SELECT CASE WHEN x = 'separation' THEN 'H2' ELSE 'H5' END, encoder_id, NULL, x || ' vs ' || y, {r('estimate', 'ci_lower', 'ci_upper')}, CASE WHEN x = 'separation' THEN ci_upper < 0 ELSE ci_lower > 0 AND estimate < 0.8 END FROM nine")
def st10_hypotheses(spark, sf):
    return rounded(statistics.hypotheses(short(spark, sf)))


#: Sizes in billions of the fixture's models: all, active, family.
SIZES = [("m0", 4.0, 4.0, "f1"), ("m1", 9.0, 9.0, "f1"), ("m2", 27.0, 27.0, "f1"), ("m3", 35.0, 3.0, "f2")]


def registry(spark):
    return spark.createDataFrame(SIZES, "model_id string, total double, active double, family_version string")


def scale_sql() -> str:
    values = ", ".join(f"('{m}', ln({t}), ln({a}), '{f}')" for m, t, a, f in SIZES)
    fit = lambda src, extra: " UNION ALL ".join(f"SELECT '{s}' AS scope, encoder_id, '{m}' AS metric, '{p}' AS predictor, {p} AS x, {m} AS y{extra} FROM {src} JOIN reg USING (model_id){w}" for s, w in (("all_models", ""), ("f1", " WHERE fam = 'f1'")) for m in ("ice", "drift") for p in ("total", "active"))
    return SCEN + f", reg(model_id, total, active, fam) AS (VALUES {values}), mm AS (SELECT encoder_id, model_id, avg(ice) AS ice, avg(drift) AS drift FROM sc GROUP BY ALL), " + draws_sql("sc", "nd") + f", bm AS (SELECT encoder_id, model_id, b, sum(times * ice) / sum(times) AS ice, sum(times * drift) / sum(times) AS drift FROM sc JOIN nd_r USING (style_axis, scenario_id) GROUP BY ALL), f0 AS ({fit('mm', '')}), f1 AS ({fit('bm', ', b')}), rk AS (SELECT *, {rank_sql('x', 'scope, encoder_id, metric, predictor')} AS rx, {rank_sql('y', 'scope, encoder_id, metric, predictor')} AS ry FROM f0), a AS (SELECT scope, encoder_id, metric, predictor, count(*) AS models, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, corr(rx, ry) AS spearman FROM rk GROUP BY ALL), s AS (SELECT scope, encoder_id, metric, predictor, b, regr_slope(y, x) AS s FROM f1 GROUP BY ALL), q AS (SELECT scope, encoder_id, metric, predictor, quantile_cont(s, 0.025) AS ci_lower, quantile_cont(s, 0.975) AS ci_upper FROM s GROUP BY ALL) SELECT scope, encoder_id, metric, predictor, models, {r('slope', 'r2', 'spearman', 'ci_lower', 'ci_upper')} FROM a JOIN q USING (scope, encoder_id, metric, predictor) WHERE models >= 3"


@query(scale_sql())
def st11_scale_regression(spark, sf):
    return rounded(statistics.scale_regression(short(spark, sf), registry(spark), ["ice", "drift"], ["total", "active"], "f1"))


@query(f", c AS (SELECT scenario_id, style_axis, model_id, target_ratio, avg(projection_raw) AS y FROM geo WHERE encoder_id = 'full' AND is_interior GROUP BY ALL) SELECT scenario_id, model_id, round(target_ratio, 6) AS target_ratio, round(y - avg(y) OVER (PARTITION BY scenario_id) - avg(y) OVER (PARTITION BY model_id) - avg(y) OVER (PARTITION BY target_ratio) + 2 * avg(y) OVER (), 6) + 0.0 AS residual FROM c WHERE scenario_id IN (SELECT scenario_id FROM c GROUP BY 1 HAVING count(*) = 20)")
def st14_fixed_effect_residuals(spark, sf):
    """Residuals on ratio, model and scenario; scenarios that have every model and ratio, where SQL has a closed form."""
    c = cells(spark, sf).where("is_interior").select("scenario_id", "style_axis", "model_id", "target_ratio", F.col("projection_raw").alias("y"))
    full = c.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("k")).where("k = 20").select("scenario_id")
    return rounded(statistics.fixed_effect_residual(c.join(full, "scenario_id"), "y", "scenario_id", ["target_ratio", "model_id"], "residual").select("scenario_id", "model_id", "target_ratio", "residual"))


def regression(spark, sf):
    keys = ["scenario_id", "style_axis", "model_id", "encoder_id", "target_ratio"]
    s = samples(spark, sf, True).where("is_interior").join(texts(spark, sf).select("run_id", "character_length"), "run_id", "left")
    c = s.groupBy(*keys).agg(F.avg("projection_error_raw").alias("y"), F.avg("separation").alias("separation"), F.avg("character_length").alias("length")).join(F.broadcast(registry(spark)), "model_id")  # a row for each model
    f2 = F.when(F.col("family_version") == "f2", 1.0).otherwise(0.0)
    terms = {"family_f2": f2, "log_active": F.ln("active"), "target_ratio": F.col("target_ratio"), "axis_a1": F.when(F.col("style_axis") == "a1", 1.0).otherwise(0.0), "encoder_hi": F.when(F.col("encoder_id") == "hi", 1.0).otherwise(0.0), "encoder_lo": F.when(F.col("encoder_id") == "lo", 1.0).otherwise(0.0), "separation": F.col("separation"), "length": F.col("length") / 1000.0, "family_f2:target_ratio": f2 * F.col("target_ratio")}
    return statistics.clustered_ols(c, "y", terms, "scenario_id")


@query()
def st18_clustered_ols(spark, sf):
    return rounded(regression(spark, sf)[0])


@query()
def st19_variance_diagnostics(spark, sf):
    figures = regression(spark, sf)[1]
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in figures.items()], "figure string, value double"))


# --- method tables, ablations, legacy

@query(", " + FOLDS.replace("t AS (SELECT txt.*, fold FROM txt JOIN f USING (scenario_id))", "t AS (SELECT g.*, fold, txt.character_length FROM geo g JOIN f USING (scenario_id) LEFT JOIN txt USING (run_id) WHERE encoder_id = 'full')") +
       ", lj AS (SELECT x.model_id, y.fold, regr_slope(x.target_ratio, x.character_length) AS s, regr_intercept(x.target_ratio, x.character_length) AS i, avg(x.character_length) AS c, avg(x.target_ratio) AS m FROM t x, (SELECT DISTINCT fold FROM t) y WHERE x.fold <> y.fold AND x.character_length IS NOT NULL GROUP BY ALL), li AS (SELECT model_id, fold, coalesce(s, m * c / (1 + c * c)) AS s, coalesce(i, m / (1 + c * c)) AS i FROM lj), " + isotonic_sql("t", "projection_raw", "iso") + ", es AS (SELECT t.*, i + s * character_length AS line, iso.estimate AS iso FROM t LEFT JOIN li USING (model_id, fold) LEFT JOIN iso USING (run_id) WHERE is_interior), lo AS (" +
       " UNION ALL ".join(f"SELECT scenario_id, style_axis, model_id, encoder_id, target_ratio, '{m}' AS method, {c} AS estimate FROM es" for m, c in (("raw_projection", "projection_raw"), ("endpoint_distance_ratio", "distance_ratio_estimate"), ("length_only_cv", "line"), ("isotonic_cv", "iso"), ("constant_half", "0.5::DOUBLE"))) + " UNION ALL SELECT scenario_id, style_axis, model_id, 'judge', target_ratio, 'llm_scalar_judge', intensity / 100.0 FROM jud WHERE judge = 'j1' AND NOT missing AND ratio_idx BETWEEN 1 AND 5), "
       "mc AS (SELECT scenario_id, style_axis, model_id, encoder_id, method, target_ratio, round(avg(estimate), 12) AS estimate, avg(abs(estimate - target_ratio)) AS e FROM lo GROUP BY ALL), mr AS (SELECT *, " + rank_sql("estimate", "scenario_id, model_id, encoder_id, method") + " AS ry, " + rank_sql("target_ratio", "scenario_id, model_id, encoder_id, method") + " AS rx FROM mc WHERE estimate IS NOT NULL), "
       "sr AS (SELECT scenario_id, style_axis, model_id, encoder_id, method, avg(e) AS mae, quantile_cont(e, 0.5) AS median_error, CASE WHEN stddev_pop(estimate) > 1e-12 THEN corr(rx, ry) END AS spearman, CASE WHEN stddev_pop(estimate) > 1e-12 THEN corr(target_ratio, estimate) END AS pearson, regr_slope(estimate, target_ratio) AS slope, regr_intercept(estimate, target_ratio) AS intercept FROM mr GROUP BY ALL)" + boot("sr", ["model_id", "encoder_id", "method"], baselines.STATISTICS) + " SELECT * FROM bt")
def ag11_method_table(spark, sf):
    """Five methods on seed-level rows, the isotonic one on coordinates, and a judge's own estimates."""
    s = samples(spark, sf).join(baselines.scenario_folds(points(spark, sf)), ["scenario_id", "style_axis"]).join(texts(spark, sf).select("run_id", F.col("character_length").cast("double").alias("character_length")), "run_id", "left").withColumn("half", F.lit(0.5))
    s = baselines.cross_validated_isotonic(once(s), ["model_id", "encoder_id"], "projection_raw", "target_ratio", "iso")
    s = baselines.cross_validated_line(s, ["model_id"], "character_length", "target_ratio", "line").where("is_interior")
    judged = scores(spark, sf).where("judge = 'j1' and not missing and ratio_idx between 1 and 5").withColumn("estimate", F.col("intensity") / 100.0)
    methods = {"raw_projection": "projection_raw", "endpoint_distance_ratio": "distance_ratio_estimate", "length_only_cv": "line", "isotonic_cv": "iso", "constant_half": "half"}
    return rounded(baselines.method_table(s, methods, judged))


LOSO_METRICS = [*LINE_METRICS, *PIECE_METRICS]


@query(LOSO + f", lj AS (SELECT {HELD}, {', '.join(LOSO_METRICS)} FROM lp JOIN lw USING ({HELD}))" + boot("lj", ["model_id", "encoder_id"], LOSO_METRICS) + " SELECT * FROM bt")
def ag8_seed_transfer(spark, sf):
    """Leave-one-seed-out rows of line, centroids and piecewise line averaged by scenario, then by model and encoder with intervals."""
    p, by = once(points(spark, sf, True)), ["scenario_id", "style_axis", "model_id", "encoder_id"]
    rows = geometry.leave_one_seed_out(p, by).join(geometry.piecewise_line(p, by), [*by, "held_seed"])
    return rounded(statistics.bootstrap_means(rows, ["model_id", "encoder_id"], LOSO_METRICS, "style_axis", "scenario_id"))


@query(", mo AS (SELECT model_id, round(avg(i) FILTER (encoder_id IN ('full', 'lo')), 12) AS two, round(avg(i), 12) AS three FROM (SELECT model_id, encoder_id, avg(ice) AS i FROM scen GROUP BY ALL) GROUP BY ALL) SELECT model_id, round(two, 6) AS two_mean, round(three, 6) AS three_mean, round(three - two, 6) + 0.0 AS difference, rank() OVER (ORDER BY two)::INT AS two_rank, rank() OVER (ORDER BY three)::INT AS three_rank FROM mo")
def ag9_two_and_three_encoders(spark, sf):
    return rounded(ladder.two_and_three(short(spark, sf), ["full", "lo"], "ice"))


@query(f", m AS (SELECT encoder_id, model_id, round(avg(ice), 12) AS ice, round(avg(drift), 12) AS drift FROM scen GROUP BY ALL), l AS (UNPIVOT m ON ice, drift INTO NAME metric VALUE v), p AS (SELECT a.encoder_id AS encoder_a, b.encoder_id AS encoder_b, metric, {rank_sql('a.v', 'a.encoder_id, b.encoder_id, metric')} AS x, {rank_sql('b.v', 'a.encoder_id, b.encoder_id, metric')} AS y FROM l a JOIN l b USING (model_id, metric) WHERE a.encoder_id < b.encoder_id) SELECT encoder_a, encoder_b, metric, count(*) AS models, {corr_sql('x', 'y')} AS spearman FROM p GROUP BY ALL")
def ag9_encoder_spearman(spark, sf):
    m = short(spark, sf).groupBy("encoder_id", "model_id").agg(F.round(F.avg("ice"), 12).alias("ice"), F.round(F.avg("drift"), 12).alias("drift")).unpivot(["encoder_id", "model_id"], ["ice", "drift"], "metric", "v")
    a, b = m.select("metric", "model_id", F.col("encoder_id").alias("encoder_a"), F.col("v").alias("x")), m.select("metric", "model_id", F.col("encoder_id").alias("encoder_b"), F.col("v").alias("y"))
    both, by = a.join(b, ["metric", "model_id"]).where("encoder_a < encoder_b"), ["encoder_a", "encoder_b", "metric"]
    return rounded(both.groupBy(*by).agg(F.count(F.lit(1)).alias("models")).join(spearman(both, "x", "y", by, "spearman"), by, "left"))


VIOL = ", vi AS (SELECT g.*, l.violation FROM geo g LEFT JOIN (SELECT run_id, character_length NOT BETWEEN 200 AND 2000 AS violation FROM txt WHERE run_id % 5 <> 0) l USING (run_id) WHERE encoder_id = 'full' AND is_interior)"


@query(VIOL + " SELECT rule, model_id, count(*) AS n, round(avg(projection_error_clipped), 6) AS mae, round(avg(projection_clipped - target_ratio), 6) + 0.0 AS bias FROM (SELECT *, 'strict' AS rule FROM vi WHERE NOT coalesce(violation, true) UNION ALL SELECT *, 'lenient' FROM vi WHERE NOT coalesce(violation, false)) GROUP BY ALL")
def ag20_length_compliant(spark, sf):
    """Errors of outputs of compliant length; those without a length row are left out (strict) or kept (lenient)."""
    lengths = texts(spark, sf).where("run_id % 5 != 0").select("run_id", (~F.col("character_length").between(200, 2000)).alias("violation"))
    return rounded(ladder.compliant(samples(spark, sf).where("is_interior").join(lengths, "run_id", "left"), "violation").groupBy("rule", "model_id").agg(F.count(F.lit(1)).alias("n"), F.avg("projection_error_clipped").alias("mae"), F.avg(F.col("projection_clipped") - F.col("target_ratio")).alias("bias")))


@query(", a AS (SELECT model_id, round(avg(projection_error_clipped), 6) AS mae, count(*) AS n FROM geo WHERE encoder_id = 'full' AND is_interior GROUP BY 1), b AS (SELECT model_id, round(avg(abs(intensity / 100.0 - target_ratio)), 6) AS judge_mae FROM jud WHERE judge = 'j1' AND NOT missing GROUP BY 1), c AS (SELECT model_id, round(avg((character_length NOT BETWEEN 200 AND 2000)::INT), 6) AS violation_rate FROM txt GROUP BY 1) SELECT * FROM a FULL JOIN b USING (model_id) FULL JOIN c USING (model_id)")
def ag21_model_comparison(spark, sf):
    p = samples(spark, sf).where("is_interior").groupBy("model_id").agg(F.avg("projection_error_clipped").alias("mae"), F.count(F.lit(1)).alias("n"))
    j = scores(spark, sf).where("judge = 'j1' and not missing").groupBy("model_id").agg(F.avg(F.abs(F.col("intensity") / 100.0 - F.col("target_ratio"))).alias("judge_mae"), F.count(F.lit(1)).alias("n"))
    t = texts(spark, sf).groupBy("model_id").agg(F.avg((~F.col("character_length").between(200, 2000)).cast("double")).alias("violation_rate"), F.count(F.lit(1)).alias("n"))
    return rounded(reports.wide_comparison([p, j, t], "model_id"))


@query(", x AS (SELECT style_axis, model_id, avg(ice) AS i FROM scen GROUP BY ALL) SELECT style_axis, " + ", ".join(f"round(max(i) FILTER (model_id = 'm{k}'), 6) AS m{k}" for k in range(4)) + " FROM x GROUP BY 1")
def ag21_axis_by_model(spark, sf):
    return rounded(short(spark, sf).groupBy("style_axis").pivot("model_id", [f"m{k}" for k in range(4)]).agg(F.avg("ice")))


@query(f", x AS (SELECT projection_raw AS a, intensity AS b FROM geo JOIN jud USING (run_id) WHERE encoder_id = 'full' AND is_interior AND judge = 'j1' AND NOT missing), y AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT count(*) AS n, {corr_sql('a', 'b')} AS pearson, {corr_sql('ra', 'rb')} AS spearman FROM y")
def ag25_judge_association(spark, sf):
    return rounded(reports.judge_association(samples(spark, sf).where("is_interior"), scores(spark, sf).where("judge = 'j1' and not missing"), "projection_raw", "intensity"))


@query(", l AS (SELECT i.run_id, 1 + count(*) FILTER (j.run_id <> i.run_id AND j.from_a ** 2 - 2 * i.target_ratio * j.along + (i.target_ratio * i.separation) ** 2 < i.from_a ** 2 - 2 * i.target_ratio * i.along + (i.target_ratio * i.separation) ** 2 - 1e-13) AS rank FROM geo i JOIN geo j USING (scenario_id, model_id, seed, encoder_id) WHERE encoder_id = 'full' GROUP BY ALL) SELECT run_id, round(projection_raw, 6) + 0.0 AS raw, round(projection_clipped, 6) + 0.0 AS clipped, round(interpolation_distance_normalized * (separation + 1e-12), 5) AS interpolation_distance, round(off_axis_drift_normalized * (separation + 1e-12), 5) AS off_axis_drift, rank, run_id - ratio_idx AS a_run_id, run_id - ratio_idx + 6 AS b_run_id FROM geo JOIN l USING (run_id) WHERE encoder_id = 'full'")
def ge1_legacy_projection(spark, sf):
    rows = geometry.legacy_projection(points(spark, sf))
    return rounded(rows.select("run_id", "raw", "clipped", F.round("interpolation_distance", 5).alias("interpolation_distance"), F.round("off_axis_drift", 5).alias("off_axis_drift"), "rank", "a_run_id", "b_run_id"))


@query("SELECT run_id, encoder_id, true AS ok, round(projection_raw, 6) + 0.0 AS projection_raw FROM geo")
def ge7_gated_samples(spark, sf):
    return rounded(geometry.gated_samples(samples(spark, sf, True)).select("run_id", "encoder_id", (F.col("residual") < 1e-6).alias("ok"), "projection_raw"))


@query("SELECT CASE WHEN count(*) FILTER (a % 10 <> 3 AND trim(ta) <> '' AND trim(tb) <> '') = count(*) THEN 'complete' ELSE 'pending' END AS status, count(*) FILTER (a % 10 <> 3 AND trim(ta) <> '' AND trim(tb) <> '') AS approved_pairs, count(*) AS required_pairs FROM (SELECT x.doc_id // 2 AS a, x.text AS ta, y.text AS tb FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 2 = 0)", plain=True)
def ge15_shared_anchor_gate(spark, sf):
    d = table(spark, sf, "documents")
    pairs = d.groupBy(F.expr("doc_id div 2").alias("n")).agg(F.max(F.when(F.col("doc_id") % 2 == 0, F.col("text"))).alias("ta"), F.max(F.when(F.col("doc_id") % 2 == 1, F.col("text"))).alias("tb")).where("ta is not null and tb is not null")
    return reports.gated(pairs, F.col("n") % 10 != 3, ["ta", "tb"])


@query(PROTOCOLS + ", s AS (SELECT scenario_id, style_axis, model_id, encoder_id, avg(ice) AS ice, avg(drift) AS drift, avg(distance) AS distance, avg(oor) AS oor, avg(separation) AS separation FROM pg WHERE protocol = 'external' AND is_interior GROUP BY ALL) SELECT scenario_id, style_axis, model_id, encoder_id, " + r("ice", "drift", "distance", "oor", "separation") + " FROM s")
def ge15_shared_scenarios(spark, sf):
    """Scenario metrics under shared references, which the gate lets through."""
    s = geometry.with_geometry(points(spark, sf, True), external(spark, sf, True), ["scenario_id", "encoder_id"]).where("is_interior")
    return rounded(s.groupBy("scenario_id", "style_axis", "model_id", "encoder_id").agg(F.avg("projection_error_raw").alias("ice"), F.avg("off_axis_drift_normalized").alias("drift"), F.avg("interpolation_distance_normalized").alias("distance"), F.avg(F.col("out_of_range").cast("double")).alias("oor"), F.avg("separation").alias("separation")))


ENDS = ", en AS (SELECT scenario_id, style_axis, model_id, seed, encoder_id, max(separation) AS separation, " + ", ".join(f"max(CASE WHEN ratio_idx = {k} THEN {c} END) AS {n}_{e}" for k, e in ((0, "a"), (6, "b")) for n, c in (("l", "character_length"), ("p", "passed::INT"), ("i", "intensity"), ("x", "(naturalness = 1)::INT"))) + " FROM geo g JOIN txt USING (run_id, scenario_id, style_axis, model_id, seed, ratio_idx, target_ratio) JOIN (SELECT run_id, intensity, passed, naturalness FROM jud WHERE judge = 'j1') USING (run_id) WHERE ratio_idx IN (0, 6) GROUP BY ALL), pt AS (SELECT model_id, encoder_id, separation, (l_b - l_a)::DOUBLE AS length_difference, abs(l_b - l_a)::DOUBLE AS length_absolute_difference, (p_a + p_b) / 2.0 AS pass_rate, greatest(x_a, x_b)::DOUBLE AS contradiction_any, (i_b - i_a)::DOUBLE AS judge_span, (abs(i_a / 100.0) + abs(i_b / 100.0 - 1)) / 2 AS judge_end_error FROM en WHERE l_a IS NOT NULL AND l_b IS NOT NULL)"
PT = ["separation", "length_difference", "length_absolute_difference", "pass_rate", "contradiction_any", "judge_span", "judge_end_error"]


@query(ENDS + " " + " UNION ALL ".join(f"SELECT model_id, encoder_id, '{m}' AS metric, round(avg({m}), 6) + 0.0 AS mean, round(quantile_cont({m}, 0.5), 6) + 0.0 AS median, round(quantile_cont({m}, 0.1), 6) + 0.0 AS p10, round(quantile_cont({m}, 0.9), 6) + 0.0 AS p90, count(*) AS pairs FROM pt GROUP BY ALL" for m in PT))
def ge18_pair_table(spark, sf):
    j = scores(spark, sf).where("judge = 'j1'").select("run_id", "intensity", "passed", (F.col("naturalness") == 1).alias("contradiction"), F.lit(1.0).alias("coverage"), F.lit(False).alias("task_changed"))
    ends = samples(spark, sf, True).where("ratio_idx in (0, 6)").join(texts(spark, sf).select("run_id", F.col("character_length").alias("length")), "run_id").join(j, "run_id")
    return rounded(reports.pair_table(reports.anchor_pair_diagnostics(ends, geometry.TRAJECTORY), ["model_id", "encoder_id"], PT))


@query(", pl AS (SELECT scenario_id, style_axis, model_id, seed, sum(d) / any_value(separation) AS path, count(*) FILTER (slope < 0) AS neg FROM (SELECT scenario_id, style_axis, model_id, seed, list_distance(v, lag(v) OVER w) AS d, separation, projection_raw - lag(projection_raw) OVER w AS slope FROM points JOIN (SELECT run_id, separation, projection_raw FROM geo WHERE encoder_id = 'full') USING (run_id) WINDOW w AS (PARTITION BY scenario_id, model_id, seed ORDER BY ratio_idx)) GROUP BY ALL)" + boot("pl", ["model_id"], ["path", "neg"]) + " SELECT * FROM bt")
def ge19_linearity_table(spark, sf):
    s = geometry.path_shape(points(spark, sf), samples(spark, sf))
    return rounded(statistics.bootstrap_means(s.select("scenario_id", "style_axis", "model_id", F.col("path_length_ratio").alias("path"), F.col("negative_slopes").alias("neg")), ["model_id"], ["path", "neg"], "style_axis", "scenario_id"))


@query(", gc AS (SELECT scenario_id, style_axis, model_id, round(target_ratio, 6) AS ratio, projection_raw AS p FROM geo WHERE encoder_id = 'full' AND is_interior)" + boot("gc", ["model_id", "ratio"], ["p"]) + " SELECT model_id, ratio, estimate, ci_lower, ci_upper, n FROM bt")
def ge21_scenario_curve(spark, sf):
    s = samples(spark, sf).where("is_interior").select("scenario_id", "style_axis", "model_id", F.round("target_ratio", 6).alias("ratio"), F.col("projection_raw").alias("p"))
    return rounded(statistics.bootstrap_means(s, ["model_id", "ratio"], ["p"], "style_axis", "scenario_id").drop("metric"))


@query(", reg(model_id, total, active, fam) AS (VALUES " + ", ".join(f"('{m}', {t}::DOUBLE, {a}::DOUBLE, '{f}')" for m, t, a, f in SIZES) + ") SELECT model_id, count(*) AS outputs, count(DISTINCT scenario_id) AS n_scenario_id, count(DISTINCT style_axis) AS n_style_axis, count(DISTINCT ratio_idx) AS n_target_ratio, count(DISTINCT seed) AS n_seed, round(avg(length(text)), 6) AS mean_length, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (length(text) > 2000) AS length_finished, any_value(total) AS total, any_value(active) AS active, any_value(fam) AS family_version FROM txt JOIN reg USING (model_id) GROUP BY ALL")
def id21_model_table(spark, sf):
    t = texts(spark, sf).withColumn("finish", F.when(F.col("character_length") > 2000, "length").otherwise("stop"))
    return rounded(reports.model_table(t, registry(spark), "text", "finish"))
