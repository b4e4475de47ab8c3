"""Geometry, baselines, aggregation and statistics over the fixture trajectories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.numeric import global_rank, r6, safe_corr, spearman
from axisgauge.operators import baselines, geometry, ladder, statistics
from axisgauge.plans.fixtures import WITH, boot, draws_sql, flips_sql, once, pair_id, points, samples, scores, texts

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
T = "scenario_id, style_axis, model_id, seed, encoder_id"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = WITH + sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


METRICS = ["projection_raw", "projection_error_raw", "projection_error_clipped", "off_axis_drift_normalized", "interpolation_distance_normalized", "out_of_range", "nearest_neighbor_rank", "separation", "distance_ratio_estimate"]


def cells(spark, sf, encoders=False):
    return baselines.seed_cells(samples(spark, sf, encoders), METRICS)


def scenario(spark, sf, encoders=False):
    return baselines.scenario_rows(once(cells(spark, sf, encoders)))


@query("SELECT model_id, count(*) AS n_points, round(avg(projection_error_raw), 6) AS mean_error FROM geo WHERE is_interior AND encoder_id = 'full' GROUP BY model_id")
def ge4_interior_error_by_model(spark, sf):
    s = geometry.with_geometry(points(spark, sf), geometry.self_anchors(points(spark, sf)), geometry.TRAJECTORY)
    return rounded(s.where("is_interior").groupBy("model_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg("projection_error_raw").alias("mean_error")))


@query("SELECT run_id, encoder_id, round(projection_raw, 6) + 0.0 AS projection_raw, round(projection_clipped, 6) + 0.0 AS projection_clipped, round(projection_error_raw, 6) AS error_raw, round(projection_error_clipped, 6) AS error_clipped, round(separation, 6) AS separation, out_of_range AND is_interior AS out_of_range FROM geo")
def ge2_self_anchored_geometry(spark, sf):
    p = points(spark, sf, True)
    s = geometry.with_geometry(p, geometry.self_anchors(p), geometry.TRAJECTORY)
    return rounded(s.select("run_id", "encoder_id", "projection_raw", "projection_clipped", F.col("projection_error_raw").alias("error_raw"), F.col("projection_error_clipped").alias("error_clipped"), "separation", (F.col("out_of_range") & F.col("is_interior")).alias("out_of_range")))


@query("SELECT run_id, round(off_axis_drift_normalized, 5) AS drift, round(interpolation_distance_normalized, 5) AS distance FROM geo WHERE is_interior AND encoder_id = 'full'")
def ge2_drift_and_distance(spark, sf):
    return samples(spark, sf).where("is_interior").select("run_id", (F.round("off_axis_drift_normalized", 5)).alias("drift"), F.round("interpolation_distance_normalized", 5).alias("distance"))


@query("""SELECT i.run_id, i.encoder_id, 1 + count(*) FILTER (j.run_id <> i.run_id AND j.from_a ** 2 - 2 * i.target_ratio * j.along + (i.target_ratio * i.separation) ** 2 < i.from_a ** 2 - 2 * i.target_ratio * i.along + (i.target_ratio * i.separation) ** 2 - 1e-13) AS closer_rank
FROM geo i JOIN geo j USING (scenario_id, model_id, seed, encoder_id) WHERE i.is_interior GROUP BY ALL""")
def ge3_nearest_neighbor_rank(spark, sf):
    return samples(spark, sf, True).where("is_interior").select("run_id", "encoder_id", F.floor("nearest_neighbor_rank").cast("long").alias("closer_rank"))


@query(f"SELECT {T}, count(*) AS points, round(avg(projection_error_raw), 6) AS ice, round(avg(projection_error_clipped), 6) AS ice_clipped, round(avg(off_axis_drift_normalized), 6) AS drift, round(avg(interpolation_distance_normalized), 6) AS distance, round(sqrt(avg(interpolation_distance_normalized ** 2)), 6) AS rms, round(avg(out_of_range::INT), 6) AS oor FROM geo WHERE is_interior GROUP BY ALL")
def ge4_interior_summary(spark, sf):
    s = geometry.interior_summary(samples(spark, sf, True))
    return rounded(s.select(*geometry.TRAJECTORY, F.col("interior_point_count").alias("points"), F.col("interior_calibration_error").alias("ice"), F.col("interior_calibration_error_clipped").alias("ice_clipped"), F.col("drift_mean").alias("drift"), F.col("distance_mean").alias("distance"), F.col("distance_rms").alias("rms"), F.col("out_of_range_rate").alias("oor")))


@query("""SELECT scenario_id, model_id, seed, round(sum(d) / any_value(separation), 6) AS path_length_ratio, round(max(turn), 4) AS turn_max, count(*) FILTER (slope < 0) AS negative_slopes FROM (
SELECT scenario_id, model_id, seed, ratio_idx, list_distance(v, lag(v) OVER w) AS d, separation, projection_raw - lag(projection_raw) OVER w AS slope,
  degrees(acos(greatest(-1, least(1, (list_dot_product(v, lag(v) OVER w) - list_dot_product(lag(v) OVER w, lag(v) OVER w) - list_dot_product(v, lag(v, 2) OVER w) + list_dot_product(lag(v) OVER w, lag(v, 2) OVER w)) / (list_distance(v, lag(v) OVER w) * list_distance(lag(v) OVER w, lag(v, 2) OVER w)))))) AS turn
FROM points JOIN (SELECT run_id, separation, projection_raw FROM geo WHERE encoder_id = 'full') USING (run_id) WINDOW w AS (PARTITION BY scenario_id, model_id, seed ORDER BY ratio_idx)) GROUP BY ALL""")
def ge5_path_shape(spark, sf):
    s = geometry.path_shape(points(spark, sf), samples(spark, sf))
    return s.select("scenario_id", "model_id", "seed", F.round("path_length_ratio", 6).alias("path_length_ratio"), F.round("turn_max", 4).alias("turn_max"), "negative_slopes")


K = "scenario_id, style_axis, model_id, seed, encoder_id"
SQUARE = "list_transform(range(0, 49), lambda m: list_sum(list_transform(range(0, 7), lambda t: p[m // 7 * 7 + t + 1] * p[t * 7 + m % 7 + 1])))"
#: The projector on the first principal axis by squaring the centred Gram matrix again and again: so often that shares which
#: differ by a part in 10^12, the least that the query tells apart, are told apart here too.
SQUARINGS = 46
PCA = f""", gm0 AS (SELECT {K}, x.ratio_idx AS i, y.ratio_idx AS j, list_dot_product(x.v, y.v) AS g FROM enc x JOIN enc y USING ({K})),
gm1 AS (SELECT {K}, i, j, g - avg(g) OVER (PARTITION BY {K}, i) - avg(g) OVER (PARTITION BY {K}, j) + avg(g) OVER (PARTITION BY {K}) AS g FROM gm0),
gq0 AS (SELECT {K}, list(g ORDER BY i, j) AS g, sum(g) FILTER (i = j) AS tr, list(g ORDER BY i, j) AS p FROM gm1 GROUP BY ALL)""" + "".join(
    f", gq{k} AS (SELECT {K}, g, tr, list_transform(p, lambda x: x / (p[1] + p[9] + p[17] + p[25] + p[33] + p[41] + p[49])) AS p FROM (SELECT {K}, g, tr, {SQUARE} AS p FROM gq{k - 1}))" for k in range(1, SQUARINGS + 1)
) + f""", pca AS (SELECT {K}, least(1, list_dot_product(g, p) / tr) AS pc1_variance, least(1, sqrt(greatest((p[49] + p[1] - 2 * p[7]) * list_dot_product(g, p), 0)) / separation) AS pc1_abs_cosine FROM gq{SQUARINGS} JOIN (SELECT {K}, max(separation) AS separation FROM geo GROUP BY ALL) USING ({K}))"""


@query(PCA + f", l AS (SELECT {K}, ratio_idx, projection_raw, rank() OVER (PARTITION BY {K} ORDER BY projection_raw) AS ry, projection_raw - lag(projection_raw) OVER (PARTITION BY {K} ORDER BY ratio_idx) AS d FROM geo), s AS (SELECT *, CASE WHEN abs(6 * d) > 1e-12 THEN sign(d) END AS sg FROM l), t AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY ratio_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), u AS (SELECT {K}, count(*) FILTER (sg <> before) AS turning_points, corr(ratio_idx, ry) AS rho FROM t GROUP BY ALL) SELECT {K}, round(pc1_variance, 5) AS pc1_variance, round(pc1_abs_cosine, 5) AS pc1_abs_cosine, turning_points, round(rho, 6) + 0.0 AS spearman_all FROM pca JOIN u USING ({K})")
def ge5_principal_axis(spark, sf):
    s = geometry.path_shape(points(spark, sf, True), samples(spark, sf, True))
    return rounded(s.select(*geometry.TRAJECTORY, F.round("pc1_variance", 5).alias("pc1_variance"), F.round("pc1_abs_cosine", 5).alias("pc1_abs_cosine"), "turning_points", "spearman_all"))


CENTRES = """, hs AS (SELECT DISTINCT scenario_id, style_axis, model_id, encoder_id, seed AS held FROM enc), tc AS (SELECT h.scenario_id, h.style_axis, h.model_id, h.encoder_id, held, ratio_idx, i, avg(v[i]) AS m FROM hs h JOIN enc e ON h.scenario_id = e.scenario_id AND h.model_id = e.model_id AND h.encoder_id = e.encoder_id AND e.seed <> held, range(1, 65) t(i) WHERE i <= len(v) GROUP BY ALL),
ct AS (SELECT scenario_id, style_axis, model_id, encoder_id, held, ratio_idx AS r, list(m ORDER BY i) AS c FROM tc GROUP BY ALL)"""


#: Tables lp (a row for each interior point and its references) and lw (pieces), behind CENTRES.
LOSO = CENTRES + """, nr AS (SELECT e.run_id, e.encoder_id, e.ratio_idx, r, list_distance(v, c) AS d, c.scenario_id, c.style_axis, c.model_id, held FROM enc e JOIN ct c ON c.scenario_id = e.scenario_id AND c.model_id = e.model_id AND c.encoder_id = e.encoder_id AND held = e.seed),
bst AS (SELECT run_id, encoder_id, scenario_id, style_axis, model_id, held, any_value(ratio_idx) AS k, arg_min(r, (round(d * d, 12), r)) AS near, min(d) AS least, max(d) FILTER (r = ratio_idx) AS own FROM nr GROUP BY ALL),
le AS (SELECT a.scenario_id, a.model_id, a.encoder_id, a.held, a.c AS a, b.c AS b, list_distance(a.c, b.c) AS separation FROM ct a JOIN ct b USING (scenario_id, style_axis, model_id, encoder_id, held) WHERE a.r = 0 AND b.r = 6),
ln AS (SELECT e.run_id, e.encoder_id, target_ratio, separation, list_distance(v, a) AS from_a, list_dot_product(v, b) - list_dot_product(v, a) - list_dot_product(a, b) + list_dot_product(a, a) AS along FROM enc e JOIN le ON le.scenario_id = e.scenario_id AND le.model_id = e.model_id AND le.encoder_id = e.encoder_id AND held = e.seed),
lp AS (SELECT scenario_id, style_axis, model_id, encoder_id, held AS held_seed, avg(abs(along / separation ** 2 - target_ratio)) AS line_error, avg((abs(along / separation ** 2 * 6 - k) < 0.5)::INT) AS line_accuracy, avg(sqrt(greatest(from_a ** 2 - 2 * target_ratio * along + (target_ratio * separation) ** 2, 0)) / (separation + 1e-12)) AS line_distance, avg(sqrt(greatest(from_a ** 2 - along ** 2 / separation ** 2, 0)) / (separation + 1e-12)) AS line_drift,
  avg(abs(near - k) / 6.0) AS centroid_error, avg((near = k)::INT) AS nearest_accuracy, avg(own / (separation + 1e-12)) AS centroid_distance, avg(least / (separation + 1e-12)) AS centroid_drift FROM bst JOIN ln USING (run_id, encoder_id) WHERE k BETWEEN 1 AND 5 GROUP BY ALL),
sg AS (SELECT a.*, b.c AS e, list_dot_product(b.c, b.c) + list_dot_product(a.c, a.c) - 2 * list_dot_product(a.c, b.c) AS long FROM ct a JOIN ct b USING (scenario_id, style_axis, model_id, encoder_id, held) WHERE b.r = a.r + 1),
f0 AS (SELECT p.run_id, p.scenario_id, p.style_axis, p.model_id, p.encoder_id, held, ratio_idx AS k, r, long, list_dot_product(v, e) - list_dot_product(v, c) - list_dot_product(c, e) + list_dot_product(c, c) AS along, list_distance(v, c) ** 2 AS d2 FROM enc p JOIN sg ON p.scenario_id = sg.scenario_id AND p.model_id = sg.model_id AND p.encoder_id = sg.encoder_id AND held = seed WHERE ratio_idx BETWEEN 1 AND 5),
f1 AS (SELECT *, CASE WHEN long <= 1e-12 THEN 0 ELSE greatest(0, least(1, along / long)) END AS part FROM f0), f2 AS (SELECT *, r + part AS place, greatest(d2 - 2 * part * along + part ** 2 * long, 0) AS away FROM f1),
f3 AS (SELECT run_id, scenario_id, style_axis, model_id, encoder_id, held, k, arg_min(place, (round(away, 12), r)) AS place, arg_min(away, (round(away, 12), r)) AS away FROM f2 GROUP BY ALL),
lw AS (SELECT scenario_id, style_axis, model_id, encoder_id, held AS held_seed, avg(abs(place - k) / 6.0) AS piecewise_error, avg((abs(place - k) < 0.5)::INT) AS piecewise_accuracy, avg(sqrt(away) / (separation + 1e-12)) AS piecewise_drift FROM f3 JOIN le USING (scenario_id, model_id, encoder_id, held) GROUP BY ALL)"""
LINE_METRICS = ["line_error", "line_accuracy", "line_distance", "line_drift", "centroid_error", "nearest_accuracy", "centroid_distance", "centroid_drift"]
PIECE_METRICS = ["piecewise_error", "piecewise_accuracy", "piecewise_drift"]
HELD = "scenario_id, style_axis, model_id, encoder_id, held_seed"


@query(LOSO + f" SELECT {HELD}, " + ", ".join(f"round({m}, 5) AS {m}" for m in LINE_METRICS) + " FROM lp")
def ge6_leave_one_seed_out(spark, sf):
    rows = geometry.leave_one_seed_out(points(spark, sf, True), ["scenario_id", "style_axis", "model_id", "encoder_id"])
    return rows.select(*HELD.split(", "), *[F.round(m, 5).alias(m) for m in LINE_METRICS])


@query(LOSO + f" SELECT {HELD}, " + ", ".join(f"round({m}, 6) AS {m}" for m in PIECE_METRICS) + " FROM lw")
def ge6_piecewise_line(spark, sf):
    return rounded(geometry.piecewise_line(points(spark, sf, True), ["scenario_id", "style_axis", "model_id", "encoder_id"]))


@query("""SELECT run_id, CASE WHEN list_distance(a, b) > 1e-12 THEN round((list_dot_product(v, b) - list_dot_product(v, a) - list_dot_product(a, b) + list_dot_product(a, a)) / list_distance(a, b) ** 2, 6) + 0.0 END AS projection_raw FROM points
JOIN (SELECT x.vec_id // 2 AS n, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0) r ON substr(scenario_id, 2)::BIGINT = r.n""")
def ge11_external_anchors(spark, sf):
    refs = spark.read.parquet(f"{sf}/embeddings.parquet").select(pair_id("vec_id").alias("scenario_id"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("endpoint"), F.col("embedding").cast("array<double>").alias("v"))
    p = points(spark, sf)
    anchors = geometry.external_anchors(refs.join(p.select("scenario_id").distinct(), "scenario_id", "left_semi"), ["scenario_id"])
    return rounded(geometry.with_geometry(p, anchors, ["scenario_id"]).select("run_id", "projection_raw"))


@query("""SELECT scenario_id, round(sqrt(sum((ma - mb) ** 2)), 6) AS separation, any_value(n) AS contributors FROM (SELECT scenario_id, i, avg(v[i]) FILTER (ratio_idx = 0) AS ma, avg(v[i]) FILTER (ratio_idx = 6) AS mb, count(*) FILTER (ratio_idx = 0) AS n FROM points, range(1, 65) t(i) GROUP BY ALL) GROUP BY scenario_id""")
def ge10_pooled_anchor_span(spark, sf):
    p = points(spark, sf)
    a = geometry.pooled_anchors(p, ["scenario_id"])
    n = p.where("ratio_idx = 0").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("contributors"))
    from axisgauge.functions.vectors import dot

    return rounded(a.select("scenario_id", F.sqrt(dot("a", "a") + dot("b", "b") - 2 * dot("a", "b")).alias("separation")).join(n, "scenario_id"))


@query("""SELECT a.run_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS similarity FROM points a JOIN points b USING (scenario_id, model_id, seed) WHERE b.ratio_idx = 0""")
def ge16_source_similarity(spark, sf):
    p = points(spark, sf)
    source = p.where("ratio_idx = 0").select("scenario_id", "model_id", "seed", F.col("v").alias("s"))
    return rounded(p.join(source, ["scenario_id", "model_id", "seed"]).select("run_id", geometry.cosine_similarity("v", "s").alias("similarity")))


@query("SELECT model_id, target_ratio, round(avg(projection_raw), 6) + 0.0 AS mean, round(stddev_samp(projection_raw) / sqrt(count(*)), 6) AS sem FROM (SELECT model_id, round(target_ratio, 6) AS target_ratio, projection_raw FROM geo WHERE encoder_id = 'full' AND is_interior) GROUP BY ALL")
def ge21_calibration_curve(spark, sf):
    s = samples(spark, sf).where("is_interior").withColumn("target_ratio", F.round("target_ratio", 6))
    return rounded(ladder.curve(s, ["model_id", "target_ratio"], "projection_raw").select("model_id", "target_ratio", "mean", "sem"))


@query("SELECT scenario_id, style_axis, (row_number() OVER (PARTITION BY style_axis ORDER BY sha256('20260916:' || style_axis || ':' || scenario_id)) - 1) % 5 AS fold FROM (SELECT DISTINCT scenario_id, style_axis FROM points)")
def bl4_scenario_folds(spark, sf):
    return baselines.scenario_folds(points(spark, sf)).select("scenario_id", "style_axis", F.col("fold").cast("long").alias("fold"))


FOLDS = "f AS (SELECT scenario_id, (row_number() OVER (PARTITION BY style_axis ORDER BY sha256('20260916:' || style_axis || ':' || scenario_id)) - 1) % 5 AS fold FROM (SELECT DISTINCT scenario_id, style_axis FROM points)), t AS (SELECT txt.*, fold FROM txt JOIN f USING (scenario_id))"


def folded(spark, sf):
    return texts(spark, sf).join(baselines.scenario_folds(points(spark, sf)), ["scenario_id", "style_axis"])


@query(", " + FOLDS + " SELECT a.run_id, round(any_value(r.i) + any_value(r.s) * a.character_length, 6) + 0.0 AS estimate FROM t a JOIN (SELECT x.model_id, y.fold, regr_slope(x.target_ratio, x.character_length) AS s, regr_intercept(x.target_ratio, x.character_length) AS i FROM t x, (SELECT DISTINCT fold FROM t) y WHERE x.fold <> y.fold GROUP BY ALL) r USING (model_id, fold) GROUP BY a.run_id, a.character_length")
def bl5_length_only_cv(spark, sf):
    return rounded(baselines.cross_validated_line(folded(spark, sf), ["model_id"], "character_length", "target_ratio", "estimate").select("run_id", "estimate"))


def isotonic_sql(source: str, x: str, name: str) -> str:
    """Tables, the last of which is `name` (run_id, estimate): the greatest of the least means over intervals around each x
    of a model's other folds, interpolated."""
    on = "a.model_id = b.model_id AND a.fold = b.fold"
    near = lambda n, sign: f"ASOF LEFT JOIN {name}_x {n} ON t.model_id = {n}.model_id AND t.fold = {n}.fold AND t.x {sign} {n}.x"
    return f"""{name}_u AS (SELECT model_id, fold, {x} AS x, sum(target_ratio) AS s, count(*) AS n FROM {source} WHERE {x} IS NOT NULL GROUP BY ALL),
{name}_t AS (SELECT u.model_id, y.fold, x, sum(s) AS s, sum(n) AS n FROM {name}_u u, (SELECT DISTINCT fold FROM {source}) y WHERE u.fold <> y.fold GROUP BY ALL),
{name}_c AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn, row_number() OVER w AS k FROM {name}_t WINDOW w AS (PARTITION BY model_id, fold ORDER BY x)),
{name}_m AS (SELECT a.model_id, a.fold, b.k, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.model_id, a.fold, a.k ORDER BY b.k DESC ROWS UNBOUNDED PRECEDING) AS y FROM {name}_c a JOIN {name}_c b ON {on} AND a.k <= b.k),
{name}_x AS (SELECT model_id, fold, x::DOUBLE AS x, max(y) AS y FROM {name}_m JOIN {name}_c USING (model_id, fold, k) GROUP BY ALL),
{name} AS (SELECT run_id, CASE WHEN a.x IS NULL THEN b.y WHEN b.x IS NULL OR a.x = b.x THEN a.y ELSE a.y + (b.y - a.y) * (t.x - a.x) / (b.x - a.x) END AS estimate FROM (SELECT run_id, model_id, fold, {x}::DOUBLE AS x FROM {source}) t {near("a", ">=")} {near("b", "<=")})"""


@query(", " + FOLDS + ", " + isotonic_sql("t", "character_length", "iso") + " SELECT run_id, round(estimate, 6) AS estimate FROM iso")
def bl7_isotonic_cv(spark, sf):
    return rounded(baselines.cross_validated_isotonic(folded(spark, sf), ["model_id"], "character_length", "target_ratio", "estimate").select("run_id", "estimate"))


@query("SELECT run_id, round(CASE WHEN a = b THEN 0.5 ELSE (character_length - a) / (b - a)::DOUBLE END, 6) + 0.0 AS estimate FROM (SELECT run_id, character_length, max(character_length) FILTER (target_ratio = 0) OVER w AS a, max(character_length) FILTER (target_ratio = 1) OVER w AS b FROM txt WINDOW w AS (PARTITION BY scenario_id, model_id, seed))")
def bl3_length_coordinate(spark, sf):
    return rounded(baselines.length_coordinate(texts(spark, sf), ["scenario_id", "model_id", "seed"]).select("run_id", F.col("length_coordinate").alias("estimate")))


@query("SELECT run_id, encoder_id, 0.5::DOUBLE AS constant_half, round(distance_ratio_estimate, 6) AS distance_ratio FROM geo")
def bl2_distance_ratio(spark, sf):
    return rounded(samples(spark, sf, True).select("run_id", "encoder_id", F.lit(0.5).alias("constant_half"), F.col("distance_ratio_estimate").alias("distance_ratio")))


@query("SELECT scenario_id, model_id, encoder_id, round(target_ratio, 6) AS target_ratio, round(projection_raw, 6) + 0.0 AS projection_raw, round(projection_error_raw, 6) AS error, round(interpolation_distance_squared, 6) AS distance_squared, round(out_of_range, 6) AS oor FROM cells WHERE is_interior")
def ag1_seed_cells(spark, sf):
    c = cells(spark, sf, True).where("is_interior")
    return rounded(c.select("scenario_id", "model_id", "encoder_id", "target_ratio", "projection_raw", F.col("projection_error_raw").alias("error"), F.col("interpolation_distance_squared").alias("distance_squared"), F.col("out_of_range").alias("oor")))


@query("""SELECT scenario_id, style_axis, model_id, encoder_id, round(avg(projection_error_raw) FILTER (is_interior), 6) AS ice, round(quantile_cont(projection_error_raw, 0.5) FILTER (is_interior), 6) AS median_error, round(sqrt(avg(interpolation_distance_squared) FILTER (is_interior)), 6) AS rms,
round(corr(target_ratio, projection_raw) FILTER (is_interior), 6) AS pearson, round(regr_slope(projection_raw, target_ratio) FILTER (is_interior), 6) AS slope, round(regr_intercept(projection_raw, target_ratio) FILTER (is_interior), 6) AS intercept, round(avg(abs(0.5 - target_ratio)) FILTER (is_interior), 6) AS constant_half, round(avg(separation), 6) AS separation FROM cells GROUP BY ALL""")
def ag2_scenario_table(spark, sf):
    s = scenario(spark, sf, True)
    return rounded(s.select(*baselines.CELL_KEYS, F.col("interior_calibration_error").alias("ice"), F.col("median_absolute_error").alias("median_error"), F.col("interpolation_distance_rms").alias("rms"), F.col("pearson_correlation").alias("pearson"), F.col("calibration_slope").alias("slope"), F.col("calibration_intercept").alias("intercept"), F.col("constant_half_mae").alias("constant_half"), F.col("endpoint_separation").alias("separation")))


ST2 = boot("scen", ["model_id", "encoder_id"], ["ice", "drift", "oor"])


@query(ST2 + " SELECT * EXCLUDE n FROM bt")
def st2_stratified_bootstrap(spark, sf):
    s = scenario(spark, sf, True).withColumnsRenamed({"interior_calibration_error": "ice", "normalized_off_axis_drift": "drift", "out_of_range_rate": "oor"})
    return rounded(statistics.bootstrap_means(s, ["model_id", "encoder_id"], ["ice", "drift", "oor"], "style_axis", "scenario_id").drop("n"))


@query(ST2 + " SELECT model_id, encoder_id, " + ", ".join(f"max({c}) FILTER (metric = '{m}') AS {m}_{c}" for m in ("ice", "drift", "oor") for c in ("estimate", "ci_lower", "ci_upper")) + " FROM bt GROUP BY ALL")
def ag3_model_summary(spark, sf):
    return rounded(ladder.wide_summary(st2_stratified_bootstrap(spark, sf), ["model_id", "encoder_id"], ["ice", "drift", "oor"]))


@query("SELECT model_id, encoder_id, round(avg(projection_error_raw), 6) AS all_points, round(avg(projection_error_raw) FILTER (is_interior), 6) AS interior, round(avg(projection_error_clipped), 6) AS all_clipped, round(1 - avg(projection_error_raw) / avg(projection_error_raw) FILTER (is_interior), 6) AS underestimate FROM geo GROUP BY ALL")
def ag4_endpoint_inclusion(spark, sf):
    return rounded(ladder.endpoint_inclusion(samples(spark, sf, True), ["model_id", "encoder_id"]))


@query("""SELECT encoder_id, cut, count(*) AS n, round(avg(ice), 6) AS ice FROM (SELECT s.*, 'full' AS cut FROM scen s UNION ALL SELECT s.*, 'p10' FROM scen s JOIN (SELECT encoder_id, quantile_cont(separation, 0.1) AS q FROM scen GROUP BY 1) USING (encoder_id) WHERE separation > q UNION ALL SELECT s.*, 'p20' FROM scen s JOIN (SELECT encoder_id, quantile_cont(separation, 0.2) AS q FROM scen GROUP BY 1) USING (encoder_id) WHERE separation > q) GROUP BY ALL""")
def ag7_low_separation(spark, sf):
    return rounded(ladder.low_separation(scenario(spark, sf, True), "encoder_id", "endpoint_separation").groupBy("encoder_id", "cut").agg(F.count(F.lit(1)).alias("n"), F.avg("interior_calibration_error").alias("ice")))


@query("SELECT style_axis AS excluded, model_id, round(avg(ice), 6) AS ice FROM (SELECT b.style_axis, a.model_id, a.ice FROM scen a JOIN (SELECT DISTINCT style_axis FROM scen) b ON a.style_axis <> b.style_axis WHERE encoder_id = 'full') GROUP BY ALL")
def ag6_drop_one_axis(spark, sf):
    s = scenario(spark, sf)
    return rounded(ladder.drop_one(s, "style_axis").groupBy("excluded", "model_id").agg(F.avg("interior_calibration_error").alias("ice")))


@query("""SELECT model_id, round(avg(abs(z)), 6) AS smoothness FROM (SELECT model_id, m - 2 * lag(m) OVER w + lag(m, 2) OVER w AS z FROM (SELECT model_id, ratio_idx, avg(projection_raw) AS m FROM geo WHERE encoder_id = 'full' GROUP BY ALL) WINDOW w AS (PARTITION BY model_id ORDER BY ratio_idx)) GROUP BY 1""")
def ag14_smoothness(spark, sf):
    return rounded(ladder.smoothness(samples(spark, sf), ["model_id"], "target_ratio", "projection_raw"))


@query("SELECT model_id, round(avg((projection_raw < 0.15 OR projection_raw > 0.85)::INT), 6) AS attraction FROM geo WHERE encoder_id = 'full' AND ratio_idx IN (2, 3, 4) GROUP BY 1")
def ag15_endpoint_attraction(spark, sf):
    return rounded(ladder.attraction(samples(spark, sf), ["model_id"], "projection_raw", [2 / 6, 3 / 6, 4 / 6]))


@query("""SELECT coalesce(model_id, 'ALL') AS model_id, coalesce(style_axis, 'ALL') AS style_axis, count(*) AS n, round(avg(projection_error_clipped), 6) AS mae, round(avg(projection_clipped - target_ratio), 6) + 0.0 AS bias, round(avg(out_of_range::INT), 6) AS oor FROM geo WHERE encoder_id = 'full' AND is_interior GROUP BY GROUPING SETS ((), (model_id), (model_id, style_axis))""")
def ag13_projection_groups(spark, sf):
    return rounded(ladder.projection_groups(samples(spark, sf).where("is_interior")))


@query("""SELECT model_id, round(avg((target_ratio < 0.5 AND projection_raw > target_ratio + 0.15)::INT) FILTER (target_ratio < 0.5), 6) AS overshoot, round(avg((projection_raw < target_ratio - 0.15)::INT) FILTER (target_ratio > 0.5), 6) AS undershoot FROM geo WHERE encoder_id = 'full' AND is_interior GROUP BY 1""")
def ag24_over_and_undershoot(spark, sf):
    return rounded(ladder.shoot_rates(samples(spark, sf).where("is_interior"), ["model_id"]))


@query("""SELECT encoder_id, model_a, model_b, round(avg(d), 6) + 0.0 AS mean_difference, round(quantile_cont(d, 0.5), 6) + 0.0 AS median_difference, round(avg(d) / stddev_samp(d), 6) AS dz, count(*) AS n FROM (SELECT encoder_id, a.model_id AS model_a, b.model_id AS model_b, a.ice - b.ice AS d FROM scen a JOIN scen b USING (encoder_id, scenario_id) WHERE a.model_id < b.model_id) GROUP BY ALL""")
def st5_paired_differences(spark, sf):
    p = statistics.paired_differences(scenario(spark, sf, True), ["encoder_id"], "model_id", "scenario_id", "interior_calibration_error")
    return rounded(statistics.paired_summary(p, ["encoder_id"]))


@query("""SELECT encoder_id, model_a, model_b, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0))::BIGINT AS statistic FROM (SELECT *, rank() OVER (PARTITION BY encoder_id, model_a, model_b ORDER BY abs(d)) AS r FROM (SELECT encoder_id, a.model_id AS model_a, b.model_id AS model_b, a.ice - b.ice AS d FROM scen a JOIN scen b USING (encoder_id, scenario_id) WHERE a.model_id < b.model_id)) GROUP BY ALL HAVING sum(r) FILTER (d > 0) IS NOT NULL AND sum(r) FILTER (d < 0) IS NOT NULL""")
def st7_wilcoxon_statistic(spark, sf):
    p = statistics.paired_differences(scenario(spark, sf, True), ["encoder_id"], "model_id", "scenario_id", "interior_calibration_error")
    return statistics.wilcoxon(p, ["encoder_id", "model_a", "model_b"], zeros="drop").where("statistic > 0").select("encoder_id", "model_a", "model_b", F.col("statistic").cast("long").alias("statistic"))


ERF = "0.254829592 * t + -0.284496736 * t ** 2 + 1.421413741 * t ** 3 + -1.453152027 * t ** 4 + 1.061405429 * t ** 5"


@query(", d AS (SELECT encoder_id, a.model_id AS model_a, b.model_id AS model_b, scenario_id, a.ice - b.ice AS d FROM scen a JOIN scen b USING (encoder_id, scenario_id) WHERE a.model_id < b.model_id), r AS (SELECT *, rank() OVER (PARTITION BY encoder_id, model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY encoder_id, model_a, model_b, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY encoder_id, model_a, model_b, abs(d)) AS t FROM d), s AS (SELECT encoder_id, model_a, model_b, count(*)::DOUBLE AS n, count(*) FILTER (d = 0)::DOUBLE AS z, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS minus, sum(CASE WHEN d = 0 THEN r ELSE 0 END) AS zero, sum(CASE WHEN d <> 0 THEN t * t - 1 ELSE 0 END)::DOUBLE AS ties FROM r GROUP BY ALL), "
       "u AS (SELECT *, least(plus, minus) + zero / 2 AS statistic, (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1)) / 24 - ties / 48 AS v FROM s), x AS (SELECT *, abs(statistic - n * (n + 1) / 4) / sqrt(v) / sqrt(2) AS x FROM u), y AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM x), p AS (SELECT encoder_id, model_a, model_b, statistic, CASE WHEN n = z OR v <= 0 THEN 1.0 ELSE least(1.0, (" + ERF + ") * exp(-x * x)) END AS p FROM y), h AS (SELECT *, row_number() OVER w AS k, (count(*) OVER (PARTITION BY encoder_id) - row_number() OVER w + 1) * p AS q FROM p WINDOW w AS (PARTITION BY encoder_id ORDER BY p, model_a, model_b)) "
       "SELECT encoder_id, model_a, model_b, round(statistic, 6) AS statistic, round(p, 6) AS p_value, round(least(1.0, max(q) OVER (PARTITION BY encoder_id ORDER BY k)), 6) AS p_holm FROM h")
def st8_holm_adjusted_tests(spark, sf):
    p = statistics.paired_differences(scenario(spark, sf, True), ["encoder_id"], "model_id", "scenario_id", "interior_calibration_error")
    return rounded(statistics.holm(statistics.wilcoxon(p, ["encoder_id", "model_a", "model_b"]), ["encoder_id"]))


@query("""SELECT model_a, model_b, round((1 + count(*) FILTER (abs(f) >= abs(m) - 1e-15)) / 100001.0, 6) AS p_value FROM (SELECT model_a, model_b, b, avg(d * """ + flips_sql("scenario_id") + """) AS f, avg(d) AS m FROM
(SELECT a.model_id AS model_a, b.model_id AS model_b, scenario_id, a.ice - b.ice AS d FROM scen a JOIN scen b USING (encoder_id, scenario_id) WHERE a.model_id < b.model_id AND encoder_id = 'full'), range(0, 100000) r(b) GROUP BY ALL) GROUP BY ALL""")
def st13_sign_flip(spark, sf):
    p = statistics.paired_differences(scenario(spark, sf), ["encoder_id"], "model_id", "scenario_id", "interior_calibration_error")
    return rounded(statistics.sign_flip(p, ["model_a", "model_b"], "scenario_id", "difference").select("model_a", "model_b", "p_value"))


@query("""SELECT round(corr(e, s), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY projection_error_raw) + (count(*) OVER (PARTITION BY projection_error_raw) - 1) / 2.0 AS e, rank() OVER (ORDER BY character_length) + (count(*) OVER (PARTITION BY character_length) - 1) / 2.0 AS s FROM geo JOIN txt USING (run_id) WHERE is_interior AND encoder_id = 'full')""")
def ag19_length_error_correlation(spark, sf):
    s = samples(spark, sf).where("is_interior").select("run_id", "projection_error_raw").join(texts(spark, sf).select("run_id", "character_length"), "run_id")
    r = global_rank(global_rank(s, "projection_error_raw", "e"), "character_length", "s")
    return rounded(r.agg(safe_corr("e", "s").alias("spearman")))


@query("""SELECT x.encoder_id AS encoder_a, y.encoder_id AS encoder_b, count(*) AS pairs, count(*) FILTER (sign(x.d) <> sign(y.d)) AS flips, round(sum(sign(x.d) * sign(y.d)) / count(*), 6) AS kendall FROM
(SELECT encoder_id, a.model_id AS i, b.model_id AS j, a.m - b.m AS d FROM (SELECT encoder_id, model_id, round(avg(ice), 12) AS m FROM scen GROUP BY ALL) a JOIN (SELECT encoder_id, model_id, round(avg(ice), 12) AS m FROM scen GROUP BY ALL) b USING (encoder_id) WHERE a.model_id < b.model_id) x JOIN
(SELECT encoder_id, a.model_id AS i, b.model_id AS j, a.m - b.m AS d FROM (SELECT encoder_id, model_id, round(avg(ice), 12) AS m FROM scen GROUP BY ALL) a JOIN (SELECT encoder_id, model_id, round(avg(ice), 12) AS m FROM scen GROUP BY ALL) b USING (encoder_id) WHERE a.model_id < b.model_id) y USING (i, j) WHERE x.encoder_id < y.encoder_id GROUP BY ALL""")
def ag9_encoder_rank_agreement(spark, sf):
    m = scenario(spark, sf, True).groupBy("encoder_id", "model_id").agg(F.round(F.avg("interior_calibration_error"), 12).alias("m"))
    a, b = m.select(F.col("encoder_id").alias("encoder_a"), "model_id", F.col("m").alias("x")), m.select(F.col("encoder_id").alias("encoder_b"), "model_id", F.col("m").alias("y"))
    both = a.join(b, "model_id").where("encoder_a < encoder_b")
    return rounded(statistics.rank_agreement(both, ["encoder_a", "encoder_b"], "model_id", "x", "y"))


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


@query(", cs AS (SELECT 'all' AS _all, scenario_id, count(*) AS n, sum(target_ratio) AS sx, sum(projection_raw) AS sy, sum(target_ratio ** 2) AS sxx, sum(projection_raw ** 2) AS syy, sum(target_ratio * projection_raw) AS sxy FROM geo WHERE encoder_id = 'full' AND is_interior GROUP BY ALL), " + draws_sql("cs", "nd", "_all") + ", bs AS (SELECT b, " + ", ".join(f"sum(times * {c}) AS {c}" for c in SUMS) + " FROM cs JOIN nd_r USING (_all, scenario_id) GROUP BY b), rs AS (SELECT (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r FROM bs) SELECT (SELECT round(corr(target_ratio, projection_raw), 6) FROM geo WHERE encoder_id = 'full' AND is_interior) AS estimate, (SELECT sum(n)::BIGINT FROM cs) AS n, round(quantile_cont(r, 0.025), 6) AS ci_lower, round(quantile_cont(r, 0.975), 6) AS ci_upper FROM rs")
def st12_bootstrap_pearson(spark, sf):
    return rounded(statistics.bootstrap_pearson(samples(spark, sf).where("is_interior"), "target_ratio", "projection_raw", "scenario_id"))


@query(", cs AS (SELECT 'all' AS _all, model_id, scenario_id, sum(projection_error_raw) AS s, count(*) AS k FROM geo WHERE encoder_id = 'full' GROUP BY ALL), " + draws_sql("cs", "nd", "_all") + ", bs AS (SELECT model_id, b, sum(times * s) / sum(times * k) AS m FROM cs JOIN nd_r USING (_all, scenario_id) GROUP BY ALL) SELECT model_id, any_value(e) AS estimate, round(quantile_cont(m, 0.025), 6) AS ci_lower, round(quantile_cont(m, 0.975), 6) AS ci_upper FROM bs JOIN (SELECT model_id, round(sum(s) / sum(k), 6) AS e FROM cs GROUP BY ALL) USING (model_id) GROUP BY model_id")
def st1_row_weighted_bootstrap(spark, sf):
    return rounded(statistics.bootstrap_ratio(samples(spark, sf), ["model_id"], "projection_error_raw", "scenario_id"))


FLAGSQL = """, fl AS (SELECT scenario_id, style_axis, model_id, encoder_id, target_ratio, avg(projection_raw) AS p, avg(projection_error_raw) AS e, avg(off_axis_drift_normalized) AS d, avg(character_length) AS l, bool_or(out_of_range) AS o, avg(separation) AS s FROM geo LEFT JOIN (SELECT run_id, character_length FROM txt) USING (run_id) GROUP BY ALL),
st AS (SELECT *, p - lag(p) OVER (PARTITION BY scenario_id, model_id, encoder_id ORDER BY target_ratio) AS step, round(target_ratio * 6)::INT AS k FROM fl),
fr AS (SELECT scenario_id, style_axis, model_id, encoder_id, avg(e) FILTER (k BETWEEN 1 AND 5) AS ice, avg(d) FILTER (k BETWEEN 1 AND 5) AS drift, avg(s) AS separation, CASE WHEN stddev_pop(l) > 1e-12 THEN covar_pop(CASE WHEN l IS NOT NULL THEN target_ratio END, l) / nullif(stddev_pop(CASE WHEN l IS NOT NULL THEN target_ratio END) * stddev_pop(l), 0) END AS lc,
  coalesce(bool_or(k IN (1, 2) AND p - target_ratio >= 0.20), false) AS early_overshoot, coalesce(bool_or(k IN (4, 5) AND p - target_ratio <= -0.20), false) AS late_under_response, coalesce(bool_or(step < -0.10), false) AS non_monotonic_reversal,
  coalesce(max(p) FILTER (k BETWEEN 1 AND 5) - min(p) FILTER (k BETWEEN 1 AND 5) <= 0.15, false) AS near_constant_response, coalesce(bool_or(k BETWEEN 1 AND 5 AND o), false) AS out_of_range_extrapolation FROM st GROUP BY ALL),
sg AS (SELECT scenario_id, style_axis, model_id, seed, encoder_id, sum(d) / any_value(separation) AS path FROM (SELECT scenario_id, style_axis, model_id, seed, encoder_id, run_id, list_distance(v, lag(v) OVER (PARTITION BY scenario_id, model_id, seed, encoder_id ORDER BY ratio_idx)) AS d FROM enc) JOIN (SELECT run_id, encoder_id, separation FROM geo) USING (run_id, encoder_id) GROUP BY ALL),
sh AS (SELECT scenario_id, style_axis, model_id, encoder_id, avg(path) AS path, avg(pc1_abs_cosine) AS cosine FROM sg JOIN pca USING (scenario_id, style_axis, model_id, seed, encoder_id) GROUP BY ALL),
ent AS (SELECT scenario_id, style_axis, model_id, encoder_id, bool_or(NOT passed AND projection_error_raw < 0.10) AS x FROM geo JOIN (SELECT run_id, passed FROM jud WHERE judge = 'j1' AND NOT missing) USING (run_id) WHERE is_interior GROUP BY ALL),
cut AS (SELECT encoder_id, quantile_cont(separation, 0.1) AS cs, quantile_cont(drift, 0.9) AS cd, quantile_cont(path, 0.9) AS cp FROM fr JOIN sh USING (scenario_id, style_axis, model_id, encoder_id) GROUP BY 1), med AS (SELECT model_id, encoder_id, quantile_cont(ice, 0.5) AS m FROM fr GROUP BY ALL),
flags AS (SELECT fr.scenario_id, fr.style_axis, fr.model_id, fr.encoder_id, ice, early_overshoot, late_under_response, non_monotonic_reversal, near_constant_response, out_of_range_extrapolation, separation <= cs AS endpoint_collapse, drift >= cd AS high_off_axis_drift, path >= cp OR coalesce(cosine < 0.80, false) AS curved_trajectory, coalesce(abs(lc) >= 0.80 AND ice > m, false) AS length_dominated_control, coalesce(ent.x, false) AS content_style_entanglement
  FROM fr JOIN sh USING (scenario_id, style_axis, model_id, encoder_id) JOIN cut USING (encoder_id) JOIN med USING (model_id, encoder_id) LEFT JOIN ent USING (scenario_id, style_axis, model_id, encoder_id))"""


@query(PCA + FLAGSQL + " SELECT * REPLACE (round(ice, 6) AS ice) FROM flags")
def fa1_failure_flags(spark, sf):
    from axisgauge.operators import failures

    p, s = points(spark, sf, True), samples(spark, sf, True)
    judged = scores(spark, sf).where("judge = 'j1' and not missing").select("run_id", "passed")
    return rounded(failures.flags(s, once(geometry.path_shape(p, s)), texts(spark, sf).select("run_id", "character_length"), judged))


FLAG_NAMES = ["early_overshoot", "late_under_response", "non_monotonic_reversal", "near_constant_response", "out_of_range_extrapolation", "endpoint_collapse", "high_off_axis_drift", "curved_trajectory", "length_dominated_control", "content_style_entanglement"]


@query(PCA + FLAGSQL + f", un AS (UNPIVOT flags ON {', '.join(FLAG_NAMES)} INTO NAME flag VALUE v) SELECT flag, model_id, style_axis, encoder_id, count(*) FILTER (v) AS n, round(avg(v::INT), 6) AS share FROM un GROUP BY GROUPING SETS ((flag), (flag, model_id), (flag, style_axis), (flag, encoder_id))")
def fa2_failure_counts(spark, sf):
    from axisgauge.operators import failures

    return rounded(failures.counts(fa1_failure_flags(spark, sf)))


@query(PCA + FLAGSQL + f", un AS (UNPIVOT flags ON {', '.join(FLAG_NAMES)} INTO NAME flag VALUE value), rk AS (SELECT scenario_id, style_axis, model_id, encoder_id, round(ice, 6) AS ice, flag, value, row_number() OVER (PARTITION BY flag, value ORDER BY CASE WHEN value THEN -round(ice, 6) ELSE round(ice, 6) END, scenario_id, style_axis, model_id, encoder_id)::INT AS nth FROM un) SELECT * FROM rk WHERE nth <= 2")
def fa3_worst_and_best(spark, sf):
    from axisgauge.operators import failures

    return failures.worst_and_best(fa1_failure_flags(spark, sf), "ice")


@query("""SELECT style_axis, scenario_id FROM (SELECT *, row_number() OVER (PARTITION BY style_axis ORDER BY sha256('7:' || style_axis || ':' || scenario_id)) AS r FROM (SELECT DISTINCT style_axis, scenario_id FROM points)) WHERE r <= 2""")
def sa1_stratified_selection(spark, sf):
    return ladder.pick_by_hash(points(spark, sf), "style_axis", "scenario_id", 2, "7")


@query("""SELECT run_id FROM points JOIN (SELECT style_axis, scenario_id, dense_rank() OVER (PARTITION BY style_axis ORDER BY scenario_id) AS r FROM (SELECT DISTINCT style_axis, scenario_id FROM points)) USING (style_axis, scenario_id) WHERE r <= 2""")
def sa2_first_scenarios(spark, sf):
    return ladder.first_groups(points(spark, sf), "style_axis", "scenario_id", 2).select("run_id")
