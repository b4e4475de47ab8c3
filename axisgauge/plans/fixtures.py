"""Measurement tables derived from the given tables, for Spark, and the same as SQL for other engines.

Trajectories are runs of seven vectors; scenario, model and seed follow from their number. Scores, pairs, ratings and
conditions are hash draws over the runs; texts are the documents; telemetry is the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.functions.numeric import hex8
from axisgauge.operators import geometry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, encoders: bool = False) -> DataFrame:
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("_fx_embeddings")
    base = spark.sql("""
        with p as (select vec_id, vec_id div 7 g, vec_id % 7 k, cast(embedding as array<double>) v from _fx_embeddings),
             c as (select g from p group by g having count(*) = 7),
             q as (select p.*, g % 3 + 1 seed, g div 3 u from p join c using (g)),
             w as (select u from q group by u having count(distinct seed) = 3)
        select vec_id run_id, concat('s', lpad(cast(u div 4 as string), greatest(4, length(cast(u div 4 as string))), '0')) scenario_id, concat('a', cast((u div 4) % 2 as string)) style_axis,
               concat('m', cast(u % 4 as string)) model_id, seed, k ratio_idx, k / 6D target_ratio, v
        from q join w using (u)""")
    if not encoders:
        return base.withColumn("encoder_id", F.lit("full"))
    parts = F.array(*[F.struct(F.lit(n).alias("encoder_id"), x.alias("v")) for n, x in (("full", F.col("v")), ("lo", F.slice("v", 1, 32)), ("hi", F.slice("v", 33, 32)))])
    return base.select("run_id", "scenario_id", "style_axis", "model_id", "seed", "ratio_idx", "target_ratio", F.inline(parts))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the text of the run with its number; scenario, model, seed and ratio follow from it as in points."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("_fx_documents")
    return spark.sql("""
        with d as (select doc_id, text, doc_id div 21 u, doc_id % 7 k from _fx_documents)
        select doc_id run_id, concat('s', lpad(cast(u div 4 as string), greatest(4, length(cast(u div 4 as string))), '0')) scenario_id, concat('a', cast((u div 4) % 2 as string)) style_axis,
               concat('m', cast(u % 4 as string)) model_id, (doc_id div 7) % 3 + 1 seed, k ratio_idx, k / 6D target_ratio, text, char_length(text) character_length
        from d""")


def once(df: DataFrame) -> DataFrame:
    """Written and read back, since a query uses it several times: computed once, and the plans on it stay small."""
    return cut(df)


def samples(spark: SparkSession, sf_dir: str, encoders: bool = False) -> DataFrame:
    return once(geometry.sample_rows(points(spark, sf_dir, encoders)))


def pair_id(key: str) -> F.Column:
    """The scenario whose references have numbers 2n and 2n + 1; numbers above 9999 keep all their digits."""
    n = F.expr(f"{key} div 2").cast("string")
    return F.concat(F.lit("s"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), "0"))


def draw(name: str, key: str = "run_id") -> F.Column:
    return hex8(F.concat_ws(":", F.lit(name), F.col(key).cast("string")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, judge, intensity, naturalness, pass of two judges; a judge leaves some runs out."""
    p = points(spark, sf_dir).drop("v", "encoder_id")
    judged = p.select("*", F.explode(F.array(F.lit("j1"), F.lit("j2"))).alias("judge"))
    h = hex8(F.concat_ws(":", "judge", F.col("run_id").cast("string")))
    near = F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.col("target_ratio") * 100).cast("int") + F.pmod(h, F.lit(41)).cast("int") - 20))
    return judged.select("*", near.alias("intensity"), (1 + F.pmod(h, F.lit(5))).cast("int").alias("naturalness"), (F.pmod(h, F.lit(10)) < 8).alias("passed"), (F.pmod(h, F.lit(17)) == 0).alias("missing"))


WITH = """WITH RECURSIVE p0 AS (SELECT vec_id, vec_id // 7 AS g, vec_id % 7 AS k, embedding::DOUBLE[] AS v FROM embeddings),
c0 AS (SELECT g FROM p0 GROUP BY g HAVING count(*) = 7),
q0 AS (SELECT p0.*, g % 3 + 1 AS seed, g // 3 AS u FROM p0 JOIN c0 USING (g)),
w0 AS (SELECT u FROM q0 GROUP BY u HAVING count(DISTINCT seed) = 3),
points AS (SELECT vec_id AS run_id, 's' || lpad((u // 4)::VARCHAR, greatest(4, length((u // 4)::VARCHAR))::INT, '0') AS scenario_id, 'a' || ((u // 4) % 2) AS style_axis, 'm' || (u % 4) AS model_id, seed, k AS ratio_idx, k / 6.0::DOUBLE AS target_ratio, v FROM q0 JOIN w0 USING (u)),
enc AS (SELECT * EXCLUDE v, 'full' AS encoder_id, v FROM points UNION ALL SELECT * EXCLUDE v, 'lo', v[1:32] FROM points UNION ALL SELECT * EXCLUDE v, 'hi', v[33:64] FROM points),
anc AS (SELECT x.scenario_id, x.model_id, x.seed, x.encoder_id, x.v AS a, y.v AS b FROM enc x JOIN enc y USING (scenario_id, model_id, seed, encoder_id) WHERE x.ratio_idx = 0 AND y.ratio_idx = 6),
g1 AS (SELECT e.* EXCLUDE v, v, a, b, list_distance(a, b) AS separation, list_distance(v, a) AS from_a, list_distance(v, b) AS from_b,
  list_dot_product(v, b) - list_dot_product(v, a) - list_dot_product(a, b) + list_dot_product(a, a) AS along FROM enc e JOIN anc USING (scenario_id, model_id, seed, encoder_id)),
geo AS (SELECT * EXCLUDE (v, a, b), along / (separation * separation) AS projection_raw, abs(along / (separation * separation) - target_ratio) AS projection_error_raw,
  least(greatest(along / (separation * separation), 0), 1) AS projection_clipped, abs(least(greatest(along / (separation * separation), 0), 1) - target_ratio) AS projection_error_clipped,
  sqrt(greatest(from_a * from_a - along * along / (separation * separation), 0)) / (separation + 1e-12) AS off_axis_drift_normalized,
  sqrt(greatest(from_a * from_a - 2 * target_ratio * along + target_ratio * target_ratio * separation * separation, 0)) / (separation + 1e-12) AS interpolation_distance_normalized,
  along < 0 OR along > separation * separation AS out_of_range, from_a / (from_a + from_b) AS distance_ratio_estimate, ratio_idx BETWEEN 1 AND 5 AS is_interior FROM g1),
cells AS (SELECT scenario_id, style_axis, model_id, encoder_id, target_ratio, is_interior, avg(projection_raw) AS projection_raw, avg(projection_error_raw) AS projection_error_raw, avg(projection_error_clipped) AS projection_error_clipped,
  avg(off_axis_drift_normalized) AS off_axis_drift_normalized, avg(interpolation_distance_normalized ** 2) AS interpolation_distance_squared, avg(out_of_range::INT) AS out_of_range, avg(separation) AS separation, avg(distance_ratio_estimate) AS distance_ratio_estimate FROM geo GROUP BY ALL),
scen AS (SELECT scenario_id, style_axis, model_id, encoder_id, avg(projection_error_raw) FILTER (is_interior) AS ice, avg(off_axis_drift_normalized) FILTER (is_interior) AS drift, avg(out_of_range) FILTER (is_interior) AS oor, avg(separation) AS separation FROM cells GROUP BY ALL),
txt AS (SELECT doc_id AS run_id, 's' || lpad((doc_id // 21 // 4)::VARCHAR, greatest(4, length((doc_id // 21 // 4)::VARCHAR))::INT, '0') AS scenario_id, 'a' || ((doc_id // 21 // 4) % 2) AS style_axis, 'm' || (doc_id // 21 % 4) AS model_id, doc_id // 7 % 3 + 1 AS seed, doc_id % 7 AS ratio_idx, (doc_id % 7) / 6.0::DOUBLE AS target_ratio, text, length(text) AS character_length FROM documents),
jud AS (SELECT p.* EXCLUDE v, judge, greatest(0, least(100, round(target_ratio * 100)::INT + ((('0x' || substr(md5(judge || ':' || run_id), 1, 8))::BIGINT % 41)::INT) - 20)) AS intensity,
  (1 + ('0x' || substr(md5(judge || ':' || run_id), 1, 8))::BIGINT % 5)::INT AS naturalness, ('0x' || substr(md5(judge || ':' || run_id), 1, 8))::BIGINT % 10 < 8 AS passed, ('0x' || substr(md5(judge || ':' || run_id), 1, 8))::BIGINT % 17 = 0 AS missing
  FROM points p, (VALUES ('j1'), ('j2')) t(judge)) """


def external(spark: SparkSession, sf_dir: str, encoders: bool = False) -> DataFrame:
    """Reference vectors as external anchors: numbers 2n and 2n + 1 are the ends of scenario n."""
    refs = table(spark, sf_dir, "embeddings").select(pair_id("vec_id").alias("scenario_id"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("endpoint"), F.col("embedding").cast("array<double>").alias("v"))
    refs = refs.join(points(spark, sf_dir).select("scenario_id").distinct(), "scenario_id", "left_semi")
    parts = [("full", F.col("v")), *([("lo", F.slice("v", 1, 32)), ("hi", F.slice("v", 33, 32))] if encoders else [])]
    refs = refs.select("scenario_id", "endpoint", F.inline(F.array(*[F.struct(F.lit(n).alias("encoder_id"), x.alias("v")) for n, x in parts])))
    return geometry.external_anchors(refs, ["scenario_id", "encoder_id"])


def protocol_samples(spark: SparkSession, sf_dir: str, encoders: bool = True) -> DataFrame:
    from axisgauge.operators import protocols

    p, shared = points(spark, sf_dir, encoders), ["scenario_id", "encoder_id"]
    return protocols.samples(p, {"self": (geometry.self_anchors(p), geometry.TRAJECTORY), "pooled": (geometry.pooled_anchors(p, shared), shared), "external": (external(spark, sf_dir, encoders), shared)})


PROTOCOLS = """, refv AS (SELECT x.vec_id // 2 AS n, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0),
pool0 AS (SELECT scenario_id, encoder_id, i, avg(v[i]) FILTER (ratio_idx = 0) AS ma, avg(v[i]) FILTER (ratio_idx = 6) AS mb FROM enc, range(1, 65) t(i) WHERE i <= len(v) AND ratio_idx IN (0, 6) GROUP BY ALL),
pool1 AS (SELECT scenario_id, encoder_id, list(ma ORDER BY i) AS a, list(mb ORDER BY i) AS b FROM pool0 GROUP BY ALL),
pg0 AS (SELECT e.*, 'self' AS protocol, a, b FROM enc e JOIN anc USING (scenario_id, model_id, seed, encoder_id) UNION ALL SELECT e.*, 'pooled', a, b FROM enc e JOIN pool1 USING (scenario_id, encoder_id)
  UNION ALL SELECT e.*, 'external', CASE encoder_id WHEN 'full' THEN a WHEN 'lo' THEN a[1:32] ELSE a[33:64] END, CASE encoder_id WHEN 'full' THEN b WHEN 'lo' THEN b[1:32] ELSE b[33:64] END FROM enc e JOIN refv ON substr(scenario_id, 2)::BIGINT = n),
pg1 AS (SELECT * EXCLUDE (v, a, b), v = a OR v = b AS at_end, list_distance(a, b) AS separation, list_distance(v, a) AS from_a, list_dot_product(v, b) - list_dot_product(v, a) - list_dot_product(a, b) + list_dot_product(a, a) AS along FROM pg0),
pg2 AS (SELECT i.run_id, i.encoder_id, i.protocol, 1 + count(*) FILTER (j.run_id <> i.run_id AND j.from_a ** 2 - 2 * i.target_ratio * j.along + (i.target_ratio * i.separation) ** 2 < i.from_a ** 2 - 2 * i.target_ratio * i.along + (i.target_ratio * i.separation) ** 2 - 1e-13) AS nn FROM pg1 i JOIN pg1 j USING (scenario_id, model_id, seed, encoder_id, protocol) GROUP BY ALL),
pg3 AS (SELECT *, CASE WHEN separation > 1e-12 AND along IS NOT NULL THEN separation END AS wide FROM pg1 JOIN pg2 USING (run_id, encoder_id, protocol)),
pg AS (SELECT *, along / wide ** 2 AS projection_raw, abs(along / wide ** 2 - target_ratio) AS ice, CASE WHEN wide > 0 THEN sqrt(greatest(from_a ** 2 - along ** 2 / wide ** 2, 0)) / (wide + 1e-12) END AS drift,
  CASE WHEN wide > 0 THEN sqrt(greatest(from_a ** 2 - 2 * target_ratio * along + target_ratio ** 2 * wide ** 2, 0)) / (wide + 1e-12) END AS distance, CASE WHEN wide > 0 THEN (NOT at_end AND (along < 0 OR along > wide ** 2))::INT END AS oor, ratio_idx BETWEEN 1 AND 5 AS is_interior FROM pg3),
traj AS (SELECT scenario_id, style_axis, model_id, seed, encoder_id, protocol, avg(ice) FILTER (is_interior) AS ice, avg(drift) FILTER (is_interior) AS drift, avg(distance) FILTER (is_interior) AS distance, avg(oor) FILTER (is_interior) AS oor, avg(nn) FILTER (is_interior) AS mean_rank, avg(separation) AS separation FROM pg GROUP BY ALL),
ps AS (SELECT scenario_id, style_axis, model_id, encoder_id, protocol, avg(ice) AS ice, avg(drift) AS drift, avg(distance) AS distance, avg(oor) AS oor, avg(mean_rank) AS mean_rank, avg(separation) AS separation, count(*) AS trajectories FROM traj GROUP BY ALL)"""


def boot(source: str, by: list[str], metrics: list[str], name: str = "bt", stratum: str = "style_axis", cluster: str = "scenario_id", replicates: int = 10_000) -> str:
    """SQL of statistics.bootstrap_means as further tables; the last is `name`, rounded."""
    k = "".join(f"{c}, " for c in by)
    each = ", ".join(f"sum(times * {m}) / nullif(sum(times) FILTER ({m} IS NOT NULL), 0) AS {m}" for m in metrics)
    q = ", ".join(f"quantile_cont({m}, 0.025) AS {m}_lo, quantile_cont({m}, 0.975) AS {m}_hi" for m in metrics)
    est = ", ".join(f"avg({m}) AS {m}, count({m}) AS {m}_n" for m in metrics)
    join = f"JOIN {name}_q USING ({', '.join(by)})" if by else f", {name}_q"
    rows = " UNION ALL ".join(f"SELECT {k}'{m}' AS metric, round({m}, 6) + 0.0 AS estimate, round({m}_lo, 6) + 0.0 AS ci_lower, round({m}_hi, 6) + 0.0 AS ci_upper, {m}_n AS n FROM {name}_x {join}" for m in metrics)
    return f""", {name}_m AS (SELECT {k}{stratum}, {cluster}, {", ".join(f"avg({m}) AS {m}" for m in metrics)} FROM {source} GROUP BY {k}{stratum}, {cluster}),
{draws_sql(name + "_m", name, stratum, cluster, replicates)},
{name}_e AS (SELECT {k}b, {each} FROM {name}_m JOIN {name}_r USING ({stratum}, {cluster}) GROUP BY {k}b),
{name}_q AS (SELECT {k}{q} FROM {name}_e{" GROUP BY " + ", ".join(by) if by else ""}),
{name}_x AS (SELECT {k}{est} FROM {name}_m{" GROUP BY " + ", ".join(by) if by else ""}),
{name} AS ({rows})"""


def draws_sql(source: str, name: str, stratum: str = "style_axis", cluster: str = "scenario_id", replicates: int = 10_000) -> str:
    """{name}_r: stratum, cluster, b, times, as resampling.dealt describes: draws are split down a tree of the clusters' hash
    bits by binomial counts. For strata of at most 512 clusters, whose draws are one piece at every node."""
    half = "lambda y: (xor(y >> 16, y) * 73244475) & 4294967295"
    u = f"(list_transform(list_transform(list_transform([(s.key + b * 2654435761) & 4294967295], {half}), {half}), lambda y: xor(y >> 16, y))[1] + 0.5) / 4294967296.0::DOUBLE"
    less = f"len(list_filter(c.cdf, lambda x: x <= {u}))"
    return f"""{name}_d AS (SELECT DISTINCT {stratum}, {cluster}, ('0x' || substr(md5({cluster}::VARCHAR), 1, 15))::BIGINT AS h FROM {source}),
{name}_n AS (SELECT {stratum}, d, h >> (60 - d)::INT AS p, count(*) AS n, any_value({cluster}) AS one FROM {name}_d, range(0, 61) t(d) GROUP BY ALL),
{name}_s AS (SELECT a.{stratum}, a.d, a.p, a.n, coalesce(l.n, 0) AS nl, ('0x' || substr(md5('1:' || a.{stratum} || ':' || a.d || ':' || a.p), 1, 8))::BIGINT AS key FROM {name}_n a LEFT JOIN {name}_n l ON l.{stratum} = a.{stratum} AND l.d = a.d + 1 AND l.p = 2 * a.p WHERE a.n > 1),
{name}_nq AS (SELECT DISTINCT n, least(nl, n - nl) AS nq FROM {name}_s WHERE nl NOT IN (0, n)),
{name}_c0 AS (SELECT n, nq, m, i, pow(1 - nq / n::DOUBLE, m) * coalesce(product(CASE WHEN i > 0 THEN (m - i + 1) / i::DOUBLE * (nq / n::DOUBLE) / (1 - nq / n::DOUBLE) ELSE 1 END) OVER (PARTITION BY n, nq, m ORDER BY i), 1) AS pmf FROM {name}_nq, range(1, (SELECT max(n) + 1 FROM {name}_n)) r(m), range(0, (SELECT max(n) FROM {name}_n)) t(i) WHERE i < m),
{name}_c AS (SELECT n, nq, m, list(cdf ORDER BY i) AS cdf FROM (SELECT n, nq, m, i, sum(pmf) OVER (PARTITION BY n, nq, m ORDER BY i) AS cdf FROM {name}_c0) GROUP BY ALL),
{name}_k AS (SELECT {stratum}, d, p, b, n AS k FROM {name}_n, range(1, {replicates + 1}) r(b) WHERE d = 0 UNION ALL
  SELECT {stratum}, d + 1, 2 * p + side, b, CASE WHEN side = 0 THEN kl ELSE k - kl END FROM (SELECT t.{stratum}, t.d, t.p, b, k, s.n, s.nl, CASE WHEN s.nl = 0 OR k = 0 THEN 0 WHEN s.nl = s.n THEN k WHEN 2 * s.nl <= s.n THEN {less} ELSE k - {less} END AS kl
    FROM {name}_k t JOIN {name}_s s ON t.{stratum} = s.{stratum} AND t.d = s.d AND t.p = s.p LEFT JOIN {name}_c c ON c.n = s.n AND c.nq = least(s.nl, s.n - s.nl) AND c.m = t.k), (VALUES (0), (1)) v(side) WHERE CASE WHEN side = 0 THEN nl > 0 ELSE nl < n END),
{name}_r AS (SELECT k.{stratum}, n.one AS {cluster}, b, k AS times FROM {name}_k k JOIN {name}_n n ON n.{stratum} = k.{stratum} AND n.d = k.d AND n.p = k.p WHERE n.n = 1 AND k > 0)"""


def rank_sql(value: str, by: str) -> str:
    """Average rank of a value inside `by`."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0)"


def corr_sql(x: str, y: str) -> str:
    return f"round(CASE WHEN stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN corr({x}, {y}) END, 6) + 0.0"


def flips_sql(item: str, replicate: str = "b") -> str:
    """Sign of an item in a replicate numbered from 0, from 32 signs to a hash."""
    return f"(1 - 2 * ((('0x' || substr(md5('1:' || ({replicate} // 32) || ':' || {item}), 1, 8))::BIGINT >> ({replicate} % 32)::INT) & 1))"


CONDITIONS = [("p1_high", "P1", 0.7), ("p1_low", "P1", 0.2), ("p2_high", "P2", 0.7), ("p2_low", "P2", 0.2)]


def robust(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outputs (every interior text under each condition), judgments and lengths of the robustness runs, by run_id."""
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("condition"), F.lit(p).alias("prompt_template_id"), F.lit(t).alias("temperature")) for k, (c, p, t) in enumerate(CONDITIONS)])
    t = texts(spark, sf_dir).where("ratio_idx between 1 and 5").select(F.col("run_id").alias("base"), "scenario_id", "style_axis", "model_id", "seed", "target_ratio", "character_length", F.inline(grid))
    t = t.withColumn("run_id", F.col("base") * 10 + F.col("k")).withColumn("h", draw("rob"))
    outputs = t.select("run_id", "scenario_id", "style_axis", "model_id", "seed", "target_ratio", "prompt_template_id", "temperature")
    near = F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.col("target_ratio") * 100).cast("int") + F.pmod("h", F.lit(41)).cast("int") - 20))
    judged = t.select("run_id", near.alias("intensity"), (1 + F.pmod("h", F.lit(5))).cast("int").alias("naturalness"), (F.pmod("h", F.lit(10)) < 8).alias("passed"))
    return outputs, judged, t.select("run_id", (F.col("character_length") + F.pmod("h", F.lit(50))).alias("character_length"))


ROBUST = """, rob0 AS (SELECT t.run_id * 10 + k AS run_id, scenario_id, style_axis, model_id, seed, target_ratio, condition, character_length AS len FROM txt t, (VALUES (0, 'p1_high'), (1, 'p1_low'), (2, 'p2_high'), (3, 'p2_low')) c(k, condition) WHERE ratio_idx BETWEEN 1 AND 5),
rob1 AS (SELECT *, ('0x' || substr(md5('rob:' || run_id), 1, 8))::BIGINT AS h FROM rob0),
rob AS (SELECT *, abs(greatest(0, least(100, round(target_ratio * 100)::INT + (h % 41)::INT - 20)) / 100.0 - target_ratio) AS style_mae, (1 + h % 5)::INT AS naturalness, (h % 10 < 8)::INT AS content_pass, len + h % 50 AS character_length FROM rob1),
rcell AS (SELECT scenario_id, style_axis, model_id, target_ratio, condition, avg(style_mae) AS style_mae, avg(naturalness) AS naturalness, avg(content_pass) AS content_pass, avg(character_length) AS character_length, count(DISTINCT run_id) AS outputs FROM rob GROUP BY ALL)"""


def matched_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Externally anchored samples of interior runs under each condition, which run's judgment each uses, and score rows of
    which a later one replaces an earlier one."""
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("condition")) for k, (c, _, _) in enumerate(CONDITIONS)])
    g = geometry.with_geometry(points(spark, sf_dir), external(spark, sf_dir), ["scenario_id", "encoder_id"]).where("is_interior").select("run_id", "scenario_id", "style_axis", "model_id", "seed", "target_ratio", "projection_error_raw", "off_axis_drift_normalized", "out_of_range", F.inline(grid))
    g = g.withColumn("run_id", F.col("run_id") * 10 + F.col("k"))
    g = g.withColumn("external_ice", F.col("projection_error_raw") + F.pmod(draw("cond"), F.lit(100)) / 1000.0).withColumn("external_oor", F.col("out_of_range").cast("double"))
    mapping = g.select("run_id", F.when(F.col("k") == 0, F.col("run_id") + 4).alias("source_run_id"))
    own = g.select(F.coalesce(F.when(F.col("k") == 0, F.col("run_id") + 4), "run_id").alias("source_run_id"))
    scores = own.select("source_run_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("input_ord"))
    return g, mapping, scores.withColumn("intensity", F.when(F.col("input_ord") == 2, F.pmod(draw("sc", "source_run_id"), F.lit(101))).otherwise(-1))


MATCHED = """, mg AS (SELECT run_id * 10 + k AS run_id, CASE WHEN k = 0 THEN run_id * 10 + 4 ELSE run_id * 10 + k END AS source, scenario_id, style_axis, model_id, target_ratio, condition, ice FROM pg, (VALUES (0, 'p1_high'), (1, 'p1_low'), (2, 'p2_high'), (3, 'p2_low')) c(k, condition) WHERE is_interior AND encoder_id = 'full' AND protocol = 'external'),
ms AS (SELECT *, ice + (('0x' || substr(md5('cond:' || run_id), 1, 8))::BIGINT % 100) / 1000.0 AS external_ice, abs((('0x' || substr(md5('sc:' || source), 1, 8))::BIGINT % 101) / 100.0 - target_ratio) AS judge_mae FROM mg),
mc AS (SELECT scenario_id, style_axis, model_id, condition, count(DISTINCT run_id) AS outputs, avg(external_ice) AS external_ice, avg(judge_mae) AS judge_mae FROM ms GROUP BY ALL)"""
