"""Run matrices, coverage, profiles, costs and identity over the fixture tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from axisgauge.functions.lineage import shared_dir
from axisgauge.functions.numeric import stable_id
from axisgauge.operators import audit, geometry, judges
from axisgauge.plans.calibration_queries import rounded
from axisgauge.plans.fixtures import WITH, points, table
from axisgauge.sources import tables

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if plain else WITH + sql
        return f

    return add


KEYS = ["scenario_id", "model_id", "seed", "ratio_idx"]


def matrix(spark, sf):
    p = points(spark, sf)
    return audit.run_matrix(p.select("scenario_id").distinct(), p.select("model_id").distinct(), p.select("seed").distinct(), p.select("ratio_idx").distinct())


def actual(spark, sf):
    return points(spark, sf).where("run_id % 13 != 0").select("run_id", *KEYS)


PLAN = ", plan AS (SELECT * FROM (SELECT DISTINCT scenario_id FROM points), (SELECT DISTINCT model_id FROM points), (SELECT DISTINCT seed FROM points), (SELECT DISTINCT ratio_idx FROM points)), act AS (SELECT * FROM points WHERE run_id % 13 <> 0) "


@query(PLAN + "SELECT scenario_id, model_id, seed, ratio_idx, 'run_' || substr(sha256(scenario_id || '::' || model_id || '::' || seed || '::' || ratio_idx), 1, 20) AS planned_id FROM plan")
def id2_run_matrix(spark, sf):
    return matrix(spark, sf)


@query(PLAN + "SELECT scenario_id, model_id, seed, ratio_idx FROM plan EXCEPT SELECT scenario_id, model_id, seed, ratio_idx FROM act")
def id4_missing_runs(spark, sf):
    return audit.missing(matrix(spark, sf), actual(spark, sf), KEYS).select(*KEYS)


@query(PLAN + "SELECT model_id, scenario_id, planned, coalesce(actual, 0) AS actual FROM (SELECT model_id, scenario_id, count(*) AS planned FROM plan GROUP BY ALL) LEFT JOIN (SELECT model_id, scenario_id, count(*) AS actual FROM act GROUP BY ALL) USING (model_id, scenario_id) WHERE coalesce(actual, 0) < planned")
def id4_incomplete_groups(spark, sf):
    return audit.incomplete_groups(matrix(spark, sf), actual(spark, sf), ["model_id", "scenario_id"], KEYS)


@query(PLAN + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.run_id IS NOT NULL THEN 'ok' WHEN f.run_id IS NOT NULL THEN 'r' || (f.run_id % 3) ELSE 'missing_unattempted' END AS status FROM plan LEFT JOIN act a USING (scenario_id, model_id, seed, ratio_idx) LEFT JOIN (SELECT * FROM points WHERE run_id % 13 = 0) f USING (scenario_id, model_id, seed, ratio_idx)) GROUP BY 1")
def id5_status(spark, sf):
    f = points(spark, sf).where("run_id % 13 = 0").select(*KEYS, F.concat(F.lit("r"), (F.col("run_id") % 3).cast("string")).alias("reason"), F.col("run_id").alias("o"))
    return audit.status(matrix(spark, sf), actual(spark, sf), f, KEYS, "o").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(PLAN + "SELECT state, count(*) AS n FROM (SELECT CASE WHEN i.run_id IS NULL THEN 'orphan' WHEN c.run_id IS NULL THEN 'missing' ELSE 'covered' END AS state FROM (SELECT run_id FROM points WHERE run_id % 7 <> 0) i FULL JOIN act c USING (run_id)) GROUP BY 1")
def id13_coverage(spark, sf):
    p, a = points(spark, sf), actual(spark, sf)
    return audit.coverage(p.where("run_id % 7 != 0"), a.where("run_id % 2 = 0"), a.where("run_id % 2 = 1"), "run_id").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS records, count(DISTINCT user_id) AS distinct_keys, count(*) - count(DISTINCT user_id) AS surplus, count(*) FILTER (props IS NULL) AS null_props FROM events", plain=True)
def id7_profile(spark, sf):
    return audit.profile(table(spark, sf, "events"), ["user_id"]).select("records", "distinct_keys", F.col("surplus").cast("long").alias("surplus"), F.element_at("nulls", "props").alias("null_props"))


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL", plain=True)
def id7_value_counts(spark, sf):
    return audit.value_counts(table(spark, sf, "documents"), ["lang", "source"])


@query("SELECT doc_id, CASE WHEN k IS NULL THEN 'missing_id' WHEN t IS NULL THEN 'empty_text' WHEN row_number() OVER (PARTITION BY k, t IS NOT NULL ORDER BY doc_id) > 1 THEN 'duplicate' END AS reason FROM (SELECT doc_id, nullif(doc_id % 50, 0) AS k, CASE WHEN n_chars > 30 THEN text END AS t FROM documents)", plain=True)
def id8_split_valid(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.nullif(F.col("doc_id") % 50, F.lit(0)).alias("k"), F.when(F.col("n_chars") > 30, F.col("text")).alias("t"))
    return audit.split_valid(d, "k", "t", "doc_id").select("doc_id", "reason")


@query("SELECT problem, n FROM (SELECT 'missing_fields' AS problem, count(*) FILTER (lang IS NULL OR source IS NULL) AS n FROM documents UNION ALL SELECT 'empty_text', count(*) FILTER (trim(text) = '') FROM documents UNION ALL SELECT 'row_count', abs(count(*) - 999) FROM documents UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT n_chars) FROM documents) WHERE n > 0", plain=True)
def id6_consolidation_gate(spark, sf):
    return audit.problems(table(spark, sf, "documents"), ["n_chars"], ["lang", "source"], "text", 999)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1", plain=True)
def id16_keep_last(spark, sf):
    return judges.keep_last(table(spark, sf, "events"), ["user_id"], "event_id").select("user_id", "event_type")


@query("SELECT event_type, sum(i)::BIGINT AS input_tokens, sum(least(c, i))::BIGINT AS cached_tokens, sum(o)::BIGINT AS output_tokens, round(sum((i - least(c, i)) * 2.0 + least(c, i) * 0.2 + o * 10.0) / 1e6, 6) AS cost FROM (SELECT event_type, user_id AS i, event_id % 300 AS c, user_id % 17 AS o FROM events) GROUP BY 1", plain=True)
def id18_cost(spark, sf):
    usage = table(spark, sf, "events").select("event_type", F.lit("j").alias("model_id"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 300).alias("cached_tokens"), (F.col("user_id") % 17).alias("output_tokens"))
    prices = spark.range(1).select(F.lit("j").alias("model_id"), F.lit(2.0).alias("input_price"), F.lit(0.2).alias("cached_price"), F.lit(10.0).alias("output_price"))
    return rounded(audit.cost(usage, prices, ["event_type"]))


@query("SELECT user_id % 4 AS stage, count(*) FILTER (value > 20) AS success, count(*) FILTER (NOT value > 20) AS failed, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS models, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1", plain=True)
def id20_service_table(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 4).alias("stage"), (F.col("value") > 20).alias("success"), F.col("event_type").alias("model_id"), F.col("value").alias("latency"))
    return rounded(audit.service_table(e, ["stage"]))


@query("SELECT doc_id, 'd_' || substr(sha256(doc_id || '::' || lang), 1, 20) AS long_id, substr(sha1(doc_id || '::' || source), 1, 16) AS short_id FROM documents", plain=True)
def id1_stable_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", stable_id("d", F.col("doc_id"), F.col("lang")).alias("long_id"), stable_id("", F.col("doc_id"), F.col("source"), bits=160, length=16).alias("short_id"))


@query(PLAN + "SELECT run_id FROM points WHERE run_id NOT IN (SELECT run_id FROM act WHERE seed = 1)")
def io8_not_yet_done(spark, sf):
    return tables.not_yet_done(points(spark, sf), actual(spark, sf).where("seed = 1"), ["run_id"]).select("run_id")


@query("SELECT l.doc_id, source, quality FROM labels l JOIN documents d USING (doc_id)", plain=True)
def id17_checked_join(spark, sf):
    return audit.checked_join(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], "1:1")


@query("SELECT source, count(*) AS records, count(*) FILTER (trim(CASE WHEN doc_id % 9 > 0 THEN text ELSE ' ' END) = '') AS empty_outputs, count(*) FILTER (doc_id % 9 > 0 AND doc_id % 10 = 0 OR doc_id % 9 > 0 AND regexp_matches(text, '<think>|</think>|Thinking Process|步骤说明', 'i')) AS hard_markers, count(DISTINCT lang || ':' || doc_id % 3) AS signatures FROM documents GROUP BY 1", plain=True)
def id4_output_audit(spark, sf):
    d = table(spark, sf, "documents").withColumn("seed", F.col("doc_id") % 3)
    d = d.withColumn("text", F.when(F.col("doc_id") % 9 == 0, " ").when(F.col("doc_id") % 10 == 0, F.concat(F.lit("</THINK>"), "text")).otherwise(F.col("text")))
    return audit.output_audit(d, ["source"], "text", ["lang", "seed"])


CORPUS = PLAN + ", plan4 AS (SELECT run_id, k, run_id * 4 + k AS corpus_id, 'prompt' || k AS prompt FROM points, range(0, 4) r(k)), "
EXISTING = CORPUS + "ex AS (SELECT *, 'new' AS origin FROM plan4 WHERE k > 0 OR run_id % 5 = 0), re AS (SELECT *, 'reused' AS origin FROM plan4 WHERE k = 0 AND run_id % 3 > 0) "


def corpus(spark, sf):
    """Planned rows, those that exist, and those that another corpus lends."""
    planned = points(spark, sf).select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    planned = planned.select("run_id", "k", (F.col("run_id") * 4 + F.col("k")).alias("corpus_id"), F.concat(F.lit("prompt"), F.col("k").cast("string")).alias("prompt"))
    return planned, planned.where("k > 0 or run_id % 5 = 0").withColumn("origin", F.lit("new")), planned.where("k = 0 and run_id % 3 > 0").withColumn("origin", F.lit("reused"))


@query(EXISTING + "SELECT run_id, k, prompt, origin FROM ex UNION ALL SELECT run_id, k, prompt, origin FROM re WHERE corpus_id NOT IN (SELECT corpus_id FROM ex)")
def id9_reused_corpus(spark, sf):
    planned, existing, reused = corpus(spark, sf)
    return audit.reuse_first(existing, reused, planned, ["run_id", "k"], ("prompt",)).select("run_id", "k", "prompt", "origin")


@query(EXISTING + ", a AS (SELECT corpus_id, k FROM ex UNION ALL SELECT corpus_id, k FROM re UNION ALL SELECT -corpus_id - 1, k FROM re WHERE run_id % 7 = 0), c AS (SELECT k, count(*) AS n FROM a GROUP BY 1), p AS (SELECT k, count(*) AS planned FROM plan4 GROUP BY 1) SELECT 'unexpected' AS problem, NULL::VARCHAR AS place, n FROM (SELECT count(*) AS n FROM a WHERE corpus_id < 0) WHERE n > 0 UNION ALL SELECT 'duplicate', NULL, n FROM (SELECT count(*) - count(DISTINCT corpus_id) AS n FROM a) WHERE n > 0 UNION ALL SELECT 'count', k::VARCHAR, n FROM c JOIN p USING (k) WHERE n <> planned")
def id9_corpus_checks(spark, sf):
    planned, existing, reused = corpus(spark, sf)
    rows = existing.unionByName(reused).unionByName(reused.where("run_id % 7 = 0").withColumn("corpus_id", -F.col("corpus_id") - 1))
    return audit.corpus_checks(rows, planned, ["corpus_id"], "k")


@query(", it AS (SELECT 'e' || doc_id AS evaluation_item_id, doc_id // 2 AS source_run_id, sha256('p') AS prompt_sha256, sha256('e' || doc_id || '::judge::p::s::' || sha256(text)) AS cache_key FROM documents) SELECT evaluation_item_id, cache_key, CASE WHEN source_run_id * 2 % 10 = 0 AND evaluation_item_id = 'e' || source_run_id * 2 THEN -1 ELSE source_run_id % 101 END AS intensity, CASE WHEN source_run_id * 2 % 10 = 0 AND evaluation_item_id = 'e' || source_run_id * 2 THEN 'existing' ELSE 'reused' END AS reuse_status FROM it WHERE source_run_id % 3 = 0 OR source_run_id * 2 % 10 = 0 AND evaluation_item_id = 'e' || source_run_id * 2")
def id14_reused_judgments(spark, sf):
    d = table(spark, sf, "documents")
    item = F.concat(F.lit("e"), F.col("doc_id").cast("string"))
    index = d.select("doc_id", item.alias("evaluation_item_id"), F.expr("doc_id div 2").alias("source_run_id"), F.sha2(F.lit("p"), 256).alias("prompt_sha256"), audit.cache_key(item, F.lit("judge"), F.lit("p"), F.lit("s"), F.col("text")).alias("cache_key"))
    prior = index.where("doc_id % 2 = 0 and source_run_id % 3 = 0").select("source_run_id", F.lit("judge").alias("evaluator_id"), "prompt_sha256", (F.col("source_run_id") % 101).alias("intensity"))
    existing = index.where("doc_id % 10 = 0").select("evaluation_item_id", "cache_key", F.lit(-1).cast("long").alias("intensity"))
    return audit.reuse_judgments(index.drop("doc_id"), prior, existing, "judge").select("evaluation_item_id", "cache_key", "intensity", "reuse_status")


@query("WITH u AS (SELECT event_type, user_id AS i, least(event_id % 300, user_id) AS c, user_id % 17 AS o, CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'truncated' WHEN 2 THEN NULL ELSE 'ok' END AS s FROM events), g AS (SELECT event_type, count(*) AS records, count(*) FILTER (coalesce(s <> 'failed', true)) AS good, sum(i) AS i, sum(c) AS c, sum(o) AS o, sum((i - c) * 2.0 + c * 0.2 + o * 10.0) / 1e6 AS cost FROM u GROUP BY 1), t AS (SELECT sum(records)::BIGINT AS records, sum(good)::BIGINT AS successful, sum(i)::BIGINT AS input_tokens, sum(c)::BIGINT AS cached_tokens, sum(o)::BIGINT AS output_tokens, sum(cost)::DOUBLE AS cost, (max(cost / good) FILTER (event_type = 'purchase') * 112)::DOUBLE AS allowance FROM g) SELECT records, successful, input_tokens, cached_tokens, output_tokens, round(cost, 6) AS cost, round(coalesce(allowance, 0), 6) AS allowance, round(cost + coalesce(allowance, 0) + 0.1::DOUBLE, 6) AS conservative_cost, round(1::DOUBLE - cost, 6) AS headroom, round(1::DOUBLE - (cost + coalesce(allowance, 0) + 0.1::DOUBLE), 6) AS conservative_headroom, cost + coalesce(allowance, 0) + 0.1::DOUBLE > 1 AS cap_exceeded FROM t", plain=True)
def id18_cost_total(spark, sf):
    usage = table(spark, sf, "events").select("event_type", F.lit("j").alias("model_id"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 300).alias("cached_tokens"), (F.col("user_id") % 17).alias("output_tokens"), F.expr("case event_id % 6 when 0 then 'failed' when 1 then 'truncated' when 2 then null else 'ok' end").alias("status"))
    prices = spark.range(1).select(F.lit("j").alias("model_id"), F.lit(2.0).alias("input_price"), F.lit(0.2).alias("cached_price"), F.lit(10.0).alias("output_price"))
    return rounded(audit.cost_total(audit.cost(usage, prices, ["event_type"], "status"), "event_type", "purchase", 112, 0.1, 1.0))


# --- readers and writers over files that are written from the tables

def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


LINE = "CASE WHEN doc_id % 7 = 0 THEN 'bad' WHEN doc_id % 11 = 0 THEN 'blank' WHEN doc_id % 13 = 0 THEN 'list' ELSE 'good' END"


@query(f"SELECT count(*) FILTER (kind = 'good') AS rows_read, (sum(doc_id) FILTER (kind = 'good'))::BIGINT AS ids, count(*) FILTER (kind = 'bad') AS not_json, count(*) FILTER (kind = 'list') AS not_objects, count(*) FILTER (kind = 'blank') AS blank FROM (SELECT doc_id, {LINE} AS kind FROM documents)", plain=True)
def io2_tolerant_lines(spark, sf):
    """Every document's id and language as a line of JSON, some of them broken, blank or no object."""
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    line = F.when(i % 7 == 0, F.concat(F.lit('{"doc_id": '), i)).when(i % 11 == 0, "  ").when(i % 13 == 0, F.concat(F.lit("["), i, F.lit("]"))).otherwise(F.to_json(F.struct("doc_id", "lang")))
    path = folder(spark, "lines")
    d.select(line.alias("value")).write.text(path)
    rows, bad, blank = tables.read_jsonl_tolerant(spark, path, "doc_id long, lang string")
    one = rows.agg(F.count(F.lit(1)).alias("rows_read"), F.sum("doc_id").alias("ids")).crossJoin(bad.agg(F.count_if(F.col("error") == "not JSON").alias("not_json"), F.count_if(F.col("error") == "not an object").alias("not_objects")))
    return one.crossJoin(blank.agg(F.sum("blank").alias("blank")))  # one row each


@query("SELECT * FROM (SELECT r_regionkey AS key, r_name AS name, NULL::VARCHAR AS segment, NULL::INTEGER AS size FROM region UNION ALL SELECT c_custkey, c_name, c_mktsegment, NULL FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part)", plain=True)
def io3_read_many(spark, sf):
    frames = [("region", ["r_regionkey key", "r_name name"]), ("customer", ["c_custkey key", "c_name name", "c_mktsegment segment"]), ("part", ["p_partkey key", "p_name name", "p_size size"])]
    return tables.read_many([table(spark, sf, t).selectExpr(*c) for t, c in frames])


@query("SELECT count(*) AS vectors, sum(len(embedding)) ::BIGINT AS entries, round(sum(embedding[1]::DOUBLE), 6) + 0.0 AS first_sum FROM embeddings", plain=True)
def io4_fragments_of_vectors(spark, sf):
    """Vectors written as four fragments, which must be four, and checked against their runs one to one."""
    path = folder(spark, "vectors")
    runs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("run_id"), F.col("embedding").alias("vector"))
    runs.repartition(4).write.parquet(path)
    tables.read_fragments(spark, path, 4)
    v = tables.read_vectors(spark, path, runs.select("run_id"))
    return rounded(v.agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.size("v")).alias("entries"), F.sum(F.get("v", 0)).alias("first_sum")))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 3 <> 0", plain=True)
def io5_registry(spark, sf):
    path = folder(spark, "registry")
    table(spark, sf, "nation").selectExpr("n_nationkey id", "n_name name", "n_nationkey % 3 <> 0 included").write.csv(path, header=True)
    return tables.read_registry(spark, path, "id int, name string, included boolean").drop("included").withColumn("id", F.col("id").cast(table(spark, sf, "nation").schema["n_nationkey"].dataType))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders", plain=True)
def io6_sorted_results(spark, sf):
    """Orders written in the order of price: files and rows in files follow it, so places are counts of the files before."""
    path = folder(spark, "sorted")
    tables.write_sorted(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, ["o_totalprice", "o_orderkey"])
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "file").select("o_orderkey", "o_totalprice", (F.col("before") + F.col("row") + 1).alias("place"))


@query(" SELECT scenario_id, style_axis, model_id, seed, encoder_id, count(*) AS points, round(avg(projection_error_raw) FILTER (is_interior), 6) AS ice FROM geo GROUP BY ALL")
def io7_laid_out_trajectories(spark, sf):
    """Points and anchors laid out alike by trajectory, joined and grouped without an exchange."""
    p = points(spark, sf, True)
    laid, ends = tables.lay_out(p, geometry.TRAJECTORY), tables.lay_out(geometry.self_anchors(p), geometry.TRAJECTORY)
    s = geometry.with_geometry(laid, ends, geometry.TRAJECTORY)
    return rounded(s.groupBy(*geometry.TRAJECTORY).agg(F.count(F.lit(1)).alias("points"), F.avg(F.when(F.col("is_interior"), F.col("projection_error_raw"))).alias("ice")))


@query("SELECT event_type, a AS value, b AS expected, abs(a - b) <= 0.02 * abs(b) AS ok FROM (SELECT event_type, round(avg(value) FILTER (user_id % 2 = 1), 6) AS a, round(avg(value) FILTER (user_id % 2 = 0), 6) AS b FROM events GROUP BY 1)", plain=True)
def id24_within_tolerance(spark, sf):
    """Means over odd users against those over even ones, two percent apart at most."""
    e = table(spark, sf, "events")
    half = lambda k, name: e.where(F.col("user_id") % 2 == k).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias(name))
    return audit.within_tolerance(half(1, "value"), half(0, "expected"), ["event_type"], F.abs("expected") * 0.02).select("event_type", "value", "expected", "ok")
