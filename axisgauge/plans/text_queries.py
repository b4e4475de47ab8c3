"""Text quality and scenario pools over the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.operators import judges, pool, textq
from axisgauge.plans.calibration_queries import rounded
from axisgauge.plans.fixtures import table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TOK = "WITH t AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[㐀-鿿]|[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*'), lambda x: lower(x)) AS t FROM documents) "


@query(TOK + "SELECT doc_id, len(t) AS n_tokens, round((len(t) - len(list_distinct(t))) / nullif(len(t), 0)::DOUBLE, 6) AS repetition_rate, length(text) AS n_characters FROM t")
def tx23_text_quality(spark, sf):
    q = textq.quality_rows(table(spark, sf, "documents").select("doc_id", "text"))
    return rounded(q.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "repetition_rate", F.col("n_characters").cast("long").alias("n_characters")))


def distinct_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return f"round(CASE WHEN len(t) >= {n} THEN len(list_distinct(list_transform(range(1, len(t) - {n - 2}), lambda i: {gram}))) / (len(t) - {n - 1})::DOUBLE END, 6) AS distinct_{n}"


@query(TOK + f"SELECT doc_id, {distinct_sql(2)}, {distinct_sql(3)} FROM t")
def tx19_distinct_ngrams(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", textq.tokens(F.col("text")).alias("t"))
    return rounded(textq.distinct_shares(t, "doc_id", "t", (2, 3)))


@query("SELECT doc_id, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS cjk FROM documents")
def tx1_cjk_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", textq.cjk_count(F.col("text")).cast("long").alias("cjk"))


@query()
def tx21_longest_repeated_block(spark, sf):
    return table(spark, sf, "documents").select("doc_id", textq.longest_repeated_block("text").alias("block"))


@query("SELECT doc_id, length(text) < 200 AS too_short, length(text) > 2000 AS too_long, length(text) NOT BETWEEN 200 AND 2000 AS violation, greatest(200 - length(text), length(text) - 2000, 0) AS deviation, abs(length(text) - 1100.0)::DOUBLE AS from_middle FROM documents")
def tx24_length_compliance(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *textq.length_compliance(F.char_length("text").cast("long"), F.lit(200), F.lit(2000)))


MARKED = "concat(CASE doc_id % 9 WHEN 0 THEN ' Assistant: ' WHEN 1 THEN '助手：' WHEN 2 THEN '</Analysis>' WHEN 3 THEN '目标风格比例' WHEN 4 THEN '```' ELSE '' END, text)"


@query("WITH d AS (SELECT source, " + MARKED + " AS t FROM documents) SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(t, '^\\s*(?:assistant|助手)\\s*[:：]', 'i')) AS assistant_prefix, count(*) FILTER (regexp_matches(t, '</?think>|</?analysis>', 'i')) AS thinking_tag, count(*) FILTER (regexp_matches(t, '目标风格比例|请生成一段中文文本，使其风格')) AS prompt_echo, count(*) FILTER (t LIKE '%```%') AS code_fence FROM d GROUP BY 1")
def tx22_format_anomalies(spark, sf):
    """Every document, some with a marker put before it."""
    d = table(spark, sf, "documents").select("source", F.expr(MARKED).alias("t")).select("source", F.split(textq.anomalies(F.col("t")), r"\|").alias("a"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("a", k)).alias(k) for k in textq.ANOMALIES])


@query()
def tx25_hashed_vectors(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", textq.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return rounded(textq.hashed_vectors(t, "doc_id", "t").select("doc_id", F.size("v").alias("dims"), F.element_at("v", 1).alias("first"), F.array_max("v").alias("top")))


def candidates(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("axis_id"), F.col("doc_id").alias("input_ord"), F.col("text").alias("content"), "lang")


POOL = "WITH c AS (SELECT source AS axis_id, doc_id AS input_ord, text AS content, lang FROM documents) "


@query(POOL + "SELECT input_ord, len(list_filter([CASE WHEN length(content) < 12 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN regexp_matches(content, '[0-9]') THEN 'digits' END], lambda x: x IS NOT NULL)) AS n_reasons FROM c")
def tx8_validation_reasons(spark, sf):
    checks = {"short": F.char_length("content") >= 12, "language": F.col("lang") == "en", "digits": ~F.col("content").rlike("[0-9]")}
    return candidates(spark, sf).select("input_ord", F.size(pool.reasons(checks)).cast("long").alias("n_reasons"))


def contents(spark, sf):
    """Short contents, whole: the names of parts by type, in key order."""
    return table(spark, sf, "part").select(F.col("p_type").alias("axis_id"), F.col("p_partkey").alias("input_ord"), F.col("p_name").alias("content"), F.col("p_brand").alias("domain"))


BG = """WITH c AS (SELECT p_type AS axis_id, min(p_partkey) AS input_ord, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS t FROM part GROUP BY ALL), g0 AS (SELECT axis_id, input_ord, list_sort(list_distinct(CASE WHEN length(t) <= 2 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) END)) AS gs FROM c WHERE t <> ''),
g1 AS (SELECT axis_id, gs, min(input_ord) AS input_ord FROM g0 GROUP BY ALL), p AS (SELECT a.axis_id, a.input_ord AS late, b.input_ord AS early FROM g1 a JOIN g1 b USING (axis_id) WHERE b.input_ord < a.input_ord AND len(list_intersect(a.gs, b.gs)) * 20 >= (len(a.gs) + len(b.gs) - len(list_intersect(a.gs, b.gs))) * 9) """


@query(BG + "SELECT axis_id, late, early FROM p")
def tx12_near_pairs(spark, sf):
    """Between contents that stand for all with the same bigrams."""
    r = cut(pool.representatives(contents(spark, sf), "axis_id", "input_ord", "content"))
    return pool.near_pairs(r, "axis_id", "input_ord", "grams")


@query()
def tx12_greedy_rejection(spark, sf):
    r = cut(pool.representatives(contents(spark, sf), "axis_id", "input_ord", "content"))
    return pool.greedy_accept(r, cut(pool.near_pairs(r, "axis_id", "input_ord", "grams")), "axis_id", "input_ord", cut)


def curated(spark, sf):
    c = contents(spark, sf)
    return pool.curate(c.withColumn("reasons", pool.reasons({"content_too_short": F.char_length("content") >= 10})), "axis_id", "input_ord", "content", "reasons", cut)


@query()
def tx11_curated_contents(spark, sf):
    return curated(spark, sf).select("axis_id", "input_ord", "accepted", F.concat_ws("|", "reasons").alias("reasons"))


@query()
def tx15_pool_summary(spark, sf):
    c = cut(curated(spark, sf).select("axis_id", "input_ord", "domain", "accepted", "reasons"))
    final = pool.diverse_pick(c.where("accepted"), "axis_id", "domain", "input_ord", 3)
    return pool.pool_summary(contents(spark, sf), c.where("accepted"), final, c.where("not accepted"), "axis_id", "domain")


ANSWER = """concat('Here: ```json {"covered": [true, ', CASE WHEN doc_id % 4 = 0 THEN 'false' ELSE 'true' END, '], "added_key_information": false, "factual_contradict', CASE WHEN doc_id % 3 = 0 THEN 'ory' ELSE 'ion' END, '": ', CASE WHEN doc_id % 5 = 0 THEN 'true' ELSE 'false' END, ', "task_result_changed_by_addition": false, "unjudgeable": false, "style_B_intensity": ', CAST(doc_id % 120 AS STRING), ', "naturalness": ', CAST(1 + doc_id % 5 AS STRING), '} ```')"""


@query("SELECT doc_id, CASE WHEN doc_id % 120 > 100 THEN 'style_B_intensity' END AS error, CASE WHEN doc_id % 120 <= 100 THEN CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1.0 END END::DOUBLE AS coverage, CASE WHEN doc_id % 120 <= 100 THEN doc_id % 4 <> 0 AND doc_id % 5 <> 0 END AS passed FROM documents")
def tx4_lenient_judgments(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", judges.normalise_lenient(F.expr(ANSWER), F.lit(2)).alias("j"))
    return d.select("doc_id", "j.error", "j.coverage", "j.passed")


@query("SELECT conv_id, i + 1 AS nth, k AS turns FROM (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1), range(0, 3) r(i) WHERE NOT (i = 1 AND conv_id % 2 = 0)")
def tx7_numbered_candidates(spark, sf):
    """The array in each conversation's free answer: an object, an object or a number, an object."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"))
    raw = c.select("conv_id", F.concat(F.lit('Sure: [{"k": '), F.col("k").cast("string"), F.lit("}, "), F.when(F.col("conv_id") % 2 == 0, "7").otherwise(F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}"))), F.lit(', {"k": '), F.col("k").cast("string"), F.lit("}] done")).alias("raw"))
    return pool.number_candidates(raw, "raw", ["conv_id"]).select("conv_id", F.col("nth").cast("long").alias("nth"), F.try_variant_get("candidate", "$.k", "long").alias("turns"))


@query("SELECT doc_id, list_aggregate(list_sort(list_filter([CASE WHEN n < 12 THEN 'content_too_short' END, CASE WHEN n > 80 THEN 'content_too_long' END, CASE WHEN doc_id % 6 NOT BETWEEN 2 AND 4 THEN 'content_checks_count' END, CASE WHEN lang IS NULL OR lang <> 'en' THEN 'domain_tag_unpreferred' END, CASE WHEN text LIKE '%the%' THEN 'content_risk_word' END, CASE WHEN source LIKE '%1%' AND source NOT LIKE '%10%' THEN 'risk_note_review' END, CASE WHEN lang IS NULL OR lang = '' THEN 'missing:domain' END, CASE WHEN text IS NULL OR text = '' THEN 'missing:content' END], lambda x: x IS NOT NULL)), 'string_agg', '|') AS reasons FROM (SELECT *, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS n FROM documents)")
def tx9_review_reasons(spark, sf):
    d = table(spark, sf, "documents").withColumn("checks", F.array_repeat(F.lit("c"), (F.col("doc_id") % 6).cast("int")))
    found = pool.review_reasons({"content": F.col("text"), "checks": F.col("checks"), "domain": F.col("lang"), "risk_note": F.col("source")}, ["en"], ["the"], ["1"], "10")
    return d.select("doc_id", F.concat_ws("|", F.array_sort(F.filter(found, lambda x: x != "missing:checks"))).alias("reasons"))


@query(POOL + "SELECT axis_id, input_ord, axis_id || '_' || lpad(r::VARCHAR, 3, '0') AS scenario_id FROM (SELECT *, row_number() OVER (PARTITION BY axis_id ORDER BY input_ord) AS r FROM c) WHERE r <= 8")
def tx13_cap_and_number(spark, sf):
    return pool.cap_and_number(candidates(spark, sf), "axis_id", "input_ord", 8).select("axis_id", "input_ord", "scenario_id")


@query(POOL + ", t AS (SELECT *, row_number() OVER (PARTITION BY axis_id, lang ORDER BY input_ord) AS turn, count(*) OVER (PARTITION BY axis_id, lang) AS size FROM c) SELECT axis_id, input_ord, place FROM (SELECT *, row_number() OVER (PARTITION BY axis_id ORDER BY turn, size DESC, lang)::INT AS place FROM t) WHERE place <= 6")
def tx14_diverse_pick(spark, sf):
    return pool.diverse_pick(candidates(spark, sf), "axis_id", "lang", "input_ord", 6).select("axis_id", "input_ord", "place")


@query("SELECT source AS axis_id, lang, count(*) AS n FROM documents GROUP BY ALL")
def tx16_axis_by_domain(spark, sf):
    return candidates(spark, sf).groupBy("axis_id", "lang").agg(F.count(F.lit(1)).alias("n"))
