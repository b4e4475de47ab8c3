"""Benchmark decontamination: which documents contain which short test items.

A test item is contained when a document has at least num / den (0.8) of the item's distinct five-word shingles,
anywhere in its whole text. Items are partitioned by size (powers of two of their number of shingles). Each item has a
bottom-k MinHash sketch: its k smallest shingle hashes, k set by its partition's largest size n as
n - ceil(0.8 n) + 1, so that every document that contains the item has at least one hash of the sketch; the search
therefore misses nothing, however long the document is (banded signatures of whole documents miss short items in long
ones, since the Jaccard similarity is near 0). Candidates are verified on the shingles' words.

Words: lower-cased, split at white space. Items with fewer than five words have their whole sequence as one shingle.
Defined results: null or empty texts contain nothing and are contained in nothing; equal texts with different ids are
found each, repeated item rows (id and text) once, and different texts with one id are items of their own; rows with a
null id, documents and items, are searched and carry the null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from axisgauge.llm.common import SPACE, small, written

WIDTH = 5
#: So many distinct sketch hashes are sent to the executors at once; more take further passes over the documents.
HASHES = 1_000_000


def lower_words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def shingled(w: Column, width: Column) -> Column:
    """Distinct shingles as strings."""
    at = F.sequence(F.lit(1), F.size(w) - width + 1)
    return F.when(F.size(w) >= width, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, width), " ")))).otherwise(F.array().cast("array<string>"))


def hashed(w: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(width)])


def hashed_at(w: Column, width: int, at: Column) -> Column:
    return hashed(w, at, width)


def sketches(items: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(key, item_id, width, n, shingles), and (width, h, key): the k smallest distinct hashes of each distinct item row.
    The key is the row's own, since ids may be null or stand for several texts; it is written, so that it stays."""
    w = lower_words(F.col("text"))
    base = items.dropDuplicates(["item_id", "text"]).select(F.monotonically_increasing_id().alias("key"), "item_id", w.alias("w")).where("size(w) > 0")
    base = written(base, "items").withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    whole = base.select("key", "item_id", "w", "width", shingled(F.col("w"), F.col("width")).alias("shingles")).withColumn("n", F.size("shingles"))
    whole = whole.withColumn("part", F.floor(F.log2("n"))).withColumn("least", F.ceil(F.col("n") * num / den).cast("int"))
    k = whole.groupBy("part").agg(F.max(F.expr("n - least + 1")).alias("k"))  # one row for each power of two
    found = whole.join(F.broadcast(k), "part").select("key", "k", "width", F.explode("shingles").alias("s"))
    words = F.split("s", " ")
    h = F.when(F.col("width") == WIDTH, hashed(words, F.lit(0), WIDTH))
    for m in range(1, WIDTH):
        h = h.when(F.col("width") == m, hashed(words, F.lit(0), m))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("h"))
    low = found.select("key", "k", "width", h.alias("h")).distinct().withColumn("nth", nth).where("nth <= k").select("width", "h", "key")
    return whole.select("key", "item_id", "width", "n", "least", "shingles"), low


def contained_items(docs: DataFrame, items: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared: one row for each document and item that it contains."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole, low = sketches(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), num, den)
    whole, low = written(whole, "shingles"), written(low, "sketches")
    words = docs.select("doc_id", lower_words(F.col("text")).alias("w"))
    found = None
    for m in sorted(r["width"] for r in low.select("width").distinct().collect()):  # five at most
        # hashes first, then rows: a row that carried the words would copy them once for each shingle. explode_outer,
        # since from explode the optimizer infers a filter in which the words are split anew for each shingle.
        hashes = F.transform(F.sequence(F.lit(0), F.size("w") - m), functools.partial(hashed_at, F.col("w"), m))
        each = words.select("doc_id", F.when(F.size("w") >= m, F.array_distinct(hashes)).alias("hashes")).select("doc_id", F.explode_outer("hashes").alias("h"))
        own = low.where(F.col("width") == m).select("h", "key")
        sent = written(own.select("h").distinct(), "hashes")
        passes = max(1, -(-sent.count() // HASHES))
        for k in range(passes):
            part = sent.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == k)
            # HASHES numbers, give or take their spread; few rows are left for the join with the keys
            hits = each.join(F.broadcast(part), "h", "left_semi").distinct().join(own, "h").select("doc_id", "key").distinct()
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.join(whole.select("item_id", F.col("n").cast("long").alias("n_item_shingles"), F.lit(0).cast("long").alias("n_shared")).limit(0), F.lit(True)).drop("text")
    found = written(found, "candidates")
    by_doc = found.groupBy("doc_id").agg(F.collect_set("key").alias("items"))  # a document has a bounded number of items
    candidates = (
        docs.join(small(by_doc), docs.doc_id.eqNullSafe(by_doc.doc_id)).select(docs.doc_id, "text", F.explode("items").alias("key"))
        .join(small(whole), "key").select("doc_id", "item_id", "n", "least", "shingles", "width", lower_words(F.col("text")).alias("w"))
    )
    shared = F.size(F.array_intersect("shingles", shingled(F.col("w"), F.col("width"))))
    rows = candidates.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item_shingles"), "least", shared.cast("long").alias("n_shared"))
    # written first: the filter would be pushed into the scan and split the words anew for each shingle
    return written(rows, "verified").where("n_shared >= least").select("doc_id", "item_id", "n_item_shingles", "n_shared")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = """
WITH w AS (SELECT 0 AS k, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
i AS (SELECT id, least(5, len(w)) AS m, w FROM w WHERE k = 1 AND len(w) > 0),
si AS (SELECT DISTINCT id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda j: array_to_string(w[j:j+m-1], ' '))) AS s FROM i),
n AS (SELECT id, count(*) AS n FROM si GROUP BY id),
sd AS (SELECT DISTINCT id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda j: array_to_string(w[j:j+m-1], ' '))) AS s FROM w, (SELECT DISTINCT m FROM i) WHERE k = 0 AND len(w) >= m)
SELECT sd.id AS doc_id, si.id AS item_id, n.n AS n_item_shingles, count(*) AS n_shared FROM sd JOIN si USING (m, s) JOIN n ON n.id = si.id
GROUP BY ALL HAVING 5 * count(*) >= 4 * n.n
"""
