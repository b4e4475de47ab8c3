"""Exact deduplication as a streaming job with keyed state.

The state, in RocksDB on the executors' disks and backed up in the checkpoint folder, has for each digest the first
document's stable identifier, its content locator (file and row) and the number of documents; it never expires, so a
later run with the same checkpoint folder goes on from it. A document whose digest is already known is a hit: its
full bytes are compared with those of the document that the locator names. Bytes that differ (a digest collision)
form groups of their own.

Defined results: null text counts as empty; empty texts are equal; null ids come after all others; of rows with one
id and one text the first by file and row stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisgauge.llm.common import SPACE, scratch, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # many small stores: without this each reserves some MB of disk ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(frame: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """id, text (normalised), digest and place: a struct that orders documents and locates their content."""
    place = F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    return frame.select(place.alias("place"), normalised(F.col(text_col)).alias("norm")).select("place", "norm", digest(F.col("norm")).alias("digest"))


def update_state(spark: SparkSession, path: str, state: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 4096) -> str:
    """Streams the files of `path` that the state in folder `state` hasn't seen; returns the folder of changed keys, by batch."""
    groups = f"{state}/groups"
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        folder, _, name = path.rstrip("/").rpartition("/")  # the braces: a table may be a single file
        source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{{{name}}}")
        state_rows = located(source, id_col, text_col, digest).groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        query = (
            state_rows.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{groups}/batch={batch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return groups


def exact_dedup(spark: SparkSession, path: str, state: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, place (file and row)."""
    schema = spark.read.parquet(path).schema
    id_type = schema[id_col].dataType
    docs = located(spark.read.schema(schema).parquet(path), id_col, text_col, digest)
    if docs.isEmpty():
        return docs.select(F.col("place.id").alias("doc_id"), F.col("place.id").cast(id_type).alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "place")
    changed = spark.read.parquet(update_state(spark, path, state or scratch(spark, "dedup"), id_col, text_col, digest))
    # each batch has the new value of the keys that it changed: the last one counts
    groups = changed.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("g")).select("digest", "g.first", "g.n")
    # texts are shuffled once, those of hits are kept for the comparison
    hits = written(docs.join(groups.where("n > 1").select("digest", "first"), "digest"), "hits")
    stays = hits.where("place = first").select("digest", F.col("norm").alias("stays"))
    differ = hits.where("place != first").join(stays, "digest").where("norm != stays").select("digest", "place", "norm")
    differ = written(differ, "collisions")  # this compares the bytes of every hit; the table is empty unless digests collide
    rows = docs.select("place", "digest").join(groups, "digest")
    if not differ.isEmpty():
        less = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
        own = differ.groupBy("digest", "norm").agg(F.min("place").alias("own_first"), F.count(F.lit(1)).alias("own_n"))
        own = differ.join(own, ["digest", "norm"]).select("digest", "place", "own_first", "own_n")
        rows = (
            rows.join(less, "digest", "left").join(own, ["digest", "place"], "left")
            .select("place", "digest", F.coalesce("own_first", "first").alias("first"), F.coalesce("own_n", F.col("n") - F.coalesce("less", F.lit(0))).alias("n"))
        )
    return rows.select(
        F.col("place.id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("place") == F.col("first")).alias("kept"), "digest", "place",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM t
"""
