"""Readers and writers: JSON lines (strict and tolerant), fragments, registries, vectors, sorted results, resuming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisgauge.functions.lineage import shared_dir


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; the first malformed line fails the job with its file and text. A path without files
    gives no rows."""
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    v = F.try_parse_json("value")
    bad = v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    checked = lines.where(F.trim("value") != "").withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("malformed line in "), "file", F.lit(": "), F.substring("value", 1, 200))).cast("string")).otherwise(F.col("value")))
    return checked.select(F.from_json("value", schema).alias("r")).select("r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, as Python counts them), value. Files are read in splits: each task numbers the lines of its splits, and
    a split's lines follow those of the file's earlier splits, whose numbers of lines are counted beforehand."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            places = []
            for k in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                seen[k] = seen.get(k, 0) + 1
                places.append(seen[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["file", "block", "value", "nth"])

    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))  # a row for each split
    before = splits.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return raw.mapInArrow(number, "file string, block long, value string, nth long").join(before, ["file", "block"]).select("file", (F.col("before") + F.col("nth")).alias("line"), "value")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows; bad lines (file, number, first 200 characters); and blank lines' count by file. A file's lines are numbered
    inside the file, whatever its size."""
    whole = numbered_lines(spark, path)
    v = F.try_parse_json("value")
    fine = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    filled = whole.where(F.trim("value") != "")
    rows = filled.where(fine).select("file", "line", F.from_json("value", schema).alias("r")).select("file", "line", "r.*")
    bad = filled.where(~fine).select("file", "line", F.when(v.isNull(), "not JSON").otherwise("not an object").alias("error"), F.substring("value", 1, 200).alias("preview"))
    return rows, bad, whole.where(F.trim("value") == "").groupBy("file").agg(F.count(F.lit(1)).alias("blank"))


def read_many(frames: list[DataFrame]) -> DataFrame:
    """Tables with differing fields under each other."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_fragments(spark: SparkSession, pattern: str, expected: int | None = None) -> DataFrame:
    df = spark.read.parquet(pattern)
    if expected is not None and len(df.inputFiles()) != expected:
        raise ValueError(f"{pattern}: {len(df.inputFiles())} fragments, {expected} expected")
    return df


def read_registry(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True).where("included")


def read_vectors(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """Vectors (run_id, vector), one for each run and no others; doubles."""
    vectors = spark.read.parquet(path).select("run_id", F.col("vector").cast("array<double>").alias("v"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("d")).first()
    if n["n"] != n["d"] or not runs.join(vectors, "run_id", "left_anti").isEmpty() or not vectors.join(runs, "run_id", "left_anti").isEmpty():
        raise ValueError(f"{path}: vectors and runs do not match one to one")
    return vectors


def write_sorted(df: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").format(kind).save(path)


def not_yet_done(planned: DataFrame, done: DataFrame, key: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Planned jobs that are neither done nor, where given, failed for good."""
    left = planned.join(done.select(*key), key, "left_anti")
    return left if failed is None else left.join(failed.select(*key), key, "left_anti")


def lay_out(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """The table written in buckets of its keys, sorted in each, and read back: joins and groups by all of these keys, between
    tables laid out alike, need no exchange. As many buckets as shuffle partitions, unless given."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"laid_out_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
