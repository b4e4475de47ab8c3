"""Size-tiered compaction of document shards under a versioned manifest.

A store is a folder: `data/` has immutable Parquet files, `manifest/v=N` lists the live ones of version N. `append`
writes arrivals as small shards of about `SMALL` bytes of text, each task its own, and commits the next version. `compact`
puts the live shards in tiers by size (a factor of `RATIO` each); where a tier has at least `RUNS` shards, its similarly
sized runs are merged into files of about the target size, and so on up the tiers until none has so many; fewer are left
for later arrivals. Merging reads whole files and coalesces, so no row is shuffled. A version is written beside the others and then renamed to its name, which fails if another writer
was first: readers see a version whole or not at all. Data files of a version that could not be committed are removed;
should the writer die before that, no version names them and nothing reads them. Older versions stay until `expire`.
The driver holds the manifest, a line for each file: at the target size about a millionth of the data.

Defined results: all columns and rows are kept as they are, nulls, repeats and empty texts included; an empty table
commits a version without shards; a column named shard is kept in the store, and replaced in what `read` returns.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisgauge.llm.common import scratch

RATIO, RUNS = 4, 4
SMALL, TARGET = 2 << 20, 32 << 20
MANIFEST = T.StructType().add("version", "long").add("file", "string").add("bytes", "long").add("n_rows", "long").add("tier", "integer")


def _context(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(path), spark.sparkContext._jsc.hadoopConfiguration()), jvm


def versions(spark: SparkSession, store: str) -> list[int]:
    files, jvm = _context(spark, store)
    folder = jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    if not files.util().exists(folder):
        return []
    return sorted(int(s.getPath().getName()[2:]) for s in files.util().listStatus(folder) if s.getPath().getName().startswith("v="))


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The live shards of a version, the last one by default."""
    version = max(versions(spark, store), default=0) if version is None else version
    if not version:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in MANIFEST])
    return spark.read.schema(MANIFEST).json(f"{store}/manifest/v={version}")


def commit(spark: SparkSession, store: str, shards: DataFrame, version: int) -> None:
    """Makes `shards` the version, or fails if there is one of that number."""
    files, jvm = _context(spark, store)
    path = jvm.org.apache.hadoop.fs.Path
    staged = f"{store}/staged-{uuid.uuid4().hex}"
    shards.withColumn("version", F.lit(version).cast("long")).coalesce(1).write.json(staged)
    folder = path(f"{store}/manifest")
    if not files.util().exists(folder):
        files.mkdir(folder, None, True)
    target = path(f"{store}/manifest/v={version}")
    # rename without overwriting is atomic; it raises if the target has files in it
    files.rename(path(staged), target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes, n_rows and tier of a folder's Parquet files; contents are not read, nor columns."""
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    counts = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))
    tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / F.lit(float(1 << 20))) / math.log(RATIO))).cast("int")
    return sizes.join(counts, "name").select(F.concat(F.lit(folder + "/"), "name").alias("file"), "bytes", "n_rows", tier.alias("tier"))


def written_shards(rows: DataFrame, folder: str, version: int, live: DataFrame, store: str, most: int = 0) -> None:
    """Writes rows as shards and commits them beside the live ones; without a commit nothing of them stays."""
    spark, columns = rows.sparkSession, MANIFEST.names[1:]
    try:
        rows.write.option("maxRecordsPerFile", most).option("compression", "zstd").parquet(folder)
        commit(spark, store, live.select(*columns).unionByName(listed(spark, folder).select(*columns)), version)
    except Exception:
        files, jvm = _context(spark, store)
        files.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
        raise


def rows_for(docs: DataFrame, size: int) -> int:
    """How many rows have about so many bytes of text."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in docs.schema.fields if isinstance(f.dataType, T.StringType)]
    each = docs.agg(F.avg(sum(texts, F.lit(8)))).first()[0] or 1.0
    return max(1, round(size / each))


def append(docs: DataFrame, store: str, rows_per_shard: int | None = None) -> int:
    """Writes the arrivals as small shards, without a shuffle, and commits them on top of the last version."""
    spark = docs.sparkSession
    last = max(versions(spark, store), default=0)
    folder = f"{store}/data/{last + 1:08d}-{uuid.uuid4().hex}"
    written_shards(docs, folder, last + 1, manifest(spark, store, last), store, rows_per_shard or rows_for(docs, SMALL))
    return last + 1


def compact(spark: SparkSession, store: str, target: int = TARGET, runs: int = RUNS) -> int:
    """Merges tiers with enough runs, from the smallest up, a version for each; returns the last version."""
    while True:
        last = max(versions(spark, store), default=0)
        live = manifest(spark, store, last)
        below = live.where(F.col("bytes") < 0.75 * target)
        full = below.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total")).where(F.col("n") >= runs).orderBy("tier").first()
        if full is None:
            return last
        merged = (F.col("tier") == full["tier"]) & (F.col("bytes") < 0.75 * target)
        paths = [r["file"] for r in live.where(merged).orderBy("file").collect()]
        folder = f"{store}/data/{last + 1:08d}-{uuid.uuid4().hex}"
        # fewer files each time, so that this ends
        rows = spark.read.parquet(*paths).coalesce(max(1, min(round(full["total"] / target), len(paths) - 1)))
        written_shards(rows, folder, last + 1, live.where(~merged), store)


def expire(spark: SparkSession, store: str) -> None:
    """Deletes data files that only versions before the last name, and those versions."""
    files, jvm = _context(spark, store)
    path, known = jvm.org.apache.hadoop.fs.Path, versions(spark, store)
    live = {r["file"] for r in manifest(spark, store).select("file").collect()}
    for version in known[:-1]:
        for r in manifest(spark, store, version).select("file").collect():
            if r["file"] not in live:
                files.delete(path(r["file"]), False)
        files.delete(path(f"{store}/manifest/v={version}"), True)


def read(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The rows of a version, with the live file that each is in as column shard."""
    paths = [r["file"] for r in manifest(spark, store, version).select("file").collect()]
    if not paths:
        raise ValueError(f"{store} has no shards in this version")
    return spark.read.parquet(*paths).withColumn("shard", F.col("_metadata.file_path"))


def shard(docs: DataFrame, store: str | None = None, arrivals: list[DataFrame] | None = None, target: int = TARGET) -> DataFrame:
    """Appends the documents (as several arrivals where given), compacts, and returns the rows with their shard. In a store
    of its own older versions go at once; a given one keeps them for its readers."""
    spark = docs.sparkSession
    own = store is None
    store = store or scratch(spark, "store")
    for each in arrivals or [docs]:
        append(each, store)
    compact(spark, store, target)
    if own:
        expire(spark, store)
    if not manifest(spark, store).where("n_rows > 0").limit(1).count():
        return docs.withColumn("shard", F.lit(None).cast("string")).limit(0)
    return read(spark, store)


def ordinal(path: F.Column) -> F.Column:
    """A shard's name without what is drawn for it: the version that wrote it, the task, and the task's file."""
    version = F.regexp_extract(path, r"/data/([0-9]+)-[0-9a-f]+/", 1)
    return F.concat_ws("-", version, F.regexp_extract(path, r"part-([0-9]+)-", 1), F.regexp_extract(path, r"-c([0-9]+)\.[^/]*$", 1))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard (version, task and number of the file that it is in) and bytes of text; arrivals are the table's files, four at a time."""
    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path)
    files = sorted(docs.inputFiles())
    arrivals = [spark.read.schema(docs.schema).parquet(*files[i : i + 4]) for i in range(0, len(files), 4)]
    rows = shard(docs, arrivals=arrivals)
    return rows.select("doc_id", ordinal(F.col("shard")).alias("shard"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
