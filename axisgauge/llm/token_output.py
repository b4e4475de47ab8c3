"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt into ranges of ids and sorted, encoded range by range, and written by Spark's ORC writer, one file
for each range. A reader splits the files at stripes; a search for some ids skips files, stripes and row groups by
their statistics and Bloom filters. `start` comes from the files alone: a running sum inside each file, and the sum of
the files before it, so that no task sees more than one file's rows.

Defined results: null text counts as empty and gives the end id only; null ids come first; rows with equal ids keep
some order among themselves, the one in which the files have them; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisgauge.llm.bytesplit import blocks, packed, release
from axisgauge.llm.common import scratch
from axisgauge.llm.wordbpe import BLOCK, encoder

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Bytes of text of a file: at most so many, and at least so many while there are fewer files than shuffle partitions.
MOST, LEAST = 128 << 20, 4 << 20
#: Files whose totals are added up in one group.
BLOCK_OF_FILES = 1000


def token_rows(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id and ids (array of int, the end id last), in the rows' own order; docs has doc_id and text."""

    def rows(keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        to = np.cumsum(counts)
        ids = np.insert(ids, to, end).astype(np.int32)
        offsets = np.concatenate([[0], to + np.arange(1, len(to) + 1)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        for batch in batches:
            data, bounds = packed(batch.column("text"))
            held: list[np.ndarray] = []
            for first, part, b, more in blocks(data, bounds, BLOCK):
                ids, counts = model.block(part, b)
                if more:
                    held.append(ids)
                    continue
                if held:  # the last part of one long text
                    ids, held = np.concatenate([*held, ids]), []
                    counts = np.array([len(ids)])
                yield rows(batch.column("doc_id").slice(first, len(counts)), ids, counts)
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, row_group: int = 1000) -> None:
    """Writes the folder of ORC files, in ascending order of ids from file to file and within each."""
    if files is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
        files = max(1, -(-size // MOST), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST)))
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    (
        token_rows(ordered, tokenizer).write.option("compression", "zstd")
        .option("orc.create.index", "true").option("orc.row.index.stride", row_group)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id and ids; with a list of ids, only those, skipping what the files' indexes rule out."""
    rows = spark.read.orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin(ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Read from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.orc(path)
    kind = files.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}  # a task may read several stretches of files; rows keep their order in each
        for batch in batches:
            lists = batch.column("ids")
            at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            sums = [zlib.crc32(values[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
            order = []
            for k in keys:
                seen[k] = seen.get(k, -1) + 1
                order.append(seen[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("block"), pa.array(order, pa.int64()), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "file", "block", "nth", "n_tokens", "ids_crc32"],
            )
        release()

    place = files.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = place.mapInArrow(digest, f"doc_id {kind}, file string, block long, nth long, n_tokens long, ids_crc32 long")
    inside = rows.withColumn("within", F.sum("n_tokens").over(Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)))
    # Spark numbers the files of one write by their range, so their numbers are in the order of ids; a row for each file
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    totals = files.select(F.col("_metadata.file_name").alias("file"), F.size("ids").cast("long").alias("n")).groupBy("file").agg(F.sum("n").alias("n")).select("file", "n", number.alias("number"), F.floor(number / BLOCK_OF_FILES).alias("some"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = totals.withColumn("before", earlier(Window.partitionBy("some").orderBy("number")))
    thousands = totals.groupBy("some").agg(F.sum("n").alias("n")).select("some", earlier(Window.orderBy("some")).alias("base"))  # a row for each thousand files
    starts = before.join(thousands, "some").select("file", (F.col("before") + F.col("base")).alias("before"))
    return inside.join(starts, "file").select("doc_id", (F.col("before") + F.coalesce("within", F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path(TOKENIZER))
    return token_index(spark, path)
