"""What the operators share: the cluster's shared folder, written intermediate tables, and text splitting rules."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisgauge.functions.lineage import shared_dir

#: The white space that separates words everywhere in this subpackage: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
#: A side is broadcast only if it has been found to have at most so many rows and so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed inside hands Python batches of at most so many rows: whole texts may be long, and every core holds
    a batch twice, in Arrow vectors of the JVM and in its Python worker. A smaller setting of the session's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def width_of(name: str, kind: T.DataType) -> F.Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(F.col(f"`{name}`")) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.aggregate(F.col(f"`{name}`"), F.lit(16), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 24)
        return F.size(F.col(f"`{name}`")) * 24 + 16
    return F.lit(16)


def small(df: DataFrame, rows: int | None = None, bytes_: int | None = None) -> DataFrame:
    """With a broadcast hint if the table, which must be cheap to read, has at most so many rows and bytes; else as it is."""
    rows, bytes_ = rows or BROADCAST_ROWS, bytes_ or BROADCAST_BYTES
    each = F.lit(0)
    for f in df.schema.fields:
        each = each + F.coalesce(width_of(f.name, f.dataType), F.lit(16))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("b")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["b"] or 0) <= bytes_ else df


def words(text) -> F.Column:
    """The words of a text, white space as in SPACE; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
