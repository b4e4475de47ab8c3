"""Text quality: characters, tokens, distinct n-grams, repeats, format anomalies, length compliance, hashed vectors."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisgauge.operators import resampling

#: Anomalies by name (fixed patterns).
ANOMALIES = {"assistant_prefix": r"(?i)^\s*(?:assistant|助手)\s*[:：]", "thinking_tag": r"(?i)</?think>|</?analysis>", "prompt_echo": r"目标风格比例|请生成一段中文文本，使其风格", "code_fence": r"```"}
#: One token: a CJK character, or an ASCII run with inner dots, underscores, slashes or hyphens (fixed pattern).
TOKEN = r"[㐀-鿿]|[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*"


def cjk_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[^一-鿿]", ""))


def strip_reasoning(text: Column, open_to_end: bool = False) -> Column:
    out = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?is)^.*?</think>", "")
    out = F.regexp_replace(out, r"(?is)<think>.*$", "") if open_to_end else out
    return F.regexp_replace(F.regexp_replace(out, r"(?i)</?think>", ""), r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Single CJK characters, and ASCII runs with dots, underscores, slashes or hyphens inside; lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def repetition(t: Column) -> Column:
    return F.when(F.size(t) > 0, (F.size(t) - F.size(F.array_distinct(t))) / F.size(t))


def distinct_shares(rows: DataFrame, key: str, t: str, lengths: tuple[int, ...]) -> DataFrame:
    """key, and distinct_n for each length n: distinct n-grams as a share of all, null with fewer than n tokens. One row's tokens
    are looked at at a time."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in lengths]
            for row in batch.column(1):
                words = row.as_py()
                for n, share in zip(lengths, out, strict=True):
                    every = 0 if words is None else len(words) - n + 1
                    share.append(len(set(zip(*[words[k:] for k in range(n)], strict=False))) / every if every > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(share, pa.float64()) for share in out]], [key, *[f"distinct_{n}" for n in lengths]])

    schema = T.StructType([rows.schema[key], *[T.StructField(f"distinct_{n}", T.DoubleType()) for n in lengths]])
    return rows.select(key, t).mapInArrow(shares, schema)


@F.pandas_udf(T.IntegerType())
def longest_repeated_block(texts: pd.Series) -> pd.Series:
    """Twice the greatest width (40 at most) of a block that follows itself at once, white space left out; 0 if none."""
    out = []
    for text in texts:
        x = np.frombuffer("".join((text or "").split()).encode("utf-32-le"), np.uint32)
        best = 0
        for width in range(min(40, len(x) // 2), 0, -1):
            same = np.concatenate([[0], np.cumsum(x[width:] != x[:-width])])
            if (same[width:] == same[:-width]).any():
                best = 2 * width
                break
        out.append(best)
    return pd.Series(out, dtype="int32")


def anomalies(text: Column) -> Column:
    return F.concat_ws("|", *[F.when(text.rlike(p), F.lit(k)) for k, p in ANOMALIES.items()])


def length_compliance(length: Column, low: Column, high: Column) -> list[Column]:
    off = F.when(length < low, low - length).when(length > high, length - high).otherwise(F.lit(0))
    return [(length < low).alias("too_short"), (length > high).alias("too_long"), (off > 0).alias("violation"), off.alias("deviation"), F.abs(length - (low + high) / 2.0).alias("from_middle")]


BUCKETS = 256


def signed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, x: signed bucket sums of each row's n-grams; one row's tokens at a time."""
    for batch in batches:
        x = np.zeros((batch.num_rows, BUCKETS))
        for row in range(batch.num_rows):
            t = batch.column(1)[row].as_py() or []
            if None in t:  # left out of its n-grams
                hashes = [crc32("\x1f".join(w for w in t[i : i + n] if w is not None).encode()) for n in (1, 2, 3) for i in range(len(t) - n + 1)]
            else:
                words = [w.encode() for w in t]
                later = [b"\x1f" + w for w in words]
                one = [crc32(w) for w in words]
                two = [crc32(w, h) for w, h in zip(later[1:], one, strict=False)]
                hashes = [*one, *two, *(crc32(w, h) for w, h in zip(later[2:], two, strict=False))]
            h = np.array(hashes, np.int64)
            x[row] = np.bincount(h & BUCKETS - 1, np.where(h >= 1 << 31, 1.0, -1.0), BUCKETS)
        ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BUCKETS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], [batch.schema.names[0], "x"])


def hashed_vectors(rows: DataFrame, key: str, t: str) -> DataFrame:
    """key, v: token uni-, bi- and trigrams in signed buckets by CRC-32 (low byte the bucket, highest bit the sign),
    scaled to length one; zeros without tokens. A row's n-grams are summed in the task that has it; rows of one key are added."""
    schema = T.StructType([rows.schema[key], T.StructField("x", T.ArrayType(T.DoubleType()))])
    each = resampling.added(rows.select(key, t).mapInArrow(signed_counts, schema), [key], ["x"])
    n = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b))
    return each.withColumn("n", n).select(key, F.transform("x", lambda b: b / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).alias("v"))


def quality_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    t = rows.withColumn("_t", tokens(F.coalesce(F.col(text), F.lit(""))))
    return t.select(
        *rows.columns, F.size("_t").alias("n_tokens"), repetition(F.col("_t")).alias("repetition_rate"), anomalies(F.col(text)).alias("format_anomalies"),
        F.char_length(text).alias("n_characters"), (F.coalesce(F.char_length(F.trim(text)), F.lit(0)) == 0).alias("is_empty"),
    )
