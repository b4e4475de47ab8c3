"""Hard negatives: rows of another label that score nearly as high with an anchor as one of its positives does.

Vectors become integers, x = floor(scale * c); a score is the integer inner product. Every row is dealt to a slot of
bounded size, and every anchor goes to every slot: a task holds one slot's candidates and multiplies tiles of anchors
with them by Strassen's recursion on 64-bit integers. Sides are filled up with zeros to even sizes; sums wrap around
modulo 2^64, so a result that fits is exact whatever its parts do. From a tile come two kinds of heaps, each anchor's
best rows of its own label and, once those are known, each positive's best rows in its window of scores. Heaps of the
slots are merged by Spark: their number of rows is bounded by anchors, slots and heap size, never by pairs of rows.

Defined results: rows with a null label or a null vector, or with null or non-finite components take no part; shorter
vectors count as zero beyond their end; a repeated row is a row of its own, as an anchor, positive or negative; equal
scores come in the order of ids, null ids last; a positive whose window is empty has no rows; the scores' bound must
fit in 62 bits (after multiplying by 100), else the job fails; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisgauge.llm.common import written
from axisgauge.llm.whitening import dense, finite

SCALE, POSITIVES, NEGATIVES = 256.0, 5, 5
#: A negative's score times 100 lies from `LEAST` times to 100 times the positive's.
LEAST = 80
#: Bytes of a slot's vectors as 64-bit integers, anchors in a tile, and the side at which Strassen's recursion ends.
SLOT_BYTES, TILE, LEAF = 8 << 20, 128, 32
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of 64-bit integers, modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    p4, p5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    p6, p7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's `most` highest allowed scores, of equal ones those furthest to the left."""
    rows = np.flatnonzero(allowed.any(1))
    scores, allowed = scores[rows], allowed[rows]
    n = scores.shape[1]
    if len(rows) and int(np.abs(scores).max()) < (1 << 62) // n:
        order = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), NONE)
        at = np.argpartition(order, n - most, axis=1)[:, n - most :] if n > most else np.broadcast_to(np.arange(n), order.shape)
    else:
        at = np.argsort(np.where(allowed, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :most]
    kept = np.take_along_axis(allowed, at, 1)
    return rows[np.nonzero(kept)[0]], at[kept]


class Slot:
    """A slot's candidates, in the order in which equal scores count."""

    def __init__(self, parts: list[pa.RecordBatch]):
        held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        order = pa.compute.sort_indices(pa.table({"n": held.column("id").is_null(), "id": held.column("id"), "key": held.column("key")}), sort_keys=[("n", "ascending"), ("id", "ascending"), ("key", "ascending")])
        held = held.take(order)
        self.id, self.key, self.label = held.column("id"), held.column("key").to_numpy(), held.column("label").to_numpy(zero_copy_only=False)
        self.x = integers(held.column("v"))

    def scores(self, x: np.ndarray) -> np.ndarray:
        width = max(x.shape[1], self.x.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, self.x))
        if 100.0 * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width >= 2.0**62:
            raise OverflowError("scores do not fit in 62 bits")
        return strassen(a, np.ascontiguousarray(b.T))


def integers(lists: pa.ListArray, scale: float = SCALE) -> np.ndarray:
    x = np.floor(dense(lists).astype(np.float64) * scale)
    if np.abs(x).max(initial=0) >= 2.0**53:
        raise OverflowError("scores do not fit in 62 bits")
    return x.astype(np.int64)


def heaps(rows: DataFrame, id_type: str, wanted: int, windows: bool) -> DataFrame:
    """rows dealt to slots, candidates before anchors. anchor (key), place (of the positive, 0 for positives' own heaps),
    score, id and key of the heap's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, slot = None, [], None
        for batch in batches:
            of, is_anchor = batch.column("slot").to_numpy(), batch.column("is_anchor").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero((of[1:] != of[:-1]) | (is_anchor[1:] != is_anchor[:-1])) + 1).tolist(), len(of)] if len(of) else []
            for first, end in zip([0, *ends[:-1]], ends, strict=True):
                piece = batch.slice(first, end - first)
                if of[first] != number:
                    number, parts, slot = of[first], [], None
                if not is_anchor[first]:
                    parts.append(piece)
                    continue
                if slot is None and parts:
                    slot, parts = Slot(parts), []
                if slot is not None:
                    for at in range(0, piece.num_rows, TILE):
                        yield tile(piece.slice(at, TILE), slot)

    def tile(anchors: pa.RecordBatch, slot: Slot) -> pa.RecordBatch:
        own, label = anchors.column("key").to_numpy(), anchors.column("label").to_numpy(zero_copy_only=False)
        scores = slot.scores(integers(anchors.column("v")))
        same = label[:, None] == slot.label
        if windows:
            given = anchors.column("positive")
            p = dense(given).astype(np.int64)
            sizes = given.value_lengths().to_numpy(zero_copy_only=False)
            found = []
            for k in range(p.shape[1]):
                inside = ~same & (100 * scores <= 100 * p[:, k : k + 1]) & (100 * scores >= LEAST * p[:, k : k + 1]) & (sizes > k)[:, None]
                found.append((k + 1, *best(scores, inside, wanted)))
        else:
            found = [(0, *best(scores, same & (own[:, None] != slot.key), wanted))]
        place = np.concatenate([np.full(len(r), k, np.int32) for k, r, _ in found] or [np.zeros(0, np.int32)])
        row, at = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(place), pa.array(scores[row, at]), slot.id.take(pa.array(at)), pa.array(slot.key[at])], ["anchor", "place", "score", "id", "key"])

    found = rows.mapInArrow(run, f"anchor long, place int, score long, id {id_type}, key long")
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= wanted)


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: a condition on `id` and `label`."""
    spark = rows.sparkSession
    taking = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(F.col("label").isNotNull() & finite(F.col("v")))
    held = written(taking.withColumn("key", F.monotonically_increasing_id()), "vectors")
    size = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] * max(size["d"] or 1, 1) * 8 // SLOT_BYTES))
    kind = held.schema["id"].dataType.simpleString()
    candidates = held.select(F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int").alias("slot"), F.lit(False).alias("is_anchor"), "key", "id", "label", "v", F.lit(None).cast("array<long>").alias("positive"))
    chosen = held.where(anchors).select("key", "id", "label", "v")

    def dealt(queries: DataFrame) -> DataFrame:
        everywhere = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(True).alias("is_anchor"), "key", "id", "label", "v", "positive")
        return candidates.unionByName(everywhere).repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "is_anchor")

    own = written(heaps(dealt(chosen.withColumn("positive", F.lit(None).cast("array<long>"))), kind, positives, False), "positives")
    given = own.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("positive"))
    windows = heaps(dealt(chosen.join(given, chosen["key"] == given["anchor"])), kind, negatives, True)
    found = windows.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = own.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(chosen.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0)


OP12_SQL = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
