"""Bootstrap draws and sign permutations as matrix work inside tasks.

A replicate draws as many clusters as a stratum has, with replacement. Draws are not listed one by one: a stratum's clusters
lie under a binary tree of the bits of their hashes, and the number of draws that falls into a node is split between its two
children by a binomial count, from the root down to single clusters. Counts of all replicates are split at once, as one numpy
vector for each node, and every split is seeded by the stratum, the node and the replicate: a task can find the counts of its
own part of the tree by itself, they do not depend on partitions, and any engine can repeat them. Clusters are dealt to
buckets of about `BUCKET` by their leading bits; a task holds one bucket.

Uniform numbers: u = (mix(key + replicate * 2654435761 + piece * 2246822519 modulo 2^32) + 0.5) / 2^32, where key is the first
32 bits of MD5(seed:stratum:depth:prefix). A binomial count of m draws with a probability q of one half or less is the number
of i in 0..m-1 whose cumulated probability P(X <= i) is at most u; more than `PIECE` draws are split piece by piece. q belongs
to the child with fewer clusters (the left one where both have as many).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a cluster's hash, clusters of a bucket (about), and draws that are split at once.
BITS, BUCKET, PIECE = 60, 256, 512
#: Replicates in a row of partial sums, clusters multiplied at once, and bytes of sums that a task holds before it hands them on.
CHUNK, SLAB, HELD = 1000, 32, 1 << 26
MASK = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """32 bits to 32 well mixed bits."""
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(0x45D9F3B) & MASK
    return (x >> np.uint64(16)) ^ x


def cumulated(m: int, q: float) -> np.ndarray:
    """P(X <= i) of a binomial count X of m draws, for i in 0..m-1; q is one half at most."""
    i = np.arange(1, m)
    p = np.concatenate([[1.0], np.cumprod((m - i + 1) / i * (q / (1 - q)))]) * (1 - q) ** m if m else np.zeros(0)
    return np.cumsum(p)


def left_counts(k: np.ndarray, left: int, n: int, key: int, replicates: np.ndarray) -> np.ndarray:
    """Of k draws for each replicate that fall into a node of n clusters, those that fall into its left child of `left`."""
    if left in (0, n):
        return k if left else np.zeros_like(k)
    less, out = min(left, n - left), np.zeros_like(k)
    base = np.uint64(key) + replicates.astype(np.uint64) * np.uint64(2654435761)
    tables: dict[int, np.ndarray] = {}
    for piece in range(-(-int(k.max(initial=0)) // PIECE)):
        m = np.clip(k - piece * PIECE, 0, PIECE)
        u = (mix((base + np.uint64(piece * 2246822519)) & MASK).astype(float) + 0.5) / 2.0**32
        for size in np.unique(m).tolist():
            if size:
                if size not in tables:
                    tables[size] = cumulated(size, less / n)
                at = m == size
                out[at] += np.searchsorted(tables[size], u[at], "right")
    return out if 2 * left <= n else k - out


def node_key(seed: int, stratum: str, depth: int, prefix: int) -> int:
    return int(hashlib.md5(f"{seed}:{stratum}:{depth}:{prefix}".encode()).hexdigest()[:8], 16)


def leaves(hashes: list[int], path: list[tuple[int, int, int]], n: int, stratum: str, seed: int, replicates: np.ndarray) -> Iterator[np.ndarray]:
    """The counts of each cluster of a bucket, whose hashes rise. path: (prefix of the node, its clusters, those of its left
    child), from the root to the bucket's parent; n: the stratum's clusters."""
    k = np.full(len(replicates), n, np.int64)
    for depth, (prefix, size, left) in enumerate(path):
        lefts = left_counts(k, left, size, node_key(seed, stratum, depth, prefix), replicates)
        k = k - lefts if hashes[0] >> (BITS - depth - 1) & 1 else lefts
    waiting = [(0, len(hashes), len(path), k)]
    while waiting:
        lo, hi, depth, k = waiting.pop()
        if hi - lo == 1:
            yield k
            continue
        if depth == BITS:
            raise ValueError("two clusters have equal hashes")
        bit = BITS - depth - 1
        mid = next((i for i in range(lo, hi) if hashes[i] >> bit & 1), hi)
        lefts = left_counts(k, mid - lo, hi - lo, node_key(seed, stratum, depth, hashes[lo] >> (bit + 1)), replicates)
        waiting += [(a, b, depth + 1, part) for a, b, part in ((mid, hi, k - lefts), (lo, mid, lefts)) if b > a]


def text(stratum: str) -> Column:
    return F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))


def dealt(clusters: DataFrame, stratum: str, cluster: str) -> DataFrame:
    """clusters (a row for each stratum and cluster, cheap to read) with _s, _h (hash), _n (the stratum's clusters), _bucket and
    _path, in partitions of whole buckets, sorted by bucket and hash."""
    d = clusters.withColumns({"_s": text(stratum), "_h": F.conv(F.substring(F.md5(F.coalesce(F.col(cluster).cast("string"), F.lit("\0"))), 1, BITS // 4), 16, 10).cast("bigint")})
    sizes = d.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.agg(F.max("_n")).first()[0] or 1
    depth = max(0, math.ceil(math.log2(top / BUCKET)))
    prefix = lambda bits: F.shiftright("_h", BITS - bits) if bits else F.lit(0).cast("bigint")
    d = d.withColumn("_bucket", prefix(depth))
    node = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("prefix", "size", "left")]))
    if depth:
        buckets = d.groupBy("_s", "_bucket").agg(F.count(F.lit(1)).alias("c"))
        every = buckets.select("_s", "c", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "_bucket").select("_s", "d", "c", F.expr(f"shiftright(_bucket, {depth} - d)").alias("p"))
        nodes = every.groupBy("_s", "d", "p").agg(F.sum("c").alias("c"))
        children = nodes.where("p % 2 = 0 and d > 0").select("_s", (F.col("d") - 1).alias("d"), F.shiftright("p", 1).alias("p"), F.col("c").alias("l"))
        splits = nodes.where(F.col("d") < depth).join(children, ["_s", "d", "p"], "left").select("_s", "d", "p", F.struct(F.col("p").alias("prefix"), F.col("c").alias("size"), F.coalesce("l", F.lit(0)).cast("bigint").alias("left")).alias("node"))
        above = buckets.select("_s", "_bucket", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("d")).withColumn("p", F.expr(f"shiftright(_bucket, {depth} - d)"))
        paths = above.join(splits, ["_s", "d", "p"]).groupBy("_s", "_bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "node"))), lambda x: x["node"]).alias("_path"))  # depth nodes each
        d = d.join(paths, ["_s", "_bucket"])
    else:
        d = d.withColumn("_path", F.array().cast(node))
    return d.join(sizes, "_s").repartition("_s", "_bucket").sortWithinPartitions("_s", "_bucket", "_h")


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A table for each bucket, of rows that come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        of = list(zip(batch.column("_s").to_pylist(), batch.column("_bucket").to_pylist(), strict=True))
        starts = [0, *[i for i in range(1, len(of)) if of[i] != of[i - 1]]] if of else []
        for first, end in zip(starts, [*starts[1:], len(of)], strict=True):
            if held and of[first] != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = of[first]
            held.append(batch.slice(first, end - first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bucket_counts(bucket: pa.Table, replicates: int, seed: int) -> Iterator[np.ndarray]:
    path = [(q["prefix"], q["size"], q["left"]) for q in bucket.column("_path")[0].as_py()]
    return leaves(bucket.column("_h").to_pylist(), path, bucket.column("_n")[0].as_py(), bucket.column("_s")[0].as_py(), seed, np.arange(1, replicates + 1))


def drawn_sums(rows: DataFrame, by: list[str], names: list[str], stratum: str, cluster: str, replicates: int, seed: int = 1) -> DataFrame:
    """by, replicate, and for each name its sum over the replicate's draw and `{name}_w`, how many values that sum has
    (nulls add nothing). rows: a few for each cluster. A cluster's rows are multiplied by its counts in all replicates as
    matrix products, and tasks hand on partial sums: neither draws nor counts are ever shuffled."""
    width = len(names)
    fields = [*[F.col(c).alias(f"b{i}") for i, c in enumerate(by)], *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]]
    held = dealt(rows.groupBy(stratum, cluster).agg(F.collect_list(F.struct(*fields)).alias("rows")), stratum, cluster)
    bounds = [*range(0, replicates, CHUNK), replicates]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            for key, s in sums.items():
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v)) for v in s]
                chunks = pa.array(range(len(bounds) - 1), pa.int32())
                yield pa.RecordBatch.from_arrays([*[pa.array([k] * len(chunks), t) for k, t in zip(key, types, strict=True)], chunks, *lists], [*by, "chunk", *out])
            sums.clear()

        for bucket in buckets(batches):
            counts = bucket_counts(bucket, replicates, seed)
            for first in range(0, bucket.num_rows, SLAB):
                of_row = bucket.column("rows").slice(first, SLAB).combine_chunks()
                times = np.stack([next(counts) for _ in range(len(of_row))]).astype(float)
                row = np.repeat(np.arange(len(of_row)), pc.list_value_length(of_row))
                columns = of_row.flatten().flatten()
                types = [c.type for c in columns[: len(by)]]
                real = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in columns[len(by) :]], dtype=float)
                value = np.array([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns[len(by) :]])
                places: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*[c.to_pylist() for c in columns[: len(by)]], strict=True) if by else [()] * len(row)):
                    places.setdefault(key, []).append(i)
                for key, at in places.items():
                    s = sums.setdefault(key, np.zeros((2 * width, replicates)))
                    s += np.concatenate([value[:, at], real[:, at]]) @ times[row[at]]
                if len(sums) * 2 * width * replicates * 8 > HELD:
                    yield from hand_on()
        yield from hand_on()

    out = [*names, *[f"{c}_w" for c in names]]
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("chunk", T.IntegerType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in out]])
    whole = added(held.mapInArrow(add_up, schema), [*by, "chunk"], out)
    each = whole.select(*by, "chunk", F.posexplode(F.arrays_zip(*out)).alias("_k", "_s"))
    return each.select(*by, (F.col("chunk") * CHUNK + F.col("_k") + 1).alias("replicate"), *[F.col("_s")[c].alias(c) for c in out])


def added(parts: DataFrame, by: list[str], lists: list[str]) -> DataFrame:
    """Lists of equal length added place by place; a few for each key and task."""
    plus = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    whole = parts.groupBy(*by).agg(*[F.collect_list(c).alias(c) for c in lists])
    return whole.select(*by, *[F.aggregate(F.slice(c, 2, F.size(c)), F.element_at(c, 1), plus).alias(c) for c in lists])


def draw_vectors(clusters: DataFrame, stratum: str, cluster: str, replicates: int, seed: int = 1) -> DataFrame:
    """stratum, cluster, chunk, times: how often each replicate drew the cluster, `CHUNK` replicates to a row, before them
    replicate 0, which has every cluster once."""
    held = dealt(clusters.select(stratum, cluster).distinct(), stratum, cluster)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in buckets(batches):
            for i, k in enumerate(bucket_counts(bucket, replicates, seed)):
                k = np.concatenate([[1], k]).astype(np.int32)
                bounds = [*range(0, len(k), CHUNK), len(k)]
                again = pa.array([i] * (len(bounds) - 1))
                yield pa.RecordBatch.from_arrays([bucket.column(stratum).combine_chunks().take(again), bucket.column(cluster).combine_chunks().take(again), pa.array(range(len(again)), pa.int32()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(k))], [stratum, cluster, "chunk", "times"])

    return held.mapInArrow(vectors, T.StructType([clusters.schema[stratum], clusters.schema[cluster], T.StructField("chunk", T.IntegerType()), T.StructField("times", T.ArrayType(T.IntegerType()))]))


def draws(clusters: DataFrame, stratum: str, cluster: str, replicates: int, seed: int = 1) -> DataFrame:
    """stratum, cluster, replicate, times: a row for each cluster that a replicate drew."""
    each = draw_vectors(clusters, stratum, cluster, replicates, seed).select(stratum, cluster, "chunk", F.posexplode("times").alias("_k", "times"))
    return each.select(stratum, cluster, (F.col("chunk") * CHUNK + F.col("_k")).cast("bigint").alias("replicate"), F.col("times").cast("bigint").alias("times")).where("replicate > 0 and times > 0")


def sign_flips(rows: DataFrame, by: list[str], item: str, value: str, replicates: int, seed: int = 1) -> DataFrame:
    """by, first, sums: sums of hash-signed values for `CHUNK` * 32 replicates from `first` on. The first 32 bits of
    MD5(seed:block:item) are an item's signs in the block's 32 replicates; tasks multiply a slab of items' signs with the
    values of all groups at once."""
    blocks = -(-replicates // 32)
    d = rows.select(*by, F.col(item).cast("string").alias("_i"), F.col(value).cast("double").alias("_v"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            for key, s in sums.items():
                for first in range(0, blocks * 32, CHUNK * 32):
                    yield pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(key, types, strict=True)], pa.array([first], pa.int32()), pa.array([s[first : first + CHUNK * 32].tolist()], pa.list_(pa.float64()))], [*by, "first", "sums"])
            sums.clear()

        for batch in batches:
            types = [batch.column(c).type for c in by]
            found = pc.dictionary_encode(batch.column("_i"))
            names, item_of, value_of = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False), batch.column("_v").to_numpy(zero_copy_only=False)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else [()] * batch.num_rows):
                places.setdefault(key, []).append(i)
            for first in range(0, len(names), SLAB):
                digests = b"".join(hashlib.md5(f"{seed}:{b}:{name}".encode()).digest()[3::-1] for name in names[first : first + SLAB] for b in range(blocks))
                minus = np.unpackbits(np.frombuffer(digests, np.uint8), bitorder="little").reshape(-1, blocks * 32)
                for key, at in places.items():
                    at = np.array([i for i in at if first <= item_of[i] < first + SLAB], np.int64)
                    if len(at):
                        weights = np.bincount(item_of[at] - first, value_of[at], len(minus))
                        s = sums.setdefault(key, np.zeros(blocks * 32))
                        s += weights.sum() - 2 * (weights @ minus)
                if len(sums) * blocks * 256 > HELD:
                    yield from hand_on()
        yield from hand_on()

    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("first", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    return added(d.mapInArrow(add_up, schema), [*by, "first"], ["sums"])
