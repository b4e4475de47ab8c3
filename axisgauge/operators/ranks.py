"""Weighted ranks of all bootstrap replicates at once.

A cluster's counts in the replicates are a vector (`resampling.draw_vectors`), kept packed, `resampling.CHUNK` replicates to a
row. For each column, distinct values with their clusters are dealt to range partitions once, as narrow rows. A partition's
ranks in a chunk of replicates are running sums of the counts of its own clusters, which are sent to it once each, above the
totals of the partitions before; those come from the clusters' side, where neither rows nor vectors move. For a pair of
columns, ranks of the first go to the partitions of the second, one packed vector for each partition and distinct value, and
the pair's moments are added up there, partial sums by partition. A task holds one partition in one chunk, some replicates
unpacked at a time; a value's rows may lie in several partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.operators import resampling

#: Rows of a range partition (about), replicates unpacked at once, and clusters multiplied at once.
ROWS, UNPACKED, SLAB = 8192, 100, 512
#: Counts of a cluster; none is ever drawn as often as this type cannot hold (it is drawn once on average).
COUNT = np.uint16
#: What a partition is sent. kind: 0 its rows, 1 counts of a cluster, 2 totals around it, 3 ranks of a value of another column.
SENT = "_g string, _p int, chunk int, kind int, key long, name string, value double, data binary, cs array<long>, ks array<long>, vs array<double>, ps array<int>"
MOMENTS = ["n", "ab", "aa", "bb", "a", "b"]


def packed(lists: pa.ListArray, kind: type) -> pa.Array:
    """The numbers of each list as bytes."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(values) and values.max() > np.iinfo(kind).max:
        raise OverflowError("a count does not fit its type")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values.astype(kind)))])


def unpacked(data: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def pack_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("_c"), batch.column("chunk"), packed(batch.column("times"), COUNT)], ["_c", "chunk", "data"])


def sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the clusters' counts for each partition and part of it; rows come sorted by chunk."""
    sums: dict[tuple, np.ndarray] = {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (chunk, g, p, part), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([p], pa.int32()), pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([s.tolist()], pa.list_(pa.float64()))], ["_g", "_p", "part", "chunk", "times"])
        sums.clear()

    for batch in batches:
        chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
        turns = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for first, end in zip(turns[:-1], turns[1:], strict=True):
            for at in range(first, end, SLAB):
                some = batch.slice(at, min(SLAB, end - at))
                lists, times = some.column("parts"), unpacked(some.column("data").to_pylist(), COUNT).astype(float)
                of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                g, p, part, k = lists.flatten().flatten()
                places: dict[tuple, int] = {}
                place = np.array([places.setdefault(key, len(places)) for key in zip(g.to_pylist(), p.to_pylist(), part.to_pylist(), strict=True)], np.int64)
                weights = np.zeros((len(places), len(lists)))
                np.add.at(weights, (place, of), k.to_numpy(zero_copy_only=False))
                for key, s in zip(places, weights @ times, strict=True):
                    key = (int(chunks[at]), *key)
                    sums[key] = sums[key] + s if key in sums else s
                if sum(s.nbytes for s in sums.values()) > resampling.HELD:
                    yield from hand_on()
            yield from hand_on()


def around(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each partition of a group and chunk: the total before it, and what partitions before and behind it have of its first
    and of its last value. Parts of a partition: 0 its first value, 2 its last one where that differs, 1 all between."""
    sums = {(p, part): np.array(s) for p, part, s in zip(pdf["_p"], pdf["part"], pdf["times"], strict=True)}
    ends = {p: (a, b) for p, a, b in zip(pdf["_p"], pdf["first"], pdf["last"], strict=True)}
    order, none = sorted(ends), np.zeros(len(pdf["times"].iloc[0]))
    before, head, tail = {}, {}, {}
    total = none
    for i, p in enumerate(order):
        q = order[i - 1] if i else None
        joined = i and ends[q][1] == ends[p][0]
        head[p] = (sums[q, 0] + head[q] if ends[q][0] == ends[q][1] else sums[q, 2]) if joined else none
        before[p], total = total, total + sum(sums.get((p, k), none) for k in range(3))
    for i, p in reversed(list(enumerate(order))):
        q = order[i + 1] if i + 1 < len(order) else None
        joined = q is not None and ends[q][0] == ends[p][1]
        tail[p] = (sums[q, 0] + (tail[q] if ends[q][0] == ends[q][1] else none)) if joined else none
    data = [np.rint(np.concatenate([before[p], head[p], tail[p]])).astype(np.int64).tobytes() for p in order]
    return pd.DataFrame({"_g": pdf["_g"].iloc[0], "_p": order, "chunk": pdf["chunk"].iloc[0], "data": data})


class Part:
    """What one partition was sent, for one chunk. Its rows are sorted by their first value."""

    def __init__(self, sent: pa.Table) -> None:
        kinds = sent.column("kind").to_numpy()
        of = lambda kind: sent.filter(pa.array(kinds == kind))
        rows, counts, totals = of(0), of(1), of(2)
        self.key = [rows.column(c)[0].as_py() for c in ("_g", "_p", "chunk")]
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        c, k = flat("cs"), flat("ks")
        values, targets = flat("vs").reshape(len(c), -1), flat("ps").reshape(len(c), -1)
        order = np.argsort(values[:, 0], kind="stable")
        self.k, self.values, self.targets = k[order], values[order], targets[order]
        keys = counts.column("key").to_numpy()
        by_key = np.argsort(keys)
        self.times = unpacked(counts.column("data").to_pylist(), COUNT)
        self.of = by_key[np.searchsorted(keys[by_key], c[order])]
        self.width = self.times.shape[1]
        self.before, self.head, self.tail = np.frombuffer(totals.column("data")[0].as_py(), np.int64).reshape(3, -1)
        own = self.values[:, 0]
        self.starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        self.distinct = own[self.starts]
        self.which = np.repeat(np.arange(len(self.starts)), np.diff([*self.starts, len(own)]))
        self.others = of(3)

    def ranks(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """(weights of the rows, twice the average rank of each distinct value) in some replicates."""
        weights = self.times[self.of, at] * self.k[:, None]
        own = np.add.reduceat(weights, self.starts, axis=0)
        before = np.cumsum(own, axis=0) - own + self.before[at]
        before[0] -= self.head[at]
        own[0] += self.head[at]
        own[-1] += self.tail[at]
        return weights, 2 * before + own + 1

    def slices(self) -> Iterator[slice]:
        for first in range(0, self.width, UNPACKED):
            yield slice(first, min(first + UNPACKED, self.width))


def replicate_correlations(held: DataFrame, by: list[str], names: list[str], pairs: list[tuple[str, str]], stratum: str, cluster: str, replicates: int, seed: int = 1) -> DataFrame:
    """by, x, y, replicate, r: rank correlations of each replicate's draw; replicate 0 is the rows themselves. held: rows
    without nulls, cheap to read."""
    clusters = cut(held.select(stratum, cluster).distinct().withColumn("_c", F.monotonically_increasing_id()))
    drawn = resampling.draw_vectors(clusters, stratum, cluster, replicates, seed).join(clusters, [stratum, cluster]).select("_c", "chunk", "times")
    vectors = cut(drawn.mapInArrow(pack_times, "_c long, chunk int, data binary"))
    chunks = replicates // resampling.CHUNK + 1
    held = held.withColumn("_g", F.to_json(F.struct(F.lit(0).alias("_"), *by)))
    groups = cut(held.select("_g", *by).distinct())
    rows = cut(held.join(clusters, [stratum, cluster]).groupBy("_g", "_c", *[(F.col(c).cast("double") + 0.0).alias(c) for c in names]).agg(F.count(F.lit(1)).alias("_k")))
    for c in names:
        values = cut(rows.select("_g", c, "_c").distinct())
        parts = max(1, -(-values.count() // ROWS))
        rows = rows.join(values.repartitionByRange(parts, "_g", c, "_c").withColumn(f"_p{c}", F.spark_partition_id()), ["_g", c, "_c"])
    rows = cut(rows)
    ends = {c: cut(rows.groupBy("_g", F.col(f"_p{c}").alias("_p")).agg(F.min(c).alias("first"), F.max(c).alias("last"))) for c in names}
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    like = dict(c.split(" ") for c in SENT.split(", "))

    def message(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumn("kind", F.lit(kind)).select(*[(F.col(c) if c in df.columns or c == "kind" else F.lit(None)).cast(t).alias(c) for c, t in like.items()])

    def sent(c: str, values: list[str], targets: list[str], more: DataFrame | None = None) -> DataFrame:
        """What the partitions of column c get: rows with c, values and the partitions named in targets."""
        p = F.col(f"_p{c}").alias("_p")
        lines = rows.groupBy("_g", p, "_c", c, *values, *[f"_p{t}" for t in targets]).agg(F.sum("_k").alias("_k"))
        lines = lines.groupBy("_g", "_p").agg(F.collect_list(F.struct(F.array(*[F.col(v) for v in (c, *values)]).alias("v"), F.array(*[F.col(f"_p{t}") for t in targets]).cast("array<int>").alias("p"), "_c", "_k")).alias("l"))  # about ROWS, or a few times as many
        lines = lines.select("_g", "_p", F.col("l._c").alias("cs"), F.col("l._k").alias("ks"), F.flatten("l.v").alias("vs"), F.flatten("l.p").alias("ps"), every)
        counts = rows.select("_g", p, "_c").distinct().join(vectors, "_c").withColumnRenamed("_c", "key")
        part = F.when(F.col(c) == F.col("first"), 0).when(F.col(c) == F.col("last"), 2).otherwise(1)
        parts = rows.withColumn("_p", p).join(ends[c], ["_g", "_p"]).groupBy("_c", "_g", "_p", part.alias("part")).agg(F.sum("_k").alias("k"))
        parts = parts.groupBy("_c").agg(F.collect_list(F.struct("_g", "_p", "part", "k")).alias("parts"))  # three for each partition at most
        sums = vectors.join(parts, "_c").select("chunk", "data", "parts").sortWithinPartitions("chunk").mapInArrow(sum_parts, "_g string, _p int, part int, chunk int, times array<double>")
        totals = resampling.added(sums, ["_g", "_p", "part", "chunk"], ["times"]).join(ends[c], ["_g", "_p"])
        totals = totals.groupBy("_g", "chunk").applyInPandas(around, "_g string, _p int, chunk int, data binary")  # a few vectors for each partition
        whole = reduce(DataFrame.unionByName, [message(lines, 0), message(counts, 1), message(totals, 2), *([message(more, 3)] if more is not None else [])])
        return whole.repartition(max(1, ends[c].count()) * chunks, "_g", "_p", "chunk")

    def ranked(c: str, homes: list[str]) -> DataFrame:
        """home, _g, _p, chunk, name, value, data: ranks of c's values for the partitions of the homes where they are met."""

        def ranks_of(sent: pa.Table) -> pa.Table:
            part = Part(sent)
            found = np.concatenate([part.ranks(at)[1] for at in part.slices()], axis=1)
            found = found.astype(np.uint32) if found.max() < 2**32 else found
            out = [(h, int(p), i) for h in range(len(homes)) for i, p in np.unique(np.stack([part.which, part.targets[:, h]], 1), axis=0).tolist()]
            g, _, chunk = part.key
            return pa.table({"home": pa.array([homes[h] for h, _, _ in out]), "_g": pa.array([g] * len(out)), "_p": pa.array([p for _, p, _ in out], pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int32()), "name": pa.array([c] * len(out)), "value": pa.array([part.distinct[i] for _, _, i in out], pa.float64()), "data": pa.array([found[i].tobytes() for _, _, i in out], pa.binary())})

        return sent(c, [], homes).groupBy("_g", "_p", "chunk").applyInArrow(ranks_of, "home string, _g string, _p int, chunk int, name string, value double, data binary")

    def moments(home: str, others: list[str], more: DataFrame) -> DataFrame:
        """_g, chunk, x, y and the moments' lists, partial sums by partition of the home column."""

        def add_up(sent: pa.Table) -> pa.Table:
            part = Part(sent)
            names = np.array(part.others.column("name").to_pylist(), object)
            met = []
            for i, x in enumerate(others):
                own = part.others.filter(pa.array(names == x))
                values, data = own.column("value").to_numpy(), own.column("data").to_pylist()
                order = np.argsort(values)
                kind = {part.width * 4: np.uint32, part.width * 8: np.int64}
                wide = unpacked(data, kind[len(data[0])]) if len({len(d) for d in data}) == 1 else np.stack([np.frombuffer(d, kind[len(d)]).astype(np.int64) for d in data])
                met.append((wide, order[np.searchsorted(values[order], part.values[:, i + 1])]))
            sums = np.zeros((len(others), len(MOMENTS), part.width))
            for at in part.slices():
                weights, ranks = part.ranks(at)
                t, b = weights.astype(float), ranks.astype(float)[part.which]
                tb = t * b
                for i, (wide, place) in enumerate(met):
                    a = wide[place, at].astype(float)
                    ta = t * a
                    sums[i, :, at] = np.stack([t.sum(0), np.einsum("ij,ij->j", tb, a), np.einsum("ij,ij->j", ta, a), np.einsum("ij,ij->j", tb, b), ta.sum(0), tb.sum(0)])
            g, _, chunk = part.key
            lists = {m: pa.array([s[k].tolist() for s in sums], pa.list_(pa.float64())) for k, m in enumerate(MOMENTS)}
            return pa.table({"_g": pa.array([g] * len(others)), "chunk": pa.array([chunk] * len(others), pa.int32()), "x": pa.array(others), "y": pa.array([home] * len(others)), **lists})

        return sent(home, others, [], more).groupBy("_g", "_p", "chunk").applyInArrow(add_up, "_g string, chunk int, x string, y string, " + ", ".join(f"{m} array<double>" for m in MOMENTS))

    homes = {c: sorted({y for x, y in pairs if x == c}) for c in sorted({x for x, _ in pairs})}
    met = cut(reduce(DataFrame.unionByName, [ranked(c, h) for c, h in homes.items()]))
    found = [moments(y, sorted({x for x, other in pairs if other == y}), met.where(F.col("home") == y).drop("home")) for y in sorted({y for _, y in pairs})]
    whole = resampling.added(cut(reduce(DataFrame.unionByName, found)), ["_g", "chunk", "x", "y"], MOMENTS)
    each = whole.join(groups, "_g").select(*by, "x", "y", "chunk", F.posexplode(F.arrays_zip(*MOMENTS)).alias("_k", "_s")).select(*by, "x", "y", (F.col("chunk") * resampling.CHUNK + F.col("_k")).alias("replicate"), "_s.*")
    spread = lambda s, u, v: F.col(s) - F.col(u) * F.col(v) / F.col("n")
    r = F.try_divide(spread("ab", "a", "b"), F.sqrt(F.greatest(spread("aa", "a", "a"), F.lit(0.0)) * F.greatest(spread("bb", "b", "b"), F.lit(0.0))))
    return each.select(*by, "x", "y", "replicate", r.alias("r"))
