"""Isotonic regression over range partitions.

The fit's levels are the slopes of the lower convex hull of cumulative (weight, sum) points. Every range partition pools
its own points into blocks of rising level, which is that partition's hull. Where a group spans several partitions, hulls
are bridged: the driver holds border points and the few hull points found so far (a few for each partition), asks all
partitions below a bridge for their extreme point in the bridge's direction (sums over blocks under that slope), and goes
on until no point lies below a bridge. A block's level is then its own, held between the slopes of the bridges that enter
and leave its partition. No task holds more than one partition of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut

#: Distinct x of a range partition, about.
ROWS = 100_000


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values to y at rising x, by weighted least squares."""
    levels, sizes, _ = pooled(y * w, w)
    return np.repeat(levels, sizes)


def pooled(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of rising level from sums and weights in order: their levels, numbers of points, and (sum, weight) rows."""
    total, weight, size = [], [], []
    for a, b in zip(s.tolist(), n.tolist(), strict=True):
        total.append(a), weight.append(b), size.append(1)
        while len(total) > 1 and total[-2] * weight[-1] > total[-1] * weight[-2]:
            a, b, k = total.pop(), weight.pop(), size.pop()
            total[-1] += a
            weight[-1] += b
            size[-1] += k
    blocks = np.array([total, weight], float).T.reshape(-1, 2)
    return blocks[:, 0] / blocks[:, 1], np.array(size, np.int64), blocks


def lower_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for p in sorted(points):
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (p[0] - out[-2][0]) * (out[-1][1] - out[-2][1]):
            out.pop()
        if out and out[-1][0] == p[0]:
            continue
        out.append(p)
    return out


class Chain:
    """The hulls of one group's partitions, in order, as far as the driver knows them."""

    def __init__(self, parts: list[dict]):
        """parts: p, s, n and the first and last block's s and n."""
        self.parts, self.points, self.w, self.s = parts, set(), [0.0], [0.0]
        for q in parts:
            w, s = self.w[-1], self.s[-1]
            self.w.append(w + q["n"])
            self.s.append(s + q["s"])
            self.points |= {(w, s), (w + q["first"]["n"], s + q["first"]["s"]), (self.w[-1] - q["last"]["n"], self.s[-1] - q["last"]["s"]), (self.w[-1], self.s[-1])}

    def bridges(self) -> list[tuple[int, int, float, tuple, tuple]]:
        """(first, last partition, slope, from, to) of the hull's edges that reach over a border."""
        hull, out = lower_hull(list(self.points)), []
        for u, v in zip(hull, hull[1:], strict=False):
            first, last = int(np.searchsorted(self.w, u[0], "right")) - 1, int(np.searchsorted(self.w, v[0], "left")) - 1
            if last > first:
                out.append((first, last, (v[1] - u[1]) / (v[0] - u[0]), u, v))
        return out

    def add(self, k: int, slope: float, n: float, s: float, edge: tuple) -> bool:
        """A partition's extreme point; whether it lies below the bridge."""
        u = edge[3]
        point = (self.w[k] + n, self.s[k] + s)
        if point in self.points or point[1] >= u[1] + slope * (point[0] - u[0]) - 1e-12 * max(1.0, abs(u[1])):
            return False
        self.points.add(point)
        return True

    def limits(self) -> list[tuple[float, float]]:
        """For each partition the slopes of the bridges over its left and right border."""
        low, high = [-math.inf] * len(self.parts), [math.inf] * len(self.parts)
        for first, last, slope, _, _ in self.bridges():
            for k in range(first, last + 1):
                if k > first:
                    low[k] = slope
                if k < last:
                    high[k] = slope
        return list(zip(low, high, strict=True))


def folded_points(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """_g, by, fold, x, s, n, asked: for each group and fold, sums of y over the other folds' rows at x, and whether the
    fold itself has x."""
    real = F.col(y).isNotNull()
    own = cut(rows.where(F.col(x).isNotNull() & F.col("fold").isNotNull()).groupBy(*by, "fold", x).agg(F.sum(F.when(real, F.col(y).cast("double"))).alias("s"), F.count(F.when(real, 1)).cast("double").alias("n")))
    own = own.withColumn("_b", F.to_json(F.struct(F.lit(0).alias("_"), *by)))
    folds = own.groupBy("_b").agg(F.collect_set("fold").alias("_f"))  # as many as there are folds
    others = own.where("n > 0").join(folds, "_b").select("_b", *by, F.col("fold").alias("_own"), x, "s", "n", F.explode("_f").alias("fold")).where("fold != _own").drop("_own").withColumn("asked", F.lit(False))
    asked = own.withColumns({"s": F.lit(0.0), "n": F.lit(0.0), "asked": F.lit(True)})
    every = others.unionByName(asked).groupBy("_b", *by, "fold", x).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    return every.withColumn("_g", F.concat_ws(":", "_b", F.col("fold").cast("string"))).drop("_b")


def _borders(placed: DataFrame, pool) -> list[tuple]:
    """For each partition of a group that has several: the slopes over its borders, and the nearest points with their levels in
    the partitions before and after it."""
    spark = placed.sparkSession
    several = placed.groupBy("_g").agg(F.countDistinct("_p").alias("c")).where("c > 1").select("_g")
    several = cut(placed.select("_g", "_p").distinct().join(several, "_g"))  # two for each partition at most
    blocks = cut(placed.join(several, ["_g", "_p"], "left_semi").groupBy("_g", "_p").applyInPandas(pool, "_g string, _p int, k long, s double, n double, lo double, hi double"))
    end = lambda f: f(F.struct("s", "n"), "k")
    summary = several.join(blocks.groupBy("_g", "_p").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), end(F.min_by).alias("first"), end(F.max_by).alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), ["_g", "_p"], "left").orderBy("_g", "_p").collect()
    groups: dict[str, list[dict]] = {}
    for r in summary:
        groups.setdefault(r["_g"], []).append(r.asDict(recursive=True))
    chains = {g: Chain([q for q in parts if q["n"]]) for g, parts in groups.items()}
    waiting = set(chains)
    while waiting:
        edges = {(g, k, e[2]): e for g in waiting for e in chains[g].bridges() for k in range(e[0], e[1] + 1)}
        if not edges:
            break
        wanted = spark.createDataFrame([(g, chains[g].parts[k]["_p"], k, slope) for g, k, slope in edges], "_g string, _p int, at int, slope double")
        under = F.col("s") < F.col("slope") * F.col("n")
        found = blocks.join(F.broadcast(wanted), ["_g", "_p"]).groupBy("_g", "at", "slope").agg(F.sum(F.when(under, F.col("n")).otherwise(0.0)).alias("n"), F.sum(F.when(under, F.col("s")).otherwise(0.0)).alias("s")).collect()  # wanted: as many as partitions
        waiting = {r["_g"] for r in found if chains[r["_g"]].add(r["at"], r["slope"], r["n"], r["s"], edges[r["_g"], r["at"], r["slope"]])}
    borders = []
    for g, held in groups.items():
        limits = dict(zip([q["_p"] for q in chains[g].parts], chains[g].limits(), strict=True))
        hold = lambda q, e, limits=limits: min(max(q[e]["s"] / q[e]["n"], limits[q["_p"]][0]), limits[q["_p"]][1])
        for i, q in enumerate(held):
            before, after = next((b for b in reversed(held[:i]) if b["n"]), None), next((b for b in held[i + 1 :] if b["n"]), None)
            borders.append((g, q["_p"], *limits.get(q["_p"], (None, None)), before and before["hi"], before and hold(before, "last"), after and after["lo"], after and hold(after, "first")))
    return borders


def fitted(points: DataFrame, keys: list[str], x: str, name: str, rows: int | None = None) -> DataFrame:
    """keys, x, name: the isotonic fit of s / n at the points with n > 0, interpolated (and held at the ends) where `asked`.
    points: _g (a text for each group), keys, x (distinct in a group), s, n, asked."""
    points = cut(points)
    parts = max(1, -(-points.count() // (rows or ROWS)))
    names = ["_low", "_high", "_bx", "_by", "_ax", "_ay"]
    alone = parts == 1  # then no group has a border
    placed = points.withColumn("_p", F.lit(0)) if alone else cut(points.repartitionByRange(parts, "_g", x).withColumn("_p", F.spark_partition_id()))
    spark, ordered = placed.sparkSession, lambda pdf: pdf.assign(_x=pdf[x].astype(float)).sort_values("_x")

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        t = ordered(pdf[pdf["n"] > 0])
        levels, sizes, blocks = pooled(t["s"].to_numpy(float), t["n"].to_numpy(float))
        ends = np.cumsum(sizes)
        at = t["_x"].to_numpy()
        return pd.DataFrame({"_g": pdf["_g"].iloc[0], "_p": pdf["_p"].iloc[0], "k": np.arange(len(levels)), "s": blocks[:, 0], "n": blocks[:, 1], "lo": at[ends - sizes], "hi": at[ends - 1]})

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        t, b = ordered(pdf[pdf["n"] > 0]), pdf.iloc[0]
        levels, sizes, _ = pooled(t["s"].to_numpy(float), t["n"].to_numpy(float))
        if not pd.isna(b["_low"]):
            levels = np.clip(levels, b["_low"], b["_high"])
        at, level = t["_x"].to_numpy(), np.repeat(levels, sizes)
        for side, place in (("b", 0), ("a", len(at))):
            if not pd.isna(b[f"_{side}x"]):
                at, level = np.insert(at, place if side == "b" else len(at), b[f"_{side}x"]), np.insert(level, place if side == "b" else len(level), b[f"_{side}y"])
        asked = pdf[pdf["asked"]]
        value = np.interp(asked[x].to_numpy(float), at, level) if len(at) else None
        return asked[[*keys, x]].assign(**{name: pd.Series(value, index=asked.index, dtype=float)})

    if alone:
        held = placed.withColumns({c: F.lit(None).cast("double") for c in names})
    else:  # a row for each partition of a group that has several
        sides = spark.createDataFrame(_borders(placed, pool), "_g string, _p int, " + ", ".join(f"{c} double" for c in names))
        held = placed.join(F.broadcast(sides), ["_g", "_p"], "left")
    schema = placed.select(*keys, x, F.lit(None).cast("double").alias(name)).schema
    return held.groupBy("_g", "_p").applyInPandas(predict, schema)
