"""Kendall's tau of any number of items, by counting inversions over range partitions.

Equal points become one with a weight. Points are dealt to ranges of (x, y) and to ranges of (y, x). A discordant pair lies in
one range of x (counted there), or else in one range of y (counted there, for different ranges of x), or in different ranges of
both (counted from the number of points in each pair of ranges). Each count is the weighted inversions of a sequence, found in
numpy bit by bit. Ties never count as inversions, since sequences are in the order of the other column inside equal values. No
task holds more than one range of a group, or the counts of its pairs of ranges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.functions.quantiles import group_key


def inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """Sum of the products of weights over pairs of places with an earlier one of higher rank; ranks are whole and not negative."""
    total, rank, weight = 0, np.asarray(rank, np.int64), np.asarray(weight, np.int64)
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        order = np.argsort(rank >> (bit + 1), kind="stable")
        high, w, prefix = rank[order] >> bit & 1, weight[order], rank[order] >> (bit + 1)
        ones = np.cumsum(high * w)
        start = np.flatnonzero(np.diff(prefix, prepend=-1))
        before = np.repeat(np.concatenate([[0], ones])[start], np.diff([*start, len(prefix)]))
        total += int(((ones - before) * w * (1 - high)).sum())
    return total


def rank_agreement(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, kendall (tau-b; null if either side is constant), flips (pairs whose two orders differ, ties being an order of their
    own), pairs. Rows without x or y are left out, groups with fewer than two rows have no row."""
    held = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group_key(by), *by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = held.groupBy("_g", *by, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    placed = points.repartitionByRange("_g", "x", "y").withColumn("_p", F.spark_partition_id())
    placed = cut(placed.repartitionByRange("_g", "y", "x").withColumn("_b", F.spark_partition_id()))
    out = "_g string, d long"

    def in_x(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "d": [inversions(pdf["y"].rank(method="dense").to_numpy() - 1, pdf["w"].to_numpy())]})

    def in_y(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_p", "y"])
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "d": [inversions(pdf["y"].rank(method="dense").to_numpy() - 1, pdf["w"].to_numpy())]})

    def in_neither(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_p", "_b"])
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "d": [inversions(pdf["_b"].to_numpy(), pdf["w"].to_numpy())]})

    d = placed.groupBy("_g", "_p").applyInPandas(in_x, out)
    # a row for each pair of ranges of a group; only groups in several ranges go on
    cells = placed.groupBy("_g", "_p", "_b").agg(F.sum("w").alias("w"))
    several = placed.groupBy("_g").agg(F.min("_p").alias("lo"), F.max("_p").alias("hi")).where("lo < hi").select("_g")
    d = d.unionByName(placed.join(several, "_g", "left_semi").groupBy("_g", "_b").applyInPandas(in_y, out)).unionByName(cells.join(several, "_g", "left_semi").groupBy("_g").applyInPandas(in_neither, out))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    ties = lambda c, n: placed.groupBy("_g", c).agg(F.sum("w").alias("w")).groupBy("_g").agg(F.sum(two("w")).alias(n))
    whole = placed.groupBy("_g", *by).agg(F.sum("w").alias("n"), F.sum(two("w")).alias("both")).withColumn("pairs", two("n")).where("pairs > 0")
    g = whole.join(ties("x", "tx"), "_g").join(ties("y", "ty"), "_g").join(d.groupBy("_g").agg(F.sum("d").alias("d")), "_g")
    nx, ny = F.col("pairs") - F.col("tx"), F.col("pairs") - F.col("ty")
    c = F.expr("pairs - tx - ty + both - 2 * d")
    return g.select(*by, F.when((nx > 0) & (ny > 0), c / F.sqrt(nx * ny)).alias("kendall"), F.expr("cast(d + tx + ty - 2 * both as bigint)").alias("flips"), F.col("pairs").cast("bigint").alias("pairs"))
