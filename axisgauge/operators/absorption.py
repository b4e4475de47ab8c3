"""Fixed effects of factors with any number of levels, and sums of products of many columns.

Effects are the least-squares coefficients of all factors' levels, found by conjugate gradients on the normal equations,
preconditioned by the levels' counts. Rows are reduced to the combinations of levels that occur; a step joins the current
direction to them, once for each factor, and sums it up by level. Directions and residuals stay tables with a row for each
level; the driver gets a few sums a step. Factors may overlap or be nested: residuals do not depend on which solution is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisgauge.functions.lineage import cut
from axisgauge.operators.resampling import added

#: Steps stop when the preconditioned residual has fallen to this part of its start; more than `STEPS` steps are an error.
TOLERANCE, STEPS = 1e-11, 500


def absorbed(rows: DataFrame, values: dict[str, Column], factors: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """rows with, for each name in values, the residual of its value on the fixed effects of all factors, over rows where every
    value is known; null elsewhere. A null level is a level of its own."""
    k, m = range(len(values)), range(len(factors))
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    held = rows.withColumns({f"_y{i}": v.cast("double") for i, v in enumerate(values.values())} | {f"_f{j}": level(f) for j, f in enumerate(factors)})
    known = F.lit(True)
    for i in k:
        known = known & F.col(f"_y{i}").isNotNull()
    cells = cut(held.where(known).groupBy(*[f"_f{j}" for j in m]).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"_y{i}").alias(f"y{i}") for i in k]))

    def by_level(sums: DataFrame, names: list[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(j).alias("f"), F.col(f"_f{j}").alias("level")) for j in m])
        return sums.select(F.inline(each), *names).groupBy("f", "level").agg(*[F.sum(c).alias(c) for c in names])

    start = by_level(cells, ["n", *[f"y{i}" for i in k]])
    state = start.select("f", "level", "n", *[F.lit(0.0).alias(f"b{i}") for i in k], *[F.col(f"y{i}").alias(f"r{i}") for i in k], *[(F.col(f"y{i}") / F.col("n")).alias(f"p{i}") for i in k])
    first: list[float] | None = None
    for _ in range(STEPS):
        state = cut(state)
        along = cells
        for j in m:
            along = along.join(state.where(F.col("f") == j).select(F.col("level").alias(f"_f{j}"), *[F.col(f"p{i}").alias(f"p{j}_{i}") for i in k]), f"_f{j}")
        pushed = by_level(along.select(*[f"_f{j}" for j in m], *[(F.col("n") * sum((F.col(f"p{j}_{i}") for j in m), F.lit(0.0))).alias(f"q{i}") for i in k]), [f"q{i}" for i in k])
        state = cut(state.join(pushed, ["f", "level"]))
        r, q, n = (lambda i: F.col(f"r{i}")), (lambda i: F.col(f"q{i}")), F.col("n")
        one = state.agg(*[F.sum(e).alias(f"{a}{i}") for i in k for a, e in (("pq", F.col(f"p{i}") * q(i)), ("rr", r(i) * r(i) / n), ("rq", r(i) * q(i) / n), ("qq", q(i) * q(i) / n))]).first()
        if one["rr0"] is None:
            break  # no rows
        now = [one[f"rr{i}"] for i in k]
        first = first or now
        going = [now[i] > tolerance**2 * first[i] and one[f"pq{i}"] > 0 for i in k]
        if not any(going):
            break
        alpha = [now[i] / one[f"pq{i}"] if going[i] else 0.0 for i in k]
        after = [max(now[i] - 2 * alpha[i] * one[f"rq{i}"] + alpha[i] ** 2 * one[f"qq{i}"], 0.0) for i in k]
        beta = [after[i] / now[i] if going[i] else 0.0 for i in k]
        left = lambda i, alpha=alpha: F.col(f"r{i}") - alpha[i] * F.col(f"q{i}")
        state = state.select("f", "level", "n", *[(F.col(f"b{i}") + alpha[i] * F.col(f"p{i}")).alias(f"b{i}") for i in k], *[left(i).alias(f"r{i}") for i in k], *[(left(i) / n + beta[i] * F.col(f"p{i}")).alias(f"p{i}") for i in k])
    else:
        raise RuntimeError(f"fixed effects did not converge in {STEPS} steps")
    out = held.withColumn("_known", known)
    for j in m:
        out = out.join(state.where(F.col("f") == j).select(F.col("level").alias(f"_f{j}"), *[F.col(f"b{i}").alias(f"_b{j}_{i}") for i in k]), f"_f{j}", "left")
    fitted = [sum((F.col(f"_b{j}_{i}") for j in m), F.lit(0.0)) for i in k]
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in values], *[F.when(F.col("_known"), F.col(f"_y{i}") - fitted[i]).alias(name) for i, name in enumerate(values)])


def lists(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gram(rows: DataFrame, *columns: str, of: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> np.ndarray:
    """The sum of outer products of an array column (equal lengths, no nulls), or of the rows that `of` makes of a batch of the
    columns: added up in numpy by each task, merged row of the matrix by row in Spark. As large as the array's length squared,
    whatever the number of rows. Rows are made in the worker that adds them up: two functions in a chain hold two workers a core."""
    of = of or (lambda batch: lists(batch.column(0)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = of(batch)
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * len(total)), pa.array(total.ravel()))], ["i", "s"])

    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    found = added(rows.select(*columns).mapInArrow(add_up, schema), ["i"], ["s"]).orderBy("i").collect()  # a row for each place
    return np.array([r["s"] for r in found], float).reshape(len(found), -1)


def cluster_scores(rows: DataFrame, cluster: str, beta: np.ndarray) -> DataFrame:
    """s: for each cluster the sum of x * e, where e = y - x . beta; rows: cluster, x (array), y."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, keys = lists(batch.column("x")), batch.column(cluster).dictionary_encode()
                own = x * (batch.column("y").to_numpy(zero_copy_only=False) - x @ beta)[:, None]
                where = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
                order = np.argsort(where, kind="stable")
                starts = np.flatnonzero(np.diff(where[order], prepend=-1))
                sums = np.add.reduceat(own[order], starts, 0)
                yield pa.RecordBatch.from_arrays([batch.column(cluster).take(pa.array(order[starts])), pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * x.shape[1]), pa.array(sums.ravel()))], [cluster, "s"])

    schema = T.StructType([rows.schema[cluster], T.StructField("s", T.ArrayType(T.DoubleType()))])
    return added(rows.select(cluster, "x", "y").mapInArrow(add_up, schema), [cluster], ["s"])


def squared_residuals(beta: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Of a batch of x and y: x and the squared residual behind it."""

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        x = lists(batch.column("x"))
        e = batch.column("y").to_numpy(zero_copy_only=False) - x @ beta
        return np.column_stack([x, e * e])

    return squares
