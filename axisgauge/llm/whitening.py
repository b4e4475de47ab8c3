"""Whitening of embeddings from an exact covariance by polarisation.

Entries become integers, x = floor(scale * c). Over the fit list, each distinct x once, the centred values z = n * x - S
(S: the sums by dimension) are integers as well, and so are the sums of squares of z_i for every dimension and of
z_i + z_j for every pair. Half the difference Q_ij - Q_i - Q_j of those is the sum of z_i * z_j, without rounding; over
n^3 it is the covariance, correctly rounded. Tasks add up squares for their own rows in numpy, numbers split into parts
of `PART` bits so that nothing overflows, and hand on one row for each dimension or pair; Spark adds those. The driver
gets d * (d + 1) / 2 sums, which grow with the dimension d and not with the rows, and takes eigenvectors of one matrix.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; vectors of several lengths
are different vectors, and shorter ones count as zero beyond their end; null and repeated ids come back as they are,
row by row; repeated vectors count once in the fit list; a component without variance (beyond rounding) has a null
`whitened` and takes no part in `identity_error`; without any variance `explained` is null; `deviation` is null where it
does not fit in a long; n * x must fit in 62 bits, else the job fails; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisgauge.llm.common import written

SCALE, COMPONENTS = 256.0, 4
#: Bits of a part of a split number, and rows whose products of parts are added in 64 bits: 2 * 23 + 1 + 12 < 63.
PART, ROWS = 23, 4096


@dataclass
class Whitening:
    """n, S (Python integers), eigenvalues (falling) and unit eigenvectors (columns) of the kept components, and of all."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    floor: float


def integral(vector: Column, scale: float = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(scale)))


def finite(vector: Column) -> Column:
    """False for null vectors, null entries, NaN and infinities."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def dense(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """A row for each list, zero beyond its end."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), width or 0)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype if len(values) else np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows: for each dimension the sum and the largest absolute value."""
    total: list[int] = []
    top = 0
    for batch in batches:
        x = dense(batch.column("x"))
        low = x >> 32  # halves, whose sums fit
        part = [(int(a) << 32) + int(b) for a, b in zip(low.sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]
        total = [*total, *[0] * (len(part) - len(total))]
        for k, v in enumerate(part):
            total[k] += v
        top = max(top, *(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))))
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(v) for v in total], pa.decimal128(38)), pa.array([top] * len(total), pa.int64())], ["i", "s", "top"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return np.int64(n) * x - np.array(sums, np.int64)


def square_sums(z: np.ndarray) -> dict[int, np.ndarray]:
    """z: dimensions by rows. {power: sums}: by dimension i, then by pair i < j, the sum of (z_i)^2 or (z_i + z_j)^2 is the
    sum over powers of 2^power times the array's entry. Rows are at most ROWS."""
    d = len(z)
    bits = int(np.abs(z).max(initial=0)).bit_length() + 2
    parts = -(-bits // PART)
    out = {PART * p: np.zeros(d * (d + 1) // 2, np.int64) for p in range(2 * parts - 1)}

    def add(v: np.ndarray, at: int) -> None:
        split = [(v >> (PART * k)) & ((1 << PART) - 1) if k < parts - 1 else v >> (PART * k) for k in range(parts)]
        for a in range(parts):
            for b in range(a, parts):
                s = np.einsum("ij,ij->i", split[a], split[b])
                out[PART * (a + b)][at : at + len(v)] += s if a == b else 2 * s

    add(z, 0)
    at = d
    for i in range(d - 1):
        add(z[i + 1 :] + z[i], at)
        at += d - 1 - i
    return out


def fit(rows: DataFrame, scale: float = SCALE, components: int = COMPONENTS, vector_col: str = "embedding") -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of rows, and those vectors (x) as a written table. None if there are none."""
    found = written(rows.where(finite(F.col(vector_col))).select(integral(F.col(vector_col), scale).alias("x")).distinct(), "fitlist")
    n = found.count()
    by_dimension = found.mapInArrow(_sums, "i int, s decimal(38,0), top long").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.max("top").alias("top")).orderBy("i").collect()  # a row for each dimension
    d = len(by_dimension)
    if not n or not d:
        return None, found
    sums, top = [int(r["s"]) for r in by_dimension], max(r["top"] for r in by_dimension)
    if 2 * n * top >= 1 << 61:
        raise OverflowError("n * x does not fit in 62 bits")

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                z = centred(dense(batch.column("x").slice(first, ROWS), d), n, sums)
                for power, s in square_sums(np.ascontiguousarray(z.T)).items():
                    total[power] = total[power] + s.astype(object) if power in total else s.astype(object)
        for power, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array([power] * len(s), pa.int32()), pa.array([Decimal(v) for v in s], pa.decimal128(38))], ["pair", "power", "s"])

    q = [0] * (d * (d + 1) // 2)
    for r in found.mapInArrow(squares, "pair int, power int, s decimal(38,0)").groupBy("pair", "power").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect():  # as many as pairs of dimensions
        q[r["pair"]] += int(r["s"]) << r["power"]
    v, at = np.zeros((d, d)), d
    for i in range(d):
        v[i, i] = q[i] / n**3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (q[at] - q[i] - q[j]) / (2 * n**3)
            at += 1
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, values[order], vectors[:, order], float(np.trace(v)), float(max(values.max(), 0) * d * np.finfo(float).eps)), found


def projected(z: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows of z = n * x - S on the components, over the root of their variance; NaN where there is none."""
    real = model.values > model.floor
    return np.where(real, (z / model.n) @ model.vectors / np.sqrt(np.where(real, model.values, 1)), np.nan)


def identity_error(found: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    real = [k for k in range(len(model.values)) if model.values[k] > model.floor]
    if not real:
        return None

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = projected(centred(dense(batch.column("x"), len(model.sums)), model.n, model.sums), model)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in real], [f"w{k}" for k in real])

    cells = [F.abs(F.covar_pop(f"w{a}", f"w{b}") - (1.0 if a == b else 0.0)) for a in real for b in real if a <= b]
    return float(found.mapInArrow(whitened, ", ".join(f"w{k} double" for k in real)).agg(F.array_max(F.array(*cells)).alias("e")).first()["e"])


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    model, found = fit(rows, scale, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(found, model), len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = centred(dense(batch.column("x"), len(model.sums)), model.n, model.sums)
            m = len(z)
            fits = np.einsum("ij,ij->i", z.astype(float), z.astype(float)) < 2.0**62.99
            deviation = pa.array(np.einsum("ij,ij->i", z, z), mask=~fits)  # modulo 2^64, so exact where it fits
            w = projected(z, model).ravel()
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation.take(again),
                 pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, m), mask=np.isnan(np.tile(explained, m))), pa.array([error] * (m * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(finite(F.col("embedding"))).select("vec_id", integral(F.col("embedding"), scale).alias("x")).mapInArrow(give, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
