"""Vector arithmetic over Arrow batches: many rows at once in numpy, vectors in and a few numbers out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(*names: str) -> T.StructType:
    """As objects: workers import this module where a DDL text cannot be parsed."""
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


PROJECTION = doubles("coordinate", "off_axis", "from_ideal", "from_a", "from_b", "separation", "along", "residual")


def matrix(s: pd.Series) -> np.ndarray:
    """A row for each vector. Shorter ones are filled up with zeros, which change no inner product with their own kind; a
    null vector is a row of NaN, of which every result is null."""
    none = np.fromiter((x is None for x in s), bool, len(s))
    if none.any():
        out = matrix(s[~none])
        full = np.full((len(s), out.shape[1]), np.nan)
        full[~none] = out
        return full
    rows = s.to_numpy()
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    if not len(rows) or (sizes == sizes[0]).all():
        return np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, 1))
    out = np.zeros((len(rows), sizes.max()))
    out[np.arange(sizes.max()) < sizes[:, None]] = np.concatenate(rows)
    return out


#: Rows of a batch that are projected at once; about ten matrices of them are held.
AT_ONCE = 1000


@F.pandas_udf(PROJECTION)
def project(v: pd.Series, a: pd.Series, b: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """Coordinate of v on the line from a to b, and distances from the line, its point at alpha, and both ends; `along`
    is (v - a).(b - a). With collapsed ends the coordinate is null, as is what follows from it."""
    parts = [projected(*(s.iloc[k : k + AT_ONCE] for s in (v, a, b, alpha))) for k in range(0, max(len(v), 1), AT_ONCE)]
    out = pd.concat(parts, ignore_index=True)
    return out.astype(object).where(~out.isna(), None)


def projected(v: pd.Series, a: pd.Series, b: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    v, a, b = matrix(v), matrix(a), matrix(b)
    wide = max(x.shape[1] for x in (v, a, b))
    v, a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (v, a, b))  # narrower where the longest are null
    step, off = b - a, v - a
    along, whole = np.einsum("ij,ij->i", off, step), np.einsum("ij,ij->i", step, step)
    separation = np.sqrt(whole)
    ok = separation > 1e-12
    c = np.where(ok, along / np.where(ok, whole, 1), np.nan)  # exactly 1 where v is b
    axial = np.where(ok, c, 0)[:, None] * step
    across = off - axial
    left = np.linalg.norm(off - (axial + across), axis=1) / np.maximum(np.linalg.norm(off, axis=1), 1)
    out = {"coordinate": c, "off_axis": np.where(ok, np.linalg.norm(across, axis=1), np.nan), "from_ideal": np.where(ok, np.linalg.norm(off - alpha.to_numpy(float)[:, None] * step, axis=1), np.nan)}
    out |= {"from_a": np.linalg.norm(off, axis=1), "from_b": np.linalg.norm(v - b, axis=1), "separation": separation, "along": along, "residual": left}
    return pd.DataFrame(out)


@F.pandas_udf(doubles("pc1_variance", "pc1_abs_cosine"))
def principal(points: pd.Series) -> pd.DataFrame:
    """Of a trajectory's points in order (an array of vectors): share of variance on the first principal axis and the
    absolute cosine between that axis and the end-to-end direction; null where the two largest shares are equal."""
    out = np.full((len(points), 2), np.nan)
    shapes: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        if p is not None and len(p) and all(x is not None for x in p) and len({len(x) for x in p}) == 1:
            shapes.setdefault((len(p), len(p[0])), []).append(i)
    for at in shapes.values():  # trajectories of equal size at once
        m = np.stack([np.stack(points.iloc[i]) for i in at]).astype(np.float64)
        centred = m - m.mean(1, keepdims=True)
        known = np.isfinite(centred).all((1, 2))
        values, vectors = np.linalg.eigh(np.where(known[:, None, None], centred @ centred.transpose(0, 2, 1), 0))
        total, ends = values.sum(1), np.linalg.norm(m[:, -1] - m[:, 0], axis=1)
        second = values[:, -2] if values.shape[1] > 1 else np.zeros(len(at))
        fine = known & (total > 0) & (ends > 1e-12) & (values[:, -1] - second >= 1e-12 * values[:, -1])
        top = np.sqrt(np.maximum(values[:, -1], 0))
        rows = np.array(at)[fine]
        out[rows, 0] = (values[:, -1] / np.where(fine, total, 1))[fine]
        out[rows, 1] = np.minimum(1.0, np.abs(vectors[:, -1, -1] - vectors[:, 0, -1]) * top / np.where(fine, ends, 1))[fine]
    return pd.DataFrame(out, columns=["pc1_variance", "pc1_abs_cosine"]).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(T.DoubleType())
def dot(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", matrix(a), matrix(b)))
