"""Vectors of a batch are projected in parts, and residual products are made in the worker that adds them up."""

import numpy as np
import pandas as pd

from axisgauge.functions import vectors
from axisgauge.operators import absorption


def test_projection_in_parts(monkeypatch):
    rng, n = np.random.default_rng(3), 2500
    v, a, b = (pd.Series([None if name == "v" and i % 97 == 0 else rng.normal(size=4 if i % 3 else 2) for i in range(n)]) for name in "vab")
    alpha, sizes, whole = pd.Series(rng.random(n)), [], vectors.matrix
    monkeypatch.setattr(vectors, "matrix", lambda s: sizes.append(len(s)) or whole(s))
    got = vectors.project.func(v, a, b, alpha)
    assert max(sizes) <= 1000 and len(got) == n
    for i in (0, 1, 2, 999, 1000, 2499):
        if v[i] is None:
            assert got.iloc[i][["coordinate", "off_axis", "from_ideal"]].isna().all()
        else:
            want = (v[i] - a[i]) @ (b[i] - a[i]) / ((b[i] - a[i]) @ (b[i] - a[i]))
            assert abs(got["coordinate"][i] - want) < 1e-12
    assert len(vectors.project.func(v[:0], a[:0], b[:0], alpha[:0])) == 0


def test_residual_products_in_one_worker(spark):
    rng = np.random.default_rng(4)
    x, y, beta = rng.normal(size=(300, 3)), rng.normal(size=300), rng.normal(size=3)
    d = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    rows = np.column_stack([x, (y - x @ beta) ** 2])
    assert np.allclose(absorption.gram(d, "x", "y", of=absorption.squared_residuals(beta)), rows.T @ rows)
    assert np.allclose(absorption.gram(d, "x"), x.T @ x)
