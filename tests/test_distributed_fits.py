"""Fits and counts that are spread over partitions, against plain Python on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisgauge.operators import baselines, isotonic, statistics

RNG = np.random.default_rng(11)


def plain_isotonic(x, y):
    """Distinct x and the greatest of the least means over intervals around each (minimax formula)."""
    at = np.unique(x)
    s, n = np.array([y[x == a].sum() for a in at]), np.array([(x == a).sum() for a in at])
    S, N = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(n)])
    mean = np.array([[(S[j + 1] - S[i]) / (N[j + 1] - N[i]) if j >= i else np.inf for j in range(len(at))] for i in range(len(at))])
    return at, np.array([max(mean[i, k:].min() for i in range(k + 1)) for k in range(len(at))])


SHAPES = {
    "noise": lambda x: RNG.normal(size=len(x)),
    "rising": lambda x: x + 0.1 * RNG.normal(size=len(x)),
    "falling": lambda x: -x,
    "steps": lambda x: np.floor(x * 5) + 2 * RNG.normal(size=len(x)),
    "low end": lambda x: np.where(x > 0.95, -50.0, x),
    "high start": lambda x: np.where(x < 0.05, 50.0, x),
    "late dip": lambda x: np.where((x > 0.6) & (x < 0.7), -5.0, x),
}


@pytest.mark.parametrize("partition", [7, 40, 10_000])
def test_isotonic_fit_over_partitions(spark, monkeypatch, partition):
    monkeypatch.setattr(isotonic, "ROWS", partition)
    rows, want = [], {}
    for g, f in SHAPES.items():
        x = np.round(RNG.random(70), 2)
        y = f(x)
        fold = RNG.integers(0, 3, 70)
        rows += [(g, int(k), float(a), float(b)) for k, a, b in zip(fold, x, y, strict=True)]
        for k in range(3):
            at, level = plain_isotonic(x[fold != k], y[fold != k])
            want |= {(g, k, float(a)): float(np.interp(a, at, level)) for a in x[fold == k]}
    rows += [("one fold", 0, 1.0, 2.0), ("noise", 0, None, 1.0), ("noise", None, 0.5, 1.0), ("noise", 1, 0.123, None)]
    df = spark.createDataFrame(rows, "g string, fold int, x double, y double")
    got = baselines.cross_validated_isotonic(df, ["g"], "x", "y", "e").collect()
    assert len(got) == len(rows)
    for r in got:
        if (r["g"], r["fold"], r["x"]) in want:
            assert r["e"] == pytest.approx(want[r["g"], r["fold"], r["x"]], abs=1e-9)
        else:
            assert (r["e"] is None) == (r["x"] != 0.123)


def test_isotonic_bridges_need_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(isotonic, "ROWS", 50)
    x = np.arange(1500.0)
    for y in (np.sin(x / 40) + 0.3 * RNG.normal(size=1500), np.where(x > 1490, -3000.0, x)):
        df = spark.createDataFrame([(float(a), int(a) % 2, float(b)) for a, b in zip(x, y, strict=True)], "x double, fold int, y double")
        got = {r["x"]: r["e"] for r in baselines.cross_validated_isotonic(df.withColumn("g", F.lit("a")), ["g"], "x", "y", "e").collect()}
        for k in range(2):
            own = np.arange(1500) % 2 == k
            level = isotonic.pool_adjacent(x[~own], y[~own], np.ones((~own).sum()))
            assert [got[a] for a in x[own]] == pytest.approx(np.interp(x[own], x[~own], level).tolist(), abs=1e-9)


def test_fixed_effects_of_many_levels(spark):
    """Two factors with 5,000 levels each, some of them hardly linked, against least squares by sparse elimination in numpy."""
    n, levels = 20_000, 5_000
    a, b = RNG.integers(0, levels, n), RNG.integers(0, levels, n)
    a[:4000] = 0  # a common level
    y = RNG.normal(size=levels)[a] + RNG.normal(size=levels)[b] + RNG.normal(size=n)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), y.tolist(), range(n), strict=True)), "a int, b int, y double, i int")
    got = {r["i"]: r["e"] for r in statistics.fixed_effect_residual(df, "y", "a", ["b"], "e").select("i", "e").collect()}
    e = np.array([got[i] for i in range(n)])
    # the least-squares residual is the one that is orthogonal to all levels and differs from y by effects
    assert max(np.abs(np.bincount(a, e)).max(), np.abs(np.bincount(b, e)).max()) < 1e-6
    fit = y - e
    for _ in range(400):  # what is left of the fit after taking out both factors' means in turn is nothing
        fit = fit - (np.bincount(a, fit, levels) / np.maximum(np.bincount(a, minlength=levels), 1))[a]
        fit = fit - (np.bincount(b, fit, levels) / np.maximum(np.bincount(b, minlength=levels), 1))[b]
    assert np.abs(fit).max() < 1e-3 and np.linalg.norm(fit) < 1e-3 * np.linalg.norm(y)


def test_nested_and_missing_levels(spark):
    rows = [("x", "p", 1.0), ("x", "q", 2.0), ("x", None, 4.0), (None, None, 8.0), ("z", "p", None), ("x", "p", 3.0)]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    got = sorted((str(r["a"]), str(r["b"]), r["e"] is None, round(r["e"] or 0, 9)) for r in statistics.fixed_effect_residual(df, "y", "a", ["b", "a"], "e").collect())
    assert got == sorted([("x", "p", False, -1), ("x", "p", False, 1), ("x", "q", False, 0), ("x", "None", False, 0), ("None", "None", False, 0), ("z", "p", True, 0)])


def test_absorbed_factors_equal_dummies_and_many_terms(spark):
    n = 400
    g, h, x = RNG.integers(0, 12, n), RNG.integers(0, 9, n), RNG.normal(size=n)
    y = 1 + 2 * x + RNG.normal(size=12)[g] + RNG.normal(size=9)[h] + RNG.normal(size=n)
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d), f"c{int(a) % 6}") for a, b, c, d in zip(g, h, x, y, strict=True)], "g int, h int, x double, y double, c string").repartition(3)
    dummies = {f"g{k}": F.when(F.col("g") == k, 1.0).otherwise(0.0) for k in range(1, 12)} | {f"h{k}": F.when(F.col("h") == k, 1.0).otherwise(0.0) for k in range(1, 9)}
    full, f1 = statistics.clustered_ols(df, "y", {"x": F.col("x")} | dummies, "c")
    short, f2 = statistics.clustered_ols(df, "y", {"x": F.col("x")}, "c", ["g", "h"])
    a, b = (t.where("term = 'x'").first() for t in (full, short))
    assert (b["estimate"], b["std_error"]) == pytest.approx((a["estimate"], a["std_error"]), rel=1e-8) and f1["clusters"] == f2["clusters"] == 6
    many = spark.range(900).select(F.col("id"), (F.col("id") % 450).alias("k"), (F.col("id") % 7).cast("string").alias("c"), (F.col("id") % 450 + F.rand(3)).alias("y"))
    table, _ = statistics.clustered_ols(many, "y", {f"t{k}": F.when(F.col("k") == k, 1.0).otherwise(0.0) for k in range(450)}, "c")
    means = {r["k"]: r["m"] for r in many.groupBy("k").agg(F.avg("y").alias("m")).collect()}
    got = {r["term"]: r["estimate"] for r in table.collect()}
    assert len(got) == 451 and all(got["intercept"] + got[f"t{k}"] == pytest.approx(means[k]) for k in range(450))
