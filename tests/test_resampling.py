"""Draws, permutations and weighted ranks against plain Python, with small buckets and partitions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisgauge.operators import ranks, resampling, statistics

RNG = np.random.default_rng(17)
STEPS = np.arange(1, 401)


def hashes(n):
    return sorted(int(hashlib.md5(f"c{i}".encode()).hexdigest()[:15], 16) for i in range(n))


def test_counts_are_binomial_splits_of_all_draws():
    for n in (1, 2, 3, 40, 700):
        k = np.stack(list(resampling.leaves(hashes(n), [], n, "s", 1, STEPS)))
        assert k.shape == (n, 400) and (k.sum(0) == n).all() and (k >= 0).all()
        if n > 3:
            assert abs(k.var() - (1 - 1 / n)) < 0.05  # of a multinomial draw
    a, b = np.stack(list(resampling.leaves(hashes(40), [], 40, "s", 1, np.arange(1, 20_001))))[[3, 30]]
    assert abs(np.corrcoef(a, b)[0, 1] + 1 / 39) < 0.02


def test_binomial_counts_follow_their_distribution():
    k = np.full(50_000, 1300)  # three pieces
    for left, n in ((1, 3), (2, 3), (1, 2), (1, 900)):
        got = resampling.left_counts(k, left, n, 12345 + n, np.arange(50_000))
        p = left / n
        assert abs(got.mean() - 1300 * p) < 5 * np.sqrt(1300 * p * (1 - p) / 50_000) and abs(got.var() / (1300 * p * (1 - p)) - 1) < 0.05
    assert (resampling.left_counts(k, 0, 5, 1, k) == 0).all() and (resampling.left_counts(k, 5, 5, 1, k) == 1300).all()


@pytest.mark.parametrize("bucket", [4, 10_000])
def test_sums_of_draws_do_not_depend_on_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(resampling, "BUCKET", bucket)
    monkeypatch.setattr(resampling, "CHUNK", 7)
    rng = np.random.default_rng(2)
    rows = [(f"g{g}", f"c{i}", "ab"[i % 3 > 0], float(rng.normal()) if rng.random() > 0.1 else None) for i in range(90) for g in range(2)] + [("g0", "alone", None, 5.0)]
    df = spark.createDataFrame(rows, "g string, c string, s string, v double")
    got = {(r["g"], r["replicate"]): (r["v"], r["v_w"]) for r in resampling.drawn_sums(df, ["g"], ["v"], "s", "c", 30).collect()}
    each = {}
    for s in ("a", "b", None):
        names = sorted({c for _, c, t, _ in rows if t == s}, key=lambda c: hashlib.md5(c.encode()).hexdigest())
        each |= dict(zip(names, resampling.leaves([int(hashlib.md5(c.encode()).hexdigest()[:15], 16) for c in names], [], len(names), "\0" if s is None else s, 1, np.arange(1, 31)), strict=True))
    for g in ("g0", "g1"):
        for b in range(30):
            own = [(v, each[c][b]) for h, c, _, v in rows if h == g and v is not None]
            assert got[g, b + 1] == pytest.approx((sum(v * t for v, t in own), sum(t for _, t in own)))
    times = {(r["c"], r["replicate"]): r["times"] for r in statistics.draws(df, "s", "c", 30).collect()}
    assert times == {(c, b + 1): k[b] for c, k in each.items() for b in range(30) if k[b]}


def test_intervals_equal_a_plain_bootstrap(spark):
    values = {s: RNG.normal(size=60) + k for k, s in enumerate("ab")}
    df = spark.createDataFrame([(s, f"{s}{i}", float(v)) for s, vs in values.items() for i, v in enumerate(vs)], "s string, c string, v double")
    got = statistics.bootstrap_means(df, [], ["v"], "s", "c", 4000).first()
    plain = np.mean([vs[RNG.integers(0, 60, (4000, 60))].mean(1) for vs in values.values()], 0)
    error = plain.std() * 4 * np.sqrt(2) * np.sqrt(0.025 * 0.975 / 4000) / 0.0584  # four standard errors of a percentile, twice
    assert [got["ci_lower"], got["ci_upper"]] == pytest.approx(np.percentile(plain, [2.5, 97.5]).tolist(), abs=error)


@pytest.mark.parametrize("rows_a_partition", [9, 100_000])
def test_rank_replicates_over_partitions(spark, monkeypatch, rows_a_partition):
    monkeypatch.setattr(ranks, "ROWS", rows_a_partition)
    monkeypatch.setattr(resampling, "CHUNK", 11)
    rows = [(g, f"s{k}", f"a{k % 2}", float(RNG.integers(0, 5)), float(RNG.integers(0, 9)), float(RNG.normal())) for g in ("e", "f") for k in range(25) for _ in range(2)] + [("e", "s1", "a1", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, s string, a string, x double, y double, z double")
    got = {(r["g"], r["x"], r["y"], r["replicate"]): r["r"] for r in ranks.replicate_correlations(df.dropna(), ["g"], ["x", "y", "z"], [("x", "y"), ("y", "z")], "a", "s", 30).collect()}
    times = {}
    for r in statistics.draws(df, "a", "s", 30).collect():
        times.setdefault(r["replicate"], {})[r["s"]] = r["times"]
    times[0] = {f"s{k}": 1 for k in range(25)}
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    for g in ("e", "f"):
        for b, t in times.items():
            drawn = np.array([r[3:] for r in rows if r[0] == g and r[3] is not None for _ in range(t.get(r[1], 0))])
            r = [rank(c) for c in drawn.T]
            assert [got[g, "x", "y", b], got[g, "y", "z", b]] == pytest.approx([np.corrcoef(r[0], r[1])[0, 1], np.corrcoef(r[1], r[2])[0, 1]])


def test_sign_flips_by_brute_force(spark):
    rows = [(g, f"i{k}", float(RNG.normal()) + 0.1) for g in ("a", "b") for k in range(70) for _ in range(1 + (g == "b"))] + [("a", "i0", None)]
    df = spark.createDataFrame(rows, "g string, i string, d double")
    got = {r["g"]: (r["mean"], r["p_value"]) for r in statistics.sign_flip(df.repartition(3), ["g"], "i", "d", 1000).collect()}
    for g in ("a", "b"):
        own = [(i, d) for h, i, d in rows if h == g and d is not None]
        sign = lambda i, b: 1 - 2 * (int(hashlib.md5(f"1:{b // 32}:{i}".encode()).hexdigest()[:8], 16) >> b % 32 & 1)
        means = np.array([np.mean([d * sign(i, b) for i, d in own]) for b in range(1000)])
        mean = np.mean([d for _, d in own])
        assert got[g] == pytest.approx((mean, (1 + (np.abs(means) >= abs(mean) - 1e-15).sum()) / 1001))
    assert statistics.sign_flip(df.where("false"), ["g"], "i", "d", 100).count() == 0
    assert statistics.sign_flip(df, [], "i", "d", 100).count() == 1
