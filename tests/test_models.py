"""Solvers, picks and pools against plain Python on small tables."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisgauge.operators import baselines, failures, pool, reports, robustness, serving, statistics, textq

RNG = np.random.default_rng(7)


def test_fixed_effects_equal_least_squares(spark):
    rows = [(f"s{s}", f"m{m}", r / 6, float(RNG.normal()) if RNG.random() > 0.2 else None) for s in range(6) for m in range(3) for r in range(1, 6)]
    df = spark.createDataFrame(rows, "s string, m string, r double, y double")
    got = {(x["s"], x["m"], round(x["r"], 6)): x["e"] for x in statistics.fixed_effect_residual(df, "y", "s", ["r", "m"], "e").collect()}
    real = [x for x in rows if x[3] is not None]
    design = np.array([[1.0, *[x[0] == f"s{k}" for k in range(6)], *[x[1] == f"m{k}" for k in range(3)], *[x[2] == k / 6 for k in range(1, 6)]] for x in real], float)
    y = np.array([x[3] for x in real])
    want = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert [got[x[0], x[1], round(x[2], 6)] for x in real] == pytest.approx(want.tolist(), abs=1e-9)
    assert all(got[x[0], x[1], round(x[2], 6)] is None for x in rows if x[3] is None)


def test_clustered_errors(spark):
    n = 60
    x, g = RNG.normal(size=n), np.arange(n) % 10
    y = 1 + 2 * x + RNG.normal(size=10)[g] + 0.1 * RNG.normal(size=n)
    df = spark.createDataFrame([(f"c{a}", float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)], "c string, x double, y double")
    table, figures = statistics.clustered_ols(df, "y", {"x": F.col("x"), "again": F.col("x") * 2}, "c")
    got = {r["term"]: r for r in table.collect()}
    design = np.stack([np.ones(n), x], 1)
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ beta
    inverse = np.linalg.inv(design.T @ design)
    scores = np.stack([design[g == k].T @ e[g == k] for k in range(10)])
    error = np.sqrt(np.diag(inverse @ scores.T @ scores @ inverse) * 10 / 9 * (n - 1) / (n - 2))
    assert got["intercept"]["estimate"] == pytest.approx(beta[0]) and got["x"]["estimate"] + 2 * got["again"]["estimate"] == pytest.approx(beta[1])
    assert got["intercept"]["std_error"] == pytest.approx(error[0])
    q = e**2
    fitted = design @ np.linalg.lstsq(design, q, rcond=None)[0]
    assert figures["lm"] == pytest.approx(n * (1 - ((q - fitted) ** 2).sum() / ((q - q.mean()) ** 2).sum()))
    assert statistics.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05) and statistics.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)


def test_sign_flips_count_all_replicates(spark):
    df = spark.createDataFrame([("g", f"i{k}", 1.0) for k in range(3)], "g string, i string, d double")
    p = statistics.sign_flip(df, ["g"], "i", "d", 10_000).first()["p_value"]
    assert p == pytest.approx(0.25, abs=0.02)  # two of eight sign patterns
    assert statistics.sign_flip(df.withColumn("d", F.lit(0.0)), ["g"], "i", "d", 70).first()["p_value"] == 1


def test_bootstrap_spearman_follows_the_draws(spark):
    rows = [(f"s{k}", f"a{k % 2}", float(k % 4), float((3 * k) % 7)) for k in range(12)]
    df = spark.createDataFrame([("e", *r) for r in rows], "e string, s string, a string, x double, y double")
    got = statistics.bootstrap_spearman(df, ["e"], [("x", "y")], "a", "s", 50).first()
    times = {}
    for r in statistics.draws(df, "a", "s", 50).collect():
        times.setdefault(r["replicate"], {})[r["s"]] = r["times"]
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    rho = []
    for t in times.values():
        drawn = [r for r in rows for _ in range(t.get(r[0], 0))]
        rho.append(np.corrcoef(rank(np.array([r[2] for r in drawn])), rank(np.array([r[3] for r in drawn])))[0, 1])
    assert [got["ci_lower"], got["ci_upper"]] == pytest.approx(np.percentile(rho, [2.5, 97.5]).tolist())


def test_scenario_under_two_axes_is_an_error(spark):
    rows = spark.createDataFrame([("s", "a"), ("s", "b")], "scenario_id string, style_axis string")
    with pytest.raises(Exception, match="several axes"):
        baselines.scenario_folds(rows).collect()


def test_curation_follows_input_order(spark):
    words = ["alpha beta gamma", "alpha beta gamm", "delta epsilon", "Delta  Epsilon", "zeta eta theta", "zeta eta thet", "zeta iota", "", "ab"]
    rows = [("x", i, RNG.choice(words)) for i in range(40)] + [("y", i, RNG.choice(words)) for i in range(40, 60)]
    df = spark.createDataFrame(rows, "axis string, o int, content string").withColumn("reasons", pool.reasons({"bad": F.col("o") % 11 != 0}))
    got = {r["o"]: (r["accepted"], r["reasons"]) for r in pool.curate(df, "axis", "o", "content", "reasons").collect()}
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 2 else {t} - {""}
    kept = {"x": [], "y": []}
    for axis, i, content in rows:
        t, why = "".join(content.split()).lower(), ["bad"] if i % 11 == 0 else []
        near = any(grams(t) and len(grams(t) & grams(k)) >= 0.45 * len(grams(t) | grams(k)) for k in kept[axis])
        ok = not why
        if t in kept[axis]:
            ok, why = False, [*why, "duplicate_content"]
        elif ok and near:
            ok, why = False, ["near_duplicate_content"]
        if ok:
            kept[axis].append(t)
        assert got[i] == (ok, sorted(why)), (i, content)


def test_hashed_vectors(spark):
    texts = ["a b a", "", "x.y 你好"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string").select("id", textq.tokens(F.col("s")).alias("t"))
    got = {r["id"]: r["v"] for r in textq.hashed_vectors(df, "id", "t").collect()}
    for i, t in enumerate([["a", "b", "a"], [], ["x.y", "你", "好"]]):
        v = np.zeros(256)
        for n in (1, 2, 3):
            for k in range(len(t) - n + 1):
                h = zlib.crc32("\x1f".join(t[k : k + n]).encode())
                v[h & 255] += 1 if h >> 31 else -1
        assert got[i] == pytest.approx((v / (np.linalg.norm(v) or 1)).tolist())


def test_cases_are_picked_in_two_passes(spark):
    rows = [("a", 1, 9.0, 0), ("a", 2, 8.0, 0), ("a", 3, 7.0, 0), ("b", 1, 5.0, 1), ("b", 4, 4.0, 1), ("c", 1, 1.0, 2)]
    df = spark.createDataFrame(rows, "category string, run_id int, severity double, place int")
    got = [(r["category"], r["run_id"]) for r in failures.picked_cases(df).orderBy("nth").collect()]
    assert got == [("a", 1), ("b", 4), ("a", 2)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_pareto(spark, by):
    rows = [(int(RNG.integers(0, 3)), float(RNG.integers(0, 9)), float(RNG.integers(0, 9)), i) for i in range(80)]
    df = spark.createDataFrame(rows, "g int, x double, y double, i int")
    got = {r["i"] for r in serving.pareto(df, "x", "y", by).collect()}
    beats = lambda b, a: (not by or a[0] == b[0]) and b[1] <= a[1] and b[2] <= a[2] and b[1:3] != a[1:3]
    assert got == {a[3] for a in rows if not any(beats(b, a) for b in rows)}


def test_matched_effects_need_all_conditions(spark):
    rows = [("s", "a", "m", c, k, float(v)) for c, k, v in zip(robustness.CONDITIONS, (15, 15, 15, 14), (1, 2, 4, 9), strict=True)] + [("t", "a", "m", "p1_high", 15, 1.0)]
    df = spark.createDataFrame(rows, "scenario_id string, style_axis string, model_id string, condition string, outputs int, v double")
    r, *none = robustness.effects(df, robustness.KEYS, ["v"], 15).collect()
    assert not none and (r["prompt_effect"], r["temperature_effect"], r["interaction"], r["complete"]) == (5, 3, 4, False)


def test_raters_that_fail_attention_items_go(spark):
    rows = [(i, s, f"r{s}", "yes" if i < 2 else "no", "no" if s == "C" and i < 2 else ("yes" if i < 2 else "no"), 50.0, "是", "否", "3") for i, s in itertools.product(range(6), "ABC")]
    df = spark.createDataFrame(rows, "item_id int, rater_slot string, rater_id string, attention_check string, unable string, style double, adds string, contradicts string, seconds string")
    got = reports.formal_ratings(df, ["style", "adds"]).collect()
    assert len(got) == 8 and {r["rater_slot"] for r in got} == {"A", "B"} and all(r["adds"] == 1 and r["contradicts"] == 0 and r["speed_anomaly"] for r in got)
    with pytest.raises(Exception, match="twice"):
        reports.formal_ratings(df.union(df), ["style"]).collect()
