"""Order statistics, ranks and frontiers from range partitions against plain Python."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from axisgauge.functions.numeric import global_rank
from axisgauge.functions.quantiles import aggregated
from axisgauge.operators import serving

RNG = np.random.default_rng(23)


def test_quantiles_equal_linear_interpolation(spark):
    groups = {"a": RNG.normal(size=501), "b": RNG.integers(0, 3, 400).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), None: np.array([5.0, 7.0, 7.0])}
    rows = [(g, float(v), float(-v) if i % 3 else None) for g, vs in groups.items() for i, v in enumerate(vs)] + [("a", None, None), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    qs = (0.0, 0.1, 0.5, 0.95, 1.0)
    got = {r["g"]: r for r in aggregated(df.repartition(5), ["g"], [F.count("v").alias("n")], {f"q{k}": ("v", q) for k, q in enumerate(qs)} | {"m": ("w", 0.25)}).collect()}
    assert set(got) == {*groups, "none"} and got["none"]["q1"] is None and got["none"]["m"] == 1.0 and got["none"]["n"] == 0
    for g, vs in groups.items():
        assert [got[g][f"q{k}"] for k in range(5)] == pytest.approx(np.quantile(vs, qs).tolist())
        w = np.array([r[2] for r in rows if r[0] == g and r[2] is not None])
        assert got[g]["m"] is None if not len(w) else got[g]["m"] == pytest.approx(np.quantile(w, 0.25))
    assert aggregated(df, [], [F.count("v").alias("n")], {"q": ("v", 0.5)}).first()["q"] == pytest.approx(np.median(np.concatenate([*groups.values()])))
    empty = aggregated(df.limit(0), [], [F.count("v").alias("n")], {"q": ("v", 0.5)}).collect()
    assert [(r["n"], r["q"]) for r in empty] == [(0, None)]


def test_global_ranks_and_frontiers_without_exchange_reuse(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        for k in old:
            spark.conf.set(k, "false")
        df = spark.range(2_000_000).select("id", F.floor(F.rand(5) * 700_000).alias("v"), F.rand(6).alias("y")).persist()
        ranks = df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("v", (F.sum("n").over(Window.orderBy("v")) - (F.col("n") - 1) / 2.0).alias("want"))
        got = global_rank(df, "v", "r").join(ranks, "v")
        assert got.where("abs(r - want) > 1e-6").count() == 0 and got.count() == 2_000_000
        front = {(r["v"], r["y"]) for r in serving.pareto(df, "v", "y").collect()}
        want, least = set(), np.inf
        for r in sorted(df.groupBy("v").agg(F.min("y").alias("y")).collect()):
            if r["y"] < least:
                want.add((r["v"], r["y"]))
                least = r["y"]
        assert front == want
        df.unpersist()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("width", [1.0, 7.0, 10_000.0])
def test_window_peaks_by_brute_force(spark, width):
    samples = [(float(t), f"d{RNG.integers(0, 3)}", float(RNG.normal())) for t in RNG.uniform(0, 100, 400)]
    windows = [("m0", 3.0, 40.0, ["d0", "d1"]), ("m1", 39.5, 39.6, ["d0", "d1", "d2"]), ("m2", 50.0, 20.0, ["d0"]), ("m3", 0.0, 100.0, ["d0", "d1", "d2"]), ("m4", 10.0, 90.0, ["d0", "d9"])]
    got = {r["model_id"]: (r["devices"], r["peak_sum"]) for r in serving.window_peaks(spark.createDataFrame(samples, "ts double, device string, value double"), spark.createDataFrame(windows, "model_id string, start double, stop double, devices array<string>"), width).collect()}
    for m, a, b, devices in windows:
        peaks = [max(vs) for d in devices if (vs := [v for t, e, v in samples if e == d and a <= t <= b])]
        if peaks:
            assert got[m][0] == len(peaks) and (got[m][1] == pytest.approx(sum(peaks)) if len(peaks) == len(devices) else got[m][1] is None)
        else:
            assert m not in got


def test_exact_group_has_its_expected_number(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, i int")
    assert sorted(r["i"] for r in serving.exact_group(rows, "g", "a", 2).collect()) == [1, 2]
    with pytest.raises(Exception, match="another number of rows"):
        serving.exact_group(rows, "g", "a", 3).collect()
