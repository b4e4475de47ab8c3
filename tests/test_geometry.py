"""The kernels on tiny trajectories whose results are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisgauge.operators import baselines, geometry, isotonic, ladder, statistics

BY = ["scenario_id", "style_axis", "model_id", "seed", "encoder_id"]


def track(spark, points, seed=1):
    rows = [(k, "s", "x", "m", seed, "e", k / 6, [float(v) for v in p]) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, "run_id long, scenario_id string, style_axis string, model_id string, seed int, encoder_id string, target_ratio double, v array<double>")


LINE = [(k / 6, 0) for k in range(7)]


def changed(k, p):
    return [p if i == k else q for i, q in enumerate(LINE)]


def test_ideal_line_has_no_error(spark):
    s = geometry.interior_summary(geometry.sample_rows(track(spark, LINE))).first()
    assert s["interior_point_count"] == 5
    assert s["interior_calibration_error"] == pytest.approx(0, abs=1e-12)
    assert s["mean_rank"] == 1 and s["spearman_monotonicity"] == pytest.approx(1)


def test_error_and_range_come_before_clipping(spark):
    r = geometry.sample_rows(track(spark, changed(1, (-0.2, 0)))).where("run_id = 1").first()
    assert r["out_of_range"] and r["projection_error_raw"] > r["projection_error_clipped"]


def test_orthogonal_push(spark):
    r = geometry.sample_rows(track(spark, changed(3, (0.5, 0.25)))).where("run_id = 3").first()
    assert r["off_axis_drift_normalized"] == pytest.approx(0.25)
    assert r["interpolation_distance_normalized"] == pytest.approx(0.25)


def test_collapsed_anchors_give_nulls(spark):
    rows = geometry.sample_rows(track(spark, [(0, 0)] * 7)).collect()
    assert all(r["endpoint_unstable"] and r["projection_raw"] is None and r["nearest_neighbor_rank"] is None for r in rows)


def test_line_diagnostics(spark):
    p = track(spark, LINE)
    r = geometry.path_shape(p, geometry.sample_rows(p)).first()
    assert r["pc1_variance"] == pytest.approx(1) and r["pc1_abs_cosine"] == pytest.approx(1) and r["path_length_ratio"] == pytest.approx(1)
    assert r["negative_slopes"] == 0 and r["turning_points"] == 0


def test_leave_one_seed_out_of_a_shared_line(spark):
    p = track(spark, LINE, 1).union(track(spark, LINE, 2)).union(track(spark, LINE, 3))
    rows = geometry.leave_one_seed_out(p, ["scenario_id", "style_axis", "model_id", "encoder_id"]).collect()
    assert len(rows) == 3
    assert all(r["line_error"] == pytest.approx(0, abs=1e-12) and r["centroid_error"] == pytest.approx(0, abs=1e-12) and r["nearest_accuracy"] == 1 for r in rows)


def test_piecewise_line_follows_a_bent_track(spark):
    bent = [(k / 6, 0.3 if k == 3 else 0.0) for k in range(7)]
    p = track(spark, bent, 1).union(track(spark, bent, 2)).union(track(spark, bent, 3))
    by = ["scenario_id", "style_axis", "model_id", "encoder_id"]
    rows = geometry.piecewise_line(p, by).collect()
    assert len(rows) == 3 and all(r["piecewise_accuracy"] == 1 and r["piecewise_error"] == pytest.approx(0, abs=1e-9) and r["piecewise_drift"] == pytest.approx(0, abs=1e-6) for r in rows)
    off = track(spark, bent, 1).union(track(spark, bent, 2)).union(track(spark, [(x, y - 0.6 * (i == 3)) for i, (x, y) in enumerate(bent)], 3))
    held = {r["held_seed"]: r for r in geometry.piecewise_line(off, by).collect()}
    # the middle point at (1/2, -0.3) lies nearest to the kinks' feet at 1/3 and 2/3; the first of equals counts
    assert held[3]["piecewise_error"] == pytest.approx(1 / 6 / 5, abs=1e-9) and held[3]["piecewise_accuracy"] == pytest.approx(0.8)
    assert held[3]["piecewise_drift"] == pytest.approx((1 / 36 + 0.09) ** 0.5 / 5, abs=1e-6)  # distances come from dot products


def test_incomplete_track_has_no_ranks(spark):
    s = geometry.with_geometry(track(spark, LINE).where("run_id != 3"), geometry.self_anchors(track(spark, LINE)), BY)
    rows = geometry.with_neighbour_rank(s, BY, complete=7).collect()
    assert len(rows) == 6 and all(r["nearest_neighbor_rank"] is None and r["projection_raw"] is not None for r in rows)


def test_fixed_anchor(spark):
    a = spark.createDataFrame([("s", [0.0, 0.0], [1.0, 0.0])], "scenario_id string, a array<double>, b array<double>")
    p = spark.createDataFrame([(1, "s", 0.25, [0.25, 0.5])], "run_id long, scenario_id string, target_ratio double, v array<double>")
    r = geometry.with_geometry(p, a, ["scenario_id"]).first()
    assert r["projection_raw"] == pytest.approx(0.25) and r["projection_error_raw"] == pytest.approx(0) and r["off_axis_drift_normalized"] == pytest.approx(0.5)


def test_isotonic_pools_neighbours():
    got = isotonic.pool_adjacent(np.arange(4.0), np.array([0, 0.8, 0.4, 1.0]), np.ones(4))
    assert got == pytest.approx([0, 0.6, 0.6, 1])


def test_folds_never_split_a_scenario(spark):
    rows = spark.createDataFrame([(f"s{i}", f"a{i % 2}") for i in range(20) for _ in range(3)], "scenario_id string, style_axis string")
    folds = baselines.scenario_folds(rows)
    assert folds.count() == 20 and folds.select("fold").distinct().count() == 5


def test_constant_length_predicts_the_mean(spark):
    rows = spark.createDataFrame([("m", f, 3.0, y) for f, y in ((0, 1.0), (1, 2.0), (2, 6.0))], "model_id string, fold int, x double, y double")
    got = {r["fold"]: r["p"] for r in baselines.cross_validated_line(rows, ["model_id"], "x", "y", "p").collect()}
    assert got == {0: pytest.approx(4), 1: pytest.approx(3.5), 2: pytest.approx(1.5)}


def test_five_of_seven(spark):
    rng = np.random.default_rng(0)
    p = track(spark, [(0, 0), *rng.normal(size=(5, 2)), (1, 0)])
    r = ladder.endpoint_inclusion(geometry.sample_rows(p), ["model_id"]).first()
    assert r["all_points"] == pytest.approx(r["interior"] * 5 / 7)


def test_kappa_of_published_counts(spark):
    cells = spark.createDataFrame([(False, False, 1627), (False, True, 365), (True, False, 26337), (True, True, 83937)], "a boolean, b boolean, n int")
    r = cells.select("a", "b", F.explode(F.sequence(F.lit(1), "n"))).agg(*statistics.cohen_kappa(F.col("a"), F.col("b"))).first()
    assert r["raw_agreement"] == pytest.approx(0.762154, abs=1e-6) and r["kappa"] == pytest.approx(0.078085, abs=1e-6)


def test_holm(spark):
    rows = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None)], "family string, id string, p_value double")
    got = {r["id"]: r["p_holm"] for r in statistics.holm(rows, ["family"]).collect()}
    assert got == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06), "d": None}


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    p = track(spark, rng.normal(size=(7, 5)))
    one, many = (sorted(map(str, geometry.sample_rows(p.repartition(n)).select("run_id", F.round("projection_raw", 9), "nearest_neighbor_rank").collect())) for n in (1, 17))
    assert one == many
