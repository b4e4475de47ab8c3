"""Readers over files of several splits, laid-out tables, concordance of many items, null vectors."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.operators import audit, concordance, geometry, judges, pool
from axisgauge.sources import tables

RNG = np.random.default_rng(29)


def test_line_numbers_over_several_splits(spark, tmp_path):
    text = []
    for i in range(3000):
        text.append(["{\"a\": %d}" % i, "", "  ", "[1]", "{bad " + "x" * int(RNG.integers(0, 300)), "{\"a\": %d, \"b\": \"日本\"}" % i][int(RNG.integers(0, 6))] + ("\r\n" if i % 5 == 0 else "\n"))
    (tmp_path / "one.jsonl").write_bytes("".join(text).encode())
    (tmp_path / "two.jsonl").write_bytes(b"{\"a\": 1}\n\n{\"a\": 2}")  # no end of line at the end
    (tmp_path / "empty.jsonl").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in tables.numbered_lines(spark, str(tmp_path)).collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        want = {(f, n): line.rstrip("\r\n") for f in ("one.jsonl", "two.jsonl") for n, line in enumerate(open(tmp_path / f, encoding="utf-8", newline=""), 1)}
        assert lines == want
        rows, bad, blank = tables.read_jsonl_tolerant(spark, str(tmp_path), "a int, b string")
        assert rows.count() == sum(v.startswith("{\"a") for v in want.values())
        assert {(r["file"].rsplit("/", 1)[1], r["line"]) for r in bad.collect()} == {k for k, v in want.items() if v.startswith(("[", "{bad"))}
        assert {r["file"].rsplit("/", 1)[1]: r["blank"] for r in blank.collect()} == {f: sum(k[0] == f and not v.strip() for k, v in want.items()) for f in ("one.jsonl", "two.jsonl")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_laid_out_tables_join_without_an_exchange(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        keys = ["s", "m"]
        p = spark.createDataFrame([(f"s{i % 7}", f"m{i % 3}", float(i)) for i in range(200)], "s string, m string, v double")
        ends = p.groupBy(*keys).agg(F.max("v").alias("top"))
        joined = tables.lay_out(p, keys).join(tables.lay_out(ends, keys), keys).groupBy(*keys).agg(F.sum(F.col("top") - F.col("v")).alias("d"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = {(r["s"], r["m"]): r["d"] for r in p.join(ends, keys).groupBy(*keys).agg(F.sum(F.col("top") - F.col("v")).alias("d")).collect()}
        assert {(r["s"], r["m"]): r["d"] for r in joined.collect()} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def plain_agreement(x, y):
    c = nx = ny = flips = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        c, nx, ny, flips = c + a * b, nx + (a != 0), ny + (b != 0), flips + (a != b)
    return (c / np.sqrt(nx * ny) if nx and ny else None), flips, len(x) * (len(x) - 1) // 2


def test_inversions():
    for _ in range(30):
        r, w = RNG.integers(0, 9, 40), RNG.integers(1, 5, 40)
        assert concordance.inversions(r, w) == sum(w[i] * w[j] for i, j in itertools.combinations(range(40), 2) if r[i] > r[j])
    assert concordance.inversions(np.array([], int), np.array([], int)) == 0


def test_agreement_of_many_items(spark):
    x = np.round(RNG.normal(size=10_000), 2)
    y = np.where(RNG.random(10_000) < 0.3, 0.5, np.round(x + RNG.normal(size=10_000), 1))  # a third of one value
    groups = {"big": (x, y), "small": (x[:40], y[:40]), "constant": (np.ones(5), np.arange(5.0)), "one": (x[:1], y[:1])}
    rows = [(g, float(a), float(b)) for g, (xs, ys) in groups.items() for a, b in zip(xs, ys, strict=True)] + [("small", None, 1.0), ("small", 1.0, None)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        got = {r["g"]: (r["kendall"], r["flips"], r["pairs"]) for r in concordance.rank_agreement(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert set(got) == {"big", "small", "constant"} and got["constant"][0] is None
    assert got["small"] == pytest.approx(plain_agreement(x[:40], y[:40]))
    c = sum(int((np.sign(x[i] - x[i + 1 :]) * np.sign(y[i] - y[i + 1 :])).sum()) for i in range(9_999))
    flips = sum(int((np.sign(x[i] - x[i + 1 :]) != np.sign(y[i] - y[i + 1 :])).sum()) for i in range(9_999))
    pairs = 10_000 * 9_999 // 2
    tied = lambda v: sum(int(k) * (int(k) - 1) // 2 for k in np.unique(v, return_counts=True)[1])
    assert got["big"] == pytest.approx((c / np.sqrt((pairs - tied(x)) * (pairs - tied(y))), flips, pairs))


def test_null_vectors_give_nulls(spark):
    p = spark.createDataFrame([(i, "s", r, v) for i, (r, v) in enumerate([(0.0, [0.0, 0.0]), (0.5, None), (0.5, [0.5, 1.0]), (0.5, [0.5, None]), (1.0, [1.0, 0.0])])], "run_id int, s string, target_ratio double, v array<double>")
    rows = {r["run_id"]: r for r in geometry.with_geometry(p, geometry.self_anchors(p, ["s"]), ["s"]).collect()}
    assert rows[1]["projection_raw"] is None and rows[3]["projection_raw"] is None and rows[1]["off_axis_drift_normalized"] is None
    assert rows[2]["projection_raw"] == 0.5 and rows[4]["projection_raw"] == 1.0 and not rows[4]["out_of_range"]
    both = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0, 2.0], [3.0, 4.0])], "i int, a array<double>, b array<double>")
    assert [r["d"] for r in both.select("i", geometry.dot("a", "b").alias("d")).orderBy("i").collect()] == [None, 11.0]


def test_principal_axes_of_many_trajectories(spark):
    paths = [RNG.normal(size=(k, 5)) for k in (2, 3, 3, 7, 7)] + [np.zeros((3, 5))]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(paths)] + [(9, [[1.0, 2.0], None])], "i int, p array<array<double>>")
    got = {r["i"]: (r["pc"]["pc1_variance"], r["pc"]["pc1_abs_cosine"]) for r in df.select("i", geometry.principal("p").alias("pc")).collect()}
    assert got[5] == got[9] == (None, None)
    for i, p in enumerate(paths[:5]):
        u, s, vt = np.linalg.svd(p - p.mean(0))
        end = p[-1] - p[0]
        assert got[i] == pytest.approx((s[0] ** 2 / (s**2).sum(), abs(vt[0] @ end) / np.linalg.norm(end)))


def test_winners_are_parsed(spark):
    texts = {'{"winner": "1", "confidence": 0.7}': ("1", 0.7), 'so {"winner": "Tie"} it is': ("tie", None), "winner = 2, surely": ("2", None), '{"winner": 3}': (None, None), "": (None, None), "no": (None, None)}
    rows = spark.createDataFrame([*[(t,) for t in texts], (None,)], "t string").select("t", judges.parse_winner(F.col("t")).alias("w")).collect()
    assert {r["t"]: (r["w"]["winner"], r["w"]["confidence"]) for r in rows} == {**texts, None: (None, None)}
    assert all(r["w"]["parse_ok"] == (r["w"]["winner"] is not None) for r in rows)


def test_sanity_gate(spark):
    measured = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "k string, value double")
    expected = spark.createDataFrame([("a", 1.0019), ("b", 2.0021), ("c", 1.0)], "k string, expected double")
    assert {r["k"]: r["ok"] for r in audit.within_tolerance(measured, expected, ["k"]).collect()} == {"a": True, "b": False, "c": None}


def test_readers_refuse_what_does_not_fit(spark, tmp_path):
    runs = spark.range(6).select(F.col("id").alias("run_id"))
    vectors = runs.withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)))
    vectors.repartition(3).write.parquet(f"{tmp_path}/v")
    assert tables.read_fragments(spark, f"{tmp_path}/v", 3).count() == 6 and tables.read_vectors(spark, f"{tmp_path}/v", runs).count() == 6
    for bad in (lambda: tables.read_fragments(spark, f"{tmp_path}/v", 4), lambda: tables.read_vectors(spark, f"{tmp_path}/v", runs.limit(5)), lambda: tables.read_vectors(spark, f"{tmp_path}/v", runs.union(spark.range(90, 91)))):
        with pytest.raises(ValueError, match="fragments|one to one"):
            bad()
    both = tables.read_many([runs, vectors.withColumnRenamed("run_id", "other")])
    assert both.columns == ["run_id", "other", "vector"] and both.count() == 12
    tables.write_sorted(vectors, f"{tmp_path}/s", ["run_id"])
    assert [r["run_id"] for r in spark.read.parquet(f"{tmp_path}/s").collect()] == sorted(range(6))


@pytest.mark.parametrize("together", [5, 1_000_000])
def test_greedy_rejection_of_chains_and_stars(spark, together):
    jobs = []
    for n in (12, 60):  # a chain of n, a star, random pairs
        chain = [("a", i, i - 1) for i in range(1, n)]
        star = [("b", i, 0) for i in range(1, 20)] + [("b", 30 + i, i) for i in range(1, 10)]
        some = sorted({("c", int(max(p)), int(min(p))) for p in RNG.integers(0, 40, (50, 2)) if p[0] != p[1]})
        pairs = chain + star + some
        rows = [("a", i) for i in range(n)] + [("b", i) for i in range(45)] + [("c", i) for i in range(45)]
        want = {}
        for axis, i in sorted(rows):
            want[axis, i] = not any(want[axis, e] for a, late, e in pairs if a == axis and late == i)
        cuts = []

        def keep(df, cuts=cuts):
            cuts.append(1)
            return cut(df)

        got = pool.greedy_accept(spark.createDataFrame(rows, "axis string, o int"), spark.createDataFrame(pairs, "axis string, late int, early int"), "axis", "o", keep, together)
        assert {(r["axis"], r["o"]): r["accepted"] for r in got.collect()} == want
        jobs.append(len(cuts))
    assert together < 100 or jobs[1] <= jobs[0] + 6  # five times the chain: two or three rounds more
