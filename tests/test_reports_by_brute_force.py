"""Length sensitivity and pool summaries against plain Python."""

from collections import Counter

import numpy as np
import pytest

from axisgauge.functions.lineage import cut
from axisgauge.operators import judges, pool, statistics

RNG = np.random.default_rng(31)


def test_length_sensitivity(spark):
    rows = []
    for s in range(7):
        for m in range(3):
            for r in (1 / 6, 0.5, 5 / 6):
                for seed in (1, 2):
                    c, n = float(r + RNG.normal() / 5), float(RNG.integers(50, 500))
                    rows.append((f"s{s}", f"a{s % 2}", f"m{m}", r, seed, c, n if RNG.random() > 0.05 else None, 100 * c + float(RNG.normal() * 10) + n / 20, float(RNG.normal()) if seed == 1 else None))
    df = spark.createDataFrame(rows, "scenario_id string, style_axis string, model_id string, target_ratio double, seed int, coordinate double, length double, j1 double, j2 double")
    got = {r["judge"]: r for r in judges.length_sensitivity(df, ["j1", "j2"], cut, 200).collect()}
    times: dict = {}
    for r in statistics.draws(df.selectExpr("scenario_id", "'all' _all"), "_all", "scenario_id", 200).collect():
        times.setdefault(r["replicate"], Counter())[r["scenario_id"]] = r["times"]
    keys = sorted({(r[0], r[2], r[3]) for r in rows})
    mean = lambda i: np.array([np.mean(v) if (v := [r[i] for r in rows if (r[0], r[2], r[3]) == k and r[i] is not None]) else np.nan for k in keys])
    design = np.array([[k[j] == v for j in range(3) for v in sorted({x[j] for x in keys})] for k in keys], float)

    def residual(v, x):
        out, known = np.full(len(v), np.nan), np.isfinite(v) & np.isfinite(x).all(1)
        out[known] = v[known] - x[known] @ np.linalg.lstsq(x[known], v[known], rcond=None)[0]
        return out

    flat = {n: residual(mean(i), design) for n, i in (("c", 5), ("l", 6), ("j1", 7), ("j2", 8))}
    line = lambda v: residual(v, np.column_stack([np.ones(len(keys)), flat["l"]]))

    def interval(a, b):
        known = np.isfinite(a) & np.isfinite(b)

        def r(t):
            w = np.array([t[k[0]] for k, ok in zip(keys, known, strict=True) if ok], float)
            x, y = a[known], b[known]
            x, y = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
            return (w * x) @ y / np.sqrt(((w * x) @ x) * ((w * y) @ y))

        return [r(Counter({f"s{s}": 1 for s in range(7)})), *np.percentile([r(t) for t in times.values()], [2.5, 97.5])]

    for j in ("j1", "j2"):
        assert [got[j][c] for c in ("estimate", "ci_lower", "ci_upper")] == pytest.approx(interval(flat["c"], flat[j]), abs=1e-7)
        assert [got[j][c] for c in ("controlled", "controlled_lower", "controlled_upper")] == pytest.approx(interval(line(flat["c"]), line(flat[j])), abs=1e-7)


def test_pool_summary(spark):
    rows = [(f"x{int(RNG.integers(0, 3))}", i, f"d{int(RNG.integers(0, 4))}", [w for w in ("bad", "short", "twin") if RNG.random() < 0.2]) for i in range(120)] + [("none", 500, "d0", ["bad"])]
    df = spark.createDataFrame(rows, "axis string, o int, domain string, reasons array<string>")
    good, bad = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    final = pool.diverse_pick(df.where("size(reasons) = 0"), "axis", "domain", "o", 5)
    got = {r["axis"]: r for r in pool.pool_summary(df, df.where("size(reasons) = 0"), final, df.where("size(reasons) > 0"), "axis", "domain", 2).collect()}
    for axis in {r[0] for r in rows}:
        own = [r for r in good if r[0] == axis]
        size, turn, ranked = Counter(r[2] for r in own), Counter(), []
        for r in sorted(own, key=lambda r: r[1]):
            turn[r[2]] += 1
            ranked.append((turn[r[2]], -size[r[2]], r[2], r[1]))
        picked = sorted(ranked)[:5]
        reasons = Counter(w for r in bad if r[0] == axis for w in r[3])
        want = (sum(r[0] == axis for r in rows), len(own), len(picked), len({p[2] for p in picked}), sum(r[0] == axis for r in bad))
        assert tuple(got[axis][c] for c in ("candidates", "filtered", "final", "domains", "rejected")) == want
        assert got[axis]["top_reasons"] == "; ".join(f"{w}:{n}" for w, n in sorted(reasons.items(), key=lambda x: (-x[1], x[0]))[:2])
