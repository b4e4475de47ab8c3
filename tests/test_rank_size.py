"""What the rank bootstrap writes grows with clusters and distinct values, not with rows times replicates."""

from pathlib import Path

import numpy as np

from axisgauge.operators import ranks


def test_rows_of_a_cluster_do_not_carry_its_draws(spark):
    rng = np.random.default_rng(3)
    rows = [("e", f"s{k % 60}", "a", float(rng.integers(0, 10)), float(rng.normal())) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, s string, a string, x double, y double")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    before = size()
    got = ranks.replicate_correlations(df, ["g"], ["x", "y"], [("x", "y")], "a", "s", 999).toPandas()
    assert len(got) == 1000 and got["r"].abs().max() < 0.2
    assert size() - before < 3000 * 1000 / 4  # a quarter of a byte for each row and replicate
