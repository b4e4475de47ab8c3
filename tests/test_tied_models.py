"""Models with equal errors: the rank agreement of the protocols is tau-b in Spark and in SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from axisgauge.plans import registry


def test_an3_ties_as_in_sql(spark, tmp_path):
    vectors = np.random.default_rng(5).normal(size=(3, 4, 21, 64))
    vectors[:, 1] = vectors[:, 0]  # the second model repeats the first
    pq.write_table(pa.table({"vec_id": range(252), "embedding": pa.array(vectors.reshape(-1, 64).tolist(), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    order = ["encoder_id", "protocol", "models", "spearman", "kendall", "flips", "pairs"]
    got = sorted(tuple(r[c] for c in order) for r in registry.QUERIES["an3_rank_sensitivity"](spark, str(tmp_path)).collect())
    want = sorted(con.sql(f"SELECT {', '.join(order)} FROM ({registry.ORACLE['an3_rank_sensitivity']})").fetchall())
    assert len(got) == 6 and got == [pytest.approx(w) for w in want]
    assert all((r[4] * 5) == pytest.approx(round(r[4] * 5), abs=1e-5) for r in got)  # five of six pairs are without ties on either side
