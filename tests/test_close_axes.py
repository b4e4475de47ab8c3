"""Trajectories whose two largest shares of variance differ by 2 parts in 100,000: query and SQL take the same axis."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from axisgauge.plans import registry


def test_same_axis_as_sql(spark, tmp_path):
    t = np.arange(21) % 7 * 2 * np.pi / 7
    v = np.zeros((21, 64))
    v[:, [0, 32]], v[:, [1, 33]] = np.cos(t)[:, None], (1 + 1e-5) * np.sin(t)[:, None]
    pq.write_table(pa.table({"vec_id": range(21), "embedding": pa.array(v.tolist(), pa.list_(pa.float64()))}), tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": [0], "text": ["a"]}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    columns = ["seed", "encoder_id", "pc1_variance", "pc1_abs_cosine"]
    plain = lambda t: sorted(zip(*[t[c].to_pylist() for c in columns], strict=True))
    got = plain(registry.QUERIES["ge5_principal_axis"](spark, str(tmp_path)).toArrow())
    want = plain(con.sql(registry.ORACLE["ge5_principal_axis"]).to_arrow_table())
    assert len(got) == len(want) == 9
    assert all(a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=2e-5) for a, b in zip(got, want, strict=True)), (got, want)
