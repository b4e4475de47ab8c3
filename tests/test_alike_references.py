"""Outputs that are copies of a reference, references that are alike, and outputs without a vector: what the query leaves
null or in range, its SQL does too."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from axisgauge.plans import registry


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("alike")
    n = 84 * 30
    v = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    for s in range(10, 30):
        v[84 * s + 36], v[84 * s + 37] = v[2 * s], v[2 * s + 1]  # outputs that are the references
    v[7] = v[6]  # references of scenario 3
    v[84 * 4 + 6] = v[84 * 4]  # ends of a trajectory
    v[84 * 5 + 29] = v[84 * 5 + 30]  # outputs of a trajectory
    rows = v.tolist()
    rows[84 * 8 + 10] = None
    pq.write_table(pa.table({"vec_id": range(n), "embedding": pa.array(rows, pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")
    pq.write_table(pa.table({"doc_id": range(n), "text": ["x" * (d % 2500) for d in range(n)]}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["fa4_severities", "ge11_external_anchors", "ge15_shared_scenarios", "rb4_source_scores"])
def test_same_rows_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, tables).toArrow(), con.sql(registry.ORACLE[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert len(got) and names == sorted(got.column_names)
    plain = lambda t: sorted(str([round(v, 4) + 0.0 if isinstance(v, float) else v for v in r]) for r in zip(*[t[k].to_pylist() for k in names], strict=True))
    assert plain(got) == plain(want)
