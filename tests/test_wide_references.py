"""References of scenario 10000 are not those of scenario 1000: failure severities and shared-reference metrics equal their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from axisgauge.plans import registry


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    ids = [2000, 2001, 20000, 20001, *range(84000, 84084)]  # references of scenarios 1000 and 10000, runs of scenario 1000
    vectors = np.random.default_rng(1).normal(size=(len(ids), 64))
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")
    pq.write_table(pa.table({"doc_id": ids, "text": ["x" * (d % 977) for d in ids]}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["fa4_severities", "ge15_shared_scenarios"])
def test_same_rows_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, tables).toArrow(), con.sql(registry.ORACLE[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert len(got) and names == sorted(got.column_names)
    plain = lambda t: sorted(str([round(v, 4) + 0.0 if isinstance(v, float) else v for v in r]) for r in zip(*[t[k].to_pylist() for k in names], strict=True))
    assert plain(got) == plain(want)
