"""Numbers of scenarios above 9,999 keep all their digits: no two scenarios share an id, in Spark and in SQL alike."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from axisgauge.plans import registry


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    ids = [2000, 2001, 20000, 20001, *range(84000, 84084), *range(840000, 840084)]  # references and runs of scenarios 1000 and 10000
    vectors = np.random.default_rng(1).normal(size=(len(ids), 64))
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")
    docs = [2000, 2001, 20000, 20001, 200000, 200001]
    pq.write_table(pa.table({"doc_id": docs, "text": ["x" * (d % 977) for d in docs]}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["an6_reference_pairs", "an6_reference_summary", "ge11_external_anchors", "rb4_source_scores"])
def test_same_rows_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, tables).toArrow(), con.sql(registry.ORACLE[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert len(got) and names == sorted(got.column_names)
    plain = lambda t: sorted(str([round(v, 5) + 0.0 if isinstance(v, float) else v for v in r]) for r in zip(*[t[k].to_pylist() for k in names], strict=True))
    assert plain(got) == plain(want)


def test_ids_are_distinct(spark, tables):
    pairs = registry.QUERIES["an6_reference_pairs"](spark, tables)
    assert sorted(r[0] for r in pairs.select("scenario_id").collect()) == ["s1000", "s10000", "s100000"]
    scenarios = registry.QUERIES["ge15_shared_scenarios"](spark, tables).select("scenario_id").distinct().collect()
    assert sorted(r[0] for r in scenarios) == ["s1000", "s10000"]
