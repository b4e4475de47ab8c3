"""A scenario that lacks a reference, or whose reference has no text, keeps its row, in Spark and in SQL alike."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from axisgauge.plans import registry


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lone")
    docs = {0: "x" * 300, 1: "x" * 300, 2: "x" * 300, 5: "x" * 300, 6: None, 7: "x" * 300}  # both, A alone, B alone, A without text
    pq.write_table(pa.table({"doc_id": list(docs), "text": list(docs.values())}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["an6_reference_pairs", "an6_reference_summary"])
def test_same_rows_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):  # the shared SQL names both
        con.sql(f"CREATE VIEW {t} AS " + (f"SELECT * FROM '{tables}/{t}.parquet'" if t == "documents" else "SELECT 0::BIGINT AS vec_id, [0.0]::FLOAT[] AS embedding"))
    got, want = registry.QUERIES[name](spark, tables).toArrow(), con.sql(registry.ORACLE[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert names == sorted(got.column_names)
    plain = lambda t: sorted(str(r) for r in zip(*[t[k].to_pylist() for k in names], strict=True))
    assert plain(got) == plain(want)
    if name == "an6_reference_pairs":
        lengths = dict(zip(got["scenario_id"].to_pylist(), zip(got["length_a"].to_pylist(), got["length_b"].to_pylist(), got["both_length_pass"].to_pylist(), strict=True), strict=True))
        assert lengths == {"s0000": (300, 300, True), "s0001": (300, None, False), "s0002": (None, 300, False), "s0003": (None, 300, False)}
