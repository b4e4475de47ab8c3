"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from axisgauge.plans import registry

DIR = "/root/testdata/sf0.001"
SOME = ["ge4_interior_error_by_model", "bl4_scenario_folds", "bl7_isotonic_cv", "ju18_content_confusion", "ju6_swap_consistency", "st21_krippendorff", "tx23_text_quality", "tx12_near_pairs", "id4_missing_runs", "id13_coverage", "ef4_pareto", "an3_rank_sensitivity", "rb3_condition_rankings", "tx4_lenient_judgments", "hu1_formal_ratings", "ju23_condition_differences", "ge1_legacy_projection"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    got, want = registry.QUERIES[name](spark, DIR).toArrow(), con.sql(registry.ORACLE[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    plain = lambda t: sorted(str([round(v, 5) + 0.0 if isinstance(v, float) else v for v in r]) for r in zip(*[t[k].to_pylist() for k in names], strict=True))
    assert plain(got) == plain(want)
