"""Judges, audits, text quality, pools and readers on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from axisgauge.operators import audit, judges, pool, reports, serving, textq
from axisgauge.sources import tables


def test_cost(spark):
    usage = spark.createDataFrame([("s", "m", 1_000_000, 250_000, 100_000)], "stage string, model_id string, input_tokens long, cached_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 0.2, 10.0)], "model_id string, input_price double, cached_price double, output_price double")
    assert audit.cost(usage, prices, ["stage"]).first()["cost"] == pytest.approx(2.55)


def test_strict_judgment_types(spark):
    good = {"covered": [True, False], "added_key_information": False, "factual_contradiction": False, "task_result_changed": False, "unjudgeable": False, "style_B_intensity": 40, "naturalness": 4}
    cases = [good, good | {"style_B_intensity": True}, good | {"covered": [True]}, good | {"naturalness": 9}, {k: v for k, v in good.items() if k != "unjudgeable"}]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(5, "no json")], "i int, raw string")
    got = {r["i"]: r["j"] for r in rows.select("i", judges.normalise_content(F.col("raw"), F.lit(2)).alias("j")).collect()}
    assert got[0]["error"] is None and got[0]["coverage"] == 0.5 and got[0]["passed"] is False
    assert [got[i]["error"] for i in range(1, 6)] == ["numbers", "covered", "range", "fields", "no object"]


def test_loose_judgments(spark):
    raw = ['{"style_b_ratio": 0.4, "content_preservation": 5}', 'Sure: {"style_b_ratio": 0.25} ok', "style_b_ratio: 0.7", "nothing"]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(judges.parse_scalar(F.col("raw")).alias("j")).collect()
    assert [r["j"]["style_b_ratio"] for r in rows] == [0.4, 0.25, 0.7, None]


def test_cache_keys_differ_for_equal_texts(spark):
    rows = spark.createDataFrame([("a", "t"), ("b", "t")], "item string, text string")
    assert rows.select(audit.cache_key(F.col("item"), F.lit("m"), F.lit("p"), F.lit("s"), F.col("text"))).distinct().count() == 2


def test_output_audit_counts_blanks_markers_and_signatures(spark):
    rows = spark.createDataFrame([("m", "a </Think> b", 1, 0.7), ("m", " ", 1, 0.7), ("m", None, 2, None), ("m", "步骤说明", 2, 0.7), ("n", "plain", 1, None)], "model string, text string, seed int, temperature double")
    got = {r["model"]: tuple(r)[1:] for r in audit.output_audit(rows, ["model"], "text", ["seed", "temperature"]).collect()}
    assert got == {"m": (4, 2, 2, 3), "n": (1, 0, 0, 1)}


def test_reused_rows_must_have_their_plans_prompt(spark):
    planned = spark.createDataFrame([(1, "p"), (2, "p")], "k int, prompt string")
    existing, reused = planned.where("k = 1").withColumn("origin", F.lit("new")), planned.withColumn("origin", F.lit("reused"))
    got = audit.reuse_first(existing, reused, planned, ["k"], ("prompt",)).select("k", "origin").collect()
    assert sorted(map(tuple, got)) == [(1, "new"), (2, "reused")]
    with pytest.raises(ValueError, match="prompt"):
        audit.reuse_first(existing, reused.withColumn("prompt", F.lit("q")), planned, ["k"], ("prompt",))


def test_corpus_checks(spark):
    planned = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, c string")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (9, "z")], "k int, c string")
    got = {(r["problem"], r["place"]): r["n"] for r in audit.corpus_checks(rows, planned, ["k"], "c").collect()}
    assert got == {("unexpected", None): 1, ("duplicate", None): 1, ("count", "b"): 0, ("count", "z"): 1}
    assert audit.corpus_checks(planned, planned, ["k"], "c").count() == 0


def test_prior_judgments_are_reused_only_under_the_same_evaluator_and_prompt(spark):
    index = spark.createDataFrame([("x", 1, "p", "kx"), ("y", 1, "p", "ky"), ("z", 2, "p", "kz")], "evaluation_item_id string, source_run_id int, prompt_sha256 string, cache_key string")
    prior = spark.createDataFrame([(1, "e", "p", 40)], "source_run_id int, evaluator_id string, prompt_sha256 string, intensity int")
    existing = spark.createDataFrame([("x", "kx", 7)], "evaluation_item_id string, cache_key string, intensity int")
    got = audit.reuse_judgments(index, prior, existing, "e").select("evaluation_item_id", "intensity", "reuse_status").collect()
    assert sorted(map(tuple, got)) == [("x", 7, "existing"), ("y", 40, "reused")]
    for wrong, what in ((prior.withColumn("evaluator_id", F.lit("f")), "evaluator"), (prior.withColumn("prompt_sha256", F.lit(None).cast("string")), "prompt")):
        with pytest.raises(ValueError, match=what):
            audit.reuse_judgments(index, wrong, existing, "e")


def test_cost_total_adds_the_allowance(spark):
    stages = spark.createDataFrame([("main", 10, 4, 100, 10, 5, 2.0), ("pilot", 2, 0, 10, 0, 1, 0.5)], "stage string, records long, successful long, input_tokens long, cached_tokens long, output_tokens long, cost double")
    row = audit.cost_total(stages, "stage", "main", 3, 0.1, 4.0).first()
    assert (row["cost"], row["allowance"], row["cap_exceeded"]) == (2.5, 1.5, True)
    assert row["conservative_cost"] == pytest.approx(4.1) and row["headroom"] == 1.5
    assert audit.cost_total(stages, "stage", "pilot", 3, 0.1, 4.0).first()["allowance"] == 0.0  # no success to average


def test_item_ids_must_be_unique(spark):
    main = spark.createDataFrame([(1, "t"), (1, "t")], "source_id int, text string")
    index = reports.evaluation_index({"main": main}, F.col("source_id"))
    with pytest.raises(ValueError, match="unique"):
        reports.index_counts(index, {"main": main})


def test_checked_join_refuses_duplicates(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="right"):
        audit.checked_join(a, b, ["k"], "1:1")
    assert audit.checked_join(a, b, ["k"], "1:m").count() == 2


def test_pareto_of_published_rows(spark):
    rows = spark.createDataFrame([("a", 0.1561, 3.106), ("b", 0.1728, 3.673), ("c", 0.1826, 3.464), ("d", 0.1892, 5.346), ("e", 0.2018, 3.2)], "m string, x double, y double")
    assert [r["m"] for r in serving.pareto(rows, "x", "y").collect()] == ["a"]


def test_longest_repeated_block(spark):
    rows = spark.createDataFrame([("abcabc",), ("a b a b x",), ("abc",), (None,)], "t string")
    assert [r[0] for r in rows.select(textq.longest_repeated_block("t")).collect()] == [6, 4, 0, 0]


def test_cjk_and_tokens(spark):
    r = spark.createDataFrame([("你好 a-b.c World",)], "t string").select(textq.cjk_count(F.col("t")), textq.tokens(F.col("t"))).first()
    assert r[0] == 2 and r[1] == ["你", "好", "a-b.c", "world"]


def test_reasoning_is_stripped(spark):
    r = spark.createDataFrame([("<think>x</think> a ",), ("x</think>b",), ("c<think>y",)], "t string").select(textq.strip_reasoning(F.col("t"), True)).collect()
    assert [x[0] for x in r] == ["a", "b", "c"]


def test_greedy_rejection_follows_accepted_rows_only(spark):
    # 2 is near 1, 3 is near 2 only: 2 is rejected, so 3 stays
    rows = spark.createDataFrame([("x", i) for i in (1, 2, 3)], "axis string, o int")
    pairs = spark.createDataFrame([("x", 2, 1), ("x", 3, 2)], "axis string, late int, early int")
    got = {r["o"]: r["accepted"] for r in pool.greedy_accept(rows, pairs, "axis", "o").collect()}
    assert got == {1: True, 2: False, 3: True}


def test_jsonl_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nnot json\n[1]\n')
    rows, bad, blank = tables.read_jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), "a int")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2]
    assert sorted((r["line"], r["error"]) for r in bad.collect()) == [(4, "not JSON"), (5, "not an object")]
    with pytest.raises(Exception, match="malformed"):
        tables.read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    assert tables.read_jsonl_strict(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
