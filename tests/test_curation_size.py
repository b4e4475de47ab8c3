"""Near-duplicate search and curation work on distinct contents; all rows are met once with what was accepted."""

from pyspark.sql import functions as F

from axisgauge.operators import pool


def copies(spark, times=200):
    return spark.range(3 * times).select(
        F.lit("x").alias("axis"), F.col("id").alias("o"), F.element_at(F.array(F.lit("large ring"), F.lit("Large  RING"), F.lit("cold plate")), (F.col("id") % 3 + 1).cast("int")).alias("content"), F.array().cast("array<string>").alias("reasons")
    )


def test_equal_bigrams_have_one_representative(spark):
    got = pool.representatives(copies(spark), "axis", "o", "content").collect()
    assert sorted((r["o"], r["text"]) for r in got) == [(0, "largering"), (2, "coldplate")]


def test_all_rows_are_joined_once(spark):
    done = pool.curate(copies(spark), "axis", "o", "content", "reasons")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    got = done.groupBy("accepted", F.concat_ws("|", "reasons").alias("why")).count().collect()
    assert {(r["accepted"], r["why"], r["count"]) for r in got} == {(True, "", 2), (False, "duplicate_content", 598)}
