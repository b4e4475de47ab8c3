"""Run matrices, coverage, consolidation gates, table profiles, checked joins, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.numeric import stable_id
from axisgauge.functions.quantiles import aggregated

#: Fixed value: what only a reasoning trace or a template leaves in an output.
HARD_MARKER = r"(?i)<think>|</think>|Thinking Process|步骤说明"


def run_matrix(scenarios: DataFrame, *dimensions: DataFrame, prefix: str = "run") -> DataFrame:
    """Every scenario under every combination of the dimensions (small tables), with ids from their values."""
    rows, keys = scenarios, ["scenario_id"]
    for d in dimensions:
        rows = rows.crossJoin(F.broadcast(d))  # declared dimensions: models, ratios, seeds
        keys += d.columns
    return rows.withColumn("planned_id", stable_id(prefix, *[F.col(k) for k in keys]))


def missing(planned: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(actual.select(*keys), keys, "left_anti")


def incomplete_groups(planned: DataFrame, actual: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    n = planned.groupBy(*group).agg(F.count(F.lit(1)).alias("planned")).join(actual.select(*keys).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("actual")), group, "left")
    return n.withColumn("actual", F.coalesce("actual", F.lit(0))).where("actual < planned")


def output_audit(rows: DataFrame, by: list[str], text: str, parameters: list[str]) -> DataFrame:
    """Records, blank outputs, outputs with a hard marker, and distinct signatures of the generation parameters."""
    blank = F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0
    marked = F.coalesce(F.col(text).rlike(HARD_MARKER), F.lit(False))
    signature = F.to_json(F.struct(*parameters), {"ignoreNullFields": "false"})
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.count_if(blank).alias("empty_outputs"), F.count_if(marked).alias("hard_markers"), F.count_distinct(signature).alias("signatures"))


def status(planned: DataFrame, ok: DataFrame, failures: DataFrame, keys: list[str], order: str) -> DataFrame:
    """ok, the latest failure's reason, or missing_unattempted."""
    last = failures.groupBy(*keys).agg(F.max_by("reason", order).alias("_reason"))
    good = ok.select(*keys).distinct().withColumn("_ok", F.lit("ok"))
    return planned.join(good, keys, "left").join(last, keys, "left").withColumn("status", F.coalesce("_ok", "_reason", F.lit("missing_unattempted"))).drop("_ok", "_reason")


def problems(rows: DataFrame, key: list[str], required: list[str], text: str, expected: int) -> DataFrame:
    """problem, n: surplus duplicates, rows without required fields, empty texts, and a wrong row count."""
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull()
    one = rows.agg(F.count_if(lacking).alias("missing_fields"), F.count_if(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0).alias("empty_text"), F.abs(F.count(F.lit(1)) - expected).alias("row_count"))
    twice = rows.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    return one.crossJoin(twice).unpivot([], ["missing_fields", "empty_text", "row_count", "duplicates"], "problem", "n").where("n > 0")


def profile(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: records, distinct keys, surplus duplicates, and the nulls of each field as a map."""
    pairs = [x for c in sorted(rows.columns) for x in (F.lit(c), F.count_if(F.col(c).isNull()))]
    one = rows.agg(F.count(F.lit(1)).alias("records"), F.create_map(*pairs).alias("nulls"))
    keys = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))
    return one.crossJoin(keys)


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    long = rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "field", "value")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def split_valid(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """reason: missing_id, empty_text, duplicate, or null for the first valid row of each id."""
    usable = F.col(key).isNotNull() & (F.coalesce(F.length(F.trim(text)), F.lit(0)) > 0)
    nth = F.row_number().over(Window.partitionBy(key, usable).orderBy(order))
    return rows.withColumn("_n", nth).withColumn("reason", F.when(F.col(key).isNull(), "missing_id").when(~usable, "empty_text").when(F.col("_n") > 1, "duplicate")).drop("_n")


def coverage(index: DataFrame, ok: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """key and state: covered, missing (not covered), orphan (not in the index)."""
    covered = ok.select(key).union(failed.select(key)).distinct()
    lost = index.select(key).distinct().join(covered, key, "left_anti").withColumn("state", F.lit("missing"))
    orphan = covered.join(index.select(key), key, "left_anti").withColumn("state", F.lit("orphan"))
    return covered.join(index.select(key), key, "left_semi").withColumn("state", F.lit("covered")).unionByName(lost).unionByName(orphan)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], validate: str, how: str = "inner") -> DataFrame:
    """A join that fails on duplicate keys on a side that must have none: validate '1:1', 'm:1' or '1:m'."""
    for side, df, name in ((validate[0], left, "left"), (validate[-1], right, "right")):
        if side == "1" and not df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"the {name} side has duplicate keys {on}")
    return left.join(right, on, how)


def cost(usage: DataFrame, prices: DataFrame, by: list[str], status: str | None = None) -> DataFrame:
    """Tokens and price by stage: cached tokens count up to the input, a missing cached price is the input price. With a
    column of statuses also records and successes; a record without a status is a success."""
    priced = usage.join(F.broadcast(prices), "model_id", "left")  # a row for each model
    cached = F.least(F.coalesce("cached_tokens", F.lit(0)), F.col("input_tokens"))
    amount = ((F.col("input_tokens") - cached) * F.col("input_price") + cached * F.coalesce("cached_price", "input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    good = [F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce(F.col(status).isin("ok", "truncated"), F.lit(True))).alias("successful")] if status else []
    return priced.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum(cached).alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(amount).alias("cost"), *good)


def cost_total(stages: DataFrame, stage: str, restarted: str, in_flight: int, extra: float, cap: float) -> DataFrame:
    """One row: the stages' total; a conservative total, which adds the average success of the stage that was restarted for
    each of the requests in flight then, and what was not recorded; what both leave of the cap, and whether it is exceeded."""
    average = F.coalesce(F.max(F.when(F.col(stage) == restarted, F.try_divide("cost", "successful"))), F.lit(0.0))
    sums = [F.sum(c).alias(c) for c in ("records", "successful", "input_tokens", "cached_tokens", "output_tokens")]
    one = stages.agg(*sums, F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), (average * in_flight).alias("allowance"))
    one = one.withColumn("conservative_cost", F.col("cost") + F.col("allowance") + extra)
    return one.withColumn("headroom", cap - F.col("cost")).withColumn("conservative_headroom", cap - F.col("conservative_cost")).withColumn("cap_exceeded", F.col("conservative_cost") > cap)


def service_table(rows: DataFrame, by: list[str]) -> DataFrame:
    return aggregated(rows, by, [F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"), F.array_join(F.sort_array(F.collect_set("model_id")), "|").alias("models")], {"p50": ("latency", 0.5), "p95": ("latency", 0.95)})


def within_tolerance(measured: DataFrame, expected: DataFrame, on: list[str], tolerance: float | Column = 0.002) -> DataFrame:
    return measured.join(F.broadcast(expected), on).withColumn("ok", F.abs(F.col("value") - F.col("expected")) <= tolerance)  # an expectation table


def reuse_first(existing: DataFrame, reused: DataFrame, planned: DataFrame, key: list[str], same: tuple[str, ...] = ()) -> DataFrame:
    """For each planned key the existing row, else the reused one. A reused row that differs from its plan in a column of
    `same` (its prompt) is an error."""
    if same:
        other = reused.join(planned.select(*key, *[F.col(c).alias(f"_{c}") for c in same]), key)
        for c in same:
            if not other.where(~F.col(c).eqNullSafe(F.col(f"_{c}"))).isEmpty():
                raise ValueError(f"reused rows differ from their plan in {c}")
    both = existing.withColumn("_p", F.lit(0)).unionByName(reused.withColumn("_p", F.lit(1))).join(planned.select(*key), key, "left_semi")
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_p"))).where("_n = 1").drop("_n", "_p")


def corpus_checks(rows: DataFrame, planned: DataFrame, key: list[str], by: str) -> DataFrame:
    """problem, place, n: keys that are not planned, surplus rows of a key, and groups whose count is not the planned one."""
    none = F.lit(None).cast("string").alias("place")
    unexpected = rows.join(planned.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unexpected").alias("problem"), none, "n")
    twice = rows.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("problem"), none, "n")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(planned.groupBy(by).agg(F.count(F.lit(1)).alias("_planned")), by, "full")
    off = counts.where(~F.col("n").eqNullSafe(F.col("_planned"))).select(F.lit("count").alias("problem"), F.col(by).cast("string").alias("place"), F.coalesce("n", F.lit(0)).alias("n"))
    return unexpected.unionByName(twice).where("n > 0").unionByName(off)


def reuse_judgments(index: DataFrame, prior: DataFrame, existing: DataFrame, evaluator: str) -> DataFrame:
    """existing, and for items of the index that it lacks the prior judgment of their source run (one row each in prior).

    index: evaluation_item_id, source_run_id, prompt_sha256, cache_key; prior: source_run_id, evaluator_id, prompt_sha256 and
    the judgment. A prior judgment of an indexed source by another evaluator or prompt is an error."""
    met = index.join(prior.withColumnRenamed("prompt_sha256", "_prompt"), "source_run_id")
    for name, wrong in (("evaluator", ~F.col("evaluator_id").eqNullSafe(F.lit(evaluator))), ("prompt", ~F.col("_prompt").eqNullSafe(F.col("prompt_sha256")))):
        if not met.where(wrong).isEmpty():
            raise ValueError(f"prior judgments differ in {name}")
    new = met.drop("_prompt").join(existing.select("evaluation_item_id"), "evaluation_item_id", "left_anti")
    return existing.withColumn("reuse_status", F.lit("existing")).unionByName(new.withColumn("reuse_status", F.lit("reused")), allowMissingColumns=True)


def cache_key(item: Column, model: Column, prompt: Column, schema: Column, text: Column) -> Column:
    """Items with the same text keep keys of their own."""
    return F.sha2(F.concat_ws("::", item, model, prompt, schema, F.sha2(text, 256)), 256)
