"""Mixing sources to target weights by temperature.

Each source's share of tokens is raised to an exponent in [0, 1] and normalised. The exponent is the largest that
reaches a target entropy (a fraction of the greatest possible), found by bisection; if a source would then be repeated
more often than the limit allows, a second bisection raises the exponent until none is. The token budget is the least
that uses every document at least once, so no clean document is lost. A source's budget is realised as passes over its
blocks: blocks are fixed hash classes of documents, each pass takes them in an order of its own, and the last pass
stops with the block that fills the budget. Only sums by source reach the driver's bisection, and sums by block the
windows; documents are joined to their block's passes, never gathered.

Tokens are white-space words. Defined results: null or empty texts have no tokens and go with their block; a null
source is a source of its own; sources without tokens get one pass; repeated rows count each; an empty table gives no
rows; other columns pass through, those named `pass`, `position` or `weight` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from axisgauge.llm.common import SPACE, small, written

ENTROPY, REPEATS, BLOCKS, SEED, STEPS = 0.95, 2.0, 256, 11, 60


def n_words(text: F.Column) -> F.Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def weights_at(tokens: list[int], exponent: float, times: list[int] | None = None) -> list[float]:
    """The weight of one source with each of these token counts, of which there are `times`."""
    times = times or [1] * len(tokens)
    total = sum(t * k for t, k in zip(tokens, times, strict=True))
    raised = [(t / total) ** exponent if t else 0.0 for t in tokens]
    every = sum(r * k for r, k in zip(raised, times, strict=True))
    return [r / every for r in raised]


def entropy(weights: list[float], times: list[int] | None = None) -> float:
    """As a fraction of the greatest possible over the sources with tokens."""
    real = [(w, k) for w, k in zip(weights, times or [1] * len(weights), strict=True) if w > 0]
    n = sum(k for _, k in real)
    return -sum(k * w * math.log(w) for w, k in real) / math.log(n) if n > 1 else 1.0


def repeats(tokens: list[int], weights: list[float]) -> float:
    """Passes over the most repeated source if the least repeated one is used once."""
    ratio = [w / t for w, t in zip(weights, tokens, strict=True) if t]
    return max(ratio) / min(ratio)


def bisected(good, low: float = 0.0, high: float = 1.0, steps: int = STEPS) -> float:
    """The end of [low, high] nearest to where `good`, true at low and not at high, changes; high if it's true there."""
    if good(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def exponent_for(tokens: list[int], target_entropy: float = ENTROPY, most_repeats: float = REPEATS, times: list[int] | None = None) -> float:
    """The largest exponent with the target entropy, or, if that repeats a source too often, the least that doesn't."""
    times = times or [1] * len(tokens)
    if sum(k for t, k in zip(tokens, times, strict=True) if t) < 2:
        return 1.0
    flat = bisected(lambda x: entropy(weights_at(tokens, x, times), times) >= target_entropy)
    if repeats(tokens, weights_at(tokens, flat, times)) <= most_repeats:
        return flat
    return 1.0 - bisected(lambda x: repeats(tokens, weights_at(tokens, 1.0 - x, times)) <= most_repeats, 0.0, 1.0 - flat)


def passes(docs: DataFrame, target_entropy: float = ENTROPY, most_repeats: float = REPEATS, blocks: int = BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, F.Column]:
    """(source, block, pass, position, weight), position the block's place in its source's order; and the block of a document."""
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(blocks)).cast("int")
    sums = written(docs.select(F.col(source_col).alias("source"), block.alias("block"), n_words(F.col(text_col)).alias("n")).groupBy("source", "block").agg(F.sum("n").alias("n")), "blocks")
    by_source = written(sums.groupBy("source").agg(F.sum("n").alias("total")), "sources")
    # weights depend on a source's tokens alone: the driver gets how many sources have each number of tokens. T tokens in all
    # have at most sqrt(2 T) such numbers
    counts = by_source.groupBy("total").agg(F.count(F.lit(1)).alias("k")).orderBy("total").collect()
    tokens, times = [r["total"] for r in counts], [r["k"] for r in counts]
    weight, budget = F.lit(0.0), 0.0
    if sum(tokens):
        exponent = exponent_for(tokens, target_entropy, most_repeats, times)
        weights = weights_at(tokens, exponent, times)
        budget = max(t / w for t, w in zip(tokens, weights, strict=True) if t)
        at = max(range(len(tokens)), key=tokens.__getitem__)
        # each source's weight from that of the largest
        weight = F.when(F.col("total") > 0, F.lit(weights[at]) * F.pow(F.col("total") / float(tokens[at]), F.lit(exponent))).otherwise(0.0)
    plan = by_source.select(F.col("source").alias("own"), "total", weight.alias("weight"), F.greatest(F.col("total").cast("double"), weight * budget).alias("tokens"))
    each = sums.join(small(plan), F.col("source").eqNullSafe(F.col("own"))).select("source", "block", "n", "weight", "tokens", "total")
    last = F.greatest(F.ceil(F.col("tokens") / F.greatest("total", F.lit(1)) - 1e-9), F.lit(1)).cast("int")
    runs = each.select("source", "block", "n", "weight", "tokens", F.explode(F.sequence(F.lit(1), last)).alias("pass"))
    order = Window.partitionBy("source", "pass").orderBy(F.xxhash64(F.lit(seed), F.col("pass"), F.col("block")), "block")  # at most `blocks` rows
    runs = runs.select(
        "source", "block", "pass", "weight", F.row_number().over(order).alias("position"),
        (F.col("tokens") - (F.col("pass") - 1) * F.sum("n").over(Window.partitionBy("source", "pass"))).alias("left"),
        (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    return written(runs.where("pass = 1 or before < left").select("source", "block", "pass", "position", "weight"), "passes"), block


def mix(docs: DataFrame, target_entropy: float = ENTROPY, most_repeats: float = REPEATS, blocks: int = BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, once for each pass that uses them, with pass, position and weight."""
    docs = docs.drop("pass", "position", "weight")
    plan, block = passes(docs, target_entropy, most_repeats, blocks, seed, id_col, text_col, source_col)
    right = small(plan.withColumnRenamed("source", "_llm_source").withColumnRenamed("block", "_llm_block"))
    return docs.join(right, F.col(source_col).eqNullSafe(F.col("_llm_source")) & (block == F.col("_llm_block"))).drop("_llm_source", "_llm_block")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "pass", "position", F.round("weight", 6).alias("weight"), n_words(F.col("text")).alias("n_tokens"))
