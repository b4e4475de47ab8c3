"""Scenario pools: parsing candidates, validation, near-duplicate rejection in input order, caps, diverse selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_candidates(raw: Column) -> Column:
    """The JSON array inside free text as an array of variants; null if there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), F.lit(""))).try_cast("array<variant>")


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, in order; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def bigrams(text: Column) -> Column:
    """Distinct pairs of characters of the lower-cased text without white space; a shorter
    text stands for itself, an empty one has none."""
    t = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    return F.when(t == "", F.array().cast("array<string>")).when(F.char_length(t) <= 2, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))))


def near_pairs(rows: DataFrame, axis: str, order: str, grams: str, num: int = 9, den: int = 20) -> DataFrame:
    """axis, late, early: pairs inside an axis with Jaccard similarity num/den (0.45) or more, exact. Rows meet on the
    rarest ceil((1 - t) n) + 1 of their bigrams only, so common bigrams gather nothing."""
    held = rows.select(axis, F.col(order).alias("o"), F.col(grams).alias("g"), F.size(grams).alias("n")).where("n > 0")
    each = held.select(axis, "o", "n", F.explode("g").alias("x"))
    rare = each.groupBy(axis, "x").agg(F.count(F.lit(1)).alias("df"))
    nth = F.row_number().over(Window.partitionBy(axis, "o").orderBy("df", "x"))
    prefix = each.join(rare, [axis, "x"]).withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1).select(axis, "o", "n", "x")
    a, b = prefix.select(axis, "x", F.col("o").alias("late"), F.col("n").alias("nl")), prefix.select(axis, "x", F.col("o").alias("early"), F.col("n").alias("ne"))
    near = a.join(b, [axis, "x"]).where(F.expr(f"early < late and least(nl, ne) * {den} >= greatest(nl, ne) * {num}")).select(axis, "late", "early").distinct()
    full = near.join(held.select(axis, F.col("o").alias("late"), F.col("g").alias("gl")), [axis, "late"]).join(held.select(axis, F.col("o").alias("early"), F.col("g").alias("ge")), [axis, "early"])
    shared = F.size(F.array_intersect("gl", "ge"))
    return full.where(shared * den >= (F.size("gl") + F.size("ge") - shared) * num).select(axis, "late", "early")


#: Near pairs of a component that one task decides; larger components are decided in rounds.
TOGETHER = 1_000_000


def star_components(pairs: DataFrame, axis: str, checkpoint) -> DataFrame:
    """axis, o, root: the least row that each row with near pairs is linked to. Every round joins each row to its least neighbour,
    first the larger neighbours and then the smaller ones; the rounds grow with the logarithm of the longest chain."""
    edges = checkpoint(pairs.select(axis, F.col("late").alias("u"), F.col("early").alias("v")))
    before = None
    while True:
        both = edges.unionByName(edges.select(axis, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(axis, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = checkpoint(both.join(least, [axis, "u"]).where("v > u and v != m").select(axis, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy(axis, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [axis, "u"])
        edges = checkpoint(small.where("v != m").select(axis, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select(axis, "u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(axis, "u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(axis, F.col("u").alias("o"), F.col("v").alias("root")).unionByName(edges.select(axis, F.col("v").alias("o"), F.col("v").alias("root")).distinct())
        before = now


def greedy_accept(rows: DataFrame, pairs: DataFrame, axis: str, order: str, checkpoint=None, together: int | None = None) -> DataFrame:
    """axis, order, accepted: a row is rejected if an earlier accepted row of its axis is near. Rows that are linked by near pairs
    are decided by one task, in their order; components with more than `together` pairs in rounds, each of which accepts the
    undecided rows without an earlier undecided neighbour and rejects those near an accepted one. checkpoint cuts the lineage."""
    checkpoint = checkpoint or (lambda df: df.checkpoint())
    root = star_components(pairs, axis, checkpoint)
    known = checkpoint(pairs.join(root.select(axis, F.col("o").alias("late"), "root"), [axis, "late"]))
    sizes = known.groupBy(axis, "root").agg(F.count(F.lit(1)).alias("size"))
    large = checkpoint(sizes.where(F.col("size") > (together or TOGETHER)).select(axis, "root"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        accepted: dict = {}
        for late, early in zip(*(pdf.sort_values(["late", "early"])[c].tolist() for c in ("late", "early")), strict=True):
            accepted[late] = accepted.get(late, True) and not accepted.get(early, True)
        return pd.DataFrame({axis: pdf[axis].iloc[0], "o": list(accepted), "ok": list(accepted.values())})

    kind = T.StructType([rows.schema[axis], T.StructField("o", rows.schema[order].dataType), T.StructField("ok", T.BooleanType())])
    small = known.join(large, [axis, "root"], "left_anti").groupBy(axis, "root").applyInPandas(decide, kind)
    decided = small
    if not large.isEmpty():
        own = known.join(large, [axis, "root"], "left_semi").select(axis, "late", "early")
        members = own.select(axis, F.col("late").alias("o")).union(own.select(axis, F.col("early").alias("o"))).distinct()
        decided = small.unionByName(_in_rounds(members, own, axis, checkpoint))
    return rows.select(axis, order).join(decided.select(axis, F.col("o").alias(order), "ok"), [axis, order], "left").select(axis, order, F.coalesce("ok", F.lit(True)).alias("accepted"))


def _in_rounds(members: DataFrame, pairs: DataFrame, axis: str, checkpoint) -> DataFrame:
    state = checkpoint(members.select(axis, "o", F.lit(None).cast("boolean").alias("ok")))
    while True:  # each round decides a row at least: the earliest undecided one
        seen = pairs.join(state.select(axis, F.col("o").alias("early"), F.col("ok").alias("eo")), [axis, "early"]).groupBy(axis, F.col("late").alias("o")).agg(F.bool_or(F.coalesce("eo", F.lit(False))).alias("hit"), F.bool_or(F.col("eo").isNull()).alias("wait"))
        new = F.when(F.col("ok").isNotNull(), F.col("ok")).when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("wait", F.lit(False)), True)
        state = checkpoint(state.join(seen, [axis, "o"], "left").select(axis, "o", new.alias("ok")))
        if state.where("ok is null").isEmpty():
            return state


def cap_and_number(rows: DataFrame, axis: str, order: str, most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(axis).orderBy(order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).withColumn("scenario_id", F.concat_ws("_", axis, F.lpad(F.col("_n").cast("string"), 3, "0"))).drop("_n")


def diverse_pick(rows: DataFrame, axis: str, domain: str, order: str, most: int) -> DataFrame:
    """Round robin over an axis's domains, the larger ones first and then by name."""
    turn = F.row_number().over(Window.partitionBy(axis, domain).orderBy(order))
    size = rows.groupBy(axis, domain).agg(F.count(F.lit(1)).alias("_size"))
    ranked = rows.withColumn("_turn", turn).join(size, [axis, domain])
    place = F.row_number().over(Window.partitionBy(axis).orderBy("_turn", F.desc("_size"), domain))
    return ranked.withColumn("place", place).where(F.col("place") <= most).drop("_turn", "_size")


def top_reasons(rejected: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    counts = rejected.select(*by, F.explode("reasons").alias("reason")).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "reason")
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", "reason", F.col("n").cast("string")).alias("s")))), lambda x: x["s"]), "; ").alias("top_reasons"))


def number_candidates(raw: DataFrame, text: str, by: list[str]) -> DataFrame:
    """by, nth, candidate: the objects of the JSON array inside each free text, numbered from 1 in their order; values that
    are no objects are left out but keep their number."""
    each = raw.select(*by, F.posexplode(parse_candidates(F.col(text))).alias("nth", "candidate"))
    return each.where(F.schema_of_variant("candidate").startswith("OBJECT")).select(*by, (F.col("nth") + 1).alias("nth"), "candidate")


def review_reasons(row: dict[str, Column], domains: list[str], risk_words: list[str], note_words: list[str], exempt: str, low: int = 12, high: int = 80) -> Column:
    """Reasons against a reviewed scenario: missing fields, length in CJK characters, two to four checks, preferred domains,
    risk words in the content, and risk notes that name a risk without the exempting word. row: content, checks (an array),
    domain, risk_note, and further required fields; the word lists are the caller's."""
    content, note = F.coalesce(row["content"].cast("string"), F.lit("")), F.coalesce(row["risk_note"].cast("string"), F.lit(""))
    n = F.char_length(F.regexp_replace(content, "[^一-鿿]", ""))
    anywhere = lambda t, words: F.coalesce(F.array_max(F.array(*[t.contains(w) for w in words])), F.lit(False)) if words else F.lit(False)
    missing = [F.when(c.isNull() | (F.coalesce(c.cast("string"), F.lit("")) == ""), F.lit(f"missing:{k}")) for k, c in row.items()]
    rules = [
        (n < low, "content_too_short"), (n > high, "content_too_long"), (row["checks"].isNotNull() & ~F.size(row["checks"]).between(2, 4), "content_checks_count"), (row["checks"].isNull(), "content_checks_not_list"),
        (~F.coalesce(row["domain"].isin(domains), F.lit(False)), "domain_tag_unpreferred"), (anywhere(content, risk_words), "content_risk_word"), (anywhere(note, note_words) & ~note.contains(exempt), "risk_note_review"),
    ]
    return F.array_compact(F.array(*missing, *[F.when(bad, F.lit(name)) for bad, name in rules]))


def normalised_content(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def first_texts(rows: DataFrame, axis: str, order: str, content: str) -> DataFrame:
    """axis, text, order: each normalised content of an axis and its first row. Equal contents are gathered before anything is
    made of them."""
    return rows.select(axis, order, normalised_content(F.col(content)).alias("text")).groupBy(axis, "text").agg(F.min(order).alias(order))


def representatives(rows: DataFrame, axis: str, order: str, content: str) -> DataFrame:
    """axis, order, text, grams: the first of the rows with the same bigrams, which stands for all of them in near-duplicate
    search. Rows without bigrams represent nothing and are left out."""
    return first_grams(first_texts(rows, axis, order, content), axis, order)


def first_grams(texts: DataFrame, axis: str, order: str) -> DataFrame:
    g = texts.where("text != ''").select(axis, order, "text", F.array_sort(bigrams(F.col("text"))).alias("grams"))
    return g.groupBy(axis, "grams").agg(F.min(F.struct(order, "text")).alias("first")).select(axis, "first.*", "grams")


def curate(rows: DataFrame, axis: str, order: str, content: str, reasons: str, checkpoint=None) -> DataFrame:
    """rows with accepted, and their reasons sorted, with duplicate_content (the same content as an earlier accepted row of
    the axis) and near_duplicate_content (0.45 alike to one). Only rows without other reasons compete. Rows with equal
    bigrams are decided by their first: if that is accepted the others are near it, and if not, neither are they. All rows
    are read twice and met once, by their contents, with what was accepted; the rest works on distinct contents."""
    checkpoint = checkpoint or (lambda df: df.checkpoint())
    texts = checkpoint(first_texts(rows.where(F.size(reasons) == 0), axis, order, content))
    one = checkpoint(first_grams(texts, axis, order))
    decided = greedy_accept(one, checkpoint(near_pairs(one, axis, order, "grams")), axis, order, checkpoint)
    taken = one.join(decided.where("accepted"), [axis, order], "left_semi").select(axis, "text", order).unionByName(texts.where("text = ''"))
    seen = checkpoint(taken.select(axis, F.col("text").alias("_norm"), F.col(order).alias("_first")))
    j = rows.withColumn("_norm", normalised_content(F.col(content))).join(seen, [axis, "_norm"], "left")
    mine = (F.size(reasons) == 0) & F.coalesce(F.col("_first") == F.col(order), F.lit(False))
    twin = F.coalesce(F.col("_first") < F.col(order), F.lit(False))
    more = F.array_compact(F.array(F.when(twin, "duplicate_content"), F.when((F.size(reasons) == 0) & ~twin & ~F.col("accepted"), "near_duplicate_content")))
    return j.withColumn("accepted", mine).withColumn(reasons, F.array_sort(F.array_distinct(F.concat(reasons, more)))).drop("_norm", "_first")


def pool_summary(candidates: DataFrame, filtered: DataFrame, final: DataFrame, rejected: DataFrame, axis: str, domain: str, k: int = 5) -> DataFrame:
    """By axis: rows at each step, domains of the final ones, rejected rows and their k most frequent reasons."""
    n = lambda df, name: df.groupBy(axis).agg(F.count(F.lit(1)).alias(name))
    out = n(candidates, "candidates")
    for part in (n(filtered, "filtered"), n(final, "final"), final.groupBy(axis).agg(F.countDistinct(domain).alias("domains")), n(rejected, "rejected")):
        out = out.join(part, axis, "full_outer")
    counts = [c for c in out.columns if c != axis]
    return out.select(axis, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]).join(top_reasons(rejected, [axis], k), axis, "left")
