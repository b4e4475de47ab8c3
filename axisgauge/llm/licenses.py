"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A header is a line of a file; a licence file is a file whose whole text is close to a header line or to a licence's
full text (`licence_texts/`, one file each). All are vectors of
term frequency times inverse document frequency (over all files, ln((1 + files) / (1 + files with the term)) + 1; a
term in no template counts in the length as one that no file has). A cosine of `HEADER` or more gives a file the best
line's licence; a whole text with `WHOLE` or more to a header line, or `FULL` or more to a full text, makes it its
directory's licence as well; a full text's licence comes before that of single lines. Files without a licence of
their own take that of the nearest directory above them that has one, found by joining paths.

Only lines that can reach the threshold are scored: by the Cauchy-Schwarz inequality a line whose terms all belong to a
set S of common terms has at most |S part of a template| / |template| with it, so lines need a term outside S, the
largest run of the most common terms for which that bound stays below the threshold.

Defined results: null or empty texts have no header; ties go to the first template by name; a null path inherits
nothing; repeated rows are one file each; a directory with several licence files takes the best score, then the first
name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from axisgauge.llm.common import small, written

#: FULL is higher than WHOLE, since long texts of one language share their most common words.
HEADER, WHOLE, FULL = 0.75, 0.5, 0.85
#: Header lines of widely used licences (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
}
TOKEN = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TOKEN), "")


def vectors(rows: DataFrame, keys: list[str], idf: DataFrame, rare: float) -> tuple[DataFrame, DataFrame]:
    """Weights of the vocabulary's terms (keys, term, w), and squared lengths over all terms (keys, length2)."""
    counted = rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare)))  # idf: terms of the templates only
    return weighed.where("idf is not null").select(*keys, "term", "w"), weighed.groupBy(*keys).agg(F.sum(F.col("w") * F.col("w")).alias("length2"))


def best_matches(rows: DataFrame, keys: list[str], idf: DataFrame, templates: DataFrame, rare: float, least: float) -> DataFrame:
    """keys, licence, score: the best template of each row with terms, where its cosine is `least` or more."""
    weights, lengths = vectors(rows, keys, idf, rare)
    scored = (
        weights.join(F.broadcast(templates), "term").groupBy(*keys, "licence", "template", "norm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
        .join(lengths, keys).withColumn("score", F.round(F.col("dot") / F.col("norm") / F.sqrt("length2"), 6)).where(F.col("score") >= least)
    )
    best = F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best")
    return scored.groupBy(*keys).agg(best).select(*keys, "best.licence", (-F.col("best.minus")).alias("score"))


def full_texts() -> dict[str, list[str]]:
    """Licence texts by name. AGPL-3.0 is GPL-3.0 under its own name with its own section 13: an approximation, close
    enough to tell the two apart."""
    found = {p.stem: [p.read_text(encoding="utf-8")] for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    gpl = re.sub(r"(?i)(GNU)\s+(General\s+Public\s+License)", r"\1 Affero \2", found["GPL-3.0"][0])
    remote = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of
    this License, if you modify the Program, your modified version must prominently offer all users interacting with it
    remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing
    access to the Corresponding Source from a network server at no charge.\n"""
    return found | {"AGPL-3.0": [re.sub(r"(?s)13\. Use with the GNU Affero.*?(?=14\. Revised)", lambda _: remote, gpl)]}


def template_terms(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """licence, template, term, tf."""
    known = spark.createDataFrame([(k, i, t) for k, v in texts.items() for i, t in enumerate(v)], "licence string, template int, text string")
    return known.select("licence", "template", F.explode(terms(F.col("text"))).alias("term")).groupBy("licence", "template", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many files each term is: each file's distinct terms meet the vocabulary in one pass; what is shuffled and
    returned has a row for each term of the vocabulary at most."""
    known = files.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    each = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(F.broadcast(known), "term")  # the templates' terms
    return {r["term"]: r["df"] for r in each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}


def modelled(own: DataFrame, n: int, df: dict[str, int], least: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Of templates' terms: each term's idf, the weights with norms, and the terms of which a row with a cosine of `least` needs one."""
    spark = own.sparkSession
    vocabulary = sorted(r["term"] for r in own.select("term").distinct().collect())
    idf = spark.createDataFrame([(t, df.get(t, 0)) for t in vocabulary], "term string, df long").select("term", (F.log((n + F.lit(1.0)) / (1 + F.col("df"))) + 1).alias("idf"))
    templates = own.join(F.broadcast(idf), "term").select("licence", "template", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    norms = templates.groupBy("licence", "template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("norm"))
    templates = written(templates.join(norms, ["licence", "template"]), "templates")
    # the common terms that cannot reach the threshold by themselves: a running sum for each template
    having: dict[str, list[tuple]] = {}
    for r in templates.collect():  # as many as the templates have terms
        having.setdefault(r["term"], []).append(((r["licence"], r["template"]), (r["tw"] / r["norm"]) ** 2))
    reached: dict[tuple, float] = {}
    order = sorted(vocabulary, key=lambda t: -df.get(t, 0))
    common = 0
    for term in order:
        after = {t: reached.get(t, 0.0) + v for t, v in having[term]}
        if max(after.values()) >= (least * 0.999) ** 2:
            break
        reached |= after
        common += 1
    return idf, templates, order[common:]


def literal(found: list[str]) -> Column:
    """The terms, which have no spaces, as a constant array."""
    return F.split(F.lit(" ".join(found)), " ") if found else F.array().cast("array<string>")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", header: float = HEADER, whole: float = WHOLE, full: float = FULL) -> DataFrame:
    """doc_id, path, licence, found ('header', 'file', 'inherited' or 'none'), score, from_dir."""
    spark = files.sparkSession
    files = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    n = files.count()
    rare = float(spark.range(1).select(F.log(F.lit(n + 1.0)) + 1).first()[0])
    by_header, by_text = (written(template_terms(spark, t), "terms") for t in (TEMPLATES, full_texts()))
    df = document_frequencies(files, sorted({r["term"] for r in by_header.unionByName(by_text).select("term").distinct().collect()}))
    idf, templates, needed = modelled(by_header, n, df, min(header, whole))
    full_idf, full_templates, full_needed = modelled(by_text, n, df, full)
    anchors, full_anchors = literal(needed), literal(full_needed)
    anchored = F.coalesce(F.arrays_overlap(F.split(F.lower("text"), TOKEN), literal(sorted({*needed, *full_needed}))), F.lit(False))
    held = files.withColumn("anchored", anchored).select("doc_id", "path", "anchored", F.when(F.col("anchored"), F.col("text")).alias("text"), F.monotonically_increasing_id().alias("file"))
    held = written(held, "anchored")  # one pass; without the texts that have no licence
    some = held.where("anchored").drop("anchored")
    lines = some.select("file", F.posexplode(F.split("text", r"[\n\r]+")).alias("line", "text")).select("file", "line", terms(F.col("text")).alias("terms"))
    by_line = best_matches(lines.where(F.arrays_overlap("terms", anchors)), ["file", "line"], idf, templates, rare, header)
    by_line = by_line.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b")).select("file", F.col("b.licence").alias("header"), (-F.col("b.minus")).alias("header_score"))
    bags = some.select("file", terms(F.col("text")).alias("terms"))
    by_file = best_matches(bags.where(F.arrays_overlap("terms", anchors)), ["file"], idf, templates, rare, whole).select("file", F.col("licence").alias("line"), F.col("score").alias("line_score"))
    by_full = best_matches(bags.where(F.arrays_overlap("terms", full_anchors)), ["file"], full_idf, full_templates, rare, full).select("file", F.col("licence").alias("full"), F.col("score").alias("full_score"))
    found = some.select("file", "doc_id", "path").join(by_line, "file", "left").join(by_file, "file", "left").join(by_full, "file", "left")
    # a file that is a full text has that licence, whatever its single lines name
    is_full = F.col("full").isNotNull()
    found = written(found.select(
        "doc_id", "path", F.when(is_full, F.col("full")).otherwise(F.col("header")).alias("header"), F.when(is_full, F.col("full_score")).otherwise(F.col("header_score")).alias("header_score"),
        F.coalesce("full", "line").alias("whole"), F.coalesce("full_score", "line_score").alias("whole_score"),
    ), "licensed")
    # directories with a licence, and each directory's nearest one
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    of_dir = found.where("whole is not null and path is not null").withColumn("dir", folder).groupBy("dir").agg(F.min(F.struct((-F.col("whole_score")).alias("minus"), F.col("whole").alias("licence"))).alias("b"))
    of_dir = of_dir.select(F.col("dir").alias("from_dir"), F.col("b.licence").alias("dir_licence"), (-F.col("b.minus")).alias("dir_score"))
    dirs = held.where("path is not null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts")).select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("from_dir"))
    nearest = above.join(of_dir, "from_dir").groupBy("dir").agg(F.max_by(F.struct("dir_licence", "dir_score", "from_dir"), "depth").alias("i")).select("dir", "i.*")
    rest = held.where("not anchored").select("doc_id", "path")  # these have no licence of their own
    rows = found.unionByName(rest, allowMissingColumns=True).withColumn("dir", folder).join(small(written(nearest, "nearest")), "dir", "left")
    kind = F.when(F.col("whole").isNotNull(), "file").when(F.col("header").isNotNull(), "header").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return rows.select(
        "doc_id", "path", F.coalesce("header", "whole", "dir_licence").alias("licence"), kind.alias("found"),
        F.coalesce("header_score", "whole_score", "dir_score").alias("score"), F.when(kind == "inherited", F.col("from_dir")).alias("from_dir"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a document's directory is its source and the thousand that its id falls in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
