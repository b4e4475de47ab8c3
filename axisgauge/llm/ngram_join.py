"""Grouped prefix join of documents by the Jaccard similarity of their word n-grams.

No pair is left out and none is estimated; shingles are compared by hashes, of which verification keeps the upper 48 bits,
so that two different shingles of a pair of documents with n and m shingles count as equal with probability n m / 2^48 at
most (4e-9 for a thousand each).

A document's set is that of its distinct n-word shingles (hashed to 64 bits; a text with fewer words has its whole
sequence as one). Two sets with similarity t or more share one of the first |set| - ceil(t |set|) + 1 shingles (the
prefix) of each in any common order, and m of the first that many + m - 1. The order here is: shingles found in few prefixes first, then by hash.

1. One pass over the texts counts, in blobs of hashes dealt by hash, which shingles stand in many prefixes. The list
   of frequent ones is held to `DEMOTED` entries by raising the threshold, so it is safe to broadcast; it changes the
   order only, never a result.
2. A second pass computes each document's prefix. Documents with the same prefix and size are one group, and a group
   appears once under each of its prefix's shingles, whatever number of documents it has.
3. Groups that meet under a shingle are filtered by size and become group pairs; a pair must share `SHARED` shingles of
   its (that much longer) prefixes. Where more than `PAIRED` groups meet, no pairs are made: the list of groups is kept,
   and equal lists are kept once. What meets is taken apart first where its sizes have a gap too wide for any link.
4. What has met forms clusters. A cluster is expanded to its members, classes of equal sets, and cut into blocks of
   bounded size. Every two blocks of a cluster meet in one task, which compares all whole sets there (near copies by
   what they do not have in common) and gives a spanning set of the links, not all pairs; so no link between different
   sets is lost.
5. Links give components.

Defined results: null or empty texts and texts without words have empty sets and link with nothing; rows with one id
count as one document, whose links are those of all its rows; a null id links with nothing and has a null component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisgauge.llm.bytesplit import giving_back, packed, shingle_hashes, word_hashes
from axisgauge.llm.common import batches_of, small, written
from axisgauge.llm.components import components

#: A shingle in more prefixes than this is put at the end of the order; the list of them has at most so many entries.
FREQUENT, DEMOTED = 8, 1_000_000
#: So many groups under one shingle are paired one by one; the lists of more are kept whole.
PAIRED = 64
#: Pairs must share so many shingles of their prefixes, which are that much longer; elements of sets in a block.
SHARED, BLOCK_ELEMENTS = 4, 300_000
#: Sets of one family in a block, at least, and families looked for; this only makes comparing faster.
FAMILY, FAMILIES = 32, 16
#: Bytes of text for each bucket of prefixes, at most.
BUCKET_BYTES = 8 << 20
#: Bytes of text, and elements of prefixes, held at once by a task; texts in a batch.
SLICE, HELD, TEXTS = 1 << 20, 1 << 19, 1000


def document_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of a batch."""
    data, bounds = packed(batch.column("text"))
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1, i + 1)
        hashes, sizes = shingle_hashes(*word_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]), width)
        at = 0
        for row, size in enumerate(sizes.tolist(), i):
            found = np.sort(hashes[at : at + size])
            at += size
            yield row, found[np.concatenate([[True], found[1:] != found[:-1]])] if size else found
        i = j


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def dealt(tokens: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs by bucket of the tokens' top bits; each blob has the tokens sorted, then the arrays in `more`, in that order."""
    order = np.argsort(tokens)
    tokens = tokens[order]
    bucket = (tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    columns = [tokens, *(m[order] for m in more)]
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, b"".join(c[cuts[b] : cuts[b + 1]].tobytes() for c in columns)


def frequent_shingles(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> np.ndarray:
    """Sorted hashes of the shingles that stand in many (slightly lengthened) prefixes in hash order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def out() -> pa.RecordBatch:
            blobs = list(dealt(np.concatenate(held), buckets))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for _, found in document_sets(batch, width):
                if len(found):
                    k = prefix_size(len(found), num, den)
                    first = found[: k + k // 4 + 4]
                    if (key := (len(found), first.tobytes()[:64])) in seen:  # copies count once for each task and blob
                        continue
                    seen.add(key)
                    held.append(first)
                    size += len(first)
                    if size >= HELD:
                        yield out()
                        held, size, seen = [], 0, set()
        if held:
            yield out()

    def frequent(table: pa.Table) -> pa.Table:
        tokens = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("blob")]))
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(starts, len(tokens)))
        many = counts > FREQUENT
        return pa.table({"token": tokens[starts[many]].view(np.int64), "n": counts[many]})

    found = written(docs.mapInArrow(giving_back(count), "bucket int, blob binary").groupBy("bucket").applyInArrow(frequent, "token long, n long"), "frequent")
    least, total = FREQUENT, 0
    steps = found.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count(F.lit(1)).alias("tokens"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    for row in steps:  # a few dozen rows
        total += row["tokens"]
        if total > DEMOTED:
            break
        least = row["n"]
    tokens = found.where(F.col("n") >= least).select("token").toArrow().column("token") if steps and steps[0]["tokens"] <= DEMOTED else []
    return np.sort(np.array(tokens, np.int64).view(np.uint64))


def candidates(docs: DataFrame, width: int, num: int, den: int, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Rows of three kinds: 'doc' (a doc_id, b group, n set size, key of the set), 'pair' (a, b groups), 'list' (a list, b group)."""
    demoted = docs.sparkSession.sparkContext.broadcast(frequent)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_last = demoted.value
        tokens, groups, sizes, size, seen = [], [], [], 0, set()

        def out() -> pa.RecordBatch:
            each = np.array([len(t) for t in tokens])
            blobs = list(dealt(np.concatenate(tokens), buckets, np.repeat(np.array(groups, np.int64), each), np.repeat(np.array(sizes, np.int32), each)))
            n = len(blobs)
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                ["bucket", "blob", "a", "b", "n", "key"],
            )

        for batch in batches:
            keys, group_of, n_of, where = [], [], [], []
            for row, found in document_sets(batch, width):
                n = len(found)
                if not n:
                    keys.append(None), group_of.append(None), n_of.append(0), where.append(row % buckets)
                    continue
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                k = min(n, prefix_size(n, num, den) + SHARED - 1)
                first = found
                if len(rare_last):
                    at = np.searchsorted(rare_last, found)
                    late = rare_last[np.minimum(at, len(rare_last) - 1)] == found
                    first = np.concatenate([found[~late][:k], found[late][:k]])
                first = first[:k]
                group = int.from_bytes(hashlib.blake2b(first.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                keys.append(key), group_of.append(group), n_of.append(n), where.append(row % buckets)
                if group not in seen:
                    seen.add(group)
                    tokens.append(first), groups.append(group), sizes.append(min(n, 2**31 - 1))
                    size += k
                    if size >= HELD:
                        yield out()
                        tokens, groups, sizes, size, seen = [], [], [], 0, set()
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), pa.nulls(len(where), pa.binary()), batch.column("doc_id"), pa.array(group_of, pa.int64()), pa.array(n_of, pa.int64()), pa.array(keys, pa.binary())],
                ["bucket", "blob", "a", "b", "n", "key"],
            )
        if tokens:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        blob = table.column("blob")
        docs = table.filter(blob.is_null()).select(["a", "b", "n", "key"])
        docs = docs.append_column("kind", pa.array(["doc"] * len(docs), pa.string()))
        held = [np.frombuffer(x.as_buffer(), np.uint8) for x in blob.drop_null()]
        if not held:
            return docs.select(["kind", "a", "b", "n", "key"])
        m = [len(x) // 20 for x in held]
        tokens = np.concatenate([x[: 8 * k].view(np.uint64) for x, k in zip(held, m, strict=True)])
        groups = np.concatenate([x[8 * k : 16 * k].view(np.int64) for x, k in zip(held, m, strict=True)])
        sizes = np.concatenate([x[16 * k :].view(np.int32) for x, k in zip(held, m, strict=True)])
        found = []
        order = np.lexsort((groups, sizes, tokens))
        tokens, groups, sizes = tokens[order], groups[order], sizes[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (groups[1:] != groups[:-1])])
        tokens, groups, sizes = tokens[new], groups[new], sizes[new].astype(np.int64)
        # what stands under one shingle, apart where sizes leave a gap that no link crosses
        starts = np.flatnonzero(np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (sizes[:-1] * den < sizes[1:] * num)]))
        counts = np.diff(np.append(starts, len(tokens)))
        for c in range(2, PAIRED + 1):
            at = starts[counts == c]
            if len(at):
                x, y = np.triu_indices(c, 1)
                x, y = (at[:, None] + x).ravel(), (at[:, None] + y).ravel()
                near = np.minimum(sizes[x], sizes[y]) * den >= np.maximum(sizes[x], sizes[y]) * num
                found.append(np.stack([groups[x[near]], groups[y[near]]]))
        pairs, shared = np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
        if sum(x.shape[1] for x in found):
            pairs = np.concatenate(found, 1)
            pairs = pairs[:, np.lexsort(pairs)]
            begin = np.flatnonzero(np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(0)]))
            pairs, shared = pairs[:, begin], np.diff(np.append(begin, pairs.shape[1]))
        lists: dict[int, np.ndarray] = {}
        for s, c in zip(starts[counts > PAIRED].tolist(), counts[counts > PAIRED].tolist(), strict=True):
            members = groups[s : s + c]
            lists[int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)] = members
        of = np.repeat(np.array(list(lists), np.int64), [len(x) for x in lists.values()]) if lists else np.zeros(0, np.int64)
        members = np.concatenate(list(lists.values())) if lists else np.zeros(0, np.int64)
        n = pairs.shape[1] + len(of)
        more = pa.table({
            "a": np.concatenate([pairs[0], of]), "b": np.concatenate([pairs[1], members]), "n": np.concatenate([shared, np.zeros(len(of), np.int64)]), "key": pa.nulls(n, pa.binary()),
            "kind": pa.array(["pair"] * pairs.shape[1] + ["list"] * len(of), pa.string()),
        })
        return pa.concat_tables([docs.select(["kind", "a", "b", "n", "key"]), more.select(["kind", "a", "b", "n", "key"])])

    rows = docs.mapInArrow(giving_back(prefixes), "bucket int, blob binary, a long, b long, n long, key binary")
    return written(rows.groupBy("bucket").applyInArrow(meet, "kind string, a long, b long, n long, key binary"), "prefixes")


def overlaps(left: tuple[np.ndarray, np.ndarray], m: int, right: tuple[np.ndarray, np.ndarray], n: int, width: int) -> Iterator[np.ndarray]:
    """For each of the m left rows, in how many columns it meets each of the n right ones; entries are (row, column), the left ones sorted by row."""
    order = np.argsort(right[1], kind="stable")
    holders, cuts = right[0][order], np.searchsorted(right[1][order], np.arange(width + 1))
    cuts_of = np.searchsorted(left[0], np.arange(m + 1))
    for r in range(m):
        own = left[1][cuts_of[r] : cuts_of[r + 1]]
        length = cuts[own + 1] - cuts[own]
        to = np.cumsum(length)
        at = np.repeat(cuts[own] - (to - length), length) + np.arange(int(to[-1]) if len(to) else 0)
        yield np.bincount(holders[at], minlength=n)


def families(row: np.ndarray, column: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A family for each row: rows that have over half of their elements from one row of it; the last is that of all others."""
    m, family = len(n), np.full(len(n), -1)
    for g in range(FAMILIES):
        free = family < 0
        if free.sum() < FAMILY:
            break
        held = np.bincount(column[free[row]], minlength=int(column.max(initial=-1)) + 1)
        common = np.bincount(row, held[column], m) / n
        inside = np.zeros(len(held), bool)
        inside[column[row == np.argmax(np.where(free, common, -1))]] = True
        like = free & (2 * np.bincount(row[inside[column]], minlength=m) > n)
        if like.sum() < FAMILY:
            break
        family[like] = g
    return np.where(family < 0, family.max(initial=-1) + 1, family)


def changes(row: np.ndarray, column: np.ndarray, m: int, width: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(entries, common): in a common column, one that over half of the m rows have, the rows that lack it are entries instead."""
    common = 2 * np.bincount(column, minlength=width) > m
    at = np.cumsum(common) - 1
    lacks = np.ones((m, int(common.sum())), bool)
    late = common[column]
    lacks[row[late], at[column[late]]] = False
    more, which = np.nonzero(lacks)
    row, column = np.concatenate([row[~late], more]), np.concatenate([column[~late], np.flatnonzero(common)[which]])
    order = np.argsort(row, kind="stable")
    return (row[order], column[order]), common


def block_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning set of the links among the sets: row numbers, each with the first row of its component.

    Near copies have most elements in common, so within a family sets are compared by what they have or lack besides:
    with K common columns, of which x and y lack i and j, they share K - i - j of those, and one for each that both lack."""
    m, n = len(sets), np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), n)
    shared = np.bincount(column) > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    width = int(shared.sum())
    label = np.arange(m)

    def link(r: int, others: np.ndarray, both: np.ndarray) -> None:
        met = np.unique(label[others[both * (num + den) >= num * (n[others] + n[r])]])
        if len(met) > 1 or len(met) and met[0] != label[r]:
            met = np.union1d(met, label[r])
            label[np.isin(label, met)] = met[0]

    family = families(row, column, n)
    for g in range(int(family.max()) + 1):
        own, later = np.flatnonzero(family == g), np.flatnonzero(family > g)
        place = np.zeros(m, np.int64)
        place[own], place[later] = np.arange(len(own)), np.arange(len(later))
        mine, theirs = family[row] == g, family[row] > g
        left, right = (place[row[mine]], column[mine]), (place[row[theirs]], column[theirs])
        entries, common = changes(*left, len(own), width)
        lacking = np.bincount(entries[0][common[entries[1]]], minlength=len(own))
        for r, both in enumerate(overlaps(entries, len(own), entries, len(own), width)):
            link(own[r], own[:r], both[:r] + int(common.sum()) - lacking[:r] - lacking[r])
        if len(later):
            for r, both in enumerate(overlaps(left, len(own), right, len(later), width)):
                link(own[r], later, both)
    return [(int(label[r]), r) for r in range(m) if label[r] != r]


def ngram_join(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; a similarity of num / den or more links; ids are cast to long."""
    with batches_of(docs.sparkSession, TEXTS):  # all passes over texts are computed, and written, in here
        return _joined(docs, width, num, den, id_col, text_col)


def _joined(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))  # each is held by one task
    found = candidates(docs, width, num, den, frequent_shingles(docs.select("text"), width, num, den, buckets), buckets)
    of_docs = found.where("kind = 'doc'").select(F.col("a").alias("doc_id"), F.col("b").alias("grp"), "n", "key")
    # classes of equal sets, and groups of classes
    classes = written(of_docs.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("cls"), F.first("grp").alias("grp"), F.first("n").alias("n")), "classes")
    groups = classes.groupBy("grp").agg(F.min("cls").alias("head"), F.first("n").alias("n"))
    # the groups that meet, as links between their heads: these only say what is compared with what
    overlap = F.ceil((F.col("na") + F.col("nb")) * num / F.lit(num + den) - 1e-9)
    pairs = (
        found.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("shared"))
        .join(groups.select(F.col("grp").alias("a"), F.col("head").alias("ha"), F.col("n").alias("na")), "a")
        .join(groups.select(F.col("grp").alias("b"), F.col("head").alias("hb"), F.col("n").alias("nb")), "b")
        .where(F.col("shared") >= F.least(F.lit(SHARED), overlap)).select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    )
    listed = found.where("kind = 'list'").select(F.col("a").alias("list"), F.col("b").alias("grp")).distinct().join(groups.select("grp", "head"), "grp")
    lists = listed.groupBy("list").agg(F.min("head").alias("a")).join(listed.select("list", F.col("head").alias("b")), "list").select("a", "b")
    inside = classes.join(groups.select("grp", "head"), "grp").where("cls != head").select(F.col("head").alias("a"), F.col("cls").alias("b"))
    compared = components(pairs.unionByName(lists).unionByName(inside))
    members = written(classes.select("cls", "n").join(compared.select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "cls"), "clusters")
    # blocks of bounded size; every two blocks of a cluster meet in one task
    cuts = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int")
    blocks = (
        members.join(cuts, "cluster").select("cluster", "cls", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
        .groupBy("cls").agg(F.first("cluster").alias("cluster"), F.collect_list(F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))).alias("at"))
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, blobs, held = [], [], 0
            names = ["cls", "cluster", "at"]
            keys = [batch.column("doc_id"), batch.column("cluster"), batch.column("at")]
            for row, s in document_sets(batch, width):
                rows.append(row), blobs.append(np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes())  # the upper six bytes
                held += len(blobs[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([*(k.take(pa.array(rows)) for k in keys), pa.array(blobs, pa.binary())], [*names, "tokens"])
                    rows, blobs, held = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([*(k.take(pa.array(rows)) for k in keys), pa.array(blobs, pa.binary())], [*names, "tokens"])

    def in_block(table: pa.Table) -> pa.Table:
        cls, held = table.column("cls").to_pylist(), []
        for x in table.column("tokens"):
            wide = np.zeros((len(x.as_buffer()) // 6, 8), np.uint8)
            wide[:, 2:] = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
            held.append(wide.view(np.uint64).ravel())
        found = block_links(held, num, den)
        return pa.table({"a": pa.array([cls[i] for i, _ in found], pa.int64()), "b": pa.array([cls[j] for _, j in found], pa.int64())})

    whole = docs.join(small(written(blocks, "blocks")).withColumnRenamed("cls", "doc_id"), "doc_id").select("doc_id", "text", "cluster", "at")
    whole = whole.mapInArrow(giving_back(sets), "cls long, cluster long, at array<struct<i:int,j:int>>, tokens binary")
    in_blocks = whole.select("cls", "cluster", "tokens", F.inline("at")).groupBy("cluster", "i", "j").applyInArrow(in_block, "a long, b long")
    found_components = components(in_blocks)
    member = classes.join(found_components.withColumnRenamed("node", "cls"), "cls", "left").select("key", F.coalesce("component", "cls").alias("component"))
    return of_docs.join(member, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 9, 10)


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, a.n AS na, b.n AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""
