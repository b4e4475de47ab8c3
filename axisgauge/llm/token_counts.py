"""Token counts that follow edits: a segment tree over each document's pre-tokens, and re-encoding of what edits touch.

A document is cut into leaves of about `LEAF` bytes, each beginning where a pre-token follows white space; the tokenizer
joins nothing across such a place, so a document's count is the sum of its leaves'. `build` keeps, with the document,
the leaves' first bytes and a heap of sums over them. `apply_edits` finds the leaves that each edit touches, widened
until the region begins and ends behind white space (the boundary context), encodes the regions' new texts alone, and
updates the sums on the paths from those leaves to the root; where a region has grown or shrunk it gets new leaves, and
the known counts of all others stay. Both work row by row without a shuffle; trees written as
a table are joined to later edits by document id.

Edits are structs (start, stop, text): bytes [start, stop) of the old text are replaced; they don't overlap, and their
order is free. Defined results: null texts count as empty; null or empty edits change nothing; bounds beyond the text
are cut to it; a row whose edits overlap, end before they start or cut a character keeps its text and tree, and its
edit_error says why; other columns pass through, those with this module's names are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisgauge.llm.bytesplit import blocks, packed, release
from axisgauge.llm.wordbpe import BLOCK, GAP, KIND, WordEncoder, encoder

TOKENIZER = "word_bpe_49k.json"
LEAF = 512
#: Pre-tokens that a worker remembers.
MEMO = 150_000


def tree_of(counts: np.ndarray) -> np.ndarray:
    """A heap of sums: its root is at 1, its leaves at the second half."""
    size = 1 << max(0, int(len(counts) - 1).bit_length())
    tree = np.zeros(2 * size, np.int32)
    tree[size : size + len(counts)] = counts
    while size > 1:
        tree[size // 2 : size] = tree[size : 2 * size : 2] + tree[size + 1 : 2 * size : 2]
        size //= 2
    return tree


def leaves(model: WordEncoder, data: np.ndarray, bounds: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its leaves' first bytes and token counts."""
    found: list[tuple[list, list]] = [([], []) for _ in range(len(bounds) - 1)]
    base = 0
    for i, part, b, more in blocks(data, bounds, BLOCK):
        if len(part):
            starts, which, ids = model.pieces(part, b)
            tokens = (np.fromiter(map(len, ids), np.int64, len(ids)) // 4)[which]
            text = np.searchsorted(b, starts, "right") - 1
            within = starts - b[text]
            opens = (within == 0) | (KIND[part[np.maximum(starts - 1, 0)]] == GAP)
            at = np.flatnonzero(opens)
            cell = within[at] // leaf
            new = at[np.concatenate([[True], (cell[1:] != cell[:-1]) | (text[at][1:] != text[at][:-1])])] if len(at) else at
            sums = np.add.reduceat(tokens, new) if len(new) else tokens
            for t, s, n in zip(text[new].tolist(), within[new].tolist(), sums.tolist(), strict=True):
                found[i + t][0].append(s + base)
                found[i + t][1].append(n)
        base = base + len(part) if more else 0
    out = []
    for starts, counts in found:
        starts, counts = np.array(starts or [0], np.int32), np.array(counts or [0], np.int32)
        starts[0] = 0
        out.append((starts, counts))
    return out


def lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)))


def build(docs: DataFrame, tokenizer: str, text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """docs with leaf_starts and tree (arrays of int); tree[1] is the number of tokens."""
    docs = docs.drop("leaf_starts", "tree")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = leaves(encoder(tokenizer, MEMO), *packed(batch.column(text_col)), leaf)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists([s for s, _ in found]), lists([tree_of(c) for _, c in found])], [*batch.schema.names, "leaf_starts", "tree"])

    numbers = T.ArrayType(T.IntegerType())
    return docs.mapInArrow(grow, T.StructType([*docs.schema.fields, T.StructField("leaf_starts", numbers), T.StructField("tree", numbers)]))


def regions(text: bytes, starts: list[int], edits: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """(first leaf, last leaf, new bytes) of the disjoint runs of leaves that the edits (rising) touch."""
    out: list[tuple[int, int, list]] = []
    for start, stop, new in edits:
        a, b = bisect_right(starts, start) - 1, bisect_right(starts, stop) - 1
        while a and (starts[a] >= len(text) or KIND[text[starts[a] - 1]] != GAP):
            a -= 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), [*out[-1][2], (start, stop, new)])
        else:
            out.append((a, b, [(start, stop, new)]))
    done = []
    for a, b, own in out:
        at, pieces = starts[a], []
        for start, stop, new in own:
            pieces += [text[at:start], new]
            at = stop
        done.append((a, b, b"".join([*pieces, text[at : starts[b + 1] if b + 1 < len(starts) else len(text)]])))
    return done


def faulty(text: bytes, edits: list[tuple[int, int, bytes]]) -> str | None:
    """Why edits (rising, bounds cut to the text) can't be applied."""
    if any(x[1] < x[0] for x in edits):
        return "an edit ends before it starts"
    if any(y[0] < x[1] for x, y in zip(edits, edits[1:], strict=False)):
        return "edits overlap"
    if any(at < len(text) and text[at] & 0xC0 == 0x80 for x in edits for at in x[:2]):
        return "an edit cuts a character"
    return None


def apply_edits(rows: DataFrame, tokenizer: str, text_col: str = "text", edits_col: str = "edits", leaf: int = LEAF) -> DataFrame:
    """rows (with edits, and with leaf_starts and tree unless they are to be built here) with the new text, leaf_starts and
    tree, and with n_tokens_before, n_tokens, n_bytes_encoded and edit_error; the edits column goes."""
    added = ["n_tokens_before", "n_tokens", "n_bytes_encoded", "edit_error"]
    rows = rows.drop(*added)
    stored = {"leaf_starts", "tree"} <= set(rows.columns)
    rows = rows if stored else rows.drop("leaf_starts", "tree")
    names = [k for k in rows.columns if k != edits_col] + ([] if stored else ["leaf_starts", "tree"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer, MEMO)
        for batch in batches:
            data, bounds = packed(batch.column(text_col))
            if stored:
                starts = [s.as_py() for s in batch.column("leaf_starts")]
                trees = [np.array(t.values, np.int32) for t in batch.column("tree")]
            else:
                grown = leaves(model, data, bounds, leaf)
                starts, trees = [s.tolist() for s, _ in grown], [tree_of(c) for _, c in grown]
            before = [int(t[1]) for t in trees]
            texts, touched, encoded, errors = [], [], [0] * len(trees), [None] * len(trees)
            for i, edits in enumerate(batch.column(edits_col).to_pylist()):
                text = data[bounds[i] : bounds[i + 1]].tobytes()
                own = sorted((min(max(e["start"] or 0, 0), len(text)), min(max(e["stop"] or 0, 0), len(text)), (e["text"] or "").encode()) for e in edits or [] if e is not None)
                errors[i] = faulty(text, own)
                own = [] if errors[i] else own
                touched += [(i, *f) for f in regions(text, starts[i], own)]
                at, pieces = 0, []
                for start, stop, new in own:
                    pieces += [text[at:start], new]
                    at = stop
                texts.append(b"".join([*pieces, text[at:]]) if own else text)
            fresh = leaves(model, *packed(pa.array([t[3] for t in touched], pa.binary())), leaf) if touched else []
            for (i, a, b, new), (cuts, counts) in reversed(list(zip(touched, fresh, strict=True))):  # from the last: places before stay valid
                tree, own = trees[i], starts[i]
                end = own[b + 1] if b + 1 < len(own) else int(bounds[i + 1] - bounds[i])
                shift = len(new) - (end - own[a])
                encoded[i] += len(new)
                if len(counts) == b + 1 - a:  # as many leaves: the sums change on the paths to the root
                    for k, n in enumerate(counts.tolist(), a):
                        node = len(tree) // 2 + k
                        change = n - int(tree[node])
                        while node:
                            tree[node] += change
                            node //= 2
                else:  # the known counts of all other leaves stay
                    held = tree[len(tree) // 2 :][: len(own)]
                    trees[i] = tree_of(np.concatenate([held[:a], counts, held[b + 1 :]]))
                starts[i] = [*own[:a], *(own[a] + cuts).tolist(), *(s + shift for s in own[b + 1 :])]
            new = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "leaf_starts": lists([np.array(s) for s in starts]), "tree": lists(trees)}
            columns = [new[k] if k in new else batch.column(k) for k in names]
            more = [pa.array(before, pa.int64()), pa.array([int(t[1]) for t in trees], pa.int64()), pa.array(encoded, pa.int64()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*names, *added])
        release()

    numbers = T.ArrayType(T.IntegerType())
    fields = [rows.schema[k] if k in rows.columns else T.StructField(k, numbers) for k in names]
    return rows.mapInArrow(edit, T.StructType([*fields, *[T.StructField(k, T.LongType()) for k in added[:3]], T.StructField("edit_error", T.StringType())]))


def sample_edits(text: F.Column, key: F.Column) -> F.Column:
    """Three edits of a text that follow from itself: a replacement, a deletion, and an addition at its end."""
    n = F.char_length(text)
    first, second = F.floor(n / 5).cast("int"), F.floor(n * 3 / 5).cast("int")
    length = (F.lit(3) + F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(9))).cast("int")

    def byte(at: F.Column) -> F.Column:
        return F.octet_length(F.substring(text, F.lit(1), at)).cast("int")

    def one(start: F.Column, stop: F.Column, new: F.Column) -> F.Column:
        return F.struct(start.alias("start"), stop.alias("stop"), new.alias("text"))

    end = F.octet_length(text).cast("int")
    return F.when(n >= 60, F.array(
        one(byte(first), byte(first + length), F.substring(text, first + 4, F.lit(8))),
        one(byte(second), byte(second + length), F.lit("")),
        one(end, end, F.substring(text, F.lit(1), F.lit(12))),
    )).otherwise(F.array(one(end, end, F.lit(" end"))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, three edits of each applied; the text after them by its SHA-256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = public_tokenizers.path(TOKENIZER)
    rows = apply_edits(docs.withColumn("edits", sample_edits(F.col("text"), F.col("doc_id"))), path)  # grown and edited in one pass
    return rows.select("doc_id", "n_tokens_before", "n_tokens", "n_bytes_encoded", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
