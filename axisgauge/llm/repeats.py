"""Removal of long repeated strings of bytes, with suffix arrays per shard.

A byte goes if it is covered by a string of `window` bytes that also starts anywhere else in the corpus.

1. Each window of `window` bytes has a minimizer: the least hash of the `gram`-byte strings in it. Equal windows have
   equal minimizers, so only windows whose minimizer occurs twice can repeat. Runs of windows with one minimizer are
   counted by a shuffle of narrow rows.
2. For each run with a repeated minimizer, the bytes under its windows (its content) are cut out. Equal contents
   under one minimizer are collapsed before they are shuffled: what occurs twice is repeated as a whole.
3. Distinct contents are dealt into shards of bounded size by minimizer; the contents of a very frequent minimizer are
   spread over several shards. Each shard builds its suffix array and common prefixes, which show the repeated windows.
4. Shards that share a spread minimizer are merged: their remaining windows, as sorted runs of 128-bit digests dealt by
   range, are looked up in each other by binary search.
5. Repeated windows go back to the documents, which take the union of their spans out.

Strings are judged on the input. Defined results: null counts as empty; texts shorter than a window lose nothing; rows
that repeat another row's id and text are documents of their own, so their long strings repeat; null ids are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisgauge.llm.bytesplit import giving_back, mixed, packed, powers, release
from axisgauge.llm.common import batches_of, small, written
from axisgauge.llm.suffix_arrays import repeated_starts

WINDOW, GRAM = 400, 64
#: Bytes of text minimized at once (a minimizer's arrays take about 80 times that, a shard's search 80 times the shard);
#: of contents in a shard; contents of one minimizer in one shard; and texts that a worker gets at once.
SLICE, SHARD, SPREAD, TEXTS = 1 << 18, 1_000_000, 1500, 1000
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(values: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """The least (or greatest) of each `width` neighbours, from running values forwards and backwards in blocks."""
    n = len(values) - width + 1
    short = -len(values) % width
    table = np.concatenate([values, np.full(short, fill, values.dtype)]).reshape(-1, width)
    ahead = pick.accumulate(table, 1).ravel()
    back = pick.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def minimizer_runs(data: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text, first window, number of windows, minimizer, how often it stands there."""
    n, width = len(data), window - gram + 1
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if n < window:
        return none
    up, down = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    grams = np.maximum(mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1]), np.uint64(1))
    least = sliding(grams, width, np.minimum, LAST)
    inside = np.zeros(n + 1, np.int8)  # windows that lie in one text
    real = np.flatnonzero(np.diff(bounds) >= window)
    if not len(real):
        return none
    inside[bounds[real]] = 1
    inside[bounds[real + 1] - window + 1] -= 1
    inside = np.cumsum(inside[: len(least)], dtype=np.int8) > 0
    least = np.where(inside, least, 0)
    begin = inside & np.concatenate([[True], (least[1:] != least[:-1])])
    begin[bounds[real]] = True
    first = np.flatnonzero(begin)
    end = np.flatnonzero(inside & np.concatenate([begin[1:] | ~inside[1:], [True]])) + 1
    # anchors: the places that are the least of some window
    greatest = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum, np.uint64(0))
    anchors = np.flatnonzero(greatest == grams)
    lo, hi = np.searchsorted(anchors, first), np.searchsorted(anchors, end - 1 + width)
    size = hi - lo
    to = np.cumsum(size)
    at = np.repeat(lo - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)
    same = np.concatenate([[0], np.cumsum(grams[anchors[at]] == np.repeat(least[first], size))])
    text = np.searchsorted(bounds, first, "right") - 1
    return text, first - bounds[text], end - first, least[first], same[to] - same[to - size]


def runs_of(data: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(first text, runs) of slices of texts; a longer text is cut into parts that overlap by a window less one byte."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1, i + 1)
        if bounds[j] - bounds[i] <= 2 * SLICE:
            yield i, minimizer_runs(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], window, gram)
        else:
            for at in range(int(bounds[i]), int(bounds[j]) - window + 1, SLICE):
                part = data[at : min(at + SLICE + window - 1, int(bounds[j]))]
                text, first, size, least, times = minimizer_runs(part, np.array([0, len(part)]), window, gram)
                yield i, (text, first + (at - bounds[i]), size, least, times)
        i = j


def _trimmed(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A group's work, after which its memory goes back to the system."""

    def worked(table: pa.Table) -> pa.Table:
        found = work(table)
        release()
        return found

    return worked


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null where nothing was removed)."""
    with batches_of(docs.sparkSession, TEXTS):  # all passes over texts are computed, and written, in here
        return _without_repeats(docs, window, gram, id_col, text_col, shard, spread)


def _without_repeats(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str, shard: int, spread: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    long = docs.where(F.octet_length("text") >= window)
    keys = ["doc_id", "th"]

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, _, _, least, times) in runs_of(*packed(batch.column("text")), window, gram):
                rows = pa.array(text + i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(least.view(np.int64)), pa.array(times)], ["doc_id", "th", "fp", "n"])

    runs = written(long.mapInArrow(giving_back(minimizers), f"doc_id {id_type}, th long, fp long, n long"), "minimizers")
    often = runs.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
    wanted = written(runs.join(often, "fp").groupBy(*keys).agg(F.collect_set("fp").alias("fps")), "wanted")  # a document's own list

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = packed(batch.column("text"))
            fps = batch.column("fps")
            at = fps.offsets.to_numpy()
            values = fps.values.to_numpy().view(np.uint64)
            for i, (text, first, size, least, _) in runs_of(data, bounds, window, gram):
                keep = np.zeros(len(text), bool)
                cut = np.searchsorted(text, np.arange(int(text[-1]) + 2)) if len(text) else []
                for t in range(len(cut) - 1):
                    keep[cut[t] : cut[t + 1]] = np.isin(least[cut[t] : cut[t + 1]], values[at[i + t] : at[i + t + 1]])
                text, first, size, least = text[keep] + i, first[keep], size[keep], least[keep]
                for s in range(0, len(text), 4096):
                    rows = slice(s, s + 4096)
                    begin = bounds[text[rows]] + first[rows]
                    found = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + size[rows] + window - 1).tolist(), strict=True)]
                    where = pa.array(text[rows])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(where), batch.column("th").take(where), pa.array(least[rows].view(np.int64)), pa.array(first[rows]), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in found], pa.binary()), pa.array(found, pa.binary())],
                        ["doc_id", "th", "fp", "first", "digest", "content"],
                    )

    chosen = long.join(small(wanted.select(F.col("doc_id").alias("d"), F.col("th").alias("t"))), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi")
    with_fps = chosen.join(wanted.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "fps"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select(*keys, "text", "fps")
    cut = written(with_fps.mapInArrow(giving_back(contents), f"doc_id {id_type}, th long, fp long, first long, digest binary, content binary"), "contents")
    places = cut.select(*keys, "fp", "first", "digest")
    unique = written(cut.groupBy("fp", "digest").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("n")), "unique")
    per_fp = unique.groupBy("fp").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    per_fp = written(per_fp, "per-minimizer")
    total = per_fp.where("contents > 1 or bytes > 2 * " + str(window)).agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    parts = per_fp.where(f"contents > {spread}").select("fp", F.ceil(F.col("contents") / spread).cast("int").alias("parts"))
    # a content that is alone under its minimizer can only repeat as a whole or inside itself
    unique = unique.join(small(parts), "fp", "left").withColumn("of", F.pmod(F.when(F.col("parts").isNull(), F.xxhash64("fp")).otherwise(F.xxhash64("fp", F.pmod(F.xxhash64("digest"), "parts"))), F.lit(shards)).cast("int"))

    def search(table: pa.Table) -> pa.Table:
        fp, digest, many = table.column("fp").to_pylist(), table.column("digest").to_pylist(), table.column("parts").to_pylist()
        n = table.column("n").to_numpy()
        data, bounds = packed(table.column("content"))
        starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
        own = np.repeat(np.arange(len(fp)), np.diff(bounds) - window + 1)
        found = repeated_starts(data, starts, n[own], window)
        lo, hi, row = starts[:0], starts[:0], own[:0]
        if found.any():
            at = np.flatnonzero(found)
            new = np.concatenate([[True], (np.diff(starts[at]) != 1) | (np.diff(own[at]) != 0)])
            lo, hi, row = starts[at[new]], starts[at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]], own[at[new]]
        out = {"fp": [fp[r] for r in row], "digest": [digest[r] for r in row], "lo": (lo - bounds[row]).tolist(), "hi": (hi - bounds[row]).tolist(), "range": [None] * len(row), "blob": [None] * len(row)}
        rest = np.flatnonzero(np.array([m is not None for m in many])[own])  # windows that another shard may have
        if len(rest):
            held, keys = data.tobytes(), bytearray(16 * len(rest))
            for k, s in enumerate(starts[rest].tolist()):
                keys[16 * k : 16 * k + 16] = hashlib.blake2b(held[s : s + window], digest_size=16).digest()
            keys = np.frombuffer(keys, ">u8").reshape(-1, 2).astype(np.uint64)
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, rest = keys[order], rest[order]
            # of those already found one stands for all, to be looked up only
            once = ~found[rest] | np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
            keys, rest = keys[once], rest[once]
            ranges = (keys[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            for g in np.unique(ranges).tolist():
                k = np.flatnonzero(ranges == g)
                w = np.stack([keys[k, 0].view(np.int64), keys[k, 1].view(np.int64), own[rest[k]], np.where(found[rest[k]], -1, starts[rest[k]] - bounds[own[rest[k]]])], 1)
                names = sorted(set(w[:, 2].tolist()))
                w[:, 2] = np.searchsorted(names, w[:, 2])
                for key, value in zip(out, (None, b"".join(np.int64(fp[r]).tobytes() + digest[r] for r in names), None, None, g, w.astype("<i8").tobytes()), strict=True):
                    out[key].append(value)
        return pa.table({"fp": pa.array(out["fp"], pa.int64()), "digest": pa.array(out["digest"], pa.binary()), "lo": pa.array(out["lo"], pa.int64()), "hi": pa.array(out["hi"], pa.int64()), "range": pa.array(out["range"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    schema = "fp long, digest binary, lo long, hi long, range int, blob binary"
    in_shards = written(unique.select("of", "fp", "digest", "content", "n", "parts").groupBy("of").applyInArrow(_trimmed(search), schema), "repeated")

    def merge(table: pa.Table) -> pa.Table:
        """Each shard's sorted digests are looked up in those of every other shard."""
        runs = [np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 4) for x in table.column("blob")]
        names = [x.as_py() for x in table.column("digest")]
        digests = [np.ascontiguousarray(r[:, :2].view(np.uint64).astype(">u8")).view("S16").ravel() for r in runs]
        hit = [np.zeros(len(r), bool) for r in runs]
        for i, mine in enumerate(digests):
            for j, other in enumerate(digests):
                if i != j and len(other):
                    at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                    hit[i] |= other[at] == mine
        out = {"fp": [], "digest": [], "lo": [], "hi": []}
        for r, name, h in zip(runs, names, hit, strict=True):
            for own, start in r[h & (r[:, 3] >= 0), 2:].tolist():
                key = name[24 * own : 24 * own + 24]
                out["fp"].append(int.from_bytes(key[:8], "little", signed=True)), out["digest"].append(key[8:]), out["lo"].append(start), out["hi"].append(start)
        return pa.table({"fp": pa.array(out["fp"], pa.int64()), "digest": pa.array(out["digest"], pa.binary()), "lo": pa.array(out["lo"], pa.int64()), "hi": pa.array(out["hi"], pa.int64())})

    merged = in_shards.where("blob is not null").groupBy("range").applyInArrow(_trimmed(merge), "fp long, digest binary, lo long, hi long")
    repeated = in_shards.where("blob is null").select("fp", "digest", "lo", "hi").unionByName(merged)
    spans = places.join(repeated, ["fp", "digest"]).groupBy(*keys).agg(F.collect_set(F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + window).alias("hi"))).alias("spans"))
    spans = written(spans, "spans").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "spans")

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = packed(batch.column("text"))
            lists = batch.column("spans")
            at, lo, hi = lists.offsets.to_numpy(), lists.values.field("lo").to_numpy(), lists.values.field("hi").to_numpy()
            removed, spans, kept = [], [], []
            for i in range(len(bounds) - 1):
                text = data[bounds[i] : bounds[i + 1]]
                mark = np.zeros(len(text) + 1, np.int64)
                np.add.at(mark, lo[at[i] : at[i + 1]], 1)
                np.add.at(mark, hi[at[i] : at[i + 1]], -1)
                gone = np.cumsum(mark[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "th", "n_removed", "n_spans", "kept"]
            )

    some = chosen.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select(*keys, "text", "spans")
    changed = some.mapInArrow(giving_back(take_out), f"doc_id {id_type}, th long, n_removed long, n_spans long, kept binary")
    changed = written(changed.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_removed", "n_spans", "kept", F.sha2("kept", 256).alias("sha")), "changed").dropDuplicates(["d", "t"])
    base = docs.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return base.join(changed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), "kept"
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
