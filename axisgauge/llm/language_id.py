"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads each white-space word (ASCII letters lower-cased, words over `LONGEST` bytes in pieces) byte by byte
in both directions, labels every position with probabilities of the languages, and a document's probabilities are the
mean over all its positions. It is trained in numpy by backpropagation through time, on the driver, on a bounded
sample: words of the `SAMPLE_DOCS` labelled documents with the smallest hashed ids, at most `SAMPLE_WORDS` of them.
Prediction covers whole texts of all rows, without a shuffle; repeated words are looked up in a memo of bounded size.

Defined results: null, empty and letterless texts are `und` with score 0; without any labelled row everything is
`und`; rows with a null id are never trained on; ties between languages go to the first by name; columns of the input
named lang_pred or score are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisgauge.llm.bytesplit import BLOCK, LOWER_BYTE, SPACE_BYTE, blocks, giving_back, owners, packed, runs, span_hashes
from axisgauge.llm.common import words

SAMPLE_DOCS, SAMPLE_WORDS = 3000, 40_000
LONGEST, HIDDEN, EPOCHS, BATCH, RATE = 24, 16, 5, 256, 0.01
#: Words whose pooled labels a worker remembers, and words labelled at once.
MEMO, AT_ONCE = 150_000, 2048
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[65:91] = True
UNKNOWN = "und"
#: Lower-casing, in training as in prediction, changes these letters only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def padded(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte values, position by word, and whether a position has one."""
    n = np.array([len(w) for w in found])
    mask = np.arange(n.max() if len(n) else 0)[:, None] < n
    x = np.zeros(mask.shape, np.int64)
    x.T[mask.T] = np.frombuffer(b"".join(found), np.uint8)
    return x, mask


def reverse(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each column's first n rows in the other order, n its number of real positions (x is positions by words [by units])."""
    n = mask.sum(0)
    at = np.where(mask, n - 1 - np.arange(len(x))[:, None], np.arange(len(x))[:, None])
    return np.take_along_axis(x, at if x.ndim == 2 else at[:, :, None], 0)


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * v) + 0.5


def initial(languages: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"out": rng.normal(0, 0.2, (2 * HIDDEN, languages)), "bias": np.zeros(languages)}
    for d in "fb":
        w |= {f"x{d}": rng.normal(0, 0.3, (256, 3 * HIDDEN)), f"u{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def forward(w: dict, d: str, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """The states of one direction; positions after a word's end carry on and are masked by the caller."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    states = np.empty((*x.shape, HIDDEN), np.float32)
    for t in range(len(x)):
        own, past = w[f"x{d}"][x[t]] + w[f"c{d}"], h @ w[f"u{d}"]
        gates = sigmoid(own[:, : 2 * HIDDEN] + past[:, : 2 * HIDDEN])
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(own[:, 2 * HIDDEN :] + reset * past[:, 2 * HIDDEN :])
        if trace is not None:
            trace.append((h, update, reset, new, past[:, 2 * HIDDEN :]))
        h = new + update * (h - new)
        states[t] = h
    return states


def backward(w: dict, d: str, x: np.ndarray, trace: list, up: np.ndarray, grads: dict) -> None:
    """Backpropagation through time: up has the loss's derivatives by this direction's states."""
    carry, steps = np.zeros_like(up[0]), []
    for t in reversed(range(len(x))):
        h, update, reset, new, past = trace[t]
        dh = up[t] + carry
        dnew = dh * (1 - update) * (1 - new * new)
        dupdate = dh * (h - new) * update * (1 - update)
        dreset = dnew * past * reset * (1 - reset)
        down = np.concatenate([dupdate, dreset, dnew * reset], 1)
        grads[f"u{d}"] += h.T @ down
        carry = dh * update + down @ w[f"u{d}"].T
        steps.append(np.concatenate([dupdate, dreset, dnew], 1))
    flat, at = np.concatenate(steps), x[::-1].ravel()
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
    grads[f"x{d}"][at[order][cuts]] += np.add.reduceat(flat[order], cuts)
    grads[f"c{d}"] += flat.sum(0)


def labels(w: dict, x: np.ndarray, mask: np.ndarray, traces: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the languages at every position, and the states of both directions."""
    ahead = forward(w, "f", x, traces and traces[0])
    back = reverse(forward(w, "b", reverse(x, mask), traces and traces[1]), mask)
    states = np.concatenate([ahead, back], 2)
    scores = states @ w["out"] + w["bias"]
    p = np.exp(scores - scores.max(2, keepdims=True))
    return p / p.sum(2, keepdims=True), states


def gradients(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean weighted cross-entropy over the real positions, and its derivatives."""
    traces: tuple = ([], [])
    p, states = labels(w, x, mask, traces)
    each = mask * weight
    total = max(float(each.sum()), 1e-9)
    loss = -float((np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-9)) * each).sum()) / total
    delta = p.copy()
    delta[:, np.arange(len(y)), y] -= 1
    delta *= (each / total)[:, :, None]
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["out"] += states.reshape(-1, 2 * HIDDEN).T @ delta.reshape(-1, delta.shape[2])
    grads["bias"] += delta.sum((0, 1))
    up = delta @ w["out"].T
    backward(w, "f", x, traces[0], up[:, :, :HIDDEN], grads)
    rmask = mask  # reversed columns fill the same positions
    backward(w, "b", reverse(x, mask), traces[1], reverse(np.ascontiguousarray(up[:, :, HIDDEN:]), rmask), grads)
    return loss, grads


def train(rows: list[tuple[bytes, str, int]], epochs: int = EPOCHS, seed: int = 7) -> dict:
    """rows: word, language, times; languages weigh alike. Returns the weights, and the languages under 'languages'."""
    languages = sorted({lang for _, lang, _ in rows})
    found = [w[:LONGEST] for w, _, _ in rows]
    y = np.array([languages.index(lang) for _, lang, _ in rows], np.int64)
    weight = np.sqrt(np.array([n for _, _, n in rows], np.float64))
    weight = (weight / np.bincount(y, weight * [len(w) for w in found])[y] * len(rows)).astype(np.float32)
    w, rng = initial(len(languages), seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    steps = epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            at = order[s : s + BATCH]
            x, mask = padded([found[i] for i in at])
            _, grads = gradients(w, x, mask, y[at], weight[at])
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k in w:  # Adam
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.005 * (grads[k] ** 2 - second[k])
                w[k] = w[k] - np.float32(rate) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-6)
    return w | {"languages": languages}


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> dict | None:
    """Trains on labelled rows that aren't held out; None if there are none. The sample's two bounds are parameters."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    chosen = labelled.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    seen = (
        labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .join(F.broadcast(chosen), "id")  # sample_docs rows at most
        .select("lang", F.explode(words(F.col("text"))).alias("word"))
        .groupBy("lang", F.translate(F.substring("word", 1, LONGEST), UPPER, UPPER.lower()).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    )
    rows = seen.orderBy(F.xxhash64("word", "lang"), "word", "lang").limit(sample_words).toArrow().to_pylist()
    rows = [(r["word"].encode(), r["lang"], r["n"]) for r in rows if r["word"]]
    return train(rows) if rows else None


class Labeller:
    """Pools the labels of whole texts; one for each task."""

    def __init__(self, w: dict):
        self.w, self.languages = w, w["languages"]
        self.at: dict[bytes, int] = {}
        self.sums = np.zeros((MEMO, len(self.languages)), np.float32)

    def pooled(self, found: list[bytes]) -> np.ndarray:
        """For each word the sum of its positions' probabilities."""
        out = np.empty((len(found), len(self.languages)), np.float32)
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        for s in range(0, len(order), AT_ONCE):
            at = order[s : s + AT_ONCE]
            x, mask = padded([found[i] for i in at])
            p, _ = labels(self.w, x, mask)
            out[at] = (p * mask[:, :, None]).sum(0)
        return out

    def distinct(self, found: list[bytes]) -> np.ndarray:
        missing = [w for w in found if w not in self.at]
        if len(self.at) + len(missing) > MEMO:
            self.at.clear()
            missing = found
            if len(found) > MEMO:
                return self.pooled(found)
        n = len(self.at)
        if missing:
            self.sums[n : n + len(missing)] = self.pooled(missing)
            self.at.update(zip(missing, range(n, n + len(missing)), strict=True))
        return self.sums[[self.at[w] for w in found]]

    def texts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of its positions' probabilities, and whether it has a letter."""
        total = np.zeros((len(bounds) - 1, len(self.languages)))
        letter = np.zeros(len(bounds) - 1, bool)
        for i, part, b, _ in blocks(data, bounds, BLOCK):
            lower = LOWER_BYTE[part]
            starts, ends = runs(~SPACE_BYTE[part], b)
            has = np.diff(np.concatenate([[0], np.cumsum(LETTERS[part])])[b]) > 0
            for k in np.flatnonzero(~has & (np.diff(b) > 0)).tolist():
                own = part[b[k] : b[k + 1]]
                has[k] = bool((own > 127).any()) and any(map(str.isalpha, own.tobytes().decode("utf-8", "ignore")))
            letter[i : i + len(has)] |= has
            if not len(starts):
                continue
            long = ends - starts > LONGEST
            per = owners(starts, b)
            if long.any():  # longer words come in pieces
                pieces = -(-(ends - starts) // LONGEST)
                to = np.cumsum(pieces)
                nth = np.arange(int(to[-1])) - np.repeat(to - pieces, pieces)
                cut = np.repeat(starts, pieces) + nth * LONGEST
                ends, starts = np.minimum(cut + LONGEST, np.repeat(ends, pieces)), cut
                per = owners(starts, b)
            _, first, back = np.unique(span_hashes(lower, starts, ends), return_index=True, return_inverse=True)
            held = lower.tobytes()
            sums = self.distinct([held[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            running = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums[back], 0, dtype=np.float64)])
            total[i : i + len(per)] += np.diff(running[np.concatenate([[0], np.cumsum(per)])], axis=0)
        return total, letter


def predict(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = docs.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        languages = np.array([*labeller.languages, UNKNOWN], object)
        for batch in batches:
            total, letter = labeller.texts(*packed(batch.column(text_col)))
            p = total / np.maximum(total.sum(1, keepdims=True), 1e-9)
            best = np.where(letter, p.argmax(1), len(labeller.languages))
            score = np.where(letter, np.minimum(p.max(1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages[best], pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(giving_back(label), schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = predict(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
