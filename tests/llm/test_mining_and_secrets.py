"""Whitening, hard negatives and secret scans against plain Python, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisgauge.llm import hard_negatives, secrets, whitening

VECTORS = "vec_id long, embedding array<float>, label int, component int, n long, score double, key long, x array<long>"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 7, 7, 7.0, 7, [7]) for i, v, lab in rows], VECTORS)


def random_rows(n=150, d=7, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=d).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(40)]  # one very common vector
    rows += [(rows[5][0], *rows[5][1:]), (None, rows[6][1], 2), (2000, None, 1), (2001, [float("nan")] * d, 1), (2002, [1.0, None, *[0.0] * (d - 2)], 2), (2003, [float("inf"), *[0.0] * (d - 1)], 2), (2004, [0.5, 0.25], 3), (2100, rows[7][1], None)]
    return rows


def whole(v, d):
    return [int(np.floor(256 * float(c))) for c in v] + [0] * (d - len(v))


def ok(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def test_square_sums_are_exact():
    rng = np.random.default_rng(1)
    for bits in (5, 20, 40, 58):
        z = rng.integers(-(1 << bits), 1 << bits, (4, 300))
        q = [0] * 10
        for power, s in whitening.square_sums(z).items():
            q = [a + (int(b) << power) for a, b in zip(q, s, strict=True)]
        rows = [[int(v) for v in r] for r in z]
        want = [sum(v * v for v in r) for r in rows] + [sum((a + b) ** 2 for a, b in zip(rows[i], rows[j], strict=True)) for i in range(4) for j in range(i + 1, 4)]
        assert q == want


def test_whitening_by_brute_force(spark):
    rows, d = random_rows(), 7
    got = whitening.whiten(vectors(spark, rows).repartition(5)).collect()
    kept = [(i, whole(v, d), len(v)) for i, v, _ in rows if ok(v)]
    fit = sorted({(tuple(x), size) for _, x, size in kept})
    n = len(fit)
    sums = [sum(x[k] for x, _ in fit) for k in range(d)]
    x = np.array([x for x, _ in fit], float)
    cov = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:4]
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by_id = {}
    for i, v, _ in kept:
        by_id.setdefault(i, []).append(v)
    for r in got:
        v, k = by_id[r["vec_id"]][0], r["component"] - 1
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert abs(r["explained"] - values[order[k]] / np.trace(cov)) < 1e-9
        assert abs(abs(r["whitened"]) - abs((np.array(v) - np.array(sums) / n) @ axes[:, order[k]] / np.sqrt(values[order[k]]))) < 1e-8
    signs = {k: {np.sign(r["whitened"] * ((np.array(by_id[r["vec_id"]][0]) - np.array(sums) / n) @ axes[:, order[k]])) for r in got if r["component"] == k + 1} for k in range(4)}
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def test_whitening_without_rows_or_variance(spark):
    assert whitening.whiten(vectors(spark, [(1, None, 1)])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    line = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], 1), (2, [1.5, 0.25], 1)])).where("component = 2").collect()
    assert [r["whitened"] for r in line] == [None, None] and all(r["explained"] == 0 and r["identity_error"] < 1e-12 for r in line)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (8, 8, 8), (33, 17, 21), (64, 40, 50)])
def test_strassen_equals_the_plain_product(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-(1 << 26), 1 << 26, shape[:2]), rng.integers(-(1 << 26), 1 << 26, shape[1:])
    assert (hard_negatives.strassen(a, b, 3) == (a.astype(object) @ b.astype(object)).astype(np.int64)).all()


def brute_negatives(rows, is_anchor, positives=5, negatives=5):
    taking = [(k, i, lab, whole(v, 7)) for k, (i, v, lab) in enumerate(rows) if lab is not None and ok(v)]
    out = []
    for k, i, lab, x in taking:
        if i is None or not is_anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), j is None, j or 0, m, other) for m, j, other, y in taking if m != k))
        for p in [s for s in scored if s[4] == lab][:positives]:
            inside = [s for s in scored if s[4] != lab and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:negatives]
            out += [(i, None if p[1] else p[2], r, None if s[1] else s[2], -p[0], -s[0]) for r, s in enumerate(inside, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("slot_bytes", [1 << 23, 600])
def test_hard_negatives_by_brute_force(spark, monkeypatch, slot_bytes):
    monkeypatch.setattr(hard_negatives, "SLOT_BYTES", slot_bytes)
    monkeypatch.setattr(hard_negatives, "TILE", 8)
    rows = random_rows()
    rows += [(5000 + i, np.round(np.array(rows[i][1]) * 4) / 4 * 0.25, i % 2) for i in range(60)]  # many equal scores
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], lab) for i, v, lab in rows]
    got = hard_negatives.mine(vectors(spark, rows).repartition(3), F.col("id") % 10 == 0)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and sorted((tuple(r) for r in got.collect()), key=str) == want


def test_hard_negatives_without_rows_anchors_or_partners(spark):
    none = hard_negatives.mine(vectors(spark, [(100, None, 1), (200, [1.0], None)]), F.col("id") % 100 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.mine(vectors(spark, [(1, [1.0], 1), (2, [1.0], 1)]), F.col("id") % 100 == 0).count() == 0
    few = hard_negatives.mine(vectors(spark, [(100, [1.0, 1.0], 1), (2, [1.0], 1), (3, [0.9, 0.0], 2)]), F.col("id") % 100 == 0)
    assert [tuple(r) for r in few.collect()] == [(100, 2, 1, 3, 65536, 58880)]


def base_spans(text):
    text, out = text or "", []
    for k, (kind, p, group, least) in enumerate([("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[group]) >= least]
    return [s for _, _, s in sorted(out)]


def test_secrets_by_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "PassWD", "'", '"', " ", "  ", ":", "=", "token", "secret: ", "api_key", "APIKEY=", "AKIA", "AKIAABCDEFGHIJ", "1234", "abcdef0123456789", "deadbeef", "ñé", "日本", "\n", "x", "AbCdEf12+/", "word words"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(400)] + ["token: secret: aaaaaaaaaaaaaaaa", None, "", "ſecret=abcdefabcdefgh", "a" * 100_000 + " token=" + "b" * 100_000]
    docs = spark.createDataFrame([(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_hex int")
    got = secrets.scan(docs).toPandas()
    want = [base_spans(t if t is None else t.replace("ſ", "?")) for t in texts]
    assert got["base_sha256"].tolist() == [hashlib.sha256(",".join(w).encode()).hexdigest() for w in want]
    for k in ("assign", "access", "hex"):
        assert got[f"n_{k}"].tolist() == [sum(s.startswith(k) for s in w) for w in want]
    for spans, w in zip(got["spans"], want, strict=True):
        own = [s for s in spans.split(",") if s]
        assert [s for s in own if not s.startswith("novel")] == w and [int(s.split(":")[1]) for s in own] == sorted(int(s.split(":")[1]) for s in own)
    assert secrets.scan(docs.limit(0)).count() == 0


def test_novel_strings_are_those_that_do_not_compress(spark):
    rng = random.Random(7)
    code = "def connect(user_name, client):\n    settings = load_settings('/etc/service/config.yaml')\n    return client.open(settings)\n" * 3
    strings = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for n in (20, 24, 32, 40, 64)]
    hidden = [code + f"# the bearer credential is {s} for now\n" + code for s in strings]
    plain = [code + f"# the bearer credential is in {s} for now\n" + code for s in ("/etc/service/config22", "load_settings_v22", "user_name_for_client_11", "2024-05-17T10")]
    far = [code + f"# the build is {s} for now\n" + code for s in strings]
    known = [code + f"token = '{s}'\n" + code for s in strings]
    got = [r["spans"] for r in secrets.scan(spark.createDataFrame(list(enumerate(hidden + plain + far + known)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for text, s, spans in zip(hidden, strings, got, strict=False):
        assert spans == f"novel:{text.index(s)}:{text.index(s) + len(s)}"
    assert not any(got[len(hidden) : -len(known)])
    assert all(s.startswith("assign:") and "novel" not in s for s in got[-len(known) :])  # a pattern has them already
