"""N-grams stay inside the row that has them: they are never rows of their own."""

from zlib import crc32

import numpy as np

from axisgauge.operators import textq


def test_hashed_vectors_explode_nothing(spark):
    rows = [(1, ["a", "b", "a", "语"]), (1, ["c"]), (2, None), (None, ["x", None, "y"]), (3, [])]
    found = textq.hashed_vectors(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for key, t in rows:
        x = want.setdefault(key, np.zeros(256))
        for n in (1, 2, 3):
            for i in range(len(t or []) - n + 1):
                h = crc32("\x1f".join(w for w in t[i : i + n] if w is not None).encode())
                x[h & 255] += 1 if h >= 1 << 31 else -1
    got = {r["id"]: r["v"] for r in found.collect()}
    assert got.keys() == want.keys()
    for key, x in want.items():
        assert np.allclose(got[key], x / (np.sqrt((x * x).sum()) or 1))


def test_distinct_shares_keep_tokens_apart(spark):
    rows = [(1, ["a", "b", "a", "b", "a"]), (2, ["a"]), (3, None), (4, ["a\x1fb", "c", "a", "b\x1fc"]), (None, ["x", "y"])]
    got = {r[0]: tuple(r[1:]) for r in textq.distinct_shares(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", (2, 3)).collect()}
    assert got == {1: (0.5, 2 / 3), 2: (None, None), 3: (None, None), 4: (1.0, 1.0), None: (1.0, None)}
