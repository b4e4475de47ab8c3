"""What tasks hold and leave behind in their workers."""

import tracemalloc

import numpy as np
import pyarrow as pa

from axisgauge.llm import bytesplit, ngram_join, repeats, suffix_arrays
from axisgauge.llm.common import batches_of


def test_one_table_of_powers_stays(spark):
    for n in (100, 70_000, 3 * bytesplit.BLOCK, 5):
        up, down = bytesplit.powers(n)
        assert len(up) == len(down) == n and bool((up * down == np.uint64(1)).all())
    assert bytesplit._powers.cache_info().currsize == 1
    assert len(bytesplit._powers(bytesplit._reach)[0]) <= 3 * bytesplit.BLOCK + 1


def test_batches_are_small_and_the_setting_comes_back(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with batches_of(spark, 1000):
        assert max(r[0] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()) == 1000
    assert spark.conf.get(name) == before


def test_join_hands_on_few_texts_at_once(spark, monkeypatch):
    seen = []
    plain = ngram_join.frequent_shingles
    monkeypatch.setattr(ngram_join, "frequent_shingles", lambda *a: seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or plain(*a))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.ngram_join(docs).collect()} == {1} and seen == [ngram_join.TEXTS]


def test_repeats_hand_on_few_texts_at_once(spark, monkeypatch):
    seen = []
    plain = repeats._without_repeats
    monkeypatch.setattr(repeats, "_without_repeats", lambda *a: seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or plain(*a))
    docs = spark.createDataFrame([(1, "ab" * 250 + "x"), (2, "y" + "ab" * 250), (3, "z")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: (500, b"x"), 2: (500, b"y"), 3: (0, None)} and seen == [repeats.TEXTS]


def test_repeats_hold_little(spark):
    letters = np.random.default_rng(1).integers(97, 123, 3 << 20).astype(np.uint8)
    bytesplit.powers(1)
    tracemalloc.start()
    for _ in repeats.runs_of(letters, np.append(np.arange(0, len(letters), 3500), len(letters)), repeats.WINDOW, repeats.GRAM):
        pass
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.reset_peak()
    full = np.tile(letters[: (repeats.SHARD + repeats.SPREAD * 600) // 2], 2)  # a shard, and as much of one minimizer as stays together
    starts = np.arange(0, len(full) - 400, 2)
    assert suffix_arrays.repeated_starts(full, starts, np.ones(len(starts), np.int64), 400).any()
    assert tracemalloc.get_traced_memory()[1] < 220e6
    tracemalloc.stop()
