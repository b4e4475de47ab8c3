"""The n-gram join on families of near copies: what is compared with what, and how."""

import random

import numpy as np
import pytest

from axisgauge.llm import ngram_join


def plain_components(sets, num, den):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * den >= num * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def shingles(text, width=3):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_common_line_does_not_join_families_of_other_sizes(spark, monkeypatch):
    rnd, line, texts = random.Random(3), " ".join(f"common{i}" for i in range(14)), []
    for n in (40, 60, 90, 140, 200):
        words = [f"w{n}x{i}" for i in range(n)]
        for _ in range(20):
            copy = list(words)
            for at in rnd.sample(range(n), rnd.choice((0, 1, 2))):
                copy[at] = f"new{rnd.random()}"
            texts.append(f"{line} {' '.join(copy)}")
    monkeypatch.setattr(ngram_join, "frequent_shingles", lambda *a: np.zeros(0, np.uint64))  # so that the line stands in prefixes
    found, plain = {}, ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: found.setdefault(name, plain(df, name)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 9, 10).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components([shingles(t) for t in texts], 9, 10)
    sizes = [sorted(r["n"]) for r in found["clusters"].groupBy("cluster").agg({"n": "collect_set"}).toDF("cluster", "n").collect()]
    assert len(sizes) == 5 and all(s[0] * 10 >= s[-1] * 9 for s in sizes)


@pytest.mark.parametrize("least", [4, 1000])
def test_families_are_compared_by_their_changes(monkeypatch, least):
    monkeypatch.setattr(ngram_join, "FAMILY", least)
    rng = np.random.default_rng(5)
    sets = [set(rng.integers(0, 80, rng.integers(1, 30)).tolist()) for _ in range(60)]
    for f, size in enumerate((40, 90, 90, 200)):
        root = np.arange(size) + 1000 * (f + 1)
        for _ in range(30):
            copy, k = root.copy(), int(rng.integers(0, size // 9))
            copy[rng.permutation(size)[:k]] = rng.integers(0, 100_000, k)
            sets.append({*copy.tolist(), *range(int(rng.integers(0, 5)))})
    sets = [sets[i] for i in rng.permutation(len(sets))]
    links = ngram_join.block_links([np.array(sorted(s), np.uint64) for s in sets], 9, 10)
    label = list(range(len(sets)))
    for a, b in links:
        label[b] = a
    assert label == plain_components(sets, 9, 10)
    assert ngram_join.block_links([np.array([i], np.uint64) for i in range(40)], 9, 10) == []


def test_changes_of_a_family_are_few():
    held = np.ones((50, 100), bool)
    held[np.arange(50), np.arange(50)] = False
    entries, common = ngram_join.changes(*np.nonzero(held), 50, 100)
    assert common.all() and sorted(zip(*(x.tolist() for x in entries), strict=True)) == [(i, i) for i in range(50)]
