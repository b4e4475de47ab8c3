"""Each operator against brute force on small tables, with nulls, empty texts, ties, repeats, and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisgauge.llm import bytesplit, decontaminate, exact_dedup, language_id, licenses, mixing, ngram_join, repeats, sharding, suffix_arrays, token_counts, token_output
from axisgauge.llm.wordbpe import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
RNG = np.random.default_rng(5)
WORDS = ["the", "of", "Tion", "ère", "und", "and", "x1", "don't", "nña", "12,", "--", "über"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


ODD = [(100, None), (101, ""), (102, " \t\n"), (103, "a"), (104, "a b"), (105, "Ünïcode 日本語 é İ <|endoftext|> 'S it's"), (None, "null id text here")]


def test_splitting_finds_all_words_of_long_texts():
    texts = [prose(50), "", prose(3000), "no_space" * 50, prose(9)]
    data, bounds = bytesplit.packed(pa.array(texts))
    _, counts = bytesplit.word_hashes(data, bounds)
    assert counts.tolist() == [len(t.split()) for t in texts]
    small = [(i, len(part), more) for i, part, _, more in bytesplit.blocks(data, bounds, 500)]
    assert sum(n for _, n, _ in small) == len(data) and any(more for _, _, more in small)


def test_encoder_equals_the_library():
    texts = [prose(200), *[t for _, t in ODD if t], "x\x0b\x0cy z", "A<|startoftext|>b ŒUVRE ×÷"]
    model = encoder(PATH)
    ids, counts = model.batch(*bytesplit.packed(pa.array(texts)))
    to = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        assert ids[to[i] : to[i + 1]].tolist() == model.tokenizer.encode(t, add_special_tokens=False).ids


def brute_components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and both * den >= num * len(sets[i] | sets[j]) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("many", [False, True])
def test_ngram_join(spark, many, monkeypatch):
    if many:  # crowded shingles and small blocks
        monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", 150)
        monkeypatch.setattr(ngram_join, "PAIRED", 2)
    base = prose(90).split()
    rows = [(i, " ".join(base)) for i in range(3)]
    for i in range(3, 40):
        w = list(base)
        for k in RNG.integers(0, len(w), RNG.integers(0, 4)):
            w[k] = f"q{RNG.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    rows += [(i, prose(RNG.integers(1, 60))) for i in range(40, 60)] + [r for r in ODD if r[0] is not None] + [(300, "a b"), (301, "A")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df, 3, 9, 10).collect()}
    assert got == brute_components(rows, 3, 9, 10)
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_exact_dedup(spark, documents):
    rows = [(i, f"text  {i % 7}\t x") for i in range(30, 0, -1)] + [r for r in ODD if r[0] is not None] + [(5, "text 5 x"), (5, "text 5 x")]
    path = documents(rows)
    got = exact_dedup.op5_exact_dedup(spark, path).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sum(r["kept"] for r in got) == len(groups)  # repeated rows: exactly one stays


def test_exact_dedup_with_colliding_digests(spark, documents):
    rows = [(i, f"t{i % 5}") for i in range(20)]
    got = exact_dedup.exact_dedup(spark, documents(rows) + "/documents.parquet", digest=lambda t: F.lit("same")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {i: (i % 5, 4) for i in range(20)}


def test_exact_dedup_goes_on_from_its_state(spark, documents, tmp_path):
    path, state = documents([(2, "a"), (3, "b")]) + "/documents.parquet", str(tmp_path / "state")
    exact_dedup.exact_dedup(spark, path, state).collect()
    spark.createDataFrame([(1, "a"), (4, "c")], "doc_id long, text string").write.mode("append").parquet(path)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark, path, state).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}


def test_empty_tables(spark, documents):
    path = documents([])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert exact_dedup.op5_exact_dedup(spark, path).count() == 0
    assert token_output.op10_token_output(spark, path).count() == 0
    assert repeats.op7_suffix_dedup(spark, path).count() == 0
    assert decontaminate.contained_items(docs, items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert mixing.mix(docs).count() == 0
    assert sharding.shard(docs).count() == 0
    assert token_counts.op3_token_counts(spark, path).count() == 0
    assert language_id.op9_language_id(spark, path).count() == 0
    assert licenses.op2_license_scan(spark, path).count() == 0


def brute_removed(texts, window):
    seen = {}
    for b in texts:
        for p in range(len(b) - window + 1):
            seen[b[p : p + window]] = seen.get(b[p : p + window], 0) + 1
    for b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        yield len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("spread", [3000, 2])
def test_repeats(spark, spread):
    shared = prose(20)
    texts = [prose(RNG.integers(1, 40)) + (" " + shared + " ") * (i % 3) + prose(RNG.integers(0, 30)) for i in range(25)] + ["aaaa" * 60, "ab" * 90, shared, shared, "", None, prose(5)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_removed int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df, window=50, gram=16, spread=spread, shard=3000).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_removed([(t or "").encode() for t in texts], 50))


def test_suffix_order_and_common_prefixes():
    for n in (1, 9, 200):
        d = RNG.integers(97, 99, n).astype(np.uint8)
        b = d.tobytes()
        order = suffix_arrays.suffix_order(d)
        assert [b[i:] for i in order] == sorted(b[i:] for i in range(n))
        shared = suffix_arrays.common_prefixes(d, order, 40, 8)
        lcp = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert shared[1:].tolist() == [min(40, lcp(b[i:], b[j:])) for i, j in zip(order[:-1], order[1:], strict=True)]


def test_language_gradients():
    w = {k: v.astype(np.float64) for k, v in language_id.initial(3).items()}
    x, mask = language_id.padded([b"abc", b"dea", b"f"])
    y, weight = np.array([0, 1, 2]), np.ones(3)
    _, g = language_id.gradients(w, x, mask, y, weight)
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][at] += 1e-3
        up = language_id.gradients(w, x, mask, y, weight)[0]
        w[k][at] -= 2e-3
        down = language_id.gradients(w, x, mask, y, weight)[0]
        w[k][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[k][at], rel=1e-3, abs=1e-6)


def test_language_id(spark, documents):
    words = {"xx": ["kara", "moko", "kika"], "yy": ["sella", "dunne", "lisse"]}
    rows = [(i, " ".join(RNG.choice(words["xx" if i % 2 else "yy"], 30)), "xx" if i % 2 else "yy") for i in range(80)]
    rows += [(i, t, None) for i, t in ODD if i] + [(200, "123 !!", "xx")]
    got = {r["doc_id"]: r for r in language_id.op9_language_id(spark, documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:80]:
        assert got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102, 200))


def test_contained_items(spark):
    item, short = prose(30, np.random.default_rng(1)), "alpha beta gamma"
    w = item.split()
    docs = [(1, prose(200) + "\n" + item.upper() + " " + prose(100)), (2, " ".join(w[:20])), (3, " ".join(w[:28])), (4, "x alpha  beta\tgamma y"), (5, prose(500))] + [r for r in ODD]
    items = [(1, item), (2, short), (3, None), (4, ""), (5, item)]
    shingles = lambda t, m: {tuple(t.lower().split()[k : k + m]) for k in range(len(t.split()) - m + 1)}
    want = set()
    for d, text in docs:
        for i, t in items:
            m = min(5, len((t or "").split()))
            if m and len(shingles(text or "", m) & shingles(t, m)) * 5 >= 4 * len(shingles(t, m)):
                want.add((d, i))
    df, it = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(df, it).collect()} == want
    assert (4, 2) in want and (1, 1) in want and (1, 5) in want and (3, 1) in want and (2, 1) not in want


def test_contained_items_with_repeated_rows_shared_ids_and_null_ids(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 30)) for _ in range(20)]
    items = [(1, texts[0])] * 8 + [(2, t) for t in texts[1:15]] + [(None, t) for t in texts[15:]]
    docs = []
    for i, t in enumerate(texts):  # 21 to 26 shingles of 26, from either end
        w = t.split()
        docs += [(100 * i + k, " ".join(w[k:] if k % 2 else w[: len(w) - k])) for k in range(6)]
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, 1 if d < 100 else 2 if d < 1500 else None, 26, 26 - d % 100) for d, _ in docs}
    assert len(got) == len(docs) and {tuple(r) for r in got} == want


def test_licences(spark):
    rows = [(1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/b/c/x", "plain text of a file"), (3, "/a/b/y", "some words\nLicensed under the Apache License, Version 2.0.\n" + "more of other words follow here " * 9 + prose(60)), (4, "/z/q", "nothing"), (5, None, "nothing"), (6, "/a/n", None)]
    got = {r["doc_id"]: (r["licence"], r["found"], r["from_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "inherited", "/a"), 3: ("Apache-2.0", "header", None), 4: (None, "none", None), 5: (None, "none", None), 6: ("MIT", "inherited", "/a")}


def test_full_licence_texts_are_files_and_pass_down(spark):
    full = licenses.full_texts()
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"} <= set(full)
    rows, want = [], {}
    for k, (name, (text,)) in enumerate(sorted(full.items())):
        rows += [(2 * k, f"/{k}/LICENSE", "Copyright 2021 Some Person\n\n" + text.upper()), (2 * k + 1, f"/{k}/src/x", "plain words " + prose(30))]
        want |= {2 * k: (name, "file", None), 2 * k + 1: (name, "inherited", f"/{k}")}
    english = "the of and to in or any that you this is for a with by as not be are it which from an such on have " * 40
    rows += [(1000 + i, f"/none/{i}", prose(80)) for i in range(60)] + [(2000, "/none/english", english)]
    want |= {1000 + i: (None, "none", None) for i in range(60)} | {2000: (None, "none", None)}
    got = {r["doc_id"]: (r["licence"], r["found"], r["from_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == want


def test_mixing_meets_weights_and_loses_nothing(spark):
    rows = [(i, prose(30), "big" if i % 10 else "small") for i in range(400)] + [(900, None, None), (901, "", "big")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, pass int")
    got = mixing.mix(df, target_entropy=0.8, most_repeats=5, blocks=32).collect()
    n = {s: sum(len((r["text"] or "").split()) for r in got if r["source"] == s) for s in ("big", "small")}
    weight = {r["source"]: r["weight"] for r in got}
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert n["small"] / (n["big"] + n["small"]) == pytest.approx(weight["small"], abs=0.02)
    assert max(r["pass"] for r in got) > 1
    x = [100, 50, 7, 3]
    assert mixing.entropy(mixing.weights_at(x, mixing.exponent_for(x, 0.95, 1e9))) == pytest.approx(0.95)
    assert mixing.repeats(x, mixing.weights_at(x, mixing.exponent_for(x, 0.95, 3))) == pytest.approx(3)


def test_sharding(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(20), "s") for i in range(500)] + [(None, None, None), (1, "", "x")], "doc_id long, text string, shard string")
    store = str(tmp_path / "store")
    for part in docs.randomSplit([1.0, 1.0, 1.0], 3):
        sharding.append(part.repartition(4), store, 30)
    before = sharding.manifest(spark, store).count()
    assert sharding.versions(spark, store) == [1, 2, 3]
    version = sharding.compact(spark, store)
    assert version == 4 and sharding.manifest(spark, store).count() < before
    for v in (3, 4):  # readers of an older version still have it
        assert sorted(map(str, sharding.read(spark, store, v).drop("shard").collect())) == sorted(map(str, docs.drop("shard").collect()))
    with pytest.raises(Exception, match="exist"):
        sharding.commit(spark, store, sharding.manifest(spark, store).drop("version"), 4)
    sharding.expire(spark, store)
    assert sharding.versions(spark, store) == [4] and sharding.read(spark, store).count() == 502


def test_token_output_round_trip(spark, documents, tmp_path):
    rows = [(i, prose(RNG.integers(0, 40))) for i in range(60, 0, -1)] + [r for r in ODD if r[0] is not None]
    path = documents(rows)
    got = sorted(token_output.op10_token_output(spark, path).collect())
    model, start = encoder(PATH).tokenizer, 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    out = str(tmp_path / "tokens")
    token_output.write_tokens(spark.read.parquet(f"{path}/documents.parquet"), out, PATH)
    assert {r["doc_id"] for r in token_output.read_tokens(spark, out, [3, 104]).collect()} == {3, 104}


@pytest.mark.parametrize("leaf", [16, 512])
def test_counts_follow_edits(spark, leaf):
    rows = []
    for i in range(30):
        text = prose(RNG.integers(0, 80))
        cuts = sorted(RNG.integers(0, len(text) + 1, 4).tolist())
        b = [len(text[:c].encode()) for c in cuts]
        rows.append((i, text, [(b[2], b[3], prose(2)), (b[0], b[1], "" if i % 2 else "zz")]))
    rows += [(50, None, None), (51, "", [(0, 9, "new words")]), (52, "a b", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>")
    got = {r["doc_id"]: r for r in token_counts.apply_edits(token_counts.build(df, PATH, leaf=leaf), PATH).collect()}
    count = lambda t: len(encoder(PATH).tokenizer.encode(t, add_special_tokens=False).ids)
    for i, text, edits in rows:
        new = (text or "").encode()
        for start, stop, add in sorted(edits or [], reverse=True):
            new = new[:start] + add.encode() + new[stop:]
        assert got[i]["text"] == new.decode() and got[i]["n_tokens"] == count(new.decode()) == got[i]["tree"][1]
        assert got[i]["n_tokens_before"] == count(text or "")


def test_one_bad_edit_stops_no_other_row(spark):
    schema = "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>"
    rows = [(1, "é b", [(1, 2, "x")]), (2, "abc def", [(0, 3, "x"), (2, 5, "y")]), (3, "abc", [(2, 1, "x")]), (4, "é b", [(0, 2, "x")]), (5, "a", [None])]
    got = {r["doc_id"]: (r["text"], r["edit_error"]) for r in token_counts.apply_edits(spark.createDataFrame(rows, schema), PATH).collect()}
    assert got == {1: ("é b", "an edit cuts a character"), 2: ("abc def", "edits overlap"), 3: ("abc", "an edit ends before it starts"), 4: ("x b", None), 5: ("a", None)}


def test_trees_grow_under_repeated_appends_and_may_be_stored(spark, tmp_path):
    df = spark.createDataFrame([(1, "start")], "doc_id long, text string")
    path = str(tmp_path / "trees")
    token_counts.build(df, PATH, leaf=32).write.parquet(path)
    rows = spark.read.parquet(path)
    for _ in range(3):  # a later edit is joined to the stored tree
        end = F.octet_length("text")
        edits = rows.select("doc_id", F.array(F.struct(end.alias("start"), end.alias("stop"), F.lit(" " + prose(30)).alias("text"))).alias("edits"))
        rows = token_counts.apply_edits(rows.drop("n_tokens", "n_tokens_before", "n_bytes_encoded", "edit_error").join(edits, "doc_id"), PATH, leaf=32)
    r = rows.first()
    assert r["n_tokens"] == r["tree"][1] == len(encoder(PATH).tokenizer.encode(r["text"], add_special_tokens=False).ids)
    assert len(r["leaf_starts"]) > 6 and r["leaf_starts"] == sorted(r["leaf_starts"])


def test_contained_items_in_slices_of_hashes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"w{k}" for k in rng.integers(0, 10**6, rng.integers(1, 40)))) for i in range(40)]
    docs = [(i, prose(30, rng) + " " + t + " " + prose(30, rng)) for i, t in items] + [(None, items[3][1])]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.contained_items(df, it).collect()))
    monkeypatch.setattr(decontaminate, "HASHES", 50)
    assert sorted(map(str, decontaminate.contained_items(df, it).collect())) == whole and len(whole) >= 41


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    from axisgauge.llm.common import small

    hinted = lambda df, **k: "broadcast" in small(df, **k)._jdf.queryExecution().logical().toString().lower()
    df = spark.createDataFrame([(i, ["x" * 50] * 4, "y" * 9) for i in range(20)], "i long, a array<string>, s string")
    assert hinted(df) and not hinted(df, rows=19) and not hinted(df, bytes_=3000) and hinted(df.limit(0))


def test_mixing_by_brute_force(spark):
    rows = [(i, prose(10 + i % 7), s) for i, s in enumerate(["a"] * 120 + ["b"] * 30 + ["c"] * 4 + [None] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, 0.9, 3.0, 16).collect()
    tokens = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    names = list(tokens)
    weights = dict(zip(names, mixing.weights_at(list(tokens.values()), mixing.exponent_for(list(tokens.values()), 0.9, 3.0)), strict=True))
    assert {r["source"]: r["weight"] for r in got} == {s: pytest.approx(w) for s, w in weights.items()}
    budget = max(tokens[s] / weights[s] for s in names)
    for s in names:
        used = {}
        for r in got:
            if r["source"] == s:
                used.setdefault(r["pass"], {}).setdefault(r["position"], []).append(r)
        wanted = max(tokens[s], weights[s] * budget)
        size = {(p, q): sum(len(r["text"].split()) for r in rs) for p, at in used.items() for q, rs in at.items()}
        total = sum(size.values())
        largest_block = max(size.values())
        assert wanted - 1e-6 <= total < wanted + largest_block + 1e-6  # the last pass stops with the block that fills the budget
        assert {r["doc_id"] for r in got if r["source"] == s and r["pass"] == 1} == {i for i, _, x in rows if x == s}


def test_sharding_query_merges_and_names_shards_alike(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "SMALL", 2000)
    rows = [(i, prose(20)) for i in range(300)] + [(400, None), (401, "")]
    path = documents(rows)
    one, two = (sorted(map(tuple, sharding.op8_sharding(spark, path).collect())) for _ in range(2))
    assert one == two and [(i, n) for i, _, n in one] == sorted((i, len((t or "").encode())) for i, t in rows)
    assert len({s for _, s, _ in one}) < 4  # many small shards became few


def test_failed_commit_leaves_no_data(spark, tmp_path, monkeypatch):
    docs, store = spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path / "store")
    sharding.append(docs, store)
    monkeypatch.setattr(sharding, "versions", lambda *a: [])  # as if another writer were not seen
    with pytest.raises(Exception):
        sharding.append(docs, store)
    assert len(list((tmp_path / "store" / "data").iterdir())) == 1


def test_memoised_labels_equal_a_plain_forward_pass():
    w = language_id.initial(3) | {"languages": ["aa", "bb", "cc"]}
    texts = [prose(60), "ÉCOLE École école", "x" * 70 + " " + "日本語" * 12, "", prose(5)]
    labeller = language_id.Labeller(w)
    total, _ = labeller.texts(*bytesplit.packed(pa.array(texts)))
    again, _ = labeller.texts(*bytesplit.packed(pa.array(texts)))
    for i, t in enumerate(texts):
        want = np.zeros(3)
        for word in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())):
            for s in range(0, len(word), language_id.LONGEST):
                x, mask = language_id.padded([word[s : s + language_id.LONGEST]])
                want += language_id.labels({k: v for k, v in w.items() if k != "languages"}, x, mask)[0][:, 0].sum(0)
        assert total[i] == pytest.approx(want, rel=1e-4, abs=1e-4) and again[i] == pytest.approx(total[i])
