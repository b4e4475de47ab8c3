"""The pipeline's stages, each on its own input, against plain Python."""

import itertools

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def words(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()


def shingles(w, n=5):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def one_of_each_group(rows):
    """rows: (id, text); the places of those that stay."""
    sets = [shingles(words(t)) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
            label = [label[a] if x == label[b] else x for x in label]
    least = {}
    for k, x in enumerate(label):
        least[x] = min(least.get(x, k), k, key=lambda p: (rows[p][0] is None, rows[p][0] or 0, p))
    return sorted(least.values())


def leaks(text, items):
    w = (text or "").lower().split()
    for t in items:
        n = min(5, len(t.lower().split()))
        want = shingles(t.lower().split(), n)
        if n and 5 * len(want & shingles(w, n) if len(w) >= n else set()) >= 4 * len(want):
            return True
    return False


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").unionByName(spark.createDataFrame([(9001, "123 ..", "en", "src0", 6), (9002, None, "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    one = corpus_pipeline.identified(spark, docs, DIR).cache()
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in one.collect()} == {9001, 9002}
    two = corpus_pipeline.deduplicated(spark, one, DIR).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    stay = {rows[k][0] for k in one_of_each_group(rows)}
    assert {r["doc_id"] for r in two.collect()} == stay and len(stay) < len(rows)
    three = corpus_pipeline.decontaminated(spark, two, DIR).cache()
    items = [r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {i for i, t in rows if i in stay and not leaks(t, items)}
    assert {r["doc_id"] for r in three.collect()} == clean and len(clean) < len(stay)
    four = corpus_pipeline.mixed(spark, three, DIR).cache()
    assert {r["doc_id"] for r in four.collect()} == clean
    five = corpus_pipeline.sharded(spark, four, DIR)
    assert five.count() == four.count() and set(five.columns) == {*corpus_pipeline.COLUMNS, "shard"}
    for stage in (one, two, three, four):
        assert stage.columns == corpus_pipeline.COLUMNS


def test_rows_with_repeated_and_null_ids(spark):
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first()["text"]
    long, other = "one two three four five six seven eight nine ten eleven", "red orange yellow green blue indigo violet black white"
    rows = [(7, long), (7, long), (None, long), (7, other), (8, other), (None, "alone " + long[::-1]), (9, "x " + item + " y"), (9, "clean words that stand for themselves here"), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    two = corpus_pipeline.deduplicated(spark, docs, DIR)
    got = sorted(((r["doc_id"], r["text"]) for r in two.collect()), key=str)
    assert got == sorted((rows[k] for k in one_of_each_group(rows)), key=str)
    three = corpus_pipeline.decontaminated(spark, two, DIR)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in three.collect()))) == sorted(str(r) for r in got if item not in r[1])


def test_predictions_take_effect_and_nothing_learned_loses_nothing(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, "the house and the garden " * 12, "en", "s", 1) if i % 2 else (i, "zwölf größere Züge für ßü " * 12, "de", "s", 1) for i in range(60)]
    odd = [(100, "the garden and the house", None, "s", 1), (101, "größere Züge", None, "s", 1), (102, "12 ..", None, "s", 1), (103, None, None, "s", 1)]
    docs = spark.createDataFrame(rows + odd, schema)
    langs = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identified(spark, docs, DIR).collect()}
    assert langs == {r[0]: r[2] for r in rows} | {100: "en", 101: "de"}
    unlabelled = corpus_pipeline.identified(spark, spark.createDataFrame(odd, schema), DIR)
    assert {r["doc_id"] for r in unlabelled.collect()} == {100, 101} and unlabelled.columns == corpus_pipeline.COLUMNS
    monkeypatch.setattr(corpus_pipeline, "LEAST_LEAD", 1.1)  # no score reaches it
    assert {r["doc_id"] for r in corpus_pipeline.identified(spark, docs, DIR).collect()} == {100, 101}  # too short to judge
