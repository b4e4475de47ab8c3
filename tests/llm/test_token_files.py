"""Starts follow the files' numbers, not their names."""

import os

import public_tokenizers

from axisgauge.llm import token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_starts_with_numbers_beyond_five_digits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_OF_FILES", 2)
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(60)], "doc_id long, text string")
    folder = f"{tmp_path}/tokens"
    token_output.write_tokens(docs, folder, PATH, files=5)
    for name in os.listdir(folder):
        if name.startswith("part-"):
            os.rename(f"{folder}/{name}", f"{folder}/part-{99_998 + int(name[5:10])}{name[10:]}")
        elif name.endswith(".crc"):
            os.remove(f"{folder}/{name}")
    assert {len(n.split("-")[1]) for n in os.listdir(folder) if n.startswith("part-")} == {5, 6}
    start = 0
    for r in token_output.token_index(spark, folder).orderBy("doc_id").collect():
        assert (r["start"], r["n_tokens"]) == (start, r["doc_id"] % 7 + 1)
        start += r["n_tokens"]


def test_files_follow_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "MOST", 1000)
    monkeypatch.setattr(token_output, "LEAST", 100)
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(100)], "doc_id long, text string")
    token_output.write_tokens(docs, f"{tmp_path}/a", PATH)
    token_output.write_tokens(docs.limit(1), f"{tmp_path}/b", PATH)
    count = lambda d: sum(n.startswith("part-") for n in os.listdir(f"{tmp_path}/{d}"))
    assert count("a") == 10 and count("b") == 1
