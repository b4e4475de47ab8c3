"""License scans against a plain scoring of every line and file with every template, without prefilters."""

import math
import random
import re
from collections import Counter

from axisgauge.llm import licenses


def plain(rows):
    """(licence, found, score) of each row before inheritance, by the module's definition."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    df = Counter(t for _, _, text in rows for t in set(split(text)))
    idf = lambda t: math.log((1 + len(rows)) / (1 + df[t])) + 1

    def scores(text, templates):
        own = Counter(split(text))
        known = {t for v in templates.values() for x in v for t in split(x)}
        length = math.sqrt(sum((n * (idf(t) if t in known else math.log(1 + len(rows)) + 1)) ** 2 for t, n in own.items()))
        out = []
        for licence, texts in templates.items():
            for x in texts:
                w = {t: n * idf(t) for t, n in Counter(split(x)).items()}
                dot = sum(own[t] * idf(t) * v for t, v in w.items() if t in own)
                out.append((-round(dot / length / math.sqrt(sum(v * v for v in w.values())), 6) if length else 0.0, licence))
        return min(out)

    full, out = licenses.full_texts(), []
    for _, _, text in rows:
        whole_full, whole_line = scores(text, full), scores(text, licenses.TEMPLATES)
        best = min((scores(line, licenses.TEMPLATES) for line in re.split(r"[\n\r]+", text or "")), default=(0.0, ""))
        if -whole_full[0] >= licenses.FULL:
            out.append((whole_full[1], "file", -whole_full[0]))
        elif -whole_line[0] >= licenses.WHOLE:
            header = best if -best[0] >= licenses.HEADER else whole_line
            out.append((header[1], "file", -header[0]))
        elif -best[0] >= licenses.HEADER:
            out.append((best[1], "header", -best[0]))
        else:
            out.append((None, "none", None))
    return out


def test_every_match_of_plain_scoring_is_found(spark):
    rng = random.Random(3)
    lines = [x for v in licenses.TEMPLATES.values() for x in v]
    words = "the of and under license licensed version code file public general open source is work this to alpha beta gamma delta".split()
    noise = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(240):
        line = rng.choice(lines).split()
        for _ in range(rng.randrange(5)):  # words lost, changed, added
            k = rng.randrange(len(line))
            line[k : k + 1] = rng.choice([[], [rng.choice(words)], [line[k], rng.choice(words)]])
            line = line or ["x"]
        text = {0: " ".join(line), 1: noise(30) + "\n" + " ".join(line) + "\n" + noise(60), 2: noise(40), 3: None if i % 8 == 3 else ""}[i % 4]
        rows.append((i // 2 if i % 10 < 2 else i, "/one/path" if i % 10 < 2 else f"/d{i}/f", text))  # some share their id and path
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, path string, text string, licence string, file int")
    got = licenses.scan(df).collect()
    own = sorted((r["doc_id"], r["path"], r["licence"], r["found"], round(r["score"] or 0, 4)) for r in got if r["found"] in ("file", "header"))
    want = sorted((i, p, *o[:2], round(o[2], 4)) for (i, p, _), o in zip(rows, plain(rows), strict=True) if o[0])
    assert len(got) == len(rows) and len(want) > 60 and own == want  # recall and precision 1


def test_two_files_with_one_id_and_path_keep_their_own_licences(spark):
    rows = [(1, "/a/x", "Released under the MIT License."), (1, "/a/x", "plain words without any"), (1, "/a/x", "plain words without any")]
    got = sorted((r["licence"], r["found"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == [("MIT", "file"), ("MIT", "inherited"), ("MIT", "inherited")]
