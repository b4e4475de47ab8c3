"""Secret scans: three patterns, and strings in a sensitive context that a dictionary-primed compressor finds new.

Of every whole text: `assign` (a value given to a sensitive name), `access` (AKIA keys) and `hex` (long runs of hex digits)
are matched by pattern; a span is the whole match, from its first to behind its last code point. Then `novel`: a
candidate is a run of secret characters with letters and digits, with a sensitive word shortly before it. It is measured
by Zstandard, primed with a dictionary of common identifiers: the surrounding text is compressed with and without the
candidate behind it, and the difference is the candidate's marginal size. Names and paths that occur nearby or in the dictionary
cost little, words of the text's own alphabet more, and random strings `BITS` or more for each of their bytes; those are
reported, unless a pattern has found them already.

Texts are read row by row in Arrow batches, without a shuffle; a candidate's work is bounded by its own length and
`AROUND` code points on each side.

Defined results: null text counts as empty and has no spans (the digest is that of an empty text); null and repeated ids
come back as they are, row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The least length: of an assigned value, an access key, a hex run, and a novel string.
ASSIGNED, ACCESS, HEX, NOVEL = 12, 18, 16, 12
ASSIGN_PATTERN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
#: Runs of hex digits and of key characters are taken whole, so a least length in the pattern drops the same runs as one afterwards.
ACCESS_PATTERN = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS - 4},}}")
HEX_PATTERN = re.compile(rf"[0-9a-f]{{{HEX},}}")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{NOVEL},}}")
#: Code points before a candidate in which a sensitive word must stand, and code points on each side that it is measured against.
BEFORE, AROUND = 64, 256
#: Bits for each byte from which a candidate is novel. Measured in 400 places each of prose and of code: 98 % of random strings
#: of 12 letters and digits cost 6.0 or more, of 20 and more 6.4 or more; of three identifiers and paths from the dictionary's
#: field 98 % cost 6.2 at most. A word with digits that is neither in the dictionary nor like its surroundings is novel too.
BITS = 6.0
#: A candidate has at least so many letters and so many digits, so that words, dates and numbers are none.
LETTERS, DIGITS = 2, 1
SENSITIVE = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access", "key", "credential", "auth", "bearer", "private", "signature", "session", "cookie", "login"]
ASSIGNING = ["password", "passwd", "secret", "token", "apikey", "api_key"]
#: Priming text: identifiers, values and paths that are common in code and settings.
IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 2020-01-01T00:00:00 127.0.0.1 localhost:8080 application/json text/html utf-8
/usr/local/lib/python /home/user/ /var/log/ /etc/ https://www.example.com/ http://localhost site-packages node_modules index.html README.md
import from class public private protected static final void const function return if else for while try except raise catch throw new delete
true false null None undefined self this string integer boolean double float array list object default value values name type size length count
index item items key keys map filter reduce config configuration settings environment variable parameter argument option version release build
module package require export include namespace directory filename path resource endpoint client server service host port timeout connection
database table column query request response header content message status error exception warning debug information description license author
user username user_name getUserName setUserName email address account identifier session_id request_id client_id client_secret access_token
refresh_token auth_token api_key apiKey secret_key private_key public_key password_hash passwordHash certificate signature credential encrypted
Bearer Basic Authorization Content-Type cookie session login logout token secret password placeholder example changeme your_api_key_here
max_retry_count default_value test_data lorem ipsum
"""
KINDS = ["assign", "access", "hex", "novel"]


class Scanner:
    def __init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def bits(self, before: str, candidate: str, after: str) -> float:
        """The candidate's marginal size in its surroundings, in bits for each of its bytes."""
        around, own = (after + before).encode(), candidate.encode()  # the candidate last, so that it parts nothing that goes together
        return 8 * (len(self.compressor.compress(around + own)) - len(self.compressor.compress(around))) / len(own)

    def base(self, text: str, lowered: str) -> list[tuple[int, int, int]]:
        """(start, kind, end), in order."""
        found = []
        if any(w in lowered for w in ASSIGNING):
            found += [(m.start(), 0, m.end()) for m in ASSIGN_PATTERN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS_PATTERN.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX_PATTERN.finditer(text)]
        return sorted(found)

    def novel(self, text: str, lowered: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not any(w in lowered for w in SENSITIVE):
            return []
        found, i, reach = [], 0, -1  # reach: how far the base spans that start before a candidate's end go
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            c = m[0]
            while i < len(base) and base[i][0] < end:
                reach = max(reach, base[i][2])
                i += 1
            if reach > start or sum(x.isalpha() for x in c) < LETTERS or sum(x.isdigit() for x in c) < DIGITS:
                continue
            near = text[max(0, start - BEFORE) : start].lower()
            if any(w in near for w in SENSITIVE) and self.bits(text[max(0, start - AROUND) : start], c, text[end : end + AROUND]) >= BITS:
                found.append((start, 3, end))
        return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel: a row for each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            counts, digests, spans = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                lowered = text.lower()
                base = scanner.base(text, lowered)
                new = scanner.novel(text, lowered, base)
                kinds = [k for _, k, _ in base]
                counts.append((*(kinds.count(k) for k in range(3)), len(new)))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted([*base, *new])))
            n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), n[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
