"""Whole-text encoding with a public word-BPE tokenizer, many texts at once.

The tokenizer never joins anything across white space, so a text's ids are its pre-tokens' ids in a row. A batch's
pre-tokens are found and grouped in numpy; each distinct one is looked up in a memo of bounded size or goes through
the tokenizers library. White-space chunks with an apostrophe, with "<|" or with characters outside ASCII and Latin-1
letters, whose lower-casing, composition or splitting may depend on their neighbours, go to the library whole.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np

from axisgauge.llm.bytesplit import blocks, owners, runs, span_hashes

#: Entries of the memo, and the longest key it keeps.
MOST, LONGEST = 400_000, 48
#: Bytes of text encoded at once.
BLOCK = 4 << 20
GAP, LETTER, DIGIT, OTHER, WHOLE = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 13, 32]] = GAP
KIND[65:91] = KIND[97:123] = LETTER
KIND[48:58] = DIGIT
KIND[128:] = WHOLE
KIND[:9] = KIND[11:13] = KIND[14:32] = KIND[127] = KIND[ord("'")] = WHOLE
#: Second bytes after 0xC3 (U+00C0 to U+00FF) that belong to letters: all but the signs for times and division.
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False


def pretokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, whether the library must see it as it is, and the lower-cased bytes."""
    kind, lower = KIND[data], data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[LATIN[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = LETTER
    upper = lead[data[lead + 1] < 0x9F] + 1
    lower[upper] += 32
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))  # may begin a special token's string
    kind[special] = WHOLE
    if (kind == WHOLE).any():
        starts, ends = runs(kind != GAP, bounds)
        seen = np.concatenate([[0], np.cumsum(kind == WHOLE)])
        odd = seen[ends] > seen[starts]
        mark = np.zeros(len(data) + 1, np.int8)
        np.add.at(mark, starts[odd], 1)
        np.add.at(mark, ends[odd], -1)
        whole = np.cumsum(mark[:-1]) > 0
        kind[whole], lower = WHOLE, np.where(whole, data, lower)
    begin = np.empty(len(kind), bool)
    begin[:1] = True
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin[bounds[:-1][bounds[:-1] < len(kind)]] = True
    at = np.flatnonzero(begin)
    ends = np.append(at[1:], len(kind))
    real = kind[at] != GAP
    return at[real], ends[real], kind[at[real]] == WHOLE, lower


def unicode_bytes() -> list[str]:
    """The character that byte-level BPE writes for each byte: printable ones stand for themselves, the others follow 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str, most: int = MOST):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chars = unicode_bytes()
        self.memo: dict[bytes, bytes] = {}
        self.most = most

    def whole(self, piece: bytes) -> bytes:
        return array("I", self.tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids).tobytes()

    def piece(self, piece: bytes) -> bytes:
        """Of a lower-cased pre-token; the library's model needs no further splitting."""
        text = piece.decode("ascii") if piece.isascii() else "".join(map(self.chars.__getitem__, piece))
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def looked_up(self, key: bytes, raw: bool) -> bytes:
        """raw: the key is a chunk for the whole library; it gets a mark, since a pre-token may have the same bytes."""
        mark = b"\0" + key if raw else key
        found = self.memo.get(mark)
        if found is None:
            found = self.whole(key) if raw else self.piece(key)
            if len(key) <= LONGEST:
                if len(self.memo) >= self.most:
                    self.memo.clear()
                self.memo[mark] = found
        return found

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Where each pre-token starts, which of the distinct ones it is, and their ids."""
        starts, ends, raw, lower = pretokens(data, bounds)
        keys = span_hashes(lower, starts, ends) ^ raw.astype(np.uint64)
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        held = lower.tobytes()
        found = [self.looked_up(held[s:e], r) for s, e, r in zip(starts[first].tolist(), ends[first].tolist(), raw[first].tolist(), strict=True)]
        return starts, back, found

    def block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        starts, back, found = self.pieces(data, bounds)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, at = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
        each = sizes[back]
        total = np.cumsum(each)
        ids = pool[np.repeat(at[back] - (total - each), each) + np.arange(int(total[-1]) if len(total) else 0)]
        per = owners(starts, bounds)
        return ids, np.diff(np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(per)])])

    def batch(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [np.zeros(0, np.uint32)], np.zeros(len(bounds) - 1, np.int64)
        for i, part, b, _ in blocks(data, bounds, BLOCK):
            ids, n = self.block(part, b)
            parts.append(ids)
            counts[i : i + len(n)] += n
        return np.concatenate(parts), counts


@functools.cache
def encoder(path: str, most: int = MOST) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(path, most)
