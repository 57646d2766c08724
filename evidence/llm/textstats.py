"""Statistics of one text that the quality rules and the quality classifier both read."""

from __future__ import annotations

import numpy as np

from evidence.llm.common import words

# Closed-class words that are common in running text.
COMMON = {
    "en": "the of and to in is that for it was as with be on by at an are this from a or his not have which".split(),
    "fr": "de la le et les des en un du une est que pour qui dans a par plus pas au sur ne se avec elle".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an wird aus er".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o este".split(),
}
#: One bin for each common word of any language, in order; the last bin is for all other words.
BINS = sorted({w for ws in COMMON.values() for w in ws})
_BIN = {w: i for i, w in enumerate(BINS)}
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "punct", "symbol", "other")


def _class_of() -> np.ndarray:
    """Class of each UTF-8 byte; continuation bytes have none (-1), other bytes above ASCII are one character each."""
    out = np.full(256, CLASSES.index("punct"))
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\r\x0b\x0c"), ("line", "\n"), ("stop", ".,"), ("symbol", "#*$%&|<>=+^~`_{}[]\\/@")):
        out[[ord(c) for c in chars]] = CLASSES.index(name)
    out[0xC0:] = CLASSES.index("other")
    out[0x80:0xC0] = -1
    return out


_CLASS_OF = _class_of()
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_ONE_HOT = np.stack([_CLASS_OF == k for k in range(len(CLASSES))]).astype(np.int64)


def byte_counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that lie in some 3-word window which the text holds twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1].astype(np.int64) * n_distinct + ids[1:]
    if n_distinct > 1_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * n_distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[k : k + len(key)] |= twice
    return int(marked.sum())


class Stats:
    """Counts of one text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, classes, bins, bytes."""

    __slots__ = ("bins", "bytes", "classes", "distinct", "n_dup_lines", "n_lines", "n_repeat_words", "n_symbols", "n_words", "top", "word_chars", "words")

    def __init__(self, text: str):
        self.words = ws = words(text)
        self.n_words = len(ws)
        self.word_chars = sum(map(len, ws))
        self.bytes = byte_counts(text)
        self.n_symbols = int(self.bytes[_SYMBOLS].sum())
        self.classes = _ONE_HOT @ self.bytes
        seen: set[str] = set()
        dup = n_lines = 0
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line and words(line):
                seen.add(line)
                n_lines += 1
        self.n_dup_lines, self.n_lines = dup, n_lines + dup
        ids_of: dict[str, int] = {}
        ids = np.fromiter((ids_of.setdefault(w, len(ids_of)) for w in ws), np.int64, len(ws))
        self.distinct = len(ids_of)
        self.n_repeat_words = repeated_words(ids, len(ids_of))
        counts = np.bincount(ids, minlength=1)
        self.top = int(counts.max())
        bins = np.zeros(len(BINS) + 1, np.int64)
        for w, k in ids_of.items():
            if len(w) < 6 and (b := _BIN.get(w) if w.islower() else _BIN.get(w.lower())) is not None:
                bins[b] += counts[k]
        bins[-1] = self.n_words - bins.sum()
        self.bins = bins
