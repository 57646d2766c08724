"""Token ids of whole texts by a public tokenizer, the same as the tokenizers library gives for the whole text.

Most text is pieces that recur. The texts of a batch are cut into pieces by Arrow and the distinct ones numbered; a
worker looks up or works out the ids of each distinct piece once, and the ids of all texts are one gather by those
numbers. A text is cut only where the tokenizer's own pre-tokenisation must cut, whatever the neighbours are; a text
with white space beyond the plain cases is encoded whole. A piece of Latin letters, with at most some stops after it,
goes straight to the tokenizer's model: its normalisation is lower-casing or nothing, and its pre-tokens are the letters
and the stops.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidence.llm.common import by_bytes

#: Pieces a worker remembers before it forgets all but those of the slice at hand; and their size in bytes.
LIMIT, LIMIT_BYTES = 300_000, 16_000_000
#: Bytes of text (or one text) that are cut at once.
SLICE_BYTES = 4_000_000
#: Marks the cuts; a text that holds it is encoded whole.
_CUT = "\x00"
#: Texts that aren't words with one space or one line end between them; for the tokenizer that drops white space, only
#: those with control characters.
_ODD_GAPS = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_CONTROL = r"[\x00\x1c-\x1f]"
#: ASCII punctuation without the apostrophe: a run of it after letters is a pre-token of its own.
_MARKS = r"!-&(-/:-@\[-`{-~"
#: Latin letters with the space before them; a line end, those letters, and stops.
_STEM = r" ?[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž]+"
_WORD = rf"\A(?P<line>\n?)(?P<stem>{_STEM})(?P<marks>[{_MARKS}]*)\z"


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _byte_letters() -> list[str]:
    """The printable letter that byte-level models write for each byte: itself where printable, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


_LETTER = {i: c for i, c in enumerate(_byte_letters()) if i != ord("\n")}


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + size] one after another, and the end of each."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """ids(text): packed ids, without special tokens. batch(texts): those of many texts."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        #: Whether a space belongs to the word after it; else white space is dropped and letters are lower-cased.
        self.spaced = not self.model.end_of_word_suffix
        #: Pieces that are remembered, and of each where in flat its ids begin and how many they are.
        self.names = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def size(self) -> int:
        """Ids are below this."""
        return max(self.tokenizer.get_vocab().values(), default=0) + 1

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, stems: list[str]) -> list[list[int]]:
        """Ids of runs of letters."""
        text = "\n".join(stems)
        text = (text if self.spaced else text.lower()).encode().decode("latin-1").translate(_LETTER)
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(word)] for word in text.split("\n")] if stems else []

    def _new(self, names: pa.Array) -> list[list[int]]:
        letters = np.asarray(pc.match_substring_regex(names, rf"\A{_STEM}\z"))
        listed = names.to_pylist()
        known = iter(self._letters([x for x, own in zip(listed, letters.tolist(), strict=True) if own]))
        return [next(known) if own else self.tokenizer.encode(x, add_special_tokens=False).ids for x, own in zip(listed, letters.tolist(), strict=True)]

    def _places(self, names: pa.Array) -> np.ndarray:
        """Where the ids of each of these distinct pieces are, once those not remembered are worked out."""
        held = len(self.names)
        found = pc.index_in(names, value_set=self.names)
        lacking = names.filter(found.is_null())
        if len(lacking):
            new = self._new(lacking)
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            flat = np.frombuffer(packed([i for ids in new for i in ids]), "<u4")
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
            self.names = pa.concat_arrays([self.names, lacking.cast(pa.string())])
        places = np.asarray(found.fill_null(-1))
        places = np.where(places < 0, held + np.cumsum(places < 0) - 1, places)
        if len(self.names) > LIMIT or self.names.nbytes > LIMIT_BYTES:
            self.flat, ends = _gathered(self.flat, self.starts[places], self.sizes[places])
            self.names, self.sizes = names.cast(pa.string()), self.sizes[places]
            self.starts, places = ends - self.sizes, np.arange(len(names))
        return places

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if not self.spaced:
            return pc.utf8_split_whitespace(texts)
        for gap in (" ", "\n"):
            texts = pc.replace_substring(texts, gap, _CUT + gap)
        return pc.split_pattern(texts, _CUT)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null) one after another, and where each text begins, with the end at last."""
        odd = pc.match_substring_regex(texts, _ODD_GAPS if self.spaced else _ODD_CONTROL)
        listed = self._cut(pc.if_else(odd, "", texts))
        ends = np.asarray(listed.offsets) - listed.offsets[0].as_py()
        numbered = listed.flatten().dictionary_encode()
        words = numbered.dictionary
        found = pc.extract_regex(words, _WORD)
        # A piece is a line end, letters and stops, each of which may be nothing; or one that can't be taken apart.
        parts = [pc.fill_null(pc.struct_field(found, "line"), ""), pc.coalesce(pc.struct_field(found, "stem"), words), pc.fill_null(pc.struct_field(found, "marks"), "")]
        names = pa.concat_arrays(parts).dictionary_encode()
        places = self._places(names.dictionary)[np.asarray(names.indices)].reshape(3, -1).T.ravel()
        flat, _ = _gathered(self.flat, self.starts[places], self.sizes[places])
        sizes = self.sizes[places].reshape(-1, 3).sum(1)
        starts = np.cumsum(sizes) - sizes
        which = np.asarray(numbered.indices)
        ids, at = _gathered(flat, starts[which], sizes[which])
        at = np.concatenate([[0], at])[ends]
        rest = np.flatnonzero(np.asarray(odd))
        if len(rest):
            whole = {i: np.frombuffer(self.whole(texts[i].as_py()), "<u4") for i in rest.tolist()}
            each = [whole[i] if i in whole else ids[at[i] : at[i + 1]] for i in range(len(texts))]
            at = np.cumsum([0, *map(len, each)])
            ids = np.concatenate(each)
        return ids, at

    def ids(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids of a slice of (doc_id, text), all its ids with end_id after each text, and where each text begins, with the end at last."""
    encode = encoder(path)
    for part in by_bytes(batches, SLICE_BYTES):
        ids, starts = encode.batch(part.column("text").chunk(0))
        yield part.column("doc_id").chunk(0), np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))
