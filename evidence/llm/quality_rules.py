"""Quality rules by distribution divergence.

Each text has two histograms: of character classes and of common words. Both are compared, by Jensen-Shannon
distance (base 2, so 0 to 1), with references of the languages; the closest language counts. A reference is the
component-wise median, over all documents of a language that pass the base rules and the length guard, of their
histograms, made to sum to 1; a minority of junk, however extreme, can't drag a median. A language makes a reference only
with MIN_DOCS such documents, and a thousandth of them all, so no text is its own reference and there are at most a
thousand. A text too short for a histogram to be stable isn't judged by it (the minimum-length guards); nor are the words
of a text whose language has no reference, but its characters are.

Defined cases: a null or empty text has no words, fails the base rules and is not kept. A null language is a
language of its own. With no document to learn references from, only the base rules decide. Repeated rows are
judged alike, each by itself. Other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import SLICE, batch_of, materialise, rows, texts
from evidence.llm.textstats import BINS, CLASSES, Stats

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents behind a reference, and their share of all that could be.
MIN_DOCS, MIN_SHARE = 10, 1e-3
#: Guards: fewer words or characters than these are too few for the histogram.
GUARD_WORDS, GUARD_CHARS = 80, 200
#: Largest Jensen-Shannon distances from the closest language, each alone and both together.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MAX_SUM = 0.30, 0.42, 0.44

_COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = f"{_COUNTS}, base_failed boolean, classes array<int>, bins array<int>"


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def _measure(batches):
    for part in rows(batches):
        out = []
        for doc_id, text, lang in part:
            s = Stats(text)
            out.append((doc_id, lang, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, base_failed(s.n_words, s.n_repeat_words), s.classes.tolist(), s.bins.tolist()))
        yield batch_of(out, _ARROW)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
    + [("base_failed", pa.bool_()), ("classes", pa.list_(pa.int32())), ("bins", pa.list_(pa.int32()))]
)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, along the last axis; p and q sum to 1 there."""
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(-1)

    return np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2))


class References(NamedTuple):
    """Of each language with enough documents: its name, its class histogram and its word histogram."""

    langs: list
    classes: np.ndarray
    bins: np.ndarray

    def has(self, langs: list) -> np.ndarray:
        return np.array([x in self.langs for x in langs], bool)


def references(measured: DataFrame) -> References:
    """One row a language with enough documents reaches the driver."""
    usable = measured.where(~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS))
    share = lambda c, k, total: (F.col(c)[k] / total).alias(f"{c}{k}")
    total = F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    narrow = usable.select("lang", *(share("classes", k, total) for k in range(len(CLASSES))), *(share("bins", k, F.col("n_words")) for k in range(len(BINS) + 1)))
    names = narrow.columns[1:]
    each = usable.groupBy("lang").count()
    least = max(MIN_DOCS, math.ceil((each.agg(F.sum("count")).first()[0] or 0) * MIN_SHARE))
    enough = [r["lang"] for r in each.where(F.col("count") >= least).select("lang").collect()]
    own = F.col("lang").isin([x for x in enough if x is not None]) | (F.lit(None in enough) & F.col("lang").isNull())
    found = narrow.where(own).groupBy("lang").agg(*(F.percentile_approx(c, 0.5, 1000).alias(c) for c in names)).orderBy("lang").collect()
    a = np.array([[r[c] or 0.0 for c in names] for r in found], float).reshape(len(found), len(names))
    unit = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1e-12)
    return References([r["lang"] for r in found], unit(a[:, : len(CLASSES)]), unit(a[:, len(CLASSES) :]))


def distances(classes: np.ndarray, bins: np.ndarray, refs: References) -> tuple[np.ndarray, np.ndarray]:
    """Of each text (a row of counts), the distance of either histogram to the closest language."""
    unit = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1)
    return tuple(js_distance(unit(x)[:, None, :], r[None]).min(1) if len(r) else np.zeros(len(x)) for x, r in ((classes, refs.classes), (bins, refs.bins)))


def diverges(dc: np.ndarray, dw: np.ndarray, enough_chars: np.ndarray, enough_words: np.ndarray) -> np.ndarray:
    return (enough_chars & (dc > MAX_CLASS_DISTANCE)) | (enough_words & (dw > MAX_WORD_DISTANCE)) | (enough_chars & enough_words & (dc + dw > MAX_SUM))


def judge(measured: DataFrame, refs: References) -> DataFrame:
    """measured with class_distance, word_distance and kept in place of the histograms."""
    schema = f"{_COUNTS}, base_failed boolean, class_distance double, word_distance double, kept boolean"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c, k: np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, k)  # noqa: B023, E731
            classes, bins = get("classes", len(CLASSES)), get("bins", len(BINS) + 1)
            dc, dw = distances(classes, bins, refs)
            n_words = batch.column("n_words").to_numpy(zero_copy_only=False)
            bad = diverges(dc, dw, classes.sum(1) >= GUARD_CHARS, (n_words >= GUARD_WORDS) & refs.has(batch.column("lang").to_pylist()))
            failed = np.array(batch.column("base_failed").to_pylist(), bool)
            counts = [batch.column(c) for c in _ARROW.names[:8]]
            yield pa.RecordBatch.from_arrays([*counts, pa.array(dc), pa.array(dw), pa.array(~failed & ~bad)], names=[*_ARROW.names[:8], "class_distance", "word_distance", "kept"])

    return measured.mapInArrow(run, schema)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each document: its counts, base_failed, the two distances, kept."""
    measured = materialise(texts(docs, "lang").mapInArrow(_measure, _SCHEMA))
    return judge(measured, references(measured))


def keep_ruled(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep; each judged where it lies."""
    measured = materialise(texts(docs, "lang").mapInArrow(_measure, _SCHEMA))
    refs = references(measured)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                stats = [Stats(t or "") for t in part.column(names.index("text")).to_pylist()]
                classes, bins = (np.array([getattr(s, c) for s in stats], float) for c in ("classes", "bins"))
                dc, dw = distances(classes, bins, refs)
                n_words = np.array([s.n_words for s in stats])
                failed = np.array([base_failed(s.n_words, s.n_repeat_words) for s in stats])
                enough_words = (n_words >= GUARD_WORDS) & refs.has(part.column(names.index("lang")).to_pylist())
                yield part.filter(pa.array(~failed & ~diverges(dc, dw, classes.sum(1) >= GUARD_CHARS, enough_words)))

    return docs.mapInArrow(run, docs.schema)
