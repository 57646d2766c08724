import re
import zlib

import numpy as np
import pytest

from evidence.llm import quality_classifier as qc
from evidence.llm import quality_rules as qr
from evidence.llm.textstats import Stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The four counts and n_words by their definition."""
    text = text or ""
    ws = WORD.findall(text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = {g: grams.count(g) for g in set(grams)} if len(grams) < 3000 else None
    if times is None:
        from collections import Counter

        times = Counter(grams)
    marked = {j for i, g in enumerate(grams) if times[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(ws)
    return n, sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_base_counts(request, which):
    df = request.getfixturevalue(which)
    got = sorted(map(repr, ((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in qr.quality_rules(df).collect())))
    assert got == sorted(repr((r["doc_id"], *base(r["text"]))) for r in df.collect())


def test_distance_by_definition():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.4, 0.5])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert qr.js_distance(p, q) == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))
    assert qr.js_distance(p, p) == 0 and qr.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_verdicts_by_brute_force(docs):
    """References, distances and verdicts again, over all texts at once."""
    rows = docs.collect()
    stats = {r["doc_id"]: Stats(r["text"]) for r in rows}
    usable = {}
    for r in rows:
        s = stats[r["doc_id"]]
        if not qr.base_failed(s.n_words, s.n_repeat_words) and s.n_words >= qr.GUARD_WORDS:
            usable.setdefault(r["lang"], []).append((s.classes / s.classes.sum(), s.bins / s.n_words))
    # percentile_approx takes an element, the lower at an even count
    low = lambda x: np.sort(np.array(x), 0)[(len(x) - 1) // 2]
    usable = {k: v for k, v in usable.items() if len(v) >= max(qr.MIN_DOCS, qr.MIN_SHARE * sum(map(len, usable.values())))}
    refs = [(low([a for a, _ in v]), low([b for _, b in v])) for v in usable.values()]
    refs = [(a / a.sum(), b / b.sum()) for a, b in refs]
    for r in qr.quality_rules(docs).collect():
        s = stats[r["doc_id"]]
        dc = min(qr.js_distance(s.classes / max(s.classes.sum(), 1), a) for a, _ in refs)
        dw = min(qr.js_distance(s.bins / max(s.n_words, 1), b) for _, b in refs)
        assert (r["class_distance"], r["word_distance"]) == pytest.approx((dc, dw), abs=1e-9)
        bad = dc > qr.MAX_CLASS_DISTANCE and s.classes.sum() >= qr.GUARD_CHARS or s.n_words >= qr.GUARD_WORDS and r["lang"] in usable and (dw > qr.MAX_WORD_DISTANCE or s.classes.sum() >= qr.GUARD_CHARS and dc + dw > qr.MAX_SUM)
        assert r["kept"] == (not r["base_failed"] and not bad)


def test_rules_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = qr.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.1


def test_stages_keep_rows_whole(odd_docs, no_docs, labels):
    for stage in (qr.keep_ruled, lambda d: qc.keep_good(d, labels)):
        kept = stage(odd_docs)
        assert kept.schema == odd_docs.schema and {repr(r) for r in kept.collect()} <= {repr(r) for r in odd_docs.collect()}
        assert stage(no_docs).count() == 0
    assert sorted(str(r["doc_id"]) for r in qr.keep_ruled(odd_docs).collect()) == sorted(str(r["doc_id"]) for r in qr.quality_rules(odd_docs).where("kept").collect())
    assert qr.quality_rules(no_docs).count() == 0


def test_classifier_on_rows_held_out(spark):
    d = "/root/testdata/sf0.01"
    gold = spark.read.parquet(f"{d}/labels.parquet")
    got = qc.quality_classifier(spark.read.parquet(f"{d}/documents.parquet"), gold).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and (got.predicted == (got.score >= 0.3)).all()
    test = got[got.held_out].merge(gold.toPandas(), on="doc_id")
    assert (test.predicted == test.quality).mean() > 0.95


def test_normal_equations_by_brute_force(docs, labels):
    """The ridge weights again, from one matrix."""
    from pyspark.sql import functions as F

    measured = docs.select("doc_id", "text").mapInArrow(qc._extract, "doc_id long, x array<double>")
    model = qc.fit(measured, labels)
    rows = measured.join(labels, "doc_id").select("doc_id", "x", "quality").collect()
    fitting = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 in (1, 2, 3)]
    x, y = np.array([r["x"] for r in fitting]), np.array([r["quality"] for r in fitting], float)
    assert model.mean == pytest.approx(x.mean(0)) and F is not None
    z = model.z(x)
    penalty = qc.RIDGE * len(x) * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    assert z @ model.weights == pytest.approx(z @ np.linalg.solve(z.T @ z + penalty, z.T @ y), abs=1e-6)


def test_isotonic_by_brute_force():
    rng = np.random.default_rng(0)
    y, w = rng.random(30), rng.integers(1, 5, 30).astype(float)
    at, value = qc.isotonic(np.arange(30.0), y, w)
    assert (np.diff(value) > 0).all()
    # the max-min formula of isotonic regression
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert sorted({round(v, 9) for v in want}) == [round(v, 9) for v in value]


def test_classifier_without_labels(odd_docs, no_docs, labels):
    got = qc.quality_classifier(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in got} == {0.5} and len(got) == odd_docs.count()
    assert qc.quality_classifier(no_docs, labels).count() == 0
    assert qc.quality_classifier(odd_docs, labels.limit(1).union(labels.limit(1))).count() == odd_docs.count()


def test_a_language_of_few_documents_is_no_reference(spark, docs):
    """Junk isn't its own reference, and a clean text of a rare language isn't judged by others' words."""
    junk = " ".join("#$%&" * 3 + str(i * 7919) for i in range(300))
    rng = np.random.default_rng(8)
    parts = "zor van kelt mi ru do pa len qua tosk vi ber sha no ti".split()
    clean = " ".join("".join(rng.choice(parts, rng.integers(1, 4))) + (". " if i % 9 == 8 else "") for i in range(300))
    more = spark.createDataFrame([(9_000_001, junk, "zz"), (9_000_002, clean, "yy"), (9_000_003, junk, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in qr.quality_rules(docs.select("doc_id", "text", "lang").union(more)).collect()}
    assert (got[9_000_001], got[9_000_002], got[9_000_003]) == (False, True, False)
