import hashlib

import pytest
from pyspark.sql import functions as F

from evidence.llm import winnowing
from evidence.llm.queries import op13_fingerprints


def picked(hashes):
    """Every window's least hash, the rightmost of equal ones, with its place."""
    out = []
    for i in range(max(1, len(hashes) - winnowing.WINDOW + 1)):
        window = hashes[i : i + winnowing.WINDOW]
        least = min(window)
        point = (least, i + max(j for j, x in enumerate(window) if x == least))
        if out[-1:] != [point]:
            out.append(point)
    return out


def grams(text):
    data = text.encode()
    return [data[i : i + winnowing.GRAM] for i in range(max(1, len(data) - winnowing.GRAM + 1))] if data else []


def fingerprints(spark, texts):
    """Of each text, by brute force; gram hashes are Spark's own."""
    every = sorted({g for t in texts for g in grams(t)})
    rows = spark.createDataFrame([(g,) for g in every], "g binary").select("g", F.shiftright(F.xxhash64("g"), winnowing.PLACE).bitwiseAND((1 << winnowing.HASH) - 1).alias("h")).collect()
    hashed = {bytes(r["g"]): r["h"] for r in rows}
    return {t: picked([hashed[g] for g in grams(t)]) if t else [] for t in texts}


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(spark, rows):
    """rows: doc_id, text, in their order. Sorted (doc_id, n_chars, digest, points, edited points, near edited, near next)."""
    texts = [t or "" for _, t in rows]
    after = [texts[(i + 1) % len(texts)] for i in range(len(texts))]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, after, strict=True)]
    of = fingerprints(spark, {*texts, *edited})
    return [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), of[t], of[e], alike(of[t], of[e]), alike(of[t], of[n])) for (i, _), t, e, n in zip(rows, texts, edited, after, strict=True)]


def found(df):
    points = lambda c: [tuple(p) for p in c]
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], points(r["points"]), points(r["edited_points"]), r["near_edited"], r["near_next"]) for r in df.collect()]


def test_documents(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(found(winnowing.fingerprints(docs))) == sorted(expected(spark, rows))


def test_query(spark, small, docs):
    got = op13_fingerprints(spark, small).collect()
    assert len(got) == docs.count()
    long = [r for r in got if r["n_chars"] > 2000]
    assert long and sum(r["near_edited"] > 0.4 for r in long) > 0.8 * len(long)
    texts = dict(docs.select("doc_id", "text").collect())
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({v for s in by_text.values() for v in s}) > 0.9 * len(by_text)


def test_odd_texts(spark):
    """Null and empty texts, one code point, one gram, ties, code points of two units, rows without doc_id, clashing columns."""
    texts = [None, "", "a", "abc", "0123456789abcdef", "ab" * 40, "x" * 3000, "😀é" * 400, "\n" * 300, "abcdefg hijk lm " * 60, "".join(chr(97 + i * i % 23) for i in range(5000))]
    rows = [(None, "no id at all, but a text " * 9)] + list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, h string, q int, times int").repartition(5)
    assert sorted(found(winnowing.fingerprints(df)), key=repr) == sorted(expected(spark, rows), key=repr)
    assert winnowing.fingerprints(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a single document " * 20)], "doc_id long, text string")
    assert found(winnowing.fingerprints(one)) == expected(spark, [(1, "a single document " * 20)])


def test_repeated_rows(spark):
    """Copies of a row follow each other, the last is followed by the next document; one text under two ids stays two."""
    rows = [(1, "first text here " * 8)] * 5 + [(2, "second text there " * 9)] + [(3, "first text here " * 8)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(found(winnowing.fingerprints(df))) == sorted(expected(spark, rows))


@pytest.mark.parametrize("at", [0, 17, 191, 192, 500])
def test_guarantee(spark, at):
    """A shared run of GRAM + WINDOW - 1 bytes shares a hash, and inside the run in both texts."""
    run = "".join(chr(0x61 + (i * i + 3 * i) % 26) for i in range(winnowing.GRAM + winnowing.WINDOW - 1))
    left, right = "L" + "".join(chr(0x410 + (i * 7) % 32) for i in range(at)) + run + "q" * 300, "".join(chr(0x3B1 + (i * 5) % 24) for i in range(2 * at + 9)) + run + "z"
    a, b = (r["f"] for r in spark.createDataFrame([(0, left), (1, right)], "i int, t string").select("i", winnowing.fingerprint(F.col("t")).alias("f")).orderBy("i").collect())
    def inside(points, text):
        at = text.encode().index(run.encode())
        return {p["hash"] for p in points if at <= p["pos"] <= at + winnowing.WINDOW - 1}

    assert inside(a, left) & inside(b, right)
