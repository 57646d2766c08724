from collections import Counter

import numpy as np
import pytest

from evidence.llm import dart_minhash as dm
from tests.metrics import last_execution, total


def bag(text):
    ws = (text or "").split()
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def classes_by_brute_force(rows, similarity=0.8):
    """Sorted (doc_id, class_id) of rows (doc_id, text): components of all pairs by exact bags of word 5-shingles."""
    bags, label = [bag(t) for _, t in rows], list(range(len(rows)))
    sizes = [sum(b.values()) for b in bags]

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            if sizes[i] and min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]):
                shared = sum((a & bags[j]).values())
                if shared / (sizes[i] + sizes[j] - shared) >= similarity:
                    x, y = sorted((find(i), find(j)))
                    label[y] = x
    named = {}
    for i, (d, _) in enumerate(rows):
        c = find(i)
        named[c] = d if named.get(c) is None else named[c] if d is None else min(d, named[c])
    return sorted(((d, named[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in dm.near_duplicates(df).collect()), key=repr)


def of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_classes_of_documents(docs):
    assert result(docs) == classes_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_large_group_of_near_copies(spark):
    """Copies with 0 to 6 edits, so that many pairs are just above and just below the threshold."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(150):
        own = list(words)
        for e in range(d % 7):
            own[int(rng.integers(0, 120))] = f"x{d}_{e}"
        texts[d * 3] = " ".join(own)
    df = of(spark, list(texts.items()))
    want = classes_by_brute_force(list(texts.items()))
    assert len({c for _, c in want}) > 2
    assert result(df) == want
    try:  # the block path, which larger buckets take
        before = dm.FEW_PAIRS, dm.X_BLOCK, dm.Y_BLOCK, dm.PIVOTS
        dm.FEW_PAIRS, dm.X_BLOCK, dm.Y_BLOCK, dm.PIVOTS = 0, 16, 32, 0
        assert result(df) == want
    finally:
        dm.FEW_PAIRS, dm.X_BLOCK, dm.Y_BLOCK, dm.PIVOTS = before


def test_odd_documents(odd_docs, no_docs):
    assert result(odd_docs) == classes_by_brute_force([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert dm.near_duplicates(no_docs).count() == 0 == dm.one_of_each(no_docs).count()


def test_short_texts(spark):
    assert result(of(spark, [(1, "a b"), (2, "a  b\n"), (3, "b a"), (4, "a b c d e"), (5, "a b c d e")])) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)]


A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")


@pytest.mark.parametrize("hot", [1, 100_000])
def test_rows_that_repeat_a_doc_id(spark, hot, monkeypatch):
    """Each row has the class of its own text, and no text is lost."""
    monkeypatch.setattr(dm, "HOT", hot)
    df = of(spark, [(1, A), (2, A), (2, B), (3, C), (3, C), (None, C), (None, "x y"), (None, "x y"), (4, None), (4, " "), (5, B + " end")])
    assert result(df) == sorted([(1, 1), (2, 1), (2, 2), (3, 3), (3, 3), (None, 3), (None, None), (None, None), (4, 4), (4, 4), (5, 2)], key=repr)
    left = sorted(((r["doc_id"], r["text"]) for r in dm.one_of_each(df).collect()), key=repr)
    assert left == sorted([(1, A), (2, B), (3, C), (None, "x y"), (4, None), (4, " ")], key=repr)


def test_weights_count(spark):
    """The same shingles, but one text has them ten times: alike as sets, unlike as bags."""
    ten, one = " ".join(["a b c d e f g"] * 10), "a b c d e f g a b c d e f"
    assert set(bag(ten)) - set(bag(one)) == set() and result(of(spark, [(1, ten), (2, one)])) == [(1, 1), (2, 2)]
    nine = " ".join(["a b c d e f g"] * 9)
    assert result(of(spark, [(1, ten), (2, nine), (3, one)])) == [(1, 1), (2, 1), (3, 3)]


def test_occurrences_make_bags_sets():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = (np.sort(u[:200]), rng.integers(1, 6, 200)), (np.sort(u[100:]), rng.integers(1, 6, 200))
    x, y = Counter(dict(zip(*map(np.ndarray.tolist, a), strict=True))), Counter(dict(zip(*map(np.ndarray.tolist, b), strict=True)))
    assert len(np.intersect1d(dm.occurrences(*a), dm.occurrences(*b))) == sum((x & y).values())
    assert len(np.unique(dm.occurrences(*a))) == sum(x.values())


@pytest.mark.parametrize("weights", [None, (1.5, 3.0), (0.3, 0.2)])
def test_agreement_is_weighted_similarity(weights):
    rng = np.random.default_rng(0)
    u = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = u[:600], u[200:]
    agreed = []
    for shift in range(8):
        es = np.concatenate([dm.mix(a + np.uint64(shift)), dm.mix(b + np.uint64(shift))])
        ws = None if weights is None else np.concatenate([np.full(600, weights[0]), np.full(800, weights[1])])
        s = dm.sketch(es, np.repeat([0, 1], [600, 800]), 2, ws)
        agreed.append((s[0] == s[1]).mean())
    x, y = weights or (1.0, 1.0)
    want = 400 * min(x, y) / (200 * x + 400 * max(x, y) + 400 * y)
    assert np.mean(agreed) == pytest.approx(want, abs=0.05)


def test_a_sketch_does_not_depend_on_its_company():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 3, 500, 20)]
    together = dm.sketch(np.concatenate(sets), np.repeat(range(4), [len(s) for s in sets]), 4)
    for i, s in enumerate(sets):
        assert (dm.sketch(s, np.zeros(len(s), int), 1)[0] == together[i]).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 42), (50, 42)], "a long, b long")
    got = {r["id"]: r["class_id"] for r in dm.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), **dict.fromkeys((40, 41, 42, 50), 40)}


def test_rooted_is_components_of_trees(spark):
    random = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    trees = [(int(random.integers(200, b)), b) for b in range(201, 300) if b % 9]
    edges = spark.createDataFrame(chain + star + trees, "a long, b long")
    found = lambda labels: sorted(map(tuple, labels.select("id", "class_id").collect()))
    got = found(dm.rooted(edges))
    assert got == found(dm.components(edges))
    assert len(got) == len({i for i, _ in got})
    assert found(dm.rooted(edges.where("a < 0"))) == []


def test_components_read_a_link_once_while_its_ends_are_apart(spark):
    random = np.random.default_rng(3)
    dense = [tuple(int(x) for x in random.choice(200, 2, replace=False)) for _ in range(2000)]
    ids = random.permutation(np.arange(1000, 1200)).tolist()
    chain = list(zip(ids, ids[1:], strict=False))
    links = sorted({(min(p), max(p)) for p in dense + chain})
    edges = spark.createDataFrame(links, "a long, b long")
    last = last_execution(spark)
    got = {r["id"]: r["class_id"] for r in dm.components(edges).collect()}
    assert got == {i: 0 if i < 1000 else 1000 for p in links for i in p}
    assert 0 < total(spark, last, "Join", "number of output rows", "[a#") < 1.5 * len(links)


def test_nodes_without_a_link_are_not_moved_once_for_each_block(spark, monkeypatch):
    """A bucket of 400 classes of which two are alike: the rows that its sets make follow its nodes, not its pairs."""
    monkeypatch.setattr(dm, "X_BLOCK", 8)
    monkeypatch.setattr(dm, "Y_BLOCK", 8)
    rng, n = np.random.default_rng(4), 400
    common = rng.integers(-(2**63), 2**63, 60).tolist()
    own = {i: common + rng.integers(-(2**63), 2**63, 40).tolist() for i in range(n)}
    own[n] = own[7][:95] + rng.integers(-(2**63), 2**63, 5).tolist()
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in own.items()], "id long, shingles array<long>")
    open_ = spark.createDataFrame([(1, i, i) for i in own] + [(2, 3, 3), (2, 4, 4)], "band long, id long, c long")
    last = last_execution(spark)
    assert [tuple(r) for r in dm.settled(open_, sets, 0.8).collect()] == [(7, n)]
    assert 0 < total(spark, last, "Join", "number of output rows", "[id#") < 4 * n


def test_marks_rule_no_link_out(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63, 3000).tolist()
    own = {}
    for i in range(120):  # of each size some pairs are just above and some just below the threshold
        size = (9, 40, 150, 700, 3000)[i % 5]
        new = int(rng.integers(0, size // 7 + 1))
        own[i] = sorted(base[: size - new] + rng.integers(-(2**63), 2**63, new).tolist())
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8
    sets = spark.createDataFrame(list(own.items()), "id long, shingles array<long>")
    open_ = dm.sized(spark.createDataFrame([(1, i, i) for i in own], "band long, id long, c long"))
    got = {r["id"] for r in dm.near_others(open_, sets, 0.8).collect()}
    assert {a for a in own for b in own if a != b and alike(own[a], own[b])} <= got


def test_the_first_pivot_meets_most_nodes(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63, 100).tolist()
    own = {50: base} | {i: rng.permutation(base)[8:].tolist() + rng.integers(-(2**63), 2**63, 8).tolist() for i in range(50)}
    sets = spark.createDataFrame(list(own.items()), "id long, shingles array<long>")
    open_ = spark.createDataFrame([(b, 50, 50) for b in range(10)] + [(i % 10, i, i) for i in range(50)], "band long, id long, c long")
    got = sorted(map(tuple, dm.by_pivots(dm.degrees(open_), sets, 0.8, 0).collect()))
    assert got == [(i, 50) for i in range(50)]
