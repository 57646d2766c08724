import numpy as np
import pytest

from evidence.llm import whitening
from evidence.llm.queries import op11_whitening


def brute(rows):
    """ids and quantised vectors in Python integers, n, sums, covariance in long doubles."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    apart = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x], dtype=np.longdouble)
    return [i for i, _ in kept], n, deviations, apart, (apart.T @ apart / n).astype(float)


def check(got, rows, most=32):
    ids, n, deviations, apart, v = brute(rows)
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(most, sum(values > values[0] * 1e-12))
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1))
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted(zip(ids, deviations, strict=True))
    for c in range(1, k + 1):
        own = sorted((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == c)
        w = np.array([x for _, _, x in own])
        assert abs(w.mean()) < 1e-8 and abs((w * w).mean() - 1) < 1e-8
        assert all(r["explained"] == pytest.approx(values[c - 1] / v.trace(), rel=1e-9) for r in got if r["component"] == c)
        # Whitened entries are the projections on the axis that they regress to.
        order = sorted(range(n), key=lambda i: (ids[i], deviations[i]))
        axis = apart[order].astype(float).T @ w / n / np.sqrt(values[c - 1])
        assert np.allclose(v @ axis, values[c - 1] * axis, rtol=1e-6, atol=1e-6 * values[0]) and abs(np.linalg.norm(axis) - 1) < 1e-8


def test_embeddings(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check(op11_whitening(spark, small).collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(x) for x in rng.normal(size=5) * 10.0 ** rng.integers(0, 3)]) for i in range(200)] + [(7, [1.0] * 5), (7, [1.0] * 5)]
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    other = [(905, [1.0, 2.0]), (906, [1e300] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in good + bad + other], "vec_id long, embedding array<double>, component int, n double").repartition(7)
    got = whitening.whitening(df).collect()
    check(sorted(got, key=lambda r: r["vec_id"]), sorted(good, key=lambda r: r[0]))
    assert whitening.whitening(df.limit(0)).collect() == [] == whitening.whitening(df.where("vec_id in (7, 900)")).where("vec_id = 900").collect()
    assert whitening.whitening(df.where("vec_id = 906 or vec_id = 905 or vec_id is null")).count() == 0
    flat = spark.createDataFrame([(None, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whitening(flat).collect()  # a single direction, ids null
    assert len(got) == 9 and {r["component"] for r in got} == {1} and all(r["explained"] == pytest.approx(1) for r in got)


def test_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, size=(500, 6)) + 10**9
    whole = whitening.moments(x)
    cuts = [0, 1, 40, 41, 300, 500]
    parts = [whitening.moments(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 1, 3]):
        got = parts[order[0]]
        for k in order[1:]:
            got = whitening.merge(got, parts[k])
        assert got.n == 500 and got.sums == whole.sums and np.allclose(got.scatter, whole.scatter, rtol=1e-12)


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(i, [2.0**43 * (i == 0), float(i)]) for i in range(8)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitening(df).collect()}
    assert got[0] is None
