"""Whitening of vectors by the principal components of their quantised entries; moments merged pairwise (Chan et al.).

Each partition works out count, mean and centred scatter of its vectors batch by batch and hands on one state, so what is
shuffled follows the number of partitions, not of rows; states meet in a tree. The driver sees one state of d x d numbers and
solves the eigenproblem. A second pass over all vectors takes the moments of what came out and compares them with the
identity. Sums of the quantised entries are integers, so n, S and deviations are exact.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.workers import on_workers

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Rows of a batch that are worked on at once.
ROWS = 4096
#: States that one task of the tree merges.
FAN_IN = 32
#: Quantised entries at or beyond this don't fit the arithmetic; such a vector takes no part.
MOST = 2.0**50
#: A component is told from rounding if its variance is at least this share of the greatest, for each dimension.
EPSILON = np.finfo(float).eps
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """Count, sums, centred scatter. Sums of integers are Python integers, so that means are apart by exactly what they are."""

    n: int
    sums: list[int] | list[float]
    scatter: np.ndarray


def centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """x - sums / n; integers are taken from the whole part of the mean first, which loses no digit however large they are."""
    if x.dtype.kind != "i":
        return x - np.array(sums) / n
    whole = [s // n for s in sums]
    return (x - np.array(whole, dtype=np.int64)).astype(float) - np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


def moments(x: np.ndarray) -> Moments:
    """Of the rows of x, integers or floats, centred before they are multiplied."""
    sums = x.sum(axis=0).tolist()
    c = centred(x, len(x), sums)
    return Moments(len(x), sums, c.T @ c)


def merge(a: Moments, b: Moments) -> Moments:
    """Chan, Golub and LeVeque: the scatter of both is the sum of theirs and that of their means."""
    n = a.n + b.n
    apart = np.array([(t * a.n - s * b.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])
    return Moments(n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def _vectors(batches: Iterator[pa.RecordBatch], d: int | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and quantised entries (without OFFSET) of the vectors that take part, ROWS at a time. d: their length, None: any."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            held = part.column(1).cast(pa.list_(pa.float64()))
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(held), 0))
            if d is None:
                for size in np.unique(sizes[sizes > 0]):
                    yield from _finite(part.column(0), held, sizes == size, int(size))
            else:
                yield from _finite(part.column(0), held, sizes == d, d)


def _finite(ids: pa.Array, held: pa.ListArray, fits: np.ndarray, d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    chosen = held.filter(pa.array(fits))
    entries = np.asarray(chosen.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, d)
    with np.errstate(all="ignore"):
        x = np.floor(SCALE * entries)
    good = (np.abs(x) < MOST).all(axis=1)  # a null entry is nan by now
    if good.any():
        yield ids.filter(pa.array(fits)).filter(pa.array(good)), x[good].astype(np.int64)


def _tree(states: DataFrame, join: Callable) -> object | None:
    """The state of all rows (state binary), merged in a tree whose tasks merge FAN_IN states each; None without any."""
    rdd = states.rdd.map(lambda r: bytes(r["state"]))
    if rdd.isEmpty():
        return None
    depth = max(2, math.ceil(math.log(max(rdd.getNumPartitions(), 2), FAN_IN)))
    return pickle.loads(rdd.treeReduce(lambda a, b: pickle.dumps(join(pickle.loads(a), pickle.loads(b))), depth))


def _merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return {d: merge(a[d], b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def fit(vectors: DataFrame) -> Moments | None:
    """Moments of the quantised vectors, of the length that most have (of equally many, the greater); None without any."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for _, x in _vectors(batches, None):
            own = _merged(own, {x.shape[1]: moments(x)})
        if own:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(own)]})

    found = _tree(vectors.mapInArrow(local, "state binary"), _merged)
    return found[max(found, key=lambda d: (found[d].n, d))] if found else None


def components(m: Moments, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances, unit eigenvectors (columns) and shares of the whole variance of the leading components, falling.

    Components without variance can't be whitened and are left out. Of either sign the one is taken whose largest entry is
    positive, so that a run gives what the last one gave.
    """
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values.max(), 0.0) * EPSILON * len(values)]
    held = vectors[:, order]
    largest = np.abs(held).argmax(axis=0) if len(order) else np.zeros(0, int)
    signs = np.where(held[largest, np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(m.scatter) / m.n)
    return values[order], held * signs, values[order] / trace if len(order) else values[order]


def whitening(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector that takes part.

    embeddings: vec_id, embedding; other columns are left alone. A vector that is null or empty, holds a null, a non-finite
    entry or one of 2^44 or more takes no part, and so do vectors of another length than most have. Repeated rows count, and
    come out, as often as they are there; vec_id may be null. A deviation beyond a long is null. Where all vectors are equal,
    or there are none, no component has a variance and nothing comes out.
    """
    spark = embeddings.sparkSession
    on_workers(spark)
    vectors = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding"))
    m = fit(vectors)
    values, axes, shares = components(m, most) if m else (np.zeros(0), None, None)
    if not len(values):
        return spark.createDataFrame([], OUT)
    n, d = m.n, len(m.sums)
    whole = np.array(m.sums, dtype=object)
    scaled = axes / np.sqrt(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        return centred(x, n, m.sums) @ scaled

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [moments(whitened(x)) for _, x in _vectors(batches, d)]
        if parts:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(reduce(merge, parts))]})

    after = _tree(vectors.mapInArrow(local, "state binary"), merge)
    error = float(np.abs(after.scatter / after.n - np.eye(len(values))).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact: n OFFSET is in both and cancels."""
        reach = float(np.abs(x).max()) * n + max(abs(s) for s in m.sums)
        if reach * reach * d < 2.0**62:
            apart = n * x - np.array(m.sums, dtype=np.int64)
            return (apart * apart).sum(axis=1).tolist()
        sums = [sum(int(v) ** 2 for v in n * row.astype(object) - whole) for row in x]
        return [s if s < 2**63 else None for s in sums]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for ids, x in _vectors(batches, d):
            times = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids.take(pa.array(times)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(len(times), n)),
                "deviation": pa.array(deviations(x), pa.int64()).take(pa.array(times)), "whitened": pa.array(whitened(x).ravel()), "explained": pa.array(np.tile(shares, len(x))), "identity_error": pa.array(np.full(len(times), error)),
            })

    return vectors.mapInArrow(rows, OUT)
