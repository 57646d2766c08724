"""A coarse index of vectors: centroids by k-means, inverted lists, and the search of the nearest lists.

Everything is by direction, as distance is cosine distance. Centroids are few (LISTS) and live on the driver and in tasks;
vectors stay where they are. A round of k-means is one pass that hands on a sum and a count for each list and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence.workers import on_workers

#: Lists at most, rounds of k-means, and vectors for each list that centroids are fitted on, at most.
LISTS, ROUNDS, PER_LIST = 4096, 6, 256
ROWS = 4096


def list_count(n: int) -> int:
    """About the root of the number of vectors, so that a list is about as long as the list of lists."""
    return int(min(LISTS, max(1, round(n**0.5))))


def directions(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have d finite entries that aren't all zero, and those, at length 1 in double precision."""
    held = column.cast(pa.list_(pa.float64()))
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(held), d), False))
    entries = np.asarray(held.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, d)
    # Scaled by the largest entry first: squares of very large or small ones don't fit a double.
    largest = np.abs(entries).max(axis=1, initial=0.0)
    good = np.isfinite(largest) & (largest > 0) & np.isfinite(entries).all(axis=1)
    fits[np.flatnonzero(fits)[~good]] = False
    scaled = entries[good] / largest[good, None]
    return fits, scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def nearest_list(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T).argmax(axis=1) if len(x) else np.zeros(0, int)


def fit(vectors: DataFrame, d: int, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids, lists x d of length 1, of vectors (id, embedding). Begins with those of the least hashes of their ids.

    vectors should be no more than PER_LIST for each list. A list that loses all its vectors keeps its centroid.
    """
    on_workers(vectors.sparkSession)
    first = vectors.where(F.size("embedding") == d).orderBy(F.xxhash64("id"), "id").limit(lists).select("embedding").toArrow()
    _, centroids = directions(first.column(0).combine_chunks(), d)
    centroids = np.unique(centroids, axis=0)

    for _ in range(rounds if len(centroids) > 1 else 0):
        held = centroids

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(held), np.zeros(len(held), int)
            for batch in batches:
                _, x = directions(batch.column(0), d)
                at = nearest_list(x, held)
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(held))
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"list": pa.array(on, pa.int32()), "total": pa.array(total[on].tolist(), pa.list_(pa.float64()))})

        def merged(t: pa.Table) -> pa.Table:
            total = np.asarray(t.column("total").combine_chunks().flatten()).reshape(t.num_rows, -1).sum(axis=0)
            return pa.table({"list": t.column("list")[:1], "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

        told = vectors.select("embedding").mapInArrow(sums, "list int, total array<double>").groupBy("list").applyInArrow(merged, "list int, total array<double>").collect()
        centroids = held.copy()
        for r in told:
            total = np.array(r["total"])
            if (size := np.sqrt(total @ total)) > 0:
                centroids[r["list"]] = total / size
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """chunk_id, doc_id, embedding with list, the number of the nearest centroid; vectors without a direction are left out."""
    on_workers(rows.sparkSession)
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                fits, x = directions(part.column(2), d)
                kept = part.filter(pa.array(fits))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(nearest_list(x, centroids), pa.int32())], names=["chunk_id", "doc_id", "embedding", "list"])

    kinds = dict(rows.dtypes)
    return rows.select("chunk_id", "doc_id", "embedding").mapInArrow(run, f"chunk_id {kinds['chunk_id']}, doc_id {kinds['doc_id']}, embedding {kinds['embedding']}, list int")


def best(rows: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """The nearest of rows (chunk_id, doc_id, embedding): chunk_id, doc_id, distance. A task hands on its limit best."""
    on_workers(rows.sparkSession)
    q = np.asarray(vector, dtype=float)
    d, kinds = len(q), dict(rows.dtypes)
    _, unit = directions(pa.array([q.tolist()]), d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            fits, x = directions(batch.column(2), d)
            kept = batch.filter(pa.array(fits))
            own = pa.table([kept.column(0), kept.column(1), pa.array(1 - x @ unit[0])], names=["chunk_id", "doc_id", "distance"])
            held = own if held is None else pa.concat_tables([held, own])
            held = held.take(pc.select_k_unstable(held, limit, [("distance", "ascending"), ("chunk_id", "ascending")]))
        if held is not None:
            yield from held.to_batches()

    if not len(unit):
        return rows.select("chunk_id", "doc_id", F.lit(0.0).alias("distance")).limit(0)
    found = rows.select("chunk_id", "doc_id", "embedding").mapInArrow(run, f"chunk_id {kinds['chunk_id']}, doc_id {kinds['doc_id']}, distance double")
    return found.orderBy("distance", "chunk_id").limit(limit)


def places(lists: DataFrame, queries: np.ndarray, k: int, order: np.ndarray) -> list[int]:
    """For the k nearest of each query among lists (embedding, list), the place of their list in the query's order of lists.

    queries: of length 1. order: for each query, lists by nearness. One pass; a task hands on k rows a query.
    """
    n, d = queries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, where = np.full((n, k), -np.inf), np.full((n, k), -1)
        for batch in batches:
            fits, x = directions(batch.column(0), d)
            at = np.asarray(batch.column(1))[fits]
            both, own = np.hstack([near, queries @ x.T]), np.hstack([where, np.tile(at, (n, 1))])
            top = np.argsort(-both, axis=1, kind="stable")[:, :k]
            near, where = np.take_along_axis(both, top, 1), np.take_along_axis(own, top, 1)
        q = np.repeat(np.arange(n), k)[where.ravel() >= 0]
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "near": pa.array(near.ravel()[where.ravel() >= 0]), "list": pa.array(where.ravel()[where.ravel() >= 0], pa.int32())})

    told = lists.select("embedding", "list").mapInArrow(run, "q int, near double, list int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "list"))
    return [int(np.flatnonzero(order[r["q"]] == r["list"])[0]) for r in told.withColumn("n", rank).where(F.col("n") <= k).collect()]


@dataclass
class Lists:
    """Centroids and, for each, the largest angle to a vector of its list: what proves that further lists hold nothing nearer."""

    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def order(self, vector: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Lists by nearness to a vector, and the least distance that each may hold."""
        _, unit = directions(pa.array([[float(x) for x in vector]]), self.centroids.shape[1])
        if not len(unit):
            return np.zeros(0, int), np.zeros(0)
        angles = np.arccos(np.clip(self.centroids @ unit[0], -1, 1))
        at = np.argsort(angles, kind="stable")
        return at, 1 - np.cos(np.maximum(angles - self.radii - 1e-7, 0))[at]


def described(lists: DataFrame, centroids: np.ndarray) -> Lists:
    """Radii and sizes of lists (embedding, list), by one aggregate."""
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii, n = np.zeros(len(centroids)), np.zeros(len(centroids), int)
        for batch in batches:
            at = np.asarray(batch.column(1))
            _, x = directions(batch.column(0), d)
            np.maximum.at(radii, at, np.arccos(np.clip((x * centroids[at]).sum(axis=1), -1, 1)))
            n += np.bincount(at, minlength=len(n))
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"list": pa.array(on, pa.int32()), "radius": pa.array(radii[on]), "n": pa.array(n[on])})

    out = Lists(centroids, np.zeros(len(centroids)), np.zeros(len(centroids), int))
    told = lists.select("embedding", "list").mapInArrow(run, "list int, radius double, n long").groupBy("list").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
    for r in told.collect():
        out.radii[r["list"]], out.sizes[r["list"]] = r["radius"], r["n"]
    return out
