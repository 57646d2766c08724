"""The stored vector index: lists in folders by their number, searched from the nearest on, wider while a filter leaves too few.

An index is built from the chunks that have a vector at that time; chunks that get or lose one later are in its layers as
any other batch's rows are. Searching without an index compares all vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence.operators import search
from evidence.operators import vector_index as vi
from evidence.sources.store import Manifest, Store, bucket_of

VECTOR = "chunk_id string, doc_id string, embedding array<float>, list int"
CENTROID = "list int, centroid array<double>, radius double, n long"
#: A search first reads so many lists that this share of the nearest of sampled vectors was found, by measure when the index
#: is built: vectors in clusters need a few, vectors without any order need most. More follow while too few hits are allowed.
RECALL, SAMPLED, NEAREST = 0.95, 32, 10
#: Hits of a round that are looked up among the documents.
LOOKUP = 4


@dataclass
class Found:
    rows: DataFrame
    lists_read: int
    lists: int


def _lists(store: Store, manifest: Manifest) -> vi.Lists | None:
    if "centroid" not in manifest.tables:
        return None
    rows = store.table("centroid", CENTROID, manifest).orderBy("list").collect()
    return vi.Lists(np.array([r["centroid"] for r in rows]), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows]))


def _write(store: Store, lists: vi.Lists, batch: int) -> str:
    rows = [(i, c.tolist(), float(r), int(n)) for i, (c, r, n) in enumerate(zip(lists.centroids, lists.radii, lists.sizes, strict=True))]
    return store.write("centroid", store.spark.createDataFrame(rows, CENTROID).coalesce(1), batch)


def build(store: Store, manifest: Manifest, chunks: DataFrame, lists: int | None = None) -> Manifest:
    """An index of all chunks (chunk_id, doc_id, embedding) in place of any that there is; published.

    Centroids are fitted on at most PER_LIST vectors for each list, by a hash of their ids; every vector gets a list.
    """
    held = chunks.where("embedding is not null")
    size = held.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None or size["d"] == 0:
        return manifest
    lists = lists or vi.list_count(size["n"])
    share = min(1.0, lists * vi.PER_LIST / size["n"])
    sample = held.where(F.pmod(F.xxhash64("chunk_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("chunk_id").alias("id"), "embedding")
    centroids = vi.fit(sample, size["d"], lists)
    batch = manifest.number + 1
    bare = Manifest(buckets=manifest.buckets)
    manifest.tables["vector_list"] = store.add_layer("vector_list", VECTOR, vi.assigned(held, centroids), None, batch, bare)
    made = Manifest(tables={"vector_list": manifest.tables["vector_list"]}, buckets=manifest.buckets)
    rows = store.table("vector_list", VECTOR, made)
    told = vi.described(rows, centroids)
    manifest.tables["centroid"] = _write(store, told, batch)
    manifest.index = {**manifest.index, "lists_read": _measured(rows, told)}
    return store.publish(manifest)


def _measured(rows: DataFrame, lists: vi.Lists) -> int:
    """How many lists hold RECALL of the nearest of sampled vectors."""
    sample = [r["embedding"] for r in rows.select("embedding", "chunk_id").orderBy(F.xxhash64("chunk_id", F.lit(9)), "chunk_id").limit(SAMPLED).collect()]
    if not sample:
        return 1
    order = [lists.order(v)[0] for v in sample]
    order = [o[lists.sizes[o] > 0] for o in order]
    units = np.array(sample, float)
    units /= np.sqrt((units * units).sum(axis=1))[:, None]
    at = np.sort(vi.places(rows, units, NEAREST, np.array(order)))
    return int(at[max(0, int(np.ceil(RECALL * len(at))) - 1)]) + 1


def update(store: Store, manifest: Manifest, tables: dict, added: DataFrame, removed: DataFrame, batch: int) -> None:
    """Bring the index in tables, if there is one, to where vectors came (chunk_id, doc_id, embedding) and went."""
    lists = _lists(store, manifest)
    if lists is None:
        return
    new = vi.assigned(added.where("embedding is not null"), lists.centroids)
    gone = vi.assigned(removed.where("embedding is not null"), lists.centroids)
    tables["vector_list"] = store.add_layer("vector_list", VECTOR, new, gone, batch, manifest)
    more = vi.described(new, lists.centroids)
    tables["centroid"] = _write(store, replace(lists, radii=np.maximum(lists.radii, more.radii), sizes=lists.sizes + more.sizes), batch)


def vector_search(store: Store, vector: list[float], limit: int = search.CANDIDATES, allowed: Column | None = None, exact: bool = False, documents: str = "doc_id string, doc_type string, metadata string, is_current boolean, is_active boolean") -> Found | None:
    """The nearest chunks of the nearest lists (chunk_id, doc_id, distance), and how many lists were read; None without an index.

    allowed: a condition on the documents table. While it leaves fewer than limit, twice as many lists are read, up to all.
    exact: also until no further list can hold a nearer vector, by the lists' radii; then the result is that of all vectors.
    """
    manifest = store.manifest()
    lists = _lists(store, manifest)
    if lists is None:
        return None
    order, least = lists.order(vector)
    order, least = order[lists.sizes[order] > 0], least[lists.sizes[order] > 0]
    n = min(len(order), manifest.index.get("lists_read", len(order)))
    if not len(order):
        return Found(store.spark.createDataFrame([], "chunk_id string, doc_id string, distance double"), 0, 0)
    while True:
        # Every further list may be read for one of them that is nearer, so what is left is judged by its least.
        rows = store.table("vector_list", VECTOR, manifest, [int(x) for x in order[:n]])
        found, whole = _allowed(store, manifest, rows, vector, limit, allowed, documents)
        enough = len(found) == limit and (not exact or n == len(order) or least[n:].min() > found[-1][2])
        if enough or n == len(order):
            kept = store.spark.createDataFrame(found, "chunk_id string, doc_id string, distance double")
            return Found(kept.orderBy("distance", "chunk_id"), n, len(order))
        n = min(len(order), 2 * n)


def _allowed(store: Store, manifest: Manifest, rows: DataFrame, vector: list[float], limit: int, allowed: Column | None, documents: str) -> tuple[list[tuple], bool]:
    """The limit best allowed of rows. The best are looked up among the documents first; where those aren't enough, all are joined."""
    if allowed is None:
        return [tuple(r) for r in vi.best(rows, vector, limit).collect()], True
    docs = lambda buckets=None: store.table("document", documents + ", doc_sk long", manifest, buckets)
    top = [tuple(r) for r in vi.best(rows, vector, LOOKUP * limit).collect()]
    ids = sorted({r[1] for r in top})
    if ids:
        where = store.spark.createDataFrame([(i,) for i in ids], "i string").select(bucket_of(F.col("i"), manifest.buckets)).distinct().collect()
        good = {r[0] for r in docs([r[0] for r in where]).where(F.col("doc_id").isin(ids) & allowed).select("doc_id").collect()}
        kept = [r for r in top if r[1] in good][:limit]
        if len(kept) == limit or len(top) < LOOKUP * limit:
            return kept, len(kept) == limit
    found = vi.best(rows.join(docs().where(allowed).select("doc_id"), "doc_id", "left_semi"), vector, limit)
    return [tuple(r) for r in found.collect()], True
