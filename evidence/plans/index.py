"""The stored indexes of a store: written by each batch from what it adds and takes away, read by a question for its terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence.operators import inverted, search
from evidence.sources.store import Manifest, Store, bucket_of

LEXEMES = "lexeme string, ndoc long"
#: Changes of lexeme counts, and of the dictionary, that are kept apart before a batch folds them into one table.
LEXEME_BATCHES = 16
ANALYSER = "english"
#: Hits that are looked up among the documents at first, and at most before all of them are joined.
LOOKUP, MOST_LOOKUPS = 200, 12_800


def analyser(manifest: Manifest) -> str:
    return manifest.index.get("analyser", ANALYSER)


def dictionary(store: Store, manifest: Manifest | None = None) -> DataFrame:
    return store.table("dictionary", inverted.DICTIONARY, manifest)


def lexemes(store: Store, manifest: Manifest | None = None) -> DataFrame:
    """lexeme, ndoc: in how many chunks. The table holds what each batch adds and takes away."""
    held = store.table("lexeme", LEXEMES, manifest)
    return held.groupBy("lexeme").agg(F.sum("ndoc").alias("ndoc")).where("ndoc > 0")


def _grow(store: Store, manifest: Manifest, name: str, change: DataFrame, whole: DataFrame, batch: int) -> dict[str, str]:
    """Folders of a table that takes changes, in order of its first column, so that a look-up skips most of a file."""
    held = store.folders(name, manifest)
    fold = len(held) >= LEXEME_BATCHES
    rows = whole if fold else change
    path = store.write(name, rows.repartitionByRange(rows.columns[0]).sortWithinPartitions(rows.columns[0]), batch)
    return {**({} if fold else {"0": held[""]} if "" in held else held), str(batch): path}


def update(store: Store, manifest: Manifest, tables: dict, added: DataFrame, removed: DataFrame, batch: int) -> None:
    """Bring dictionary, postings and lexeme counts in tables to where chunks were added and removed (chunk_id, doc_id, text)."""
    texts = added.select("chunk_id", "doc_id", "text").unionByName(removed.select("chunk_id", "doc_id", "text"))
    held, how = dictionary(store, manifest), analyser(manifest)
    fresh = inverted.new_tokens(texts, held, how)
    tables["dictionary"] = _grow(store, manifest, "dictionary", fresh, held.unionByName(fresh), batch)
    tables["posting"] = store.add_layer("posting", inverted.POSTING, inverted.postings_by(added, how), inverted.postings_by(removed, how), batch, manifest)
    signed = inverted.counts_by(added, how).unionByName(inverted.counts_by(removed, how).withColumn("ndoc", -F.col("ndoc")))
    total = lambda df: df.groupBy("lexeme").agg(F.sum("ndoc").alias("ndoc")).where("ndoc <> 0")
    change = total(signed)
    tables["lexeme"] = _grow(store, manifest, "lexeme", change, total(lexemes(store, manifest).unionByName(change)), batch)


def build(store: Store, manifest: Manifest, tables: dict, batch: int, chunks: str = "chunk_id string, doc_id string, text string") -> None:
    """The index of all chunks of tables, in place of any that there is."""
    for name in ("dictionary", "posting", "lexeme"):
        tables.pop(name, None)
    rows = store.table("chunk", chunks, Manifest(tables=tables, buckets=manifest.buckets))
    bare = Manifest(tables={k: v for k, v in manifest.tables.items() if k not in ("dictionary", "posting", "lexeme")}, index=manifest.index, buckets=manifest.buckets)
    update(store, bare, tables, rows, rows.limit(0), batch)


def question_lexemes(question: str, manifest: Manifest, store: Store) -> list[str]:
    """The distinct lexemes of a question by the index's analyser; a question is short, and cut where it is asked."""
    cut = search.question_terms(store.spark, question)
    work = inverted.ANALYSERS[analyser(manifest)]
    return sorted({x for r in cut.collect() if (x := work(r[0])) is not None})


def rare_terms(store: Store, question: str, manifest: Manifest) -> list[str]:
    """The terms that a search uses, by the stored counts of the question's lexemes alone."""
    asked = question_lexemes(question, manifest, store)
    known = {r["lexeme"]: r["ndoc"] for r in store.table("lexeme", LEXEMES, manifest, where=F.col("lexeme").isin(asked)).groupBy("lexeme").agg(F.sum("ndoc").alias("ndoc")).collect()} if asked else {}
    most = search.RARE_SHARE * (manifest.chunks or 0)
    found = sorted((known.get(x, 0), x) for x in asked if known.get(x, 0) <= most)
    return [x for _, x in found[: search.RARE_TERMS]]


def posting_hits(store: Store, terms: list[str], manifest: Manifest) -> DataFrame:
    """chunk_id, doc_id, score of the chunks that hold any of the terms: the terms' buckets are read, and in them their rows."""
    one = store.spark.createDataFrame([(t,) for t in terms], "t string")
    buckets = [r[0] for r in one.select(bucket_of(F.col("t"), manifest.buckets)).distinct().collect()]
    rows = store.table("posting", inverted.POSTING, manifest, buckets, F.col("lexeme").isin(terms))
    return inverted.scored(rows, search.POSITION_WEIGHT)


def text_search(store: Store, question: str, limit: int = search.CANDIDATES, allowed: Column | None = None, documents: str = "doc_id string, doc_type string, metadata string, is_current boolean, is_active boolean") -> DataFrame:
    """search.text_search() over the stored index: chunk_id, doc_id, score. allowed: a condition on the documents table.

    The best hits are looked up among the documents, more of them while too few are allowed; beyond MOST_LOOKUPS the
    documents are joined instead.
    """
    manifest = store.manifest()
    terms = rare_terms(store, question, manifest)
    empty = store.spark.createDataFrame([], "chunk_id string, doc_id string, score double")
    if not terms:
        return empty
    hits = posting_hits(store, terms, manifest)
    best = lambda df: df.orderBy(F.desc("score"), "chunk_id")
    if allowed is None:
        return best(hits).limit(limit)
    window = max(LOOKUP, 4 * limit)
    while window <= MOST_LOOKUPS:
        top = best(hits).limit(window).collect()
        ids = sorted({r["doc_id"] for r in top})
        where = store.spark.createDataFrame([(i,) for i in ids], "i string").select(bucket_of(F.col("i"), manifest.buckets)).distinct() if ids else None
        docs = store.table("document", documents + ", doc_sk long", manifest, [r[0] for r in where.collect()] if where is not None else [])
        good = {r["doc_id"] for r in docs.where(F.col("doc_id").isin(ids) & allowed).select("doc_id").collect()}
        kept = [tuple(r) for r in top if r["doc_id"] in good][:limit]
        if len(kept) == limit or len(top) < window:
            return best(store.spark.createDataFrame(kept, empty.schema)) if kept else empty
        window *= 4
    docs = store.table("document", documents + ", doc_sk long", manifest).where(allowed)
    return best(hits.join(docs.select("doc_id"), "doc_id", "left_semi")).limit(limit).select("chunk_id", "doc_id", "score")
