"""Chunk rows: made from documents, their vectors carried over, moved between versions, embedded, counted."""

from __future__ import annotations

import hashlib
import json
import time
from typing import Protocol

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence.functions.chunking import OVERLAP, SIZE, chunks
from evidence.functions.text import sha256


def chunk_rows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs: doc_sk, text. doc_sk, ord (from 0), text, text_hash."""
    cut = docs.select("doc_sk", F.posexplode(chunks(F.col("text"), size, overlap)).alias("ord", "text"))
    return cut.withColumn("text_hash", sha256(F.col("text")))


def vectors_by_hash(rows: DataFrame, *by: str) -> DataFrame:
    """For each text hash (and by), the vector of the least chunk_id that has one."""
    keys = [*by, "text_hash"]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_id"))
    return rows.where("embedding is not null").withColumn("__n", order).where("__n = 1").select(*keys, "embedding", *([] if "embed_model" in by else ["embed_model"]))


def carry_vectors(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks with the vector, of any model, of an old chunk with the same text."""
    return new.join(vectors_by_hash(old), "text_hash", "left")


def move_chunks(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Chunks with doc_sk replaced by moves (old_sk, new_sk); chunk_id stays."""
    joined = rows.join(moves, rows["doc_sk"] == moves["old_sk"], "left")
    return joined.select(*(F.coalesce("new_sk", "doc_sk").alias("doc_sk") if c == "doc_sk" else F.col(c) for c in rows.columns))


def same_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """doc_sk of documents whose ordered chunk hashes are as stored."""
    listed = lambda d, name: d.groupBy("doc_sk").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text_hash"))), lambda s: s.text_hash).alias(name))
    return listed(stored, "was").join(listed(fresh, "now"), "doc_sk").where("was = now").select("doc_sk")


def pending_cost(rows: DataFrame) -> DataFrame:
    """Distinct texts that no chunk has a vector for: their number and characters."""
    done = rows.where("embedding is not null").select("text_hash").distinct()
    todo = rows.where("embedding is null").groupBy("text_hash").agg(F.max(F.length("text")).alias("n")).join(done, "text_hash", "left_anti")
    return todo.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"))


def pending_count(rows: DataFrame) -> DataFrame:
    """Chunks without a vector."""
    return rows.where("embedding is null").agg(F.count("*").alias("pending"))


def repeated_texts(rows: DataFrame) -> DataFrame:
    """text_hash, times of texts that are there more than once, and are embedded once."""
    return rows.groupBy(sha256(F.col("text")).alias("text_hash")).agg(F.count("*").alias("times")).where("times > 1")


def reuse_embeddings(rows: DataFrame, model: str) -> DataFrame:
    """Pending chunks take the vector of an equal text, of the same model only."""
    wanted = rows.where("embedding is null").select("text_hash").distinct()
    known = vectors_by_hash(rows.where(F.col("embed_model") == model).join(wanted, "text_hash", "left_semi")).select("text_hash", F.col("embedding").alias("k_embedding"), F.col("embed_model").alias("k_model"))
    joined = rows.join(known, "text_hash", "left")
    fill = {"embedding": F.coalesce("embedding", "k_embedding"), "embed_model": F.when(F.col("embedding").isNull(), F.col("k_model")).otherwise(F.col("embed_model"))}
    return joined.select(*(fill[c].alias(c) if c in fill else F.col(c) for c in rows.columns))


def embed_budget(rows: DataFrame, limit: int) -> DataFrame:
    """The pending distinct texts of a run with a limit, in order of their hash."""
    todo = rows.where("embedding is null").groupBy("text_hash").agg(F.min("text").alias("text"))
    return todo.orderBy("text_hash").limit(limit)


VECTORS = "text_hash string, embedding array<float>, embed_model string, error string"


class RateLimited(RuntimeError):
    """A provider asks to wait; it is asked again, up to PATIENCE times in a row."""

    def __init__(self, wait: float = 65.0):
        super().__init__(f"rate limited for {wait} s")
        self.wait = wait

    def __reduce__(self):
        return RateLimited, (self.wait,)


PATIENCE = 30


class EmbeddingProvider(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in for a model: the first 8 bytes of sha256(text), each over 255, plus 0.01."""

    model, dim = "hash-8", 8

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 + 0.01 for b in hashlib.sha256(t.encode()).digest()[: self.dim]] for t in texts]


def _vectors(provider: EmbeddingProvider, texts: list[str]) -> list[list[float]]:
    for left in range(PATIENCE, -1, -1):
        try:
            got = provider.embed(texts)
        except RateLimited as asked:
            if not left:
                raise
            time.sleep(asked.wait)
        else:
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
            return got
    raise AssertionError


def embed(pending: DataFrame, provider: EmbeddingProvider, batch: int = 64) -> DataFrame:
    """text_hash, embedding, embed_model, error of distinct pending texts; each is sent once, in batches.

    A batch that fails ends its partition: one row tells the error, batches before it keep their vectors.
    """

    def run(parts):
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                try:
                    vectors = _vectors(provider, own["text"].tolist())
                except Exception as wrong:  # whatever a provider raises is told
                    yield pd.DataFrame({"text_hash": [None], "embedding": [None], "embed_model": [provider.model], "error": [f"{type(wrong).__name__}: {wrong}"]})
                    return
                yield pd.DataFrame({"text_hash": own["text_hash"], "embedding": vectors, "embed_model": provider.model, "error": None})

    return pending.select("text_hash", "text").mapInPandas(run, VECTORS)


def embed_together(pending: DataFrame, provider: EmbeddingProvider, tasks: int, batch: int = 64) -> DataFrame:
    """embed() by so many tasks at once, in rounds: each sends one request, all tell each other how it went, and where one was
    told to wait all do, so that no request begins while a wait lasts. A barrier stage: there must be as many free cores.

    A quota of requests is shared by choosing tasks. A failing request ends its task's part, as in embed(); others go on.
    """

    def run(parts):
        ctx = BarrierTaskContext.get()
        waiting = (pdf.iloc[at : at + batch] for pdf in parts for at in range(0, len(pdf), batch))
        own, waits = next(waiting, None), 0
        while True:
            wait, out, failed = 0.0, None, False
            if own is not None:
                try:
                    got = provider.embed(own["text"].tolist())
                    if len(got) != len(own):
                        raise ValueError(f"{len(got)} vectors for {len(own)} texts")
                    out, waits = pd.DataFrame({"text_hash": own["text_hash"], "embedding": got, "embed_model": provider.model, "error": None}), 0
                except RateLimited as asked:
                    wait, waits = asked.wait, waits + 1
                    failed, wrong = waits > PATIENCE, asked
                except Exception as other:  # whatever a provider raises is told
                    failed, wrong = True, other
                if failed:
                    out = pd.DataFrame({"text_hash": [None], "embedding": [None], "embed_model": [provider.model], "error": [f"{type(wrong).__name__}: {wrong}"]})
                if out is not None:
                    own = None if failed else next(waiting, None)
            told = [json.loads(x) for x in ctx.allGather(json.dumps([own is not None, 0.0 if failed else wait]))]
            if out is not None:
                yield out
            if not any(more for more, _ in told):
                return
            if (longest := max(w for _, w in told)) > 0:
                time.sleep(longest)
                ctx.barrier()

    return pending.select("text_hash", "text").repartition(tasks).mapInPandas(run, VECTORS, barrier=True)


def mark_indexed(rows: DataFrame) -> DataFrame:
    """doc_sk of versions with at least one chunk and none pending."""
    return rows.groupBy("doc_sk").agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("pending")).where("pending = 0").select("doc_sk", "chunks")


def index_stats(versions: DataFrame, rows: DataFrame) -> DataFrame:
    """Per doc_type: documents, active, versions, indexed (documents with chunks, none of them pending), chunks, embedded."""
    per = rows.groupBy("doc_sk").agg(F.count("*").alias("c"), F.count("embedding").alias("e"))
    indexed = F.count_if(F.col("is_current") & (F.col("c") == F.col("e"))).alias("indexed")
    counted = versions.join(per, "doc_sk", "left").groupBy("doc_type")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return counted.agg(F.count_if("is_current").alias("documents"), F.count_if(F.col("is_current") & F.col("is_active")).alias("active"), F.count("*").alias("versions"), indexed, total("c")("chunks"), total("e")("embedded"))
