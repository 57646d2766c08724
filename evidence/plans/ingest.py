"""An ingest run: change window, mapping, checks, history, chunks, one commit; the pause for approval; finalisation."""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence.functions.chunking import OVERLAP, SIZE
from evidence.operators import changes, mapping, quality, scd2
from evidence.operators import chunks as ch
from evidence.operators.catalog import Catalog, validate
from evidence.plans import index, metadata, vectors
from evidence.plans.index import lexemes  # noqa: F401  read beside the tables below
from evidence.rules.spec import DocType
from evidence.sources.snapshot import Snapshot
from evidence.sources.store import Manifest, Store, bucket_of

VERSIONS = "doc_sk long, doc_id string, doc_type string, source_id string, title string, body string, url string, metadata string, content_hash string, tracked_hash string, is_active boolean, version int, is_current boolean, valid_from timestamp, valid_to timestamp, change_reason string, source_change_id long, batch_id long"
#: Actions that make a document's chunks anew, and those that change its chunks at all.
MADE = (scd2.INSERT, scd2.NEW_VERSION, scd2.RECHUNK)
CHUNKED = (*MADE, scd2.MOVE)
VECTORS = ch.VECTORS + ", attempt string"
CHUNKS = "chunk_id string, doc_id string, doc_sk long, ord int, text string, text_hash string, embedding array<float>, embed_model string"


@dataclass
class Run:
    status: str
    mode: str = ""
    reason: str = ""
    stats: dict = field(default_factory=dict)
    findings: list = field(default_factory=list)
    pending: dict = field(default_factory=dict)


def _extract(rule: DocType, frames: dict[str, DataFrame], keys: DataFrame | None, n_keys: int | None = None) -> DataFrame:
    """Rows of the run: all, or those of the changed keys, with the children of those alone."""
    parent = frames[f"{rule.source.namespace}.{rule.source.table}" if rule.source.namespace else rule.source.table]
    children = {a: frames[f"{c.namespace}.{c.table}" if c.namespace else c.table] for a, c in rule.children.items()}
    if keys is None:
        return mapping.source_rows(rule, parent, children)
    keyed = parent.withColumn("record_key", F.col(rule.source.key).cast("string"))
    return mapping.source_rows(rule, changes.changed_rows(keyed, keys, n_keys).drop("record_key"), children, few=True)


def stage(rule: DocType, rows: DataFrame, keys: DataFrame | None, versions: DataFrame, rechunk: bool, stored_chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """Decisions for every document of the run, those whose row is gone included."""
    current = versions.where(F.col("is_current") & (F.col("doc_type") == rule.doc_type))
    docs = mapping.build_documents(rule, rows).drop("record_key")
    same = None
    if rechunk:
        fresh = ch.chunk_rows(current.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_sk", mapping.document_text(F.col("title"), F.col("body")).alias("text")), size, overlap)
        same = ch.same_chunks(stored_chunks, fresh).join(current.select("doc_sk", "doc_id"), "doc_sk").select("doc_id")
    decided = scd2.decide(current, docs, rule.scd2, rechunk, same)
    if keys is None:
        gone = scd2.vanished(current, docs)
    else:
        lost = keys.select(F.concat(F.lit(f"{rule.doc_type}:"), F.col("record_key")).alias("doc_id")).join(docs.select("doc_id"), "doc_id", "left_anti")
        held = current.join(lost, "doc_id", "left_semi")
        gone = scd2.vanished(held, docs.limit(0), "the source row is gone")
    dropped = scd2.decide(current, gone.drop("gone_reason"), rule.scd2).drop("reason").join(gone.select("doc_id", F.col("gone_reason").alias("reason")), "doc_id")
    return decided.unionByName(dropped.select(*decided.columns))


def restage_chunks(stored: DataFrame, after: DataFrame, decided: DataFrame, size: int, overlap: int) -> DataFrame:
    """The chunks, after a batch, of the documents whose chunks it changes: moved, or made anew with carried vectors.

    stored: their chunks before. after: their versions after the batch.
    """
    now = after.where("is_current").select("doc_id", F.col("doc_sk").alias("new_sk"))
    act = decided.select("doc_id", "action", F.col("p_doc_sk").alias("old_sk")).join(now, "doc_id")
    moves = act.where(F.col("action") == scd2.MOVE).select("old_sk", "new_sk")
    made = act.where(F.col("action").isin(*MADE))
    kept = ch.move_chunks(stored.join(moves.select(F.col("old_sk").alias("doc_sk")), "doc_sk", "left_semi"), moves)
    texts = made.select(F.col("new_sk").alias("doc_sk")).join(after.select("doc_sk", mapping.document_text(F.col("title"), F.col("body")).alias("text")), "doc_sk")
    cut = ch.chunk_rows(texts, size, overlap).join(made.select("doc_id", F.col("new_sk").alias("doc_sk")), "doc_sk")
    replaced = made.where("old_sk is not null").select(F.col("old_sk").alias("doc_sk"))
    fresh = ch.carry_vectors(cut, stored.join(replaced, "doc_sk", "left_semi"))
    keyed = fresh.withColumn("chunk_id", F.concat(F.col("doc_sk").cast("string"), F.lit("-"), F.col("ord").cast("string"), F.lit("-"), F.substring("text_hash", 1, 8)))
    return kept.unionByName(keyed.select(*kept.columns))


def _touched(manifest: Manifest, doc_ids: DataFrame) -> list[int]:
    """The buckets of some documents."""
    return sorted(r[0] for r in doc_ids.select(bucket_of(F.col("doc_id"), manifest.buckets)).distinct().collect())


def _chunks(store: Store, manifest: Manifest, versions: DataFrame, buckets: list[int] | None = None) -> DataFrame:
    """The chunk table; the chunks of a store of layout 1 take the doc_id that they lack from their version."""
    rows = store.table("chunk", CHUNKS, manifest, None if isinstance(manifest.tables.get("chunk"), str) else buckets)
    if not isinstance(manifest.tables.get("chunk"), str):
        return rows
    return rows.drop("doc_id").join(versions.select("doc_sk", "doc_id"), "doc_sk").select(*rows.columns)


def _chunk_counters(acts: DataFrame, before: DataFrame, after: DataFrame) -> dict[str, int]:
    """acts: doc_id, action. Chunks that a batch made, took away and moved, and the vectors that new chunks carry."""
    made = F.col("action").isin(*MADE)
    new = after.join(acts, "doc_id").agg(
        F.count_if(made).alias("chunks_added"), F.count_if(F.col("action") == scd2.MOVE).alias("chunks_moved"), F.count_if(made & F.col("embedding").isNotNull()).alias("vectors_carried"),
    ).first().asDict()
    return {**new, "chunks_removed": before.join(acts.where(made), "doc_id", "left_semi").count()}


def _decisions(spark: SparkSession, store: Store, rule: DocType, frames: dict[str, DataFrame], manifest: Manifest, full: bool, size: int, overlap: int):
    """Mode, reason, head, rows and a plan of what happens to each document (None: nothing changed), and the buckets read."""
    stored_mark = manifest.watermarks.get(rule.doc_type)
    mark = changes.Watermark(**stored_mark) if stored_mark else None
    signature = rule.signature(size, overlap)
    mode, reason = changes.choose_mode(mark, signature, full)
    head = changes.source_head(frames["record_change"], rule.source.source_id).first()["head"]
    changes.check_window(mode, mark, head)
    batch, keys, n_keys, buckets = manifest.number + 1, None, None, None
    if mode == "incremental":
        path = store.write("changed", changes.changed_keys(frames["record_change"], rule.source.source_id, mark.change_id, head), batch)
        keys = spark.read.schema("record_key string").parquet(f"{store.root}/{path}")
        n_keys = keys.count()
        if not n_keys:
            return mode, reason, head, signature, None, None, None
        buckets = _touched(manifest, keys.select(F.concat(F.lit(f"{rule.doc_type}:"), F.col("record_key")).alias("doc_id")))
    rows = _extract(rule, frames, keys, n_keys)
    # Rows are checked, mapped and counted: their collections are worked out once.
    path = store.write("extract", rows, batch)
    rows = spark.read.schema(rows.schema).parquet(f"{store.root}/{path}")
    versions = store.table("document", VERSIONS, manifest, buckets)
    decided = lambda: stage(rule, rows, keys, versions, changes.rechunk_all(mark, signature), _chunks(store, manifest, versions, buckets), size, overlap)
    return mode, reason, head, signature, rows, decided, buckets


def ingest(spark: SparkSession, store: Store, rule: DocType, frames: dict[str, DataFrame] | Snapshot, catalog: Catalog, *args, **how) -> Run:
    """ingest_leased() with the store held for writing: runs of other document types wait instead of losing their work."""
    with store.lease():
        return ingest_leased(spark, store, rule, frames, catalog, *args, **how)


def ingest_leased(spark: SparkSession, store: Store, rule: DocType, frames: dict[str, DataFrame] | Snapshot, catalog: Catalog, full: bool = False, size: int = SIZE, overlap: int = OVERLAP, approve_over: int = 0, now: datetime.datetime | None = None, provider: ch.EmbeddingProvider | None = None, max_chunks: int | None = None) -> Run:
    """One batch of one document type. Findings of severity error stop it before anything is published.

    The head is read once, and the change window is closed by it. Documents, chunks, their index and watermark are one
    commit. A batch reads the buckets of documents that it changes and writes what it changes in them. With more than
    approve_over pending chunks (0: no limit) the run's status is waiting: documents are in, embedding waits for approve().
    Else provider, if there is one, embeds what is pending, at most max_chunks texts. frames: tables by name; where they are
    a snapshot, all steps read its files, and the list is kept with the run.
    """
    manifest: Manifest = store.manifest()
    pinned = frames if isinstance(frames, Snapshot) else None
    frames = pinned.frames(spark) if pinned else frames
    wrong = validate(rule, frames, catalog)
    if any(s == "error" for s, _ in wrong):
        return Run("failed", findings=wrong)
    mode, reason, head, signature, rows, plan, _ = _decisions(spark, store, rule, frames, manifest, full, size, overlap)
    if rows is None:
        return Run("nothing", mode, reason)
    found = quality.run_checks(rows, rule.quality, mode)
    findings = [tuple(r) for r in found.where("not passed").collect()]
    if any(f[2] == "error" for f in findings):
        return Run("failed", mode, reason, findings=findings)
    batch, at = manifest.number + 1, now or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    # Decisions are read several times: they become a table of the batch first.
    path = store.write("decision", plan(), batch)
    decided = spark.read.parquet(f"{store.root}/{path}")
    stats = scd2.batch_stats(decided).first().asDict()
    acts = decided.where(F.col("action") != scd2.UNCHANGED).select("doc_id", "action")
    touched = _touched(manifest, acts)
    top = manifest.top
    if top is None:
        top = store.table("document", VERSIONS, manifest).agg(F.coalesce(F.max("doc_sk"), F.lit(0))).first()[0]
    if touched:
        versions = store.table("document", VERSIONS, manifest, touched)
        tables = dict(manifest.tables)
        rows, dead = scd2.delta(versions, decided, at, head, batch, top)
        tables["document"] = store.add_layer("document", VERSIONS, rows, dead, batch, manifest)
        after = store.table("document", VERSIONS, Manifest(**{**asdict(manifest), "tables": tables}), touched)
        current = lambda df: df.where("is_current").select("doc_sk", "doc_id", "metadata")
        if "meta" in tables or not manifest.tables.get("document"):
            metadata.update(store, manifest, tables, current(rows), current(versions.join(dead.select("doc_sk"), "doc_sk", "left_semi")), batch)
        else:  # a store of an older layout
            every = current(store.table("document", VERSIONS, Manifest(**{**asdict(manifest), "tables": tables})))
            metadata.update(store, manifest, tables, every, every.limit(0), batch)
        own = acts.where(F.col("action").isin(*CHUNKED))
        before = _chunks(store, manifest, versions, touched).join(own, "doc_id", "left_semi")
        # The batch's chunks are read for the index and the counters: they become a table of the batch first.
        path = store.write("made", restage_chunks(before, after, decided, size, overlap), batch)
        chunks = spark.read.schema(CHUNKS).parquet(f"{store.root}/{path}")
        tables["chunk"] = store.add_layer("chunk", CHUNKS, chunks, before, batch, manifest)
        counted = _chunk_counters(acts, before, chunks)
        stats |= counted
        new = acts.where(F.col("action").isin(*MADE))
        if "posting" in tables or not manifest.tables.get("chunk"):
            index.update(store, manifest, tables, chunks.join(new, "doc_id", "left_semi"), before.join(new, "doc_id", "left_semi"), batch)
        else:  # a store of an older layout: its whole index is made now
            index.build(store, manifest, tables, batch)
        vectors.update(store, manifest, tables, chunks, before, batch)
        if manifest.chunks is None:
            manifest.chunks = store.table("chunk", CHUNKS, manifest).count()
        manifest.chunks += counted["chunks_added"] - counted["chunks_removed"]
        manifest.tables, manifest.top = tables, top + stats["versions_created"]
    manifest.watermarks[rule.doc_type] = asdict(changes.Watermark(rule.doc_type, rule.source.source_id, head, signature))
    pending = ch.pending_cost(store.table("chunk", CHUNKS, manifest)).first().asDict()
    status = "waiting" if 0 < approve_over < pending["texts"] else "succeeded"
    manifest.runs[rule.doc_type] = {"batch": batch, "status": status, "mode": mode}
    if pinned:
        path = store.write(f"source-{rule.doc_type}", pinned.table(spark).coalesce(1), batch)
        manifest.tables[f"source-{rule.doc_type}"] = path
    store.publish(manifest)
    told = (batch, rule.doc_type, at, status, mode, json.dumps(stats, sort_keys=True))
    store.append("batch", spark.createDataFrame([told], BATCHES).coalesce(1))
    if provider is not None and status == "succeeded" and pending["texts"]:
        done = embed_step(spark, store, provider, max_chunks)
        status, pending, reason = done.status, done.pending, done.reason or reason
    return Run(status, mode, reason, stats, findings, pending)


BATCHES = "batch long, doc_type string, at timestamp, status string, mode string, stats string"


def batches(store: Store) -> DataFrame:
    """The log of published runs, latest first; stats is a JSON object."""
    return store.log("batch", BATCHES).orderBy(F.desc("batch"))


def preview(spark: SparkSession, store: Store, rule: DocType, frames: dict[str, DataFrame], full: bool = False, size: int = SIZE, overlap: int = OVERLAP) -> dict:
    """What ingest() would do now: mode, head, documents by kind, texts to embed. Nothing is published."""
    manifest = store.manifest()
    mode, reason, head, _, rows, plan, _ = _decisions(spark, store, rule, frames, manifest, full, size, overlap)
    out = {"mode": mode, "reason": reason, "head": head}
    if rows is None:
        return out
    decided = plan()
    made = decided.where(F.col("action").isin(scd2.INSERT, scd2.NEW_VERSION, scd2.RECHUNK))
    texts = made.select(F.xxhash64("doc_id").alias("doc_sk"), mapping.document_text(F.col("title"), F.col("body")).alias("text"))
    known = store.table("chunk", CHUNKS, manifest).where("embedding is not null").select("text_hash")
    return {**out, **plan_preview(decided, ch.chunk_rows(texts, size, overlap), known).first().asDict()}


def plan_preview(decided: DataFrame, fresh: DataFrame, known: DataFrame) -> DataFrame:
    """What a run would do, without doing it: documents by kind, and the distinct chunk texts it would embed.

    fresh: chunks of the documents that would be written. known: text_hash of every chunk that has a vector.
    """
    did = lambda *a: F.count_if(F.col("action").isin(*a))
    counts = decided.agg(did(scd2.INSERT).alias("new_documents"), did(scd2.NEW_VERSION, scd2.RECHUNK).alias("changed_documents"), did(scd2.UNCHANGED).alias("unchanged_documents"), did(scd2.INSERT, scd2.NEW_VERSION, scd2.MOVE).alias("new_versions"))
    todo = fresh.groupBy("text_hash").agg(F.max(F.length("text")).alias("n")).join(known.select("text_hash").distinct(), "text_hash", "left_anti")
    cost = todo.agg(F.count("*").alias("to_embed"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"))
    return counts.join(cost)


def init_index(store: Store, provider: ch.EmbeddingProvider, force: bool = False) -> dict:
    """Pin the index to a provider's model and dimension, and return the pin. Vectors of two models never mix: another model
    or dimension than the pinned is refused, or, by force, takes its place and every vector goes."""
    manifest, wanted = store.manifest(), {"model": provider.model, "dim": len(provider.embed(["dimension"])[0])}
    if manifest.index.get("model") and {**manifest.index, **wanted} != manifest.index:
        if not force:
            raise ValueError(f"the index is pinned to {manifest.index}, not {wanted}")
        versions = store.table("document", VERSIONS, manifest)
        held = _chunks(store, manifest, versions).where("embedding is not null")
        bare = held.withColumns({"embedding": F.lit(None).cast("array<float>"), "embed_model": F.lit(None).cast("string")})
        manifest.tables["chunk"] = store.add_layer("chunk", CHUNKS, bare, held, manifest.number + 1, manifest)
        for name in ("vector_list", "centroid"):
            manifest.tables.pop(name, None)
        store.remove("vector")
    if {**manifest.index, **wanted} != manifest.index:
        manifest.index = {**manifest.index, **wanted}
        store.publish(manifest)
    return wanted


def build_vectors(store: Store, lists: int | None = None) -> dict:
    """Index the vectors of all chunks anew; how many lists and vectors there are."""
    manifest = store.manifest()
    rows = _chunks(store, manifest, store.table("document", VERSIONS, manifest))
    manifest = vectors.build(store, manifest, rows.where(F.col("embed_model") == manifest.index.get("model", "")), lists)
    held = store.table("centroid", vectors.CENTROID, manifest).agg(F.count("*").alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"))
    return held.first().asDict()


class IndexStateError(RuntimeError):
    """There is no index, or it holds vectors of another model than the one asked for."""


def require_state(store: Store, provider: ch.EmbeddingProvider) -> dict:
    """The index's pin, if it is the provider's: distances between vectors of two models mean nothing."""
    held = store.manifest().index
    if not held.get("model"):
        raise IndexStateError("there is no index yet: run init or embed first")
    if held["model"] != provider.model:
        raise IndexStateError(f"the index holds vectors of {held['model']}, not of {provider.model}: go back to that model, or init by force and embed again")
    return held


def approve(store: Store, doc_type: str, yes: bool = True, provider: ch.EmbeddingProvider | None = None) -> Run:
    """Answer a waiting run: it goes on with embedding by the provider, or it is refused and its chunks stay pending."""
    manifest = store.manifest()
    held = manifest.runs.get(doc_type, {})
    if held.get("status") != "waiting":
        raise ValueError(f"no run of {doc_type} waits")
    held["status"] = "approved" if yes else "refused"
    store.publish(manifest)
    return embed_step(store.spark, store, provider) if yes and provider is not None else Run(held["status"])


def _types_pending(store: Store, manifest: Manifest) -> set[str]:
    """The document types with chunks that have no vector."""
    open_ = store.table("chunk", CHUNKS, manifest).where("embedding is null").select("doc_sk").distinct()
    return {r[0] for r in store.table("document", VERSIONS, manifest).join(open_, "doc_sk", "left_semi").select("doc_type").distinct().collect()}


def embed_step(spark: SparkSession, store: Store, provider: ch.EmbeddingProvider, limit: int | None = None, wave: int = 100_000, together: int | None = None) -> Run:
    """Embed distinct pending texts, reuse equal ones, and publish; also what resumes a waiting or stopped run.

    Texts go in waves of about wave, in order of their hash: they are written down once, with their wave, and each wave reads
    its own. A wave's vectors are kept before the next one starts, and a failing request costs its own batch only: the run
    stops, publishes what it has, and the next run asks for the rest. Chunks that got a vector are all that is written. A
    run's status follows what is left of its own document type; one that waits or was refused stays so while anything is.
    together: so many tasks ask in rounds and wait together, where a provider's quota is one for all.
    """
    manifest = store.manifest()
    if manifest.index.get("model", provider.model) != provider.model:
        return Run("embedding_refused", reason=f"the index holds vectors of {manifest.index['model']}")
    batch = manifest.number + 1
    stored = _chunks(store, manifest, store.table("document", VERSIONS, manifest))
    pending = stored.where("embedding is null")
    known = ch.vectors_by_hash(stored.where(F.col("embed_model") == provider.model).join(pending.select("text_hash").distinct(), "text_hash", "left_semi"))
    kept = lambda: store.log("vector", VECTORS).where(F.col("embed_model") == provider.model)
    new = pending.join(known.select("text_hash"), "text_hash", "left_anti").join(kept().where("embedding is not null").select("text_hash"), "text_hash", "left_anti")
    todo = ch.embed_budget(new, limit) if limit is not None else new.groupBy("text_hash").agg(F.min("text").alias("text"))
    path = store.write("todo", todo, batch)
    todo = spark.read.schema("text_hash string, text string").parquet(f"{store.root}/{path}")
    waves, error = -(-todo.count() // wave), None
    if waves > 1:
        place = F.floor(F.conv(F.substring("text_hash", 1, 8), 16, 10).cast("long") * waves / 2**32).cast("int")
        waved = f"{store.root}/{path}-waves"
        todo.withColumn("wave", place).repartition("wave").write.mode("overwrite").partitionBy("wave").parquet(waved)
        todo = spark.read.schema("text_hash string, text string, wave int").parquet(waved)
    for w in range(waves):
        attempt = f"{batch}-{w}-{uuid.uuid4()}"
        part = todo.where(F.col("wave") == w) if waves > 1 else todo
        store.append("vector", (ch.embed_together(part, provider, together) if together else ch.embed(part, provider)).withColumn("attempt", F.lit(attempt)))
        error = kept().where(F.col("attempt") == attempt).agg(F.min("error")).first()[0]
        if error is not None:
            break
    got = kept().where("embedding is not null").groupBy("text_hash").agg(F.first("embedding").alias("embedding"), F.first("embed_model").alias("embed_model"))
    known_now = known.unionByName(got.join(known.select("text_hash"), "text_hash", "left_anti"))
    filled = pending.drop("embedding", "embed_model").join(known_now, "text_hash").select(*stored.columns)
    manifest.tables["chunk"] = store.add_layer("chunk", CHUNKS, filled, filled, batch, manifest)
    vectors.update(store, manifest, manifest.tables, store.table("chunk", CHUNKS, manifest).join(filled.select("chunk_id"), "chunk_id", "left_semi"), filled.limit(0), batch)
    manifest.index = {"model": provider.model, **manifest.index}
    left = ch.pending_cost(store.table("chunk", CHUNKS, manifest)).first().asDict()
    status = "failed" if error is not None else "succeeded" if not left["texts"] else "stopped"
    open_types = _types_pending(store, manifest) if left["texts"] else set()
    for doc_type, run in manifest.runs.items():
        if doc_type not in open_types:
            run["status"] = "succeeded"
        elif run["status"] not in ("waiting", "refused"):
            run["status"] = status
    store.publish(manifest)
    store.remove("vector")
    return Run(status, reason=error or "", pending=left)
