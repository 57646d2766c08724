"""Command line over the library: python -m evidence.cli COMMAND --root STORE --rules FOLDER --source FOLDER ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence import logs
from evidence.operators import catalog, changes, gate, scd2, search
from evidence.operators import chunks as ch
from evidence.plans import answer
from evidence.plans import ingest as run
from evidence.sources import catalogs, snapshot
from evidence.sources.rules import load_rules_cached
from evidence.sources.store import Store
from evidence.streaming import changelog
from evidence.workers import on_workers

PAUSED, FAILED = 3, 1
#: Seconds between the runs of ingest --loop.
INTERVAL = 300
COMMANDS = ["migrate", "init", "ingest", "plan", "approve", "embed", "index", "status", "history", "qualify", "search", "ask", "chat", "resume", "conversations", "feedback", "rules-check", "catalog"]


def _tables(spark: SparkSession, folder: str, rule, keys: dict) -> tuple[snapshot.Snapshot, dict[str, DataFrame], catalog.Catalog]:
    """Parquet tables of a rule, and of the change log, from a folder: <schema>.<table>.parquet or <table>.parquet."""
    names = {f"{x.namespace}.{x.table}" if x.namespace else x.table for x in (rule.source, *rule.children.values())} | {snapshot.LOG}
    pinned = snapshot.pin(spark, folder, sorted(names))
    frames = pinned.frames(spark)
    return pinned, frames, catalog.read_catalog(frames, keys)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evidence")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("text", nargs="?", default="")
    p.add_argument("--root", default="store")
    p.add_argument("--rules", default="rules")
    p.add_argument("--source", default="source")
    p.add_argument("--doc-types", default="all")
    p.add_argument("--filter", action="append", default=[])
    p.add_argument("--full", action="store_true")
    p.add_argument("--force", action="store_true", help="init: drop the vectors of another model")
    p.add_argument("--no", action="store_true", help="approve: refuse")
    p.add_argument("--approve-over", type=int, default=0)
    p.add_argument("--no-embed", action="store_true", help="ingest: documents and chunks only")
    p.add_argument("--max-chunks", type=int, help="ingest, embed: at most so many texts are embedded")
    p.add_argument("--loop", action="store_true", help="ingest: follow the change log, a run for what is new, until stopped")
    p.add_argument("--interval", type=int, default=INTERVAL, help="ingest --loop: seconds between runs")
    p.add_argument("--follow-up", action="store_true", help="qualify: judge it as a turn of a conversation")
    p.add_argument("--candidates", type=int, default=search.CANDIDATES)
    p.add_argument("--limit", type=int, default=20, help="conversations, status: how many")
    p.add_argument("--refresh", action="store_true", help="rules-check: read the catalog anew, not its latest run")
    p.add_argument("--pause", help="resume: the turn that waits")
    p.add_argument("--top-k", type=int, default=search.TOP_K)
    p.add_argument("--thread", help="ask, chat: the conversation to go on with")
    p.add_argument("--cap", type=int, default=0, help="ask, chat: questions a day, 0 for any number")
    p.add_argument("--verdict", choices=["good", "bad"], default="good", help="feedback: of the answer whose query_id is given")
    p.add_argument("--comment")
    p.add_argument("--stored", action="store_true", help="catalog: of the latest run, tables are not read")
    p.add_argument("--export", help="catalog: also write it to this file, as YAML")
    p.add_argument("--log", choices=["json", "text"], default="json")
    p.add_argument("--log-level", default="INFO")
    a = p.parse_args(argv)
    logs.set_up(a.log_level, a.log == "json")
    spark = SparkSession.builder.appName("evidence").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    on_workers(spark)
    store, embedder = Store(spark, a.root), ch.HashEmbedder()
    show = lambda x: print(json.dumps(x, default=str, ensure_ascii=False), flush=True)

    if a.command == "catalog":
        return _catalog(spark, store, a, show)
    if a.command == "ingest" and a.loop:
        return _follow(spark, store, a, embedder, show)
    if a.command in ("ingest", "plan", "rules-check"):
        return _run(spark, store, a, embedder, show)
    if a.command == "migrate":
        show({"steps": store.migrate()})
    elif a.command == "init":
        with store.lease():
            show(run.init_index(store, embedder, a.force))
    elif a.command == "approve":
        with store.lease():
            done = run.approve(store, a.text, not a.no, None if a.no else embedder)
        show({"doc_type": a.text, **done.__dict__})
        return FAILED if done.status == "failed" else 0
    elif a.command == "embed":
        with store.lease():
            done = run.embed_step(spark, store, embedder, a.max_chunks)
        show(done.__dict__)
        return 0 if done.status == "succeeded" else FAILED
    elif a.command == "index":
        with store.lease():
            show(run.build_vectors(store))
    elif a.command == "status":
        manifest = store.manifest()
        marks = [(k, m["source_id"], m["change_id"]) for k, m in manifest.watermarks.items()]
        log = f"{a.source}/record_change.parquet"
        behind = []
        if marks and store.exists(log):
            known = spark.createDataFrame(marks, "doc_type string, source_id string, change_id long")
            behind = [r.asDict() for r in changes.changes_behind(spark.read.parquet(log), known).orderBy("doc_type").collect()]
        recent = [r.asDict() for r in run.batches(store).limit(a.limit).collect()]
        show({"manifest": manifest.__dict__, "behind": behind, "batches": recent, "index": [r.asDict() for r in ch.index_stats(store.table("document", run.VERSIONS), store.table("chunk", run.CHUNKS)).collect()]})
    elif a.command == "history":
        for r in scd2.document_history(store.table("document", run.VERSIONS), a.text).collect():
            show(r.asDict())
    elif a.command == "qualify":
        asked = spark.createDataFrame([(a.text, len(a.filter), 0, a.follow_up)], "question string, n_filters int, n_doc_types int, is_follow_up boolean")
        show(gate.qualify(asked, load_rules_cached(a.rules).gate).first().asDict())
    elif a.command in ("ask", "chat", "resume"):
        return _ask(store, a, embedder, show)
    elif a.command == "conversations":
        for r in answer.conversations(store, a.limit).collect():
            show(r.asDict())
    elif a.command == "feedback":
        answer.feedback(store, a.text, a.verdict == "good", a.comment)
        show({"query_id": a.text, "verdict": a.verdict})
    else:
        chosen = [] if a.doc_types == "all" else [r.doc_type for r in load_rules_cached(a.rules).resolve(a.doc_types)]
        for r in answer.find(store, a.text, embedder, a.top_k, a.candidates, chosen, search.parse_filters(a.filter)).collect():
            show(r.asDict())
    return 0


def _run(spark: SparkSession, store: Store, a: argparse.Namespace, embedder: ch.EmbeddingProvider, show) -> int:
    """One run of ingest, plan or rules-check over the chosen document types."""
    code = 0
    for rule in load_rules_cached(a.rules).resolve(a.doc_types):
        keys = {f"{rule.source.namespace}.{rule.source.table}" if rule.source.namespace else rule.source.table: (rule.source.key,)}
        pinned, frames, found = _tables(spark, a.source, rule, keys)
        if a.command == "rules-check":
            kept = None if a.refresh else catalogs.load_catalog(store)
            wrong = catalog.validate(rule, frames, kept or found)
            show({"doc_type": rule.doc_type, "findings": wrong})
            code = max(code, FAILED if any(s == "error" for s, _ in wrong) else 0)
        elif a.command == "plan":
            show({"doc_type": rule.doc_type, **run.preview(spark, store, rule, frames, full=a.full)})
        else:
            done = run.ingest(spark, store, rule, pinned, found, full=a.full, approve_over=a.approve_over, provider=None if a.no_embed else embedder, max_chunks=a.max_chunks)
            show({"doc_type": rule.doc_type, **done.__dict__})
            code = max(code, {"failed": FAILED, "waiting": PAUSED}.get(done.status, 0))
    return code


def _follow(spark: SparkSession, store: Store, a: argparse.Namespace, embedder: ch.EmbeddingProvider, show) -> int:
    """Runs for what a stream of the change log brings, until it is stopped. --interval 0: once over what there is."""
    schema = "change_id long, source_id string, record_key string"
    follower = changelog.Follower(lambda: _run(spark, store, a, embedder, show))
    stream = changelog.change_stream(spark, f"{a.source}/record_change.parquet", schema)
    follower.start(stream, f"{a.root}/_stream", f"{a.interval} seconds" if a.interval else None).awaitTermination()
    for wrong in follower.failures:
        show({"failed": wrong})
    return FAILED if follower.failures else 0


def _catalog(spark: SparkSession, store: Store, a: argparse.Namespace, show) -> int:
    """Read the catalog of the rules' tables that catalog.yaml wants, and keep it as a run; or show the latest run."""
    if a.stored:
        found = catalogs.load_catalog(store)
        if found is None:
            return FAILED
    else:
        rules, frames, keys = load_rules_cached(a.rules), {}, {}
        for rule in rules.resolve(a.doc_types):
            source = f"{rule.source.namespace}.{rule.source.table}" if rule.source.namespace else rule.source.table
            keys[source] = (rule.source.key,)
            frames |= _tables(spark, a.source, rule, keys)[1]
        found = catalog.read_catalog({n: df for n, df in frames.items() if rules.catalog.wants(n)}, keys, sizes=True)
        catalogs.save_catalog(store, found)
    if a.export:
        Path(a.export).write_text(catalogs.to_yaml(found), encoding="utf-8")
    show(found.to_dict())
    return 0


def _ask(store: Store, a: argparse.Namespace, embedder: ch.EmbeddingProvider, show) -> int:
    """One question, or each line of the input as a turn of one conversation."""
    rules, code, thread = load_rules_cached(a.rules), 0, a.thread
    chosen = [] if a.doc_types == "all" else [r.doc_type for r in rules.resolve(a.doc_types)]
    lines = [a.text] if a.command != "chat" else (line.strip() for line in sys.stdin)
    for question in lines:
        if a.command == "chat" and not question:
            continue
        body = {"question": question, "doc_types": chosen, "filters": search.parse_filters(a.filter), "thread": thread}
        how = {"top_k": a.top_k, "cap": a.cap, "candidates": a.candidates}
        if a.command == "resume":
            reply = answer.resume(store, rules.gate, a.pause, question, sorted(rules.doc_types), embedder, answer.ExcerptChat(), **how)
        else:
            reply = answer.ask(store, rules.gate, body, sorted(rules.doc_types), embedder, answer.ExcerptChat(), clarify=a.command == "ask", **how)
        show(reply.__dict__)
        thread, code = reply.thread, FAILED if reply.error else code
    return code


if __name__ == "__main__":
    sys.exit(main())
