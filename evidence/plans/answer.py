"""Answering a question: daily cap, gate, follow-up, search, prompt, chat, citations; conversations and the log of turns.

The log only grows: a turn is a row of the folder turn_log in the store. Two turns of one conversation that are asked at
the same time may get the same number. A question that is too vague can pause its turn: what was asked is kept, sample
questions are offered, and resume() goes on with the corrected question, in this process or another.
"""

from __future__ import annotations

import datetime
import json
import logging
import re
import time
import uuid
from dataclasses import dataclass, field
from typing import Protocol

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from evidence.operators import chunks as ch
from evidence.operators import conversation as cv
from evidence.operators import gate, search
from evidence.plans import index, metadata, vectors
from evidence.plans import ingest as run
from evidence.rules.spec import Gate
from evidence.sources.store import Store

#: retrieved: the documents of the hits, best first, as a JSON array. hits: all about them, as a JSON array.
TURNS = "query_id string, asked_at timestamp, conversation_id string, turn int, question string, standalone string, doc_types array<string>, top_k int, retrieved string, hits string, answer string, decision string, rule_id string, embed_model string, chat_model string, duration_ms long, error string, pause_id string"
CONVERSATIONS = "conversation_id string, created_at timestamp"
FEEDBACK = "query_id string, given_at timestamp, good boolean, comment string"
#: asked: the request, as JSON. A pause is over when its turn is logged.
PAUSES = "pause_id string, paused_at timestamp, conversation_id string, asked string"
NO_RECORDS = "The records hold nothing on that."
SAMPLES, SAMPLE_DOCUMENTS = 4, 12
#: Documents that a filter leaves, up to which their chunks are read instead of the indexes' nearest.
FEW = 2000
_ANSWER = "You answer questions about records. Use the excerpts and nothing else."
_REWRITE = "Rewrite the last question so that it can be understood without the earlier turns. Return the question alone."
_log = logging.getLogger(__name__)


class OverCap(RuntimeError):
    """As many questions as a day allows were asked today."""


class ChatProvider(Protocol):
    model: str

    def chat(self, system: str, prompt: str) -> str: ...


class ExcerptChat:
    """A deterministic stand-in for a model: repeats the first line of the first excerpt and cites it; rewrites nothing."""

    model = "excerpt"

    def chat(self, system: str, prompt: str) -> str:
        if system == _REWRITE:
            return prompt.rpartition("Question: ")[2]
        first = re.search(r"^\[1\] .*\n(.*)", prompt, re.MULTILINE)
        return f"{first[1]} [1]" if first else "No excerpt answers that."


@dataclass
class Reply:
    query_id: str | None
    thread: str
    turn: int
    decision: str
    question: str
    answer: str | None
    sources: list[dict] = field(default_factory=list)
    cited: list[int] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    error: str | None = None
    #: Of a turn that waits for a clearer question: what resume() takes, and questions that the records can answer.
    pause: str | None = None
    samples: list[str] = field(default_factory=list)


def turn_log(store: Store) -> DataFrame:
    return store.log("turn_log", TURNS)


def searchable(store: Store) -> DataFrame:
    """Chunks with what a search needs of their documents."""
    docs = store.table("document", run.VERSIONS).select("doc_sk", "doc_type", "metadata", "is_current", "is_active", "title")
    return store.table("chunk", run.CHUNKS).join(docs, "doc_sk")


def log_query(store: Store, turn: dict) -> str | None:
    """Add a turn to the log; its query_id. A turn that can't be written is told in the program's log, not raised."""
    query_id = uuid.uuid4().hex
    row = {**turn, "query_id": query_id}
    try:
        schema = store.log("turn_log", TURNS).schema
        store.append("turn_log", store.spark.createDataFrame([tuple(row.get(c) for c in schema.names)], schema).coalesce(1))
    except (Py4JError, PySparkException, OSError):
        _log.warning("the turn could not be logged", exc_info=True)
        return None
    return query_id


def open_conversation(store: Store, now: datetime.datetime | None = None) -> str:
    """Begin a conversation; its thread, 32 hexadecimal digits."""
    thread = uuid.uuid4().hex
    store.append("conversation", store.spark.createDataFrame([(thread, now or datetime.datetime.now(datetime.UTC))], CONVERSATIONS).coalesce(1))
    return thread


def conversations(store: Store, limit: int = 20) -> DataFrame:
    """The latest conversations: conversation_id, created_at, turns, title (their first question)."""
    found, log = store.log("conversation", CONVERSATIONS), turn_log(store)
    return cv.listed(found, log, limit).join(cv.titles(log), "conversation_id", "left").orderBy(F.desc("created_at"), "conversation_id")


def feedback(store: Store, query_id: str, good: bool, comment: str | None = None) -> None:
    """Keep a judgement of one logged answer."""
    if not turn_log(store).where(F.col("query_id") == query_id).take(1):
        raise ValueError(f"no answer {query_id} was logged")
    row = (query_id, datetime.datetime.now(datetime.UTC), good, comment)
    store.append("feedback", store.spark.createDataFrame([row], FEEDBACK).coalesce(1))


def _gated(spark: SparkSession, rules: Gate, question: str, request: dict, follow_up: bool) -> Row:
    schema = "question string, n_filters int, n_doc_types int, is_follow_up boolean"
    asked = spark.createDataFrame([(question, len(request["filters"]), len(request["doc_types"]), follow_up)], schema)
    return gate.qualify(asked, rules).withColumn("blocked", gate.blocked_answer(F.col("message"), F.col("sql_hint"))).first()


def _standalone(spark: SparkSession, chat: ChatProvider, question: str, earlier: list[Row], block: str) -> str:
    """The question to search for, where there are earlier turns. A rewrite that fails is none."""
    try:
        rewrite = chat.chat(_REWRITE, f"{block}\n\nQuestion: {question}")
    except Exception:  # whatever a provider raises
        _log.warning("the question could not be rewritten", exc_info=True)
        rewrite = None
    row = (earlier[-1]["question"], question, rewrite, [t["answer"] for t in earlier])
    one = spark.createDataFrame([row], "previous string, question string, rewrite string, answers array<string>")
    return one.select(cv.condensed(*(F.col(c) for c in one.columns))).first()[0]


def _suggested(store: Store, question: str, doc_types: list[str]) -> list[str]:
    """Questions that the records answer: of documents that match the words of this one, else of the latest."""
    docs = store.table("document", run.VERSIONS).where("is_current and is_active")
    docs = docs.where(F.col("doc_type").isin(doc_types)) if doc_types else docs
    near = [r["doc_id"] for r in index.text_search(store, question, SAMPLE_DOCUMENTS, search.allowed(doc_types)).select("doc_id").distinct().collect()]
    chosen = docs.where(F.col("doc_id").isin(near)) if near else docs.join(search.sample_recent(docs, SAMPLE_DOCUMENTS).select("doc_id"), "doc_id", "left_semi")
    return [r["question"] for r in search.sample_questions(chosen).orderBy("doc_id").limit(SAMPLES).collect()]


def _pause(store: Store, request: dict, thread: str, at: datetime.datetime) -> str:
    pause = uuid.uuid4().hex
    row = (pause, at, thread, json.dumps({**request, "thread": thread}))
    store.append("pause", store.spark.createDataFrame([row], PAUSES).coalesce(1))
    return pause


def resume(store: Store, rules: Gate, pause: str, question: str, doc_types: list[str], embedder: ch.EmbeddingProvider, chat: ChatProvider, **how) -> Reply:
    """Go on with a paused turn. The corrected question is judged like any other, but doesn't pause again; where there is
    none (blank), the turn ends with the gate's message."""
    held = store.log("pause", PAUSES).where(F.col("pause_id") == pause).first()
    if held is None:
        raise ValueError(f"there is no pause {pause}")
    if turn_log(store).where(F.col("pause_id") == pause).take(1):
        raise ValueError(f"pause {pause} is over")
    body = json.loads(held["asked"])
    return ask(store, rules, {**body, "question": question.strip() or body["question"]}, doc_types, embedder, chat, **{**how, "clarify": False, "pause": pause})


def ask(store: Store, rules: Gate, body: dict, doc_types: list[str], embedder: ch.EmbeddingProvider, chat: ChatProvider, top_k: int = search.TOP_K, cap: int = 0, now: datetime.datetime | None = None, candidates: int = search.CANDIDATES, clarify: bool = False, pause: str | None = None) -> Reply:
    """Answer a request (question, doc_types, filters, thread) and log the turn.

    A question that the gate blocks gets the gate's message, without a search or a model. A follow-up is judged twice: as
    typed, where rules may spare follow-ups, and as the standalone question that the search will use, where none are spared,
    whether or not the rewrite changed it. Without excerpts no model is asked. A model or an embedder that fails leaves a turn
    without an answer, and its error. clarify: a question that is too vague pauses its turn, which isn't logged until
    resume(). cap: questions a day, 0 for any. An index of another model than the embedder's is refused.
    """
    spark, began, at = store.spark, time.monotonic(), now or datetime.datetime.now(datetime.UTC)
    request = cv.parse_ask(body, doc_types)
    log = turn_log(store)
    if cap and cv.over_cap(cv.used_today(log, at).first()["used"], cap):
        raise OverCap(f"{cap} questions were asked today")
    thread = request["thread"]
    if thread is None:
        thread, earlier, turn = open_conversation(store, at), [], 1
    else:
        known = store.log("conversation", CONVERSATIONS).where(F.col("conversation_id") == thread)
        if not known.take(1):
            raise ValueError(f"there is no conversation {thread}")
        own = log.where(F.col("conversation_id") == thread)
        turns = cv.history(own)
        earlier, turn = turns.orderBy("n").collect(), cv.next_turn(known, own).first()["next_turn"]

    question = request["question"]
    reply = Reply(None, thread, turn, gate.PASS, question, None, steps=["qualify"])
    standalone, hits, passed = None, [], _gated(spark, rules, question, request, bool(earlier))
    if passed["decision"] == "clarify" and clarify:
        reply.decision, reply.answer, reply.steps = "clarify", passed["blocked"], ["qualify", "pause"]
        reply.samples, reply.pause = _suggested(store, question, request["doc_types"]), _pause(store, request, thread, at)
        return reply
    if passed["decision"] == gate.PASS and earlier:
        reply.steps += ["condense", "qualify"]
        wanted = _standalone(spark, chat, question, earlier, cv.history_block(turns).first()["block"])
        passed = _gated(spark, rules, wanted, request, False)
        standalone = None if wanted == question else wanted
    reply.decision = passed["decision"]
    if reply.decision != gate.PASS:
        reply.answer = passed["blocked"]
    else:
        run.require_state(store, embedder)
        reply.steps.append("search")
        try:
            hits = _found(store, standalone or question, embedder, request, top_k, candidates)
            if not hits:
                reply.answer = NO_RECORDS
            else:
                excerpts = spark.createDataFrame([(i, h["title"], h["text"]) for i, h in enumerate(hits, 1)], "rank int, title string, text string")
                asked = cv.questions_block(turns).first()["block"] if earlier else ""
                reply.steps.append("answer")
                reply.answer = chat.chat(_ANSWER, cv.build_prompt(question, search.context_block(excerpts).first()["context"], asked))
        except (Py4JError, PySparkException):
            raise
        except Exception as wrong:  # whatever a provider raises is told
            reply.error = f"{type(wrong).__name__}: {wrong}"
        else:
            if hits:
                one = spark.createDataFrame([(reply.answer, len(hits))], "answer string, n int")
                reply.cited = one.select(cv.mark_cited(F.col("answer"), F.col("n"))).first()[0]
        reply.sources = [{"rank": i, "doc_id": h["doc_id"], "title": h["title"], "matched_by": h["matched_by"]} for i, h in enumerate(hits, 1)]

    told = [{"rank": i, "chunk_id": h["chunk_id"], "doc_id": h["doc_id"], "score": round(h["score"], 6), "matched_by": h["matched_by"]} for i, h in enumerate(hits, 1)]
    used = "answer" in reply.steps
    reply.query_id = log_query(
        store,
        {
            "asked_at": at, "conversation_id": thread, "turn": turn, "question": question, "standalone": standalone,
            "doc_types": request["doc_types"] or None, "top_k": top_k, "retrieved": json.dumps([h["doc_id"] for h in hits]), "hits": json.dumps(told),
            "answer": reply.answer, "decision": reply.decision, "rule_id": passed["rule_id"], "embed_model": embedder.model,
            "chat_model": chat.model if used else None, "duration_ms": int((time.monotonic() - began) * 1000), "error": reply.error, "pause_id": pause,
        },
    )
    return reply


def _found(store: Store, question: str, embedder: ch.EmbeddingProvider, request: dict, top_k: int, candidates: int) -> list[Row]:
    return find(store, question, embedder, top_k, candidates, request["doc_types"], request["filters"]).collect()


def _few(store: Store, filters: dict) -> list[str] | None:
    """The documents that filters allow, by the metadata index, if they are no more than FEW."""
    held = metadata.documents_with(store, filters)
    found = [r["doc_id"] for r in held.select("doc_id").distinct().limit(FEW + 1).collect()] if held is not None else None
    return None if found is None or len(found) > FEW else found


def find(store: Store, question: str, embedder: ch.EmbeddingProvider, top_k: int = search.TOP_K, candidates: int = search.CANDIDATES, doc_types: list[str] | None = None, filters: dict | None = None) -> DataFrame:
    """The best chunks for a question, by vectors and by the stored text index, with title and text. An index of another
    model is refused."""
    if not question.strip():
        raise ValueError("the question is empty")
    run.require_state(store, embedder)
    chunks, vector, allowed = searchable(store), embedder.embed([question])[0], search.allowed(doc_types, filters)
    few, near = _few(store, filters or {}), None
    if few is None:
        near = vectors.vector_search(store, vector, candidates, allowed)
    else:  # so few documents that their chunks are looked up
        allowed, filters = search.allowed(doc_types) & F.col("doc_id").isin(few), None
        chunks = chunks.where(F.col("doc_id").isin(few))
    text_rows = index.text_search(store, question, candidates, allowed)
    found = search.hybrid_search(chunks, question, vector, top_k, candidates, doc_types=doc_types or None, filters=filters or None, text_rows=text_rows, vector_rows=near.rows if near else None)
    return found.join(chunks.select("chunk_id", "title", "text"), "chunk_id").orderBy(F.desc("score"), "chunk_id")
