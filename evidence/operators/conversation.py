"""Conversations: history, turns, titles, lists, daily use, citations, sources, prompts."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence.functions.text import strip

HISTORY, TITLE, ECHO, REWRITE = 6, 120, 20, 1000
# Labels that may stand before a rewritten question, and quotes around it.
_LABELS, _QUOTES = ("standalone question", "question", "rewritten question"), "\"'“”‘’`"


def history(log: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The last answered turns of each conversation that passed the gate, oldest first: conversation_id, turn, question, answer, n.

    log: conversation_id, turn, question, answer, error, decision.
    """
    answered = log.where(F.col("answer").isNotNull() & F.col("error").isNull() & (F.coalesce("decision", F.lit("pass")) == "pass"))
    late = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("turn")))
    kept = answered.withColumn("back", late).where(F.col("back") <= limit)
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn"))).select("conversation_id", "turn", "question", "answer", "n")


def next_turn(conversations: DataFrame, log: DataFrame) -> DataFrame:
    """The next turn of each conversation, blocked turns counted."""
    return conversations.select("conversation_id").join(log, "conversation_id", "left").groupBy("conversation_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_turn"))


def titles(log: DataFrame, longest: int = TITLE) -> DataFrame:
    return log.groupBy("conversation_id").agg(F.substring(F.min_by("question", "turn"), 1, longest).alias("title"))


def listed(conversations: DataFrame, log: DataFrame, limit: int) -> DataFrame:
    """The latest conversations and their number of turns, also those without any."""
    counted = conversations.join(log.select("conversation_id", "turn"), "conversation_id", "left").groupBy("conversation_id", "created_at").agg(F.count("turn").alias("turns"))
    return counted.orderBy(F.desc("created_at"), "conversation_id").limit(limit)


def indexed_doc_types(docs: DataFrame) -> DataFrame:
    """The document types that can be asked about, and how many current, active documents each has."""
    return docs.where("is_current and is_active").groupBy("doc_type").agg(F.count("*").alias("documents"))


def used_today(log: DataFrame, now: datetime.datetime) -> DataFrame:
    return log.where(F.col("asked_at") >= F.date_trunc("DAY", F.lit(now))).agg(F.count("*").alias("used"))


def citations(answer: Column) -> Column:
    """Numbers in [1] or [1, 2], distinct, ascending."""
    lists = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(lists, lambda s: F.split(s, r"\s*,\s*"))), lambda x: x.try_cast("int"))))


def mark_cited(answer: Column, n_sources: Column) -> Column:
    """The cited places among the sources; all of them if none is cited."""
    every = F.when(n_sources > 0, F.sequence(F.lit(1), n_sources)).otherwise(F.array().cast("array<int>"))
    hit = F.array_intersect(citations(answer), every)
    return F.when(F.size(hit) > 0, hit).otherwise(every)


def turn_sources(log: DataFrame, documents: DataFrame) -> DataFrame:
    """The logged document ids of each turn (retrieved, a JSON array) with today's title, null if gone: conversation_id, turn, n, doc_id, title."""
    ids = log.select("conversation_id", "turn", F.posexplode(F.from_json("retrieved", "array<string>")).alias("n", "doc_id"))
    return ids.join(documents.select("doc_id", "title"), "doc_id", "left").select("conversation_id", "turn", (F.col("n") + 1).alias("n"), "doc_id", "title")


def clean_rewrite(text: Column) -> Column:
    """The first line that isn't blank, without a label before it or quotes around it; null if nothing is left, or too much."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")
    line = F.regexp_replace(F.get(lines, F.lit(0)), rf"(?i)^({'|'.join(_LABELS)})\s*:\s*", "")
    bare = strip(F.btrim(strip(line), F.lit(_QUOTES)))
    return F.when((bare != "") & (F.length(bare) <= REWRITE), bare)


def condensed(previous: Column, question: Column, rewrite: Column, answers: Column) -> Column:
    """The question to search for. Without earlier turns (previous is null) and where nothing is left of the rewrite or it
    repeats an earlier answer, the question as typed; where there was no rewrite (null), the previous question and it."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))
    clean = clean_rewrite(rewrite)
    echoes = F.coalesce((F.length(flat(clean)) >= ECHO) & F.exists(answers, lambda a: flat(a).contains(flat(clean))), F.lit(False))
    return F.when(previous.isNull(), question).when(rewrite.isNull(), F.concat_ws(" ", previous, question)).when(clean.isNull() | echoes, question).otherwise(clean)


def shorten(text: Column, longest: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.rtrim(F.substring(text, 1, longest - 4)), F.lit(" ..."))).otherwise(text)


def history_block(turns: DataFrame, longest: int = 300) -> DataFrame:
    """Per conversation, its turns as one text."""
    one = F.concat(F.lit("Q: "), shorten(F.col("question"), longest), F.lit("\nA: "), shorten(F.col("answer"), longest))
    ordered = F.array_sort(F.collect_list(F.struct("turn", one.alias("s"))))
    return turns.groupBy("conversation_id").agg(F.array_join(F.transform(ordered, lambda x: x.s), "\n").alias("block"))


def questions_block(turns: DataFrame) -> DataFrame:
    """Per conversation, the questions of its turns (n, question) as a numbered list: what the answering model is told of them."""
    one = F.concat(F.col("n").cast("string"), F.lit(". "), F.col("question"))
    ordered = F.array_sort(F.collect_list(F.struct("n", one.alias("s"))))
    return turns.groupBy("conversation_id").agg(F.array_join(F.transform(ordered, lambda x: x.s), "\n").alias("block"))


_THREAD = re.compile(r"[0-9a-f]{32}\Z")


def parse_ask(body: dict, doc_types: list[str], longest: int = 2000, most_filters: int = 5) -> dict:
    """A checked request: question, doc_types, filters, thread. Errors name what is wrong."""
    question = str(body.get("question") or "").strip()
    if not question or len(question) > longest:
        raise ValueError(f"a question has 1 to {longest} characters")
    types, filters, thread = body.get("doc_types") or [], body.get("filters") or {}, body.get("thread")
    if unknown := [t for t in types if t not in doc_types]:
        raise ValueError(f"unknown document types {unknown}")
    if not isinstance(filters, dict) or len(filters) > most_filters:
        raise ValueError(f"filters are an object of at most {most_filters}")
    if thread is not None and not _THREAD.match(str(thread)):
        raise ValueError("a thread is 32 hexadecimal digits")
    return {"question": question, "doc_types": list(types), "filters": filters, "thread": thread}


def over_cap(used: int, cap: int) -> bool:
    """A cap of 0 is none."""
    return cap > 0 and used >= cap


def build_prompt(question: str, context: str, turns: str = "") -> str:
    before = f"Earlier questions:\n{turns}\n\n" if turns else ""
    return f"{before}Answer from the numbered excerpts only and cite them like [1].\n\nExcerpts:\n{context}\n\nQuestion: {question}"
