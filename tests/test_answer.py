import datetime
import json
import logging

import pytest

from evidence import logs
from evidence.operators import catalog as cat
from evidence.operators import chunks as ch
from evidence.operators import conversation as cv
from evidence.operators import gate
from evidence.plans import answer as an
from evidence.plans import ingest as run
from evidence.rules.spec import Gate
from evidence.sources import catalogs
from evidence.sources.store import Manifest, Store

NOON = datetime.datetime(2024, 5, 1, 12, tzinfo=datetime.UTC)


class Recorder(an.ExcerptChat):
    """Keeps prompts; rewrites to what it is given, and fails where that is an exception."""

    def __init__(self, rewrite=None, answer=None):
        self.seen, self.rewrite, self.answer = [], rewrite, answer

    def chat(self, system, prompt):
        self.seen.append(prompt)
        given = self.rewrite if system == an._REWRITE else self.answer
        if isinstance(given, Exception):
            raise given
        return given or super().chat(system, prompt)


@pytest.fixture
def store(spark, tmp_path):
    place, model = Store(spark, f"file://{tmp_path}/store"), ch.HashEmbedder()
    texts = {"n:a": "smooth river stones", "n:b": "white clouds above"}
    versions = [(i, d, "note", d, d.upper(), t, None, "{}", "", "", True, 1, True, NOON, None, "new", 1, 1) for i, (d, t) in enumerate(texts.items(), 1)]
    held = [(f"{i}-0", d, i, 0, t, f"h{i}", model.embed([t])[0], model.model) for i, (d, t) in enumerate(texts.items(), 1)]
    docs, chunks = spark.createDataFrame(versions, run.VERSIONS), spark.createDataFrame(held, run.CHUNKS)
    tables = {"document": place.write("document", docs, 1), "chunk": place.write("chunk", chunks, 1)}
    place.publish(Manifest(tables=tables, index={"model": model.model, "dim": model.dim}))
    return place


def say(store, question, chat=None, thread=None, **more):
    return an.ask(store, gate.DEFAULT, {"question": question, "thread": thread}, ["note"], ch.HashEmbedder(), chat or Recorder(), **more)


def test_a_turn_is_answered_cited_and_logged(store):
    got = say(store, "which river stones are smooth", Recorder(answer="They are smooth [2], not [7]."), now=NOON)
    assert (got.turn, got.decision, got.cited, got.steps) == (1, "pass", [2], ["qualify", "search", "answer"])
    row = an.turn_log(store).first()
    assert (row["query_id"], row["conversation_id"], row["answer"]) == (got.query_id, got.thread, got.answer)
    assert json.loads(row["retrieved"]) == [s["doc_id"] for s in got.sources] == [h["doc_id"] for h in json.loads(row["hits"])]
    titles = store.table("document", run.VERSIONS).select("doc_id", "title")
    sources = cv.turn_sources(an.turn_log(store), titles).orderBy("n").collect()
    assert [r["title"] for r in sources] == [s["title"] for s in got.sources]


def test_blocked_questions_need_no_model(store):
    chat = Recorder()
    got = say(store, "how many river stones are there", chat)
    assert (got.decision, got.steps, chat.seen, got.sources) == ("needs_sql", ["qualify"], [], [])
    row = an.turn_log(store).first()
    assert (row["decision"], row["rule_id"], row["chat_model"], row["retrieved"]) == ("needs_sql", "aggregate", None, "[]")


def test_follow_ups(store):
    first = say(store, "which river stones are smooth")
    chat = Recorder(rewrite="Question: how white are the clouds")
    second = say(store, "and the clouds", chat, first.thread)
    assert (second.turn, second.steps) == (2, ["qualify", "condense", "qualify", "search", "answer"])
    assert "which river stones are smooth" in chat.seen[0] and "which river stones are smooth" in chat.seen[1]
    third = say(store, "and others", Recorder(rewrite="how many clouds are there"), first.thread)
    assert (third.decision, third.sources) == ("needs_sql", [])
    fourth = say(store, "and above", Recorder(rewrite=OSError("down")), first.thread)
    asked = {r["turn"]: r["standalone"] for r in an.turn_log(store).collect()}
    assert "1. which river stones are smooth" in chat.seen[1] and "A:" not in chat.seen[1]  # questions alone
    # The blocked turn is no part of the history; the turn before it is.
    assert fourth.turn == 4 and asked == {1: None, 2: "how white are the clouds", 3: "how many clouds are there", 4: "and the clouds and above"}


def test_a_failing_model_leaves_a_turn_without_answer(store):
    got = say(store, "which river stones are smooth", Recorder(answer=TimeoutError("slow")))
    assert got.answer is None and got.error == "TimeoutError: slow" and got.query_id
    again = say(store, "which stones are smooth", Recorder(), got.thread)
    assert (again.turn, again.steps) == (2, ["qualify", "search", "answer"])


STRICT = Gate.of({"limits": {"min_words": 2}, "rules": [{"id": "topic", "kind": "reject", "require_any": ["river", "cloud"], "message": "Off topic.", "skip_for_follow_up": True}]})


@pytest.mark.parametrize("rewrite", [None, "how do I pick a lock"])
def test_a_follow_up_is_judged_as_the_question_that_is_searched(store, rewrite):
    """Rules that spare follow-ups don't spare the standalone question, whether or not the rewrite changed it."""
    strict = lambda q, chat, thread=None: an.ask(store, STRICT, {"question": q, "thread": thread}, ["note"], ch.HashEmbedder(), chat)
    assert strict("how do I pick a lock", Recorder()).decision == "reject"
    first = strict("which river stones are smooth", Recorder())
    chat = Recorder(rewrite=rewrite)
    second = strict("how do I pick a lock", chat, first.thread)
    assert (second.decision, second.answer, second.sources) == ("reject", "Off topic.", []) and len(chat.seen) == 1  # the rewrite alone
    third = strict("and the white ones", Recorder(rewrite="which clouds are white"), first.thread)
    assert third.decision == "pass" and third.sources


def test_an_index_of_another_model_is_refused(store):
    other = ch.HashEmbedder()
    other.model = "another"
    with pytest.raises(run.IndexStateError, match="hash-8"):
        an.ask(store, gate.DEFAULT, {"question": "which river stones"}, ["note"], other, Recorder())
    manifest = store.manifest()
    manifest.index = {}
    store.publish(manifest)
    with pytest.raises(run.IndexStateError, match="no index"):
        say(store, "which river stones are smooth")


def test_no_model_without_excerpts(spark, store):
    manifest, chat = store.manifest(), Recorder()
    manifest.tables = {}
    store.publish(manifest)
    got = say(store, "which river stones are smooth", chat)
    assert (got.answer, got.steps, chat.seen) == (an.NO_RECORDS, ["qualify", "search"], [])
    assert an.turn_log(store).first()["chat_model"] is None


def test_a_failing_embedder_is_logged_like_a_failing_model(store):
    class Down(ch.HashEmbedder):
        def embed(self, texts):
            raise ConnectionError("no route")

    got = an.ask(store, gate.DEFAULT, {"question": "which river stones"}, ["note"], Down(), Recorder())
    assert got.error == "ConnectionError: no route" and an.turn_log(store).first()["error"] == got.error


def test_a_vague_question_pauses_and_goes_on(store):
    got = say(store, "river", clarify=True)
    assert (got.decision, got.query_id, got.steps) == ("clarify", None, ["qualify", "pause"]) and got.samples
    assert got.samples[0] == "What do the records say about N:A?" and not an.turn_log(store).count()
    on = lambda q: an.resume(store, gate.DEFAULT, got.pause, q, ["note"], ch.HashEmbedder(), Recorder())
    again = on("which river stones are smooth")
    assert (again.thread, again.turn, again.decision) == (got.thread, 1, "pass") and again.sources
    with pytest.raises(ValueError, match="over"):
        on("which river stones are smooth")
    with pytest.raises(ValueError, match="no pause"):
        an.resume(store, gate.DEFAULT, "0" * 32, "x", ["note"], ch.HashEmbedder(), Recorder())
    kept = say(store, "clouds", clarify=True)
    ended = an.resume(store, gate.DEFAULT, kept.pause, " ", ["note"], ch.HashEmbedder(), Recorder())
    assert (ended.decision, ended.sources) == ("clarify", []) and an.turn_log(store).count() == 2


def test_an_unwritable_log_is_not_the_askers_fault(store, monkeypatch, caplog):
    thread = an.open_conversation(store)

    def full(name, rows):
        raise OSError("disk full")

    monkeypatch.setattr(store, "append", full)
    with caplog.at_level(logging.WARNING, "evidence"):
        got = say(store, "which river stones are smooth", thread=thread)
    assert got.query_id is None and got.answer and "could not be logged" in caplog.text


def test_cap_and_bad_requests(store):
    got = say(store, "which river stones are smooth", cap=1, now=NOON)
    with pytest.raises(an.OverCap):
        say(store, "which clouds are white", cap=1, now=NOON)
    assert say(store, "which clouds are white", cap=1, now=NOON + datetime.timedelta(days=1)).answer
    with pytest.raises(ValueError, match="no conversation"):
        say(store, "which clouds are white", thread="0" * 32)
    with pytest.raises(ValueError, match="no answer"):
        an.feedback(store, "0" * 32, True)
    an.feedback(store, got.query_id, False, "vague")
    assert [(r["query_id"], r["good"]) for r in store.log("feedback", an.FEEDBACK).collect()] == [(got.query_id, False)]


def test_conversations_without_turns_are_listed(store):
    empty = an.open_conversation(store, NOON)
    got = say(store, "which river stones are smooth", now=NOON + datetime.timedelta(hours=1))
    rows = [(r["conversation_id"], r["turns"], r["title"]) for r in an.conversations(store).collect()]
    assert rows == [(got.thread, 1, "which river stones are smooth"), (empty, 0, None)]


def test_catalog_runs(spark, store):
    assert catalogs.load_catalog(store) is None
    frames = {"a": spark.createDataFrame([(1, "x")], "z int, id string"), "b": spark.createDataFrame([], "id string, n int")}
    found = cat.read_catalog(frames, {"a": ("id",), "b": ("id", "n")}, unique={"a": (("z",),)}, sizes=True)
    assert [t.rows for t in found.tables.values()] == [1, 0] and found.tables["a"].is_unique(("z",))
    catalogs.save_catalog(store, cat.read_catalog({"a": frames["a"]}, {}), now=NOON)
    catalogs.save_catalog(store, found, now=NOON + datetime.timedelta(days=1))
    back = catalogs.load_catalog(store)
    assert back == found and list(back.tables["a"].columns) == ["z", "id"]
    runs = catalogs.catalog_runs(store).collect()
    assert [r["digest"] for r in runs][0] == found.digest() and len(runs) == 2
    # Sizes are no part of the structure.
    assert found.digest() == cat.read_catalog(frames, {"a": ("id",), "b": ("id", "n")}, unique={"a": (("z",),)}).digest()


def test_catalog_as_yaml(spark):
    yaml = pytest.importorskip("yaml")
    found = cat.read_catalog({"a": spark.createDataFrame([], "id string")}, {"a": ("id",)})
    assert yaml.safe_load(catalogs.to_yaml(found)) == {"digest": found.digest(), **found.to_dict()}


def test_log_lines(capsys):
    logs.set_up()
    logging.getLogger("evidence.x").warning("so %s", "it is", extra={"run": "r1"})
    line = json.loads(capsys.readouterr().err)
    assert (line["level"], line["message"], line["run"]) == ("WARNING", "so it is", "r1")
    logging.getLogger("evidence").handlers = []
    logging.getLogger("evidence").propagate = True
