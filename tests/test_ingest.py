import datetime
import random

import pytest
from pyspark.sql import functions as F

from evidence.operators import scd2
from evidence.operators.catalog import Table, read_catalog, validate, verify_key
from evidence.operators.chunks import HashEmbedder, RateLimited
from evidence.operators.quality import blocks, run_checks
from evidence.functions.text import english
from evidence.operators.search import lexeme_stats
from evidence.plans.ingest import CHUNKS, VERSIONS, approve, embed_step, ingest, init_index, lexemes, preview
from evidence.rules.spec import Check, DocType
from evidence.sources.store import Conflict, OldSchema, Store
from evidence.streaming.changelog import Follower, change_stream, head_by_source, run_on_change

RULE = DocType.of({
    "doc_type": "note", "source": {"source_id": "notes", "table": "note", "key": "id"}, "title": {"field": "name"}, "body": [{"label": "Text", "value": {"field": "text"}}],
    "url": {"field": "url"}, "quality": [{"rule": "not_null", "column": "name"}],
})
DAY = datetime.datetime(2024, 1, 1)


class Source:
    def __init__(self, spark):
        self.spark, self.rows, self.log = spark, {}, []

    def put(self, key, name="n", text="t", url="u", active=True):
        self.rows[key] = (key, name, text, url, active)
        self.log.append((len(self.log) + 1, "notes", key))

    def drop(self, key):
        del self.rows[key]
        self.log.append((len(self.log) + 1, "notes", key))

    def frames(self):
        return {
            "note": self.spark.createDataFrame(list(self.rows.values()), "id string, name string, text string, url string, is_active boolean"),
            "record_change": self.spark.createDataFrame(self.log, "change_id long, source_id string, record_key string"),
        }


def go(spark, store, source, n, **how):
    frames = source.frames()
    return ingest(spark, store, RULE, frames, read_catalog(frames, {"note": ("id",)}), size=40, overlap=10, now=DAY + datetime.timedelta(n), **how)


def state(store):
    return store.table("document", VERSIONS), store.table("chunk", CHUNKS)


def test_incremental_life(spark, tmp_path):
    store, source = Store(spark, f"file://{tmp_path}/s"), Source(spark)
    long = "\n".join(f"Sentence number {i}." for i in range(12))
    for k in "abc":
        source.put(k, text=long if k == "a" else k)
    first = go(spark, store, source, 1)
    assert (first.status, first.mode, first.stats["inserted"]) == ("succeeded", "full", 3)
    assert embed_step(spark, store, HashEmbedder()).status == "succeeded"
    before = {r["text_hash"]: r["embedding"] for r in state(store)[1].collect()}
    assert go(spark, store, source, 2).status == "nothing"
    source.put("a", text=long + "\nOne more.")
    source.put("a", text=long + "\nOne more line.")
    source.put("b", text="b", active=False)
    source.put("d", text="d")
    source.drop("c")
    source.log.append((len(source.log) + 1, "notes", "never"))
    run = go(spark, store, source, 3)
    assert (run.mode, run.stats["inserted"], run.stats["updated"], run.stats["deactivated"], run.stats["versions_created"]) == ("incremental", 1, 1, 2, 4)
    versions, chunks = state(store)
    assert not scd2.violations(versions).collect()
    current = scd2.current_versions(versions)
    assert not chunks.join(current, "doc_sk", "left_anti").collect()
    assert {r["doc_id"] for r in current.where("not is_active").collect()} == {"note:b", "note:c"}
    kept = {r["text_hash"]: r["embedding"] for r in chunks.where("embedding is not null").collect()}
    assert kept and all(before[h] == v for h, v in kept.items())
    assert run.pending["texts"] < chunks.count()
    stats = lambda df: {(r["lexeme"], r["ndoc"]) for r in df.collect()}
    assert stats(lexemes(store)) == stats(lexeme_stats(chunks, english(F.col("text"))))
    assert embed_step(spark, store, HashEmbedder(), limit=1).status in ("stopped", "succeeded")
    assert embed_step(spark, store, HashEmbedder()).status == "succeeded"
    other = HashEmbedder()
    other.model = "another"
    assert embed_step(spark, store, other).status == "embedding_refused"


def test_failed_checks_write_nothing_and_approval_waits(spark, tmp_path):
    store, source = Store(spark, f"file://{tmp_path}/s"), Source(spark)
    source.put("a", name=None)
    assert go(spark, store, source, 1).status == "failed" and store.manifest().number == 0
    source.put("a")
    source.put("b", text="other")
    run = go(spark, store, source, 2, approve_over=1)
    assert run.status == "waiting" and run.pending["texts"] == 2 and store.manifest().runs["note"]["status"] == "waiting"
    assert approve(store, "note").status == "approved"
    with pytest.raises(ValueError, match="waits"):
        approve(store, "note")
    assert embed_step(spark, store, HashEmbedder()).status == "succeeded" and store.manifest().runs["note"]["status"] == "succeeded"


def test_a_reset_log_needs_a_full_run(spark, tmp_path):
    store, source = Store(spark, f"file://{tmp_path}/s"), Source(spark)
    for k in "abc":
        source.put(k)
    go(spark, store, source, 1)
    source.log = source.log[:1]
    with pytest.raises(RuntimeError):
        go(spark, store, source, 2)
    assert go(spark, store, source, 3, full=True).stats["unchanged"] == 3
    assert store.manifest().watermarks["note"]["change_id"] == 1


def layers(store, table):
    return store.manifest().tables[table]


@pytest.mark.parametrize("size", [40, 400])
def test_a_batch_writes_what_it_changes(spark, tmp_path, size):
    """However large the tables are; what it adds and kills is merged when it is read."""
    store, source = Store(spark, f"file://{tmp_path}/s", buckets=8), Source(spark)
    for k in range(size):
        source.put(str(k), text=f"text {k}")
    first = go(spark, store, source, 1)
    assert first.stats["chunks_added"] == size and [(x["rows"], x["marks"]) for x in layers(store, "chunk")] == [(size, 0)]
    before = store.manifest().tables
    source.put("3", text="text three")
    source.put("new", text="new text")
    ahead = preview(spark, store, RULE, source.frames(), size=40, overlap=10)
    assert (ahead["mode"], ahead["changed_documents"], ahead["new_documents"], ahead["to_embed"]) == ("incremental", 1, 1, 2)
    assert store.manifest().tables == before
    second = go(spark, store, source, 2)
    assert (second.stats["chunks_added"], second.stats["chunks_removed"], second.stats["chunks_moved"]) == (2, 1, 0)
    written = {t: (layers(store, t)[-1]["rows"], layers(store, t)[-1]["marks"]) for t in ("document", "chunk", "posting")}
    # The version that ended and two new ones; two chunks for one; postings of three texts.
    assert written["document"] == (3, 1) and written["chunk"] == (2, 1) and written["posting"] == (6, 3)
    versions, chunks = state(store)
    assert versions.count() == size + 2 and sorted(r["doc_sk"] for r in versions.collect()) == list(range(1, size + 3)) and not scd2.violations(versions).collect()
    assert {(r["lexeme"], r["ndoc"]) for r in lexemes(store).collect()} == {(r["lexeme"], r["ndoc"]) for r in lexeme_stats(chunks, english(F.col("text"))).collect()}
    assert store.manifest().chunks == chunks.count() == size + 1
    assert store.sweep(1) > 0 and {r["doc_id"] for r in state(store)[0].collect()} == {f"note:{k}" for k in [*range(size), "new"]}


def test_layers_fold_and_keep_the_latest_row(spark, tmp_path):
    store, manifest, held = Store(spark, f"file://{tmp_path}/s", buckets=4), None, {}
    manifest = store.manifest()
    schema = "doc_sk long, doc_id string, title string"
    rng = random.Random(3)
    for batch in range(1, 25):
        new = {rng.randrange(60): f"{batch}" for _ in range(30 if batch == 1 else 5)}
        gone = {k for k in rng.sample(sorted(held), min(3, len(held)))} - set(new)
        rows = spark.createDataFrame([(k, f"d{k}", v) for k, v in new.items()], schema)
        dead = spark.createDataFrame([(k, f"d{k}", "") for k in gone | (set(new) & set(held))], schema)
        manifest.tables["document"] = store.add_layer("document", schema, rows, dead, batch, manifest)
        held = {k: v for k, v in held.items() if k not in gone} | new
        if batch % 4 == 0:
            assert {r["doc_sk"]: r["title"] for r in store.table("document", schema, manifest).collect()} == held
    assert len(manifest.tables["document"]) <= 6
    some = store.table("document", schema, manifest, [1]).collect()
    assert some and {r["doc_sk"] for r in some} < set(held)
    assert store.table("document", schema, manifest, where=F.col("doc_sk") == 7).count() == (7 in held)


def test_an_older_layout_is_read_and_becomes_the_oldest_layer(spark, tmp_path):
    store, source = Store(spark, f"file://{tmp_path}/s", buckets=4), Source(spark)
    for k in range(12):
        source.put(str(k), text=f"text {k}")
    go(spark, store, source, 1)
    manifest = store.manifest()
    for t in ("document", "chunk"):
        manifest.tables[t] = store.write(f"{t}", store.table(t, VERSIONS if t == "document" else CHUNKS), 77)
    for t in ("posting", "dictionary", "lexeme"):
        del manifest.tables[t]
    manifest.schema, manifest.chunks = 2, None
    store.publish(manifest)
    with pytest.raises(OldSchema):
        store.manifest()
    assert store.migrate() == 1 and state(store)[0].count() == 12
    source.put("3", text="other words")
    assert go(spark, store, source, 2).stats["versions_created"] == 1
    versions, chunks = state(store)
    assert versions.count() == 13 and chunks.count() == 12 == store.manifest().chunks and not scd2.violations(versions).collect()
    assert {(r["lexeme"], r["ndoc"]) for r in lexemes(store).collect()} == {(r["lexeme"], r["ndoc"]) for r in lexeme_stats(chunks, english(F.col("text"))).collect()}


class Flaky(HashEmbedder):
    """Asks to wait once, and fails on one text while bad."""

    def __init__(self, bad=""):
        self.bad, self.asked = bad, False

    def embed(self, texts):
        if not self.asked:
            self.asked = True
            raise RateLimited(0)
        if self.bad and any(self.bad in t for t in texts):
            raise OSError("no answer")
        return super().embed(texts)


def test_embedding_keeps_what_it_has(spark, tmp_path):
    store, source = Store(spark, f"file://{tmp_path}/s"), Source(spark)
    for k in range(30):
        source.put(str(k), text=f"text {k} here")
    go(spark, store, source, 1)
    run = embed_step(spark, store, Flaky("text 7 "), wave=4)
    assert run.status == "failed" and "no answer" in run.reason and 0 < run.pending["texts"] <= 30
    assert embed_step(spark, store, Flaky(), wave=4).status == "succeeded"
    assert state(store)[1].where("embedding is null").count() == 0


def test_an_index_holds_vectors_of_one_model(spark, tmp_path):
    store, source, other = Store(spark, f"file://{tmp_path}/s"), Source(spark), HashEmbedder()
    source.put("a")
    go(spark, store, source, 1)
    assert init_index(store, HashEmbedder()) == {"model": "hash-8", "dim": 8} == init_index(store, HashEmbedder())
    embed_step(spark, store, HashEmbedder())
    other.dim = 4
    with pytest.raises(ValueError, match="pinned"):
        init_index(store, other)
    assert init_index(store, other, force=True)["dim"] == 4
    assert state(store)[1].where("embedding is not null").count() == 0


def test_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    a, b = store.manifest(), store.manifest()
    assert store.publish(a).number == 1
    with pytest.raises(Conflict):
        store.publish(b)


def test_checks(spark):
    rows = spark.createDataFrame([("a", "x", ["p"]), ("a", " ", [None]), ("b", None, []), (None, "z", None)], "k string, v string, l array<string>")
    checks = (Check("not_null", "v"), Check("unique", "k"), Check("allowed_values", "v", values=("x",), severity="warn"), Check("max_null_fraction", "l", max=0.75), Check("min_rows", min=5))
    got = {r["rule"]: (r["failed_rows"], r["passed"]) for r in run_checks(rows, checks).collect()}
    assert got == {"not_null": (2, False), "unique": (2, False), "allowed_values": (1, False), "max_null_fraction": (3, True), "min_rows": (1, False)}
    assert "min_rows" not in {r["rule"] for r in run_checks(rows, checks, "incremental").collect()}
    assert blocks(run_checks(rows, checks)) and not blocks(run_checks(rows, (checks[2],)))
    empty = rows.limit(0)
    assert not blocks(run_checks(empty, checks[:4]))


def test_validation(spark):
    source = Source(spark)
    source.put("a")
    frames = source.frames()
    good = read_catalog(frames, {"note": ("id",)})
    assert validate(RULE, frames, good) == []
    assert ("error", "id is no key of note") in validate(RULE, frames, read_catalog(frames, {}))
    assert validate(RULE, {}, good)[0][0] == "error"
    assert any("no column url" in m for _, m in validate(RULE, {"note": frames["note"].drop("url")}, good))
    assert good.digest() == read_catalog(dict(reversed(frames.items())), {"note": ("id",)}).digest() != read_catalog(frames, {}).digest()
    assert Table("t", {}, ("a", "b")).is_unique(("a", "b")) and not Table("t", {}, ("a", "b")).is_unique(("b", "a"))
    assert verify_key(frames["note"], ("id",)) and not verify_key(frames["note"].union(frames["note"]), ("id",))


def test_stream_runs_batches(spark, tmp_path):
    schema, calls = "change_id long, source_id string, record_key string", []
    log = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, "t", "c")], schema)
    log.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
    run_on_change(stream, lambda: calls.append(1), f"{tmp_path}/cp").awaitTermination(60)
    assert calls == [1]
    q = head_by_source(stream).writeStream.format("memory").queryName("heads").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.awaitTermination(60)
    assert {(r["source_id"], r["head"], r["changes"]) for r in spark.table("heads").collect()} == {("s", 2, 2), ("t", 3, 1)}


def test_a_failed_run_is_skipped_and_made_up_for(spark, tmp_path):
    """Of three micro-batches the second's run fails; the third's publishes all that is open."""
    schema = "change_id long, source_id string, record_key string"
    store, source, told = Store(spark, f"file://{tmp_path}/s"), Source(spark), []
    attempts = []

    def run():
        attempts.append(1)
        if len(attempts) == 2:
            raise OSError("the source is away")
        go(spark, store, source, len(attempts))

    follower = Follower(run, lambda number, wrong: told.append(wrong))
    for i, key in enumerate("abc"):
        source.put(key, text=key)
        spark.createDataFrame(source.log[-1:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        query = follower.start(change_stream(spark, f"{tmp_path}/log", schema), f"{tmp_path}/cp")
        assert query.awaitTermination(120) and query.exception() is None
        assert follower.owed == (i == 1)
    assert len(attempts) == 3 and len(told) == 1 and "the source is away" in told[0]
    assert {r["doc_id"] for r in state(store)[0].collect()} == {"note:a", "note:b", "note:c"} and store.manifest().watermarks["note"]["change_id"] == 3
    assert follower.settle()
