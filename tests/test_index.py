"""The stored indexes: plans that read the terms' buckets and the nearest lists, recall, filters, changes of a batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence.functions.text import english, tokens
from evidence.operators import inverted, search
from evidence.operators import vector_index as vi
from evidence.operators.catalog import read_catalog
from evidence.operators.chunks import HashEmbedder
from evidence.plans import answer, index, metadata, vectors
from evidence.plans import fixtures as fx
from evidence.plans import ingest as run
from evidence.rules.spec import DocType
from evidence.sources.store import Store
from tests.metrics import last_execution, total
from tests.test_ingest import Source, go


def test_a_search_reads_the_buckets_of_its_terms(spark, small):
    store = fx.indexed(spark, small)
    manifest = store.manifest()
    terms = index.rare_terms(store, fx.QUESTION, manifest)
    plan = index.posting_hits(store, terms, manifest)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [b" in plan.replace("isnotnull(b", "b") and "In(lexeme" in plan and "text" not in plan.split("ReadSchema")[1]
    read = lambda df: df.select(F.input_file_name()).distinct().count()
    assert read(store.table("posting", inverted.POSTING, manifest, [0])) == 1 < read(store.table("posting", inverted.POSTING, manifest))


def test_english_by_dictionary_is_english_by_text(spark, small):
    rows = fx.chunks(spark, small)
    words = inverted.new_tokens(rows, spark.createDataFrame([], inverted.DICTIONARY), "english")
    got = {(r["lexeme"], r["ndoc"]) for r in inverted.counts(inverted.postings(rows, words)).collect()}
    assert got == {(r["lexeme"], r["ndoc"]) for r in search.lexeme_stats(rows, english(F.col("text"))).collect()}


@pytest.mark.parametrize("part", [3, 500_000])
@pytest.mark.parametrize("analyser", ["english", "simple"])
def test_postings_hold_every_position(spark, monkeypatch, analyser, part):
    monkeypatch.setattr(inverted, "PART_TOKENS", part)
    texts = ["Run, running runs; the the", None, "", "...", "the", "x run x", "Ünïcode 12 Ünïcode"]
    rows = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "chunk_id long, doc_id string, text string").coalesce(1)
    want = {}
    for r in rows.select("chunk_id", "doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).collect():
        if (x := inverted.ANALYSERS[analyser](r["token"])) is not None:
            want.setdefault((x, r["chunk_id"], r["doc_id"]), []).append(r["pos"] + 1)
    words = inverted.new_tokens(rows, spark.createDataFrame([], inverted.DICTIONARY), analyser)
    for found in (inverted.postings_by(rows, analyser), inverted.postings(rows, words)):
        assert sorted(map(tuple, found.collect())) == sorted((*k, v) for k, v in want.items())
    ndoc = {}
    for x, *_ in want:
        ndoc[x] = ndoc.get(x, 0) + 1
    assert {tuple(r) for r in inverted.counts_by(rows, analyser).collect()} == set(ndoc.items())
    assert inverted.postings_by(rows.limit(0), analyser).collect() == inverted.counts_by(rows.limit(0), analyser).collect() == []


def test_an_index_shuffles_a_posting_once(spark, small):
    last = last_execution(spark)
    store = fx.indexed(spark, small)
    n, words = store.table("posting", inverted.POSTING).count(), store.table("dictionary", inverted.DICTIONARY).count()
    moved = total(spark, last, "Exchange", "shuffle records written")
    assert n < moved < 2 * n + 4 * words


def test_words_are_found_by_their_stem_and_follow_changes(spark, tmp_path):
    store, source = Store(spark, f"file://{tmp_path}/s", buckets=4), Source(spark)
    for k in range(30):
        source.put(str(k), name=f"name {k}", text="plain words" if k else "the firm recalled bottles")
    go(spark, store, source, 1)
    found = lambda q, **how: [r["doc_id"] for r in index.text_search(store, q, **how).collect()]
    assert found("which firm recalls a bottle") == ["note:0"] and found("the of and") == [] and found("zebras") == []
    assert found("recalls", allowed=search.allowed(["note"])) == ["note:0"] and found("recalls", allowed=search.allowed(["other"])) == []
    source.put("0", name="name 0", text="nothing of the kind")
    source.put("5", name="name 5", text="recalling cups", active=False)
    go(spark, store, source, 2)
    assert found("recalls") == ["note:5"] and found("recalls", allowed=search.allowed()) == []
    assert store.manifest().chunks == store.table("chunk", run.CHUNKS).count()


def test_lookups_widen(spark, small, monkeypatch):
    monkeypatch.setattr(index, "LOOKUP", 2)
    store = fx.indexed(spark, small)
    rare = search.allowed(["en"]) & (F.col("doc_id").isin([f"d{i}" for i in range(7, 200, 40)]))
    want = [tuple(r) for r in index.text_search(store, fx.QUESTION, 1000).join(spark.createDataFrame([(f"d{i}",) for i in range(7, 200, 40)], "doc_id string"), "doc_id").join(store.table("document", "doc_id string, doc_type string, is_current boolean, is_active boolean, doc_sk long").where("is_active and doc_type = 'en'").select("doc_id"), "doc_id").select("chunk_id", "doc_id", "score").collect()]
    for most in (4, 12_800):
        monkeypatch.setattr(index, "MOST_LOOKUPS", most)
        assert sorted(tuple(r) for r in index.text_search(store, fx.QUESTION, 3, allowed=rare).collect()) == sorted(sorted(want, key=lambda r: (-r[2], r[0]))[:3])


@pytest.fixture(scope="module")
def lists(spark):
    return fx.indexed(spark, "/root/testdata/sf0.01", vectors=True)


def test_recall(spark, lists):
    """Of the nearest ten, with the lists that are read by default; all of them where the radii have to prove it."""
    rows = lists.table("vector_list", vectors.VECTOR).collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, hits, read = np.array([r["chunk_id"] for r in rows]), 0, []
    asked = range(0, len(rows), len(rows) // 12)
    for q in asked:
        want = set(ids[np.argsort(-(x @ x[q]))[:10]])
        got = vectors.vector_search(lists, rows[q]["embedding"], 10)
        read.append(got.lists_read / got.lists)
        hits += len({r["chunk_id"] for r in got.rows.collect()} & want)
    assert hits / (10 * len(asked)) >= 0.9 and max(read) < 1
    proved = vectors.vector_search(lists, rows[3]["embedding"], 10, exact=True)
    assert {r["chunk_id"] for r in proved.rows.collect()} == set(ids[np.argsort(-(x @ x[3]))[:10]])


def test_clustered_vectors_need_few_lists(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 12))
    x = centres[np.arange(2000) % 20] + 0.05 * rng.normal(size=(2000, 12))
    rows = spark.createDataFrame([(str(i), f"d{i}", [float(c) for c in v]) for i, v in enumerate(x)] + [("null", "n", None), ("zero", "z", [0.0] * 12)], "chunk_id string, doc_id string, embedding array<float>")
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    vectors.build(store, store.manifest(), rows, lists=40)
    got = vectors.vector_search(store, x[7].tolist(), 30, exact=True)
    assert vectors.vector_search(store, x[7].tolist(), 10).lists_read <= 5
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert {r["chunk_id"] for r in got.rows.collect()} == {str(i) for i in np.argsort(-(unit @ unit[7]))[:30]} and got.lists_read <= 10


def test_a_filter_widens_the_search(spark, lists):
    """Lists are read until a filter leaves enough, or all are."""
    q = fx.query_vector(spark, "/root/testdata/sf0.01")
    few = search.allowed(["de"]) & (F.substring("doc_id", -1, 1) == "7")
    docs = lists.table("document", "doc_id string, doc_type string, is_current boolean, is_active boolean, doc_sk long")
    there = lists.table("vector_list", vectors.VECTOR).join(docs.where(few).select("doc_id"), "doc_id", "left_semi")
    want = [r["chunk_id"] for r in vi.best(there, q, 5).collect()]
    got = vectors.vector_search(lists, q, 5, few, exact=True)
    assert [r["chunk_id"] for r in got.rows.collect()] == want and len(want) == 5
    every = vectors.vector_search(lists, q, 100_000, few)
    assert every.rows.count() == there.count() and every.lists_read == every.lists


def test_the_index_follows_batches(spark, tmp_path):
    store, source, model = Store(spark, f"file://{tmp_path}/s", buckets=4), Source(spark), HashEmbedder()
    assert vectors.vector_search(store, [1.0] * 8) is None
    for k in range(40):
        source.put(str(k), text=f"text {k}")
    go(spark, store, source, 1, provider=model)
    assert run.build_vectors(store, lists=4)["vectors"] == 40
    source.put("3", text="text three")
    source.put("new", text="a new text")
    go(spark, store, source, 2, provider=model)
    held = {(r["chunk_id"], r["doc_id"]) for r in store.table("vector_list", vectors.VECTOR).collect()}
    assert held == {(r["chunk_id"], r["doc_id"]) for r in store.table("chunk", run.CHUNKS).collect()}
    first = answer.find(store, "n\n\nText: a new text", model, 1).first()
    assert first["doc_id"] == "note:new" and first["matched_by"] == "both"


def test_extreme_and_empty_vectors():
    import pyarrow as pa

    fits, x = vi.directions(pa.array([[1e-200, 2e-200], [1e200, 2e200], [0.0, 0.0], [1.0], None, [float("nan"), 1.0], [float("inf"), 1.0], [1.0, None]]), 2)
    assert fits.tolist() == [True, True, False, False, False, False, False, False] and np.allclose(x[0], x[1])


@pytest.mark.parametrize("filters", [{"y": 2024}, {"y": "2024"}, {"y": True}, {"h": "Fire"}, {"y": 2024, "h": "Fire"}, {"none": 1}, {"n": 0}])
def test_metadata_pairs_filter_as_the_json_does(spark, tmp_path, filters):
    rows = ['{"y":2024,"h":"Fire"}', '{"y":"2024"}', '{"h":"Fire","y":2024.0}', '{"y":true}', '{"y":"true","n":null}', '{"h":["Fire"],"o":{"y":2024}}', None, "{broken", "[1]", '{"n":0,"y":2024}', "7"]
    docs = spark.createDataFrame([(i, f"d{i}", m) for i, m in enumerate(rows)], "doc_sk long, doc_id string, metadata string")
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    manifest = store.manifest()
    metadata.update(store, manifest, manifest.tables, docs, docs.limit(0), 1)
    got = metadata.documents_with(store, filters, manifest)
    assert {r["doc_sk"] for r in got.collect()} == {r["doc_sk"] for r in docs.where(search.metadata_filter(F.col("metadata"), filters)).collect()}
    assert metadata.documents_with(store, {"y": 1.5}, manifest) is None is metadata.documents_with(store, {}, manifest)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [b" in plan.replace("isnotnull(b", "b") and ("In(pair" in plan or "EqualTo(pair" in plan)


def test_the_metadata_index_follows_batches(spark, tmp_path):
    rule = DocType.of({"doc_type": "note", "source": {"source_id": "notes", "table": "note", "key": "id"}, "title": {"field": "name"}, "body": [{"label": "Text", "value": {"field": "text"}}], "metadata": {"kind": {"field": "url"}}})
    store, source, model = Store(spark, f"file://{tmp_path}/s", buckets=4), Source(spark), HashEmbedder()

    def batch(n):
        frames = source.frames()
        return run.ingest(spark, store, rule, frames, read_catalog(frames, {"note": ("id",)}), provider=model)

    for k in range(20):
        source.put(str(k), text=f"text {k}", url="x" if k % 4 else "y")
    batch(1)
    source.put("0", text="text 0", url="x")
    source.put("1", text="text 1", url="y")
    source.drop("4")
    batch(2)
    ids = lambda v: sorted(r["doc_id"] for r in metadata.documents_with(store, {"kind": v}).collect())
    assert ids("y") == sorted(f"note:{k}" for k in (1, 4, 8, 12, 16)) and len(ids("x")) == 15
    found = answer.find(store, "text 8", model, 10, filters={"kind": "y"}).collect()
    assert {r["doc_id"] for r in found} == {f"note:{k}" for k in (1, 8, 12, 16)}  # the dropped one is inactive
