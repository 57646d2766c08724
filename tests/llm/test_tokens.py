import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from evidence.llm import packing, token_store, tokens
from evidence.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path
from evidence.llm.tokens import Encoder

ENCODERS = {name: Encoder(public_tokenizers.path(name)) for name in (WORD_BPE, BYTE_BPE)}
ALPHABET = st.sampled_from(list("abcABZ  \n\n.,!?'é Éßſİ1\t\r\x1c\x85 😀日") + ["'ll", "don't", "<|endoftext|>", "the ", "The", "ǅ", "́"])


@pytest.mark.parametrize("name", ENCODERS)
@given(text=st.lists(ALPHABET, max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_whole_text(name, text):
    e = ENCODERS[name]
    assert e.ids(text) == e.whole(text)


def ids_of(name, text, end):
    return [*np.frombuffer(ENCODERS[name].whole(text or ""), "<u4").tolist(), end]


def best_fit(lengths, capacity):
    """Best-fit decreasing, one item after another."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@given(st.lists(st.integers(1, 60), max_size=120))
@settings(max_examples=300, deadline=None)
def test_plan_is_best_fit_and_every_slot_is_used_once(lengths):
    counts = Counter(lengths)
    runs, n_bins = packing.plan(dict(counts), 60)
    assert n_bins == best_fit(lengths, 60)
    used, ranks = {}, Counter()
    for length, low, high, first, each, offset in runs.tolist():
        assert low == ranks[length]
        ranks[length] = high
        for rank in range(low, high):
            k, j = divmod(rank - low, each)
            used.setdefault(first + k, []).append((offset + j * length, length))
    assert ranks == counts and len(used) == n_bins
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 60


def pieces_of(text, capacity=packing.CAPACITY):
    ids = np.array(ids_of(WORD_BPE, text, 1), "<u4")
    return [(p, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for p, at in enumerate(range(0, len(ids), capacity))]


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    got = packing.best_fit_packing(df, tokenizer_path(WORD_BPE)).collect()
    want = sorted(repr((r["doc_id"], *p)) for r in df.collect() for p in pieces_of(r["text"]))
    assert sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= packing.CAPACITY for n in at.values())
    assert len(at) == best_fit([r["length"] for r in got], packing.CAPACITY)


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_store_round_trip(request, which):
    df = request.getfixturevalue(which)
    store = token_store.write_store(df, tokenizer_path(BYTE_BPE))
    got = store.documents().collect()
    ids = [(r["doc_id"], np.array(ids_of(BYTE_BPE, r["text"], 0), "<u4")) for r in df.collect()]
    assert sorted(repr((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got) == sorted(repr((d, len(x), zlib.crc32(x.tobytes()))) for d, x in ids)
    at, last = 0, None
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (last is None or last <= r["doc_id"])
        at, last = at + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else last


def test_many_ranges_and_shards(docs, monkeypatch):
    """Ranges and shards small enough that both are many, so that their bases add up."""
    monkeypatch.setattr(token_store, "RANGE_DOCS", 40)
    monkeypatch.setattr(token_store, "SHARD_BYTES", 3000)
    store = token_store.write_store(docs, tokenizer_path(BYTE_BPE))
    assert store.shards.select("range").distinct().count() > 3 and store.shards.where("seq > 1").count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in store.documents().collect()}
    at = 0
    for d in sorted(texts):
        ids = np.array(ids_of(BYTE_BPE, texts[d], 0), "<u4")
        assert got.pop(d) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


def test_a_store_is_a_folder_that_can_be_opened_later(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    wrote = token_store.write_store(docs, tokenizer_path(BYTE_BPE), path=path)
    again = token_store.open_store(spark, path)
    assert again.dictionary == wrote.dictionary and again.end_id == 0
    assert sorted(map(tuple, again.documents().collect())) == sorted(map(tuple, wrote.documents().collect()))


def test_hot_and_unknown_ids_are_dealt_and_ties_have_an_order(spark, monkeypatch):
    """A doc_id of a third of all rows, a third without one: several ranges each, and the same store however rows lie."""
    monkeypatch.setattr(token_store, "RANGE_DOCS", 20)
    rows = [(None if k % 3 == 0 else 77 if k % 3 == 1 else k, f"text number {k % 90}") for k in range(300)]
    got = []
    for parts in (2, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        store = token_store.write_store(df, tokenizer_path(BYTE_BPE))
        got.append(sorted(map(repr, store.documents().collect())))
        assert store.shards.agg(F.max("n_docs")).first()[0] <= 80 and store.shards.count() > 10
    assert got[0] == got[1] and len(got[0]) == 300
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in store.documents().collect())
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    ids = [-1 if d is None else d for _, _, d in starts]
    assert ids == sorted(ids)


def test_an_id_takes_as_many_bytes_as_it_needs(monkeypatch):
    path = tokenizer_path(BYTE_BPE)
    assert token_store.id_bytes(path, 0) == 2 and token_store.id_bytes(path, 1 << 16) == 4
    monkeypatch.setattr(Encoder, "size", 100_000)
    assert token_store.id_bytes(path, 0) == 4


@pytest.mark.parametrize("name", ENCODERS)
def test_slices_and_a_full_memory_change_nothing(name, docs, monkeypatch):
    monkeypatch.setattr(tokens, "LIMIT", 50)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 2000)
    table = docs.selectExpr("doc_id", "coalesce(text, '') text").toArrow().combine_chunks()
    n = 0
    for doc_ids, ids, starts in tokens.encoded(iter(table.to_batches(max_chunksize=7)), tokenizer_path(name), 9):
        for k, d in enumerate(doc_ids.to_pylist()):
            assert d == table.column("doc_id")[n].as_py()
            assert ids[starts[k] : starts[k + 1]].tolist() == ids_of(name, table.column("text")[n].as_py(), 9)
            n += 1
    assert n == table.num_rows


def test_one_document_of_a_shard(docs):
    store = token_store.write_store(docs, tokenizer_path(BYTE_BPE))
    shard = token_store.Shard(store.shards.first()["shard"], store.dictionary)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d in shard.doc_ids[::17]:
        assert shard.find(d).tolist() == ids_of(BYTE_BPE, texts[d], 0)
    assert shard.find(-1) is None
    with pytest.raises(ValueError):
        token_store.Shard(store.shards.first()["shard"], b"another dictionary")
