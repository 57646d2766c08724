"""Snapshots of a source, leases between writers, requests that wait together."""

import threading
import time
from dataclasses import dataclass

import pytest

from evidence.operators import catalog
from evidence.operators.chunks import HashEmbedder, RateLimited, embed_together
from evidence.plans.ingest import VERSIONS, embed_step, ingest
from evidence.rules.spec import DocType
from evidence.sources import snapshot
from evidence.sources.store import Leased, Store
from tests.test_ingest import CHUNKS, DAY, RULE, Source, go

CHILD = DocType.of({
    "doc_type": "note", "source": {"source_id": "notes", "table": "note", "key": "id"}, "children": {"tags": {"table": "tag", "join": {"note_id": "id"}, "select": "tag", "order_by": "tag"}},
    "title": {"field": "name"}, "body": [{"label": "Tags", "value": {"field": "tags"}}],
})


def test_a_batch_reads_the_files_that_were_there(spark, tmp_path):
    def add(key, change):
        spark.createDataFrame([(key, f"name {key}", True)], "id string, name string, is_active boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/note.parquet")
        spark.createDataFrame([(key, f"tag {key}")], "note_id string, tag string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/tag.parquet")
        spark.createDataFrame([(change, "notes", key)], "change_id long, source_id string, record_key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/record_change.parquet")

    add("a", 1)
    store, names = Store(spark, f"file://{tmp_path}/s"), ["note", "tag", "record_change"]
    pinned = snapshot.pin(spark, str(tmp_path), names)
    found = catalog.read_catalog(pinned.frames(spark), {"note": ("id",)})
    add("b", 2)
    spark.createDataFrame([("a", "late tag")], "note_id string, tag string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/tag.parquet")
    run = ingest(spark, store, CHILD, pinned, found, now=DAY)
    assert run.stats["inserted"] == 1 and store.manifest().watermarks["note"]["change_id"] == 1
    assert "late" not in store.table("document", VERSIONS).first()["body"]
    kept = store.table("source-note", snapshot.PINNED).collect()
    assert {(r["table"], r["file"]) for r in kept} == {(n, f) for n, held in pinned.files.items() for f in held}
    again = ingest(spark, store, CHILD, snapshot.pin(spark, str(tmp_path), names), found, now=DAY)
    assert again.stats["inserted"] == 1 and store.manifest().watermarks["note"]["change_id"] == 2


def test_two_document_types_at_once(spark, tmp_path):
    store, errors = Store(spark, f"file://{tmp_path}/s"), []

    def write(kind):
        try:
            source = Source(spark)
            for k in range(5):
                source.put(str(k), text=f"{kind} {k}")
            rule = DocType.of({"doc_type": kind, "source": {"source_id": "notes", "table": "note", "key": "id"}, "title": {"field": "name"}, "body": [{"label": "Text", "value": {"field": "text"}}]})
            frames = source.frames()
            ingest(spark, Store(spark, store.root), rule, frames, catalog.read_catalog(frames, {"note": ("id",)}), now=DAY)
        except Exception as wrong:  # noqa: BLE001  told below
            errors.append(wrong)

    both = [threading.Thread(target=write, args=(kind,)) for kind in ("note", "memo")]
    [t.start() for t in both]
    [t.join() for t in both]
    assert not errors and set(store.manifest().watermarks) == {"note", "memo"}
    rows = store.table("document", VERSIONS).collect()
    assert len(rows) == 10 and len({r["doc_sk"] for r in rows}) == 10


def test_leases(spark, tmp_path):
    store, other = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    with store.lease():
        with pytest.raises(Leased), other.lease(wait=0):
            pass
    with other.lease(seconds=0.2):
        time.sleep(0.4)
        with store.lease(wait=0):  # the other's time is over
            pass
    with store.lease(wait=0):
        pass


@dataclass
class Quota(HashEmbedder):
    """Tells when requests begin; the second of each task is told to wait, for as long."""

    folder: str
    wait: float = 1.0

    def embed(self, texts):
        from pyspark import TaskContext

        task, now = TaskContext.get().partitionId(), time.time()
        seen = len(list(__import__("pathlib").Path(self.folder).glob(f"{task}-*")))
        limited = task == 0 and seen == 1
        with open(f"{self.folder}/{task}-{seen}", "w") as f:
            f.write(f"{now} {limited}")
        if limited:
            raise RateLimited(self.wait)
        return super().embed(texts)


def test_all_tasks_wait_together(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    rows = spark.createDataFrame([(f"{i:04d}", f"text {i}") for i in range(60)], "text_hash string, text string")
    provider = Quota(str(tmp_path / "asked"))
    got = embed_together(rows, provider, 3, batch=4).collect()
    assert len(got) == 60 and all(r["error"] is None for r in got) and len({r["text_hash"] for r in got}) == 60
    asked = [(float(a), b == "True") for a, b in (p.read_text().split() for p in (tmp_path / "asked").iterdir())]
    began = next(t for t, limited in asked if limited)
    # A request of the same round may be under way; none begins in the wait after it.
    assert not [t for t, _ in asked if began + 0.4 < t < began + provider.wait] and [t for t, _ in asked if t >= began + provider.wait]


def test_embedding_together(spark, tmp_path):
    store, source = Store(spark, f"file://{tmp_path}/s"), Source(spark)
    for k in range(9):
        source.put(str(k), text=f"text {k}")
    go(spark, store, source, 1)
    assert embed_step(spark, store, HashEmbedder(), together=2).status == "succeeded"
    assert store.table("chunk", CHUNKS).where("embedding is null").count() == 0
    assert RULE.doc_type == "note"


def test_keys_and_references_of_odd_tables(spark):
    a = spark.createDataFrame([(i, i % 3, None if i == 5 else i, "x") for i in range(50)], "id long, part long, holed long, same string")
    b = spark.createDataFrame([(i * 2, i) for i in range(10)], "ref long, other long")
    assert catalog.find_keys(a) == ["id"] and catalog.find_keys(a.limit(0)) == []
    found = catalog.find_references({"a": a, "b": b, "none": b.limit(0)})
    assert ("b", "ref", "a", "id") in found and ("a", "part", "b", "other") in found and ("a", "holed", "a", "id") in found
    assert not [f for f in found if f[0] == "none" or f[2] == "none"] and ("a", "id", "b", "other") not in found
