import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidence.operators import scd2
from evidence.operators.changes import Watermark, WatermarkAhead, check_window, choose_mode, rechunk_all
from evidence.operators.mapping import content_hash
from evidence.rules.spec import History

VERSIONS = "doc_sk long, doc_id string, doc_type string, source_id string, title string, body string, url string, metadata string, content_hash string, tracked_hash string, is_active boolean, version int, is_current boolean, valid_from timestamp, valid_to timestamp, change_reason string, source_change_id long, batch_id long"
DAY = datetime.datetime(2024, 1, 1)


def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(f"d{k}", "t", "s", title, "b", url, "{}", active) for k, title, url, active in rows], "doc_id string, doc_type string, source_id string, title string, body string, url string, metadata string, is_active boolean")
    h = content_hash(F.col("title"), F.col("body"))
    return df.withColumn("content_hash", h).withColumn("tracked_hash", h).select(*scd2.DOCUMENT_COLUMNS)


def step(spark, versions, rows, n, history=History(), **how):
    decided = scd2.decide(scd2.current_versions(versions), docs(spark, rows), history, **how)
    after = scd2.apply(versions, decided, DAY + datetime.timedelta(n), n, n)
    return {r["doc_id"]: r["action"] for r in decided.collect()}, spark.createDataFrame(after.collect(), VERSIONS)


def test_six_actions(spark):
    none = spark.createDataFrame([], VERSIONS)
    first = [(1, "a", "u", True), (2, "a", "u", True), (3, "a", "u", True), (4, "a", "u", True)]
    did, versions = step(spark, none, first, 1)
    assert set(did.values()) == {"insert"}
    did, versions = step(spark, versions, [(1, "A", "u", True), (2, "a", "u", False), (3, "a", "v", True), (4, "a", "u", True), (5, "a", "u", True)], 2)
    assert did == {"d1": "new_version", "d2": "new_version_move_chunks", "d3": "overwrite", "d4": "unchanged", "d5": "insert"}
    assert not scd2.violations(versions).collect()
    assert [(r["version"], r["is_current"], r["title"]) for r in scd2.document_history(versions, "d1").collect()] == [(1, False, "a"), (2, True, "A")]
    assert {r["doc_id"]: r["title"] for r in scd2.as_of(versions, DAY + datetime.timedelta(1.5)).collect()}["d1"] == "a"
    did, _ = step(spark, versions, [(4, "a", "u", True)], 3, rechunk_all=True)
    assert did == {"d4": "rechunk"}
    did, _ = step(spark, versions, [(4, "a", "u", True)], 3, rechunk_all=True, same_chunks=spark.createDataFrame([("d4",)], "doc_id string"))
    assert did == {"d4": "unchanged"}
    did, _ = step(spark, versions, [(4, "a", "u", False)], 3, History(version_on_activation_change=False))
    assert did == {"d4": "overwrite"}
    did, _ = step(spark, versions, [(4, "a", "w", True)], 3, History(overwrite=("metadata",)))
    assert did == {"d4": "unchanged"}


@given(st.lists(st.lists(st.tuples(st.integers(1, 4), st.sampled_from("ab"), st.sampled_from("uv"), st.booleans()), max_size=4, unique_by=lambda r: r[0]), min_size=1, max_size=3))
@settings(max_examples=4, deadline=None)
def test_any_edits_keep_the_invariants(spark, batches):
    versions, last = spark.createDataFrame([], VERSIONS), {}
    for n, rows in enumerate(batches, 1):
        _, versions = step(spark, versions, rows, n)
        last |= {f"d{k}": (t, u, a) for k, t, u, a in rows}
    assert not scd2.violations(versions).collect()
    assert {r["doc_id"]: (r["title"], r["url"], r["is_active"]) for r in scd2.current_versions(versions).collect()} == last


def test_violations_are_found(spark):
    good = ("d1", 1, True, DAY, None)
    rows = [good, ("d2", 1, True, DAY, None), ("d2", 2, True, DAY, None), ("d3", 1, False, DAY, DAY + datetime.timedelta(1)), ("d3", 2, True, DAY + datetime.timedelta(2), None)]
    found = {(r["doc_id"], r["problem"]) for r in scd2.violations(spark.createDataFrame(rows, "doc_id string, version int, is_current boolean, valid_from timestamp, valid_to timestamp")).collect()}
    assert {("d2", "not one current version"), ("d3", "gap between versions")} <= found and not any(d == "d1" for d, _ in found)


def test_violations_are_found_in_one_pass(spark):
    at = lambda n: DAY + datetime.timedelta(n)
    rows = [
        ("ok", 1, False, at(0), at(1)), ("ok", 2, True, at(1), None), ("thrice", 1, False, at(0), at(1)), ("thrice", 1, False, at(1), at(1)), ("thrice", 1, True, at(1), None),
        ("none", None, False, at(0), at(1)), ("none", 0, False, at(2), at(1)), ("open", 3, False, at(0), None), (None, 1, True, at(0), None), (None, None, True, at(0), at(0)),
    ]
    found = scd2.violations(spark.createDataFrame(rows, "doc_id string, version int, is_current boolean, valid_from timestamp, valid_to timestamp"))
    many = "not one current version"
    want = [(None, many), (None, "current without open end"), ("none", many), ("none", "ends before it begins"), ("none", "gap between versions"), ("open", many), ("open", "current without open end"), ("thrice", "version repeats")]
    got = sorted(map(tuple, found.collect()), key=repr)
    assert [x for x in got if x != ("thrice", "gap between versions")] == sorted(want, key=repr)
    # One reading and one sort of the versions: four of each held their memory in one task at once.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.rpartition("Initial Plan")[2].count("hashpartitioning(doc_id") == 1


def test_modes():
    mark = Watermark("t", "s", 10, "sig")
    assert choose_mode(mark, "sig", full=True)[0] == choose_mode(None, "sig")[0] == choose_mode(mark, "new")[0] == "full"
    assert choose_mode(mark, "sig") == ("incremental", "watermark")
    assert rechunk_all(mark, "new") and not rechunk_all(mark, "sig") and not rechunk_all(None, "sig")
    check_window("full", mark, 5)
    with pytest.raises(WatermarkAhead):
        check_window("incremental", mark, 5)
