"""Type 2 history: what happens to each document, and the version table after it.

Everything is one plan over the current versions and the incoming documents; the batch's time is one literal, so that a
version ends exactly when the next begins.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence.rules.spec import History

INSERT, NEW_VERSION, MOVE, RECHUNK, OVERWRITE, UNCHANGED = "insert", "new_version", "new_version_move_chunks", "rechunk", "overwrite", "unchanged"
VERSION_COLUMNS = ("doc_sk", "doc_id", "doc_type", "source_id", "title", "body", "url", "metadata", "content_hash", "tracked_hash", "is_active", "version", "is_current", "valid_from", "valid_to", "change_reason", "source_change_id", "batch_id")
DOCUMENT_COLUMNS = ("doc_id", "doc_type", "source_id", "title", "body", "url", "metadata", "content_hash", "tracked_hash", "is_active")


def _action(history: History, rechunk: Column) -> tuple[Column, Column]:
    """Action and reason, first match wins. Columns: p_* of the current version, and those of the document."""
    flag = ~F.col("p_is_active").eqNullSafe(F.col("is_active"))
    attribute = F.lit(False)
    for name in ("url", "metadata"):
        if name in history.overwrite:
            attribute = attribute | ~F.col(f"p_{name}").eqNullSafe(F.col(name))
    rules = [(F.col("p_doc_sk").isNull(), INSERT, "first seen"), (~F.col("p_tracked_hash").eqNullSafe(F.col("tracked_hash")), NEW_VERSION, "text changed")]
    if history.version_on_activation_change:
        rules += [(flag & rechunk, NEW_VERSION, "activation changed"), (flag, MOVE, "activation changed")]
    rules += [(rechunk, RECHUNK, "chunking changed"), (flag, OVERWRITE, "activation changed"), (attribute, OVERWRITE, "attribute changed")]
    action = reason = F
    for when, what, why in rules:
        action, reason = action.when(when, what), reason.when(when, why)
    return action.otherwise(UNCHANGED), reason.otherwise("no change")


def decide(current: DataFrame, incoming: DataFrame, history: History = History(), rechunk_all: bool = False, same_chunks: DataFrame | None = None) -> DataFrame:
    """incoming with p_doc_sk, p_version, p_is_active, action, reason.

    same_chunks (doc_id) are documents whose chunks come out as stored; a change of chunking doesn't concern those.
    """
    names = ("doc_sk", "version", "is_active", "tracked_hash", "url", "metadata")
    before = current.select("doc_id", *(F.col(c).alias(f"p_{c}") for c in names))
    rows = incoming.join(before, "doc_id", "left")
    rechunk = F.lit(rechunk_all)
    if rechunk_all and same_chunks is not None:
        rows = rows.join(same_chunks.select("doc_id", F.lit(True).alias("same")), "doc_id", "left")
        rechunk = ~F.coalesce(F.col("same"), F.lit(False))
    action, reason = _action(history, rechunk)
    return rows.select(*incoming.columns, "p_doc_sk", "p_version", "p_is_active", action.alias("action"), reason.alias("reason"))


def _with_keys(opened: DataFrame, top: DataFrame) -> DataFrame:
    """Surrogate keys after the largest, in order of (first three digits of sha256(doc_id), doc_id).

    Each of the 4096 digit groups is ranked by itself and offset by the sizes of those before it: the keys are the same
    however the rows lie, and no task ranks all documents.
    """
    grouped = opened.withColumn("__g", F.substring(F.sha2("doc_id", 256), 1, 3))
    ranked = grouped.withColumn("__n", F.row_number().over(Window.partitionBy("__g").orderBy("doc_id")))
    before = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    bases = grouped.groupBy("__g").count().select("__g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    return ranked.join(F.broadcast(bases), "__g").join(F.broadcast(top)).withColumn("doc_sk", F.col("__top") + F.col("__base") + F.col("__n")).drop("__g", "__n", "__base", "__top")


def _after(versions: DataFrame, decided: DataFrame, at: datetime.datetime, change_id: int, batch_id: int, top: int | None, how: str) -> tuple[DataFrame, DataFrame]:
    """Versions that were there, as they are after a batch (how: left for all, inner for those that it changes), and new ones."""
    now = F.lit(at).cast("timestamp")
    opens = F.col("action").isin(INSERT, NEW_VERSION, MOVE)
    todo = decided.where(F.col("action") != UNCHANGED)
    plan = todo.select("doc_id", "action", F.col("url").alias("n_url"), F.col("metadata").alias("n_metadata"), F.col("is_active").alias("n_is_active"))
    held = versions.join(plan, (versions["doc_id"] == plan["doc_id"]) & versions["is_current"], how).drop(plan["doc_id"])
    closed, inplace = F.col("action").isin(NEW_VERSION, MOVE), F.col("action").isin(OVERWRITE, RECHUNK)
    kept = held.select(
        *(F.when(inplace, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in ("url", "metadata", "is_active")
          else F.when(closed, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_current"
          else F.when(closed, now).otherwise(F.col(c)).alias(c) if c == "valid_to"
          else F.when(inplace, F.lit(v)).otherwise(F.col(c)).cast("long").alias(c) if (v := {"source_change_id": change_id, "batch_id": batch_id}.get(c)) is not None
          else F.col(c)
          for c in VERSION_COLUMNS)
    )
    given = versions.sparkSession.range(1).select(F.lit(top).cast("long").alias("__top"))
    highest = versions.agg(F.coalesce(F.max("doc_sk"), F.lit(0)).cast("long").alias("__top")) if top is None else given
    opened = _with_keys(todo.where(opens), highest).select(
        "doc_sk", *DOCUMENT_COLUMNS, (F.coalesce(F.col("p_version"), F.lit(0)) + 1).cast("int").alias("version"), F.lit(True).alias("is_current"),
        now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("reason").alias("change_reason"),
        F.lit(change_id).cast("long").alias("source_change_id"), F.lit(batch_id).cast("long").alias("batch_id"),
    )
    return kept, opened.select(*VERSION_COLUMNS)


def apply(versions: DataFrame, decided: DataFrame, at: datetime.datetime, change_id: int, batch_id: int, top: int | None = None) -> DataFrame:
    """The version table after a batch: versions closed, opened, overwritten in place; others as they were.

    top: the largest surrogate key given so far, where versions are a part of the table; else that of versions.
    """
    kept, opened = _after(versions, decided, at, change_id, batch_id, top, "left")
    return kept.unionByName(opened)


def delta(versions: DataFrame, decided: DataFrame, at: datetime.datetime, change_id: int, batch_id: int, top: int) -> tuple[DataFrame, DataFrame]:
    """What a batch writes: rows as apply() has them, of changed and new versions alone, and the changed ones' doc_sk and doc_id."""
    changed, opened = _after(versions, decided, at, change_id, batch_id, top, "inner")
    return changed.unionByName(opened), changed.select("doc_sk", "doc_id")


def vanished(current: DataFrame, present: DataFrame, reason: str = "not in the source any more") -> DataFrame:
    """Active current documents that are absent, as incoming documents that are inactive; reason goes with them."""
    gone = current.where("is_active").join(present.select("doc_id"), "doc_id", "left_anti")
    return gone.select(*(F.lit(False).alias(c) if c == "is_active" else F.col(c) for c in DOCUMENT_COLUMNS)).withColumn("gone_reason", F.lit(reason))


def current_versions(versions: DataFrame) -> DataFrame:
    return versions.where("is_current")


def document_history(versions: DataFrame, doc_id: str) -> DataFrame:
    return versions.where(F.col("doc_id") == doc_id).orderBy("version")


def as_of(versions: DataFrame, at: datetime.datetime) -> DataFrame:
    """The versions valid at a time: from valid_from, before valid_to."""
    t = F.lit(at).cast("timestamp")
    return versions.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))


def batch_stats(decided: DataFrame) -> DataFrame:
    """Counters of a batch, one row."""
    did = lambda *a: F.col("action").isin(*a)
    off, on = F.col("p_is_active") & ~F.col("is_active"), ~F.col("p_is_active") & F.col("is_active")
    moved = did(NEW_VERSION, MOVE, OVERWRITE, RECHUNK)
    return decided.agg(
        F.count_if(did(INSERT)).alias("inserted"), F.count_if((did(NEW_VERSION) & (F.col("reason") == "text changed")) | did(RECHUNK)).alias("updated"), F.count_if(did(OVERWRITE)).alias("refreshed"),
        F.count_if(did(UNCHANGED)).alias("unchanged"), F.count_if(moved & off).alias("deactivated"), F.count_if(moved & on).alias("reactivated"),
        F.count_if(did(INSERT, NEW_VERSION, MOVE)).alias("versions_created"),
    )


def violations(versions: DataFrame) -> DataFrame:
    """Broken invariants of the version table: doc_id, problem. Empty is good.

    One pass: each document's versions in order, each compared with its neighbours; what counts for a whole document or
    for all rows of a version is told at one of its rows.
    """
    order = Window.partitionBy("doc_id").orderBy("version")
    rows = versions.select("doc_id", "version", "is_current", "valid_from", "valid_to", F.struct("version").alias("v")).select(
        "*", F.lead("valid_from").over(order).alias("next"), F.lead("v").over(order).alias("v1"), F.lag("v").over(order).alias("v0"), F.lag("v", 2).over(order).alias("v00"),
        F.count_if("is_current").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
    )
    repeats = F.col("v0").isNotNull() & (F.col("v0") == F.col("v")) & ~F.col("v00").eqNullSafe(F.col("v"))
    problems = F.array(
        F.when(F.col("v1").isNull() & (F.col("n") != 1), "not one current version"),
        F.when(repeats, "version repeats"),
        F.when(F.col("is_current") != F.col("valid_to").isNull(), "current without open end").when(F.col("valid_to") < F.col("valid_from"), "ends before it begins").when(F.col("version") < 1, "version below 1"),
        F.when(F.col("next").isNotNull() & ~F.col("valid_to").eqNullSafe(F.col("next")), "gap between versions"),
    )
    return rows.select("doc_id", F.explode(F.array_compact(problems)).alias("problem"))
