"""The change log: head, window, changed keys, rows and missing keys, and the mode of a run.

Windows are open below and closed above. Changed keys are read again as they are now; events aren't replayed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys are broadcast to the parent scan only if there are no more than this.
BROADCAST_KEYS = 500_000


class WatermarkAhead(RuntimeError):
    """The stored watermark is beyond the log's head: the log was reset. A full run repairs it."""


def source_head(log: DataFrame, source_id: str) -> DataFrame:
    return log.where(F.col("source_id") == source_id).agg(F.coalesce(F.max("change_id"), F.lit(0)).cast("long").alias("head"))


def _window(log: DataFrame, source_id: str, low: int, high: int | None) -> DataFrame:
    rows = log.where((F.col("source_id") == source_id) & (F.col("change_id") > low))
    return rows if high is None else rows.where(F.col("change_id") <= high)


def changes_behind(log: DataFrame, marks: DataFrame) -> DataFrame:
    """For each watermark (doc_type, source_id, change_id), the changes past it. There is a watermark a document type: few."""
    late = log.select("source_id", F.col("change_id").alias("id")).join(F.broadcast(marks), "source_id").where(F.col("id") > F.col("change_id"))
    counted = late.groupBy("doc_type", "source_id").agg(F.count("*").alias("behind"))
    return marks.select("doc_type", "source_id").join(counted, ["doc_type", "source_id"], "left").select("doc_type", "source_id", F.coalesce("behind", F.lit(0)).alias("behind"))


def changed_keys(log: DataFrame, source_id: str, low: int, high: int | None) -> DataFrame:
    return _window(log, source_id, low, high).select("record_key").distinct()


def changed_rows(parent: DataFrame, keys: DataFrame, n_keys: int | None = None) -> DataFrame:
    """The parent's rows (record_key and more) among the keys; a semi-join, broadcast for few keys."""
    few = n_keys is not None and n_keys <= BROADCAST_KEYS
    return parent.join(F.broadcast(keys) if few else keys, "record_key", "left_semi")


def missing_keys(parent: DataFrame, keys: DataFrame) -> DataFrame:
    """Changed keys without a row: the record is gone."""
    return keys.join(parent.select("record_key"), "record_key", "left_anti")


@dataclass(frozen=True)
class Watermark:
    doc_type: str
    source_id: str
    change_id: int
    signature: str


def choose_mode(mark: Watermark | None, signature: str, full: bool = False) -> tuple[str, str]:
    """Mode and reason: full if asked, without a watermark, or with another signature; else incremental."""
    if full:
        return "full", "requested"
    if mark is None:
        return "full", "no watermark"
    if mark.signature != signature:
        return "full", "signature changed"
    return "incremental", "watermark"


def rechunk_all(mark: Watermark | None, signature: str) -> bool:
    return mark is not None and mark.signature != signature


def check_window(mode: str, mark: Watermark | None, head: int) -> None:
    """Refuse an incremental run from beyond the head. A full run doesn't read the log from the watermark, and repairs it."""
    if mode == "incremental" and mark is not None and mark.change_id > head:
        raise WatermarkAhead(f"watermark {mark.change_id} of {mark.doc_type} is ahead of the log's head {head}; run in full")
