"""The change log as a stream: each micro-batch runs the ingest of what has changed since the committed watermark.

The stream only says that something changed; what is read is decided by the manifest's watermark, so a micro-batch that
is delivered twice finds nothing to do.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_log = logging.getLogger(__name__)


def change_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of an append-only change log."""
    return spark.readStream.schema(schema).parquet(path)


def head_by_source(changes: DataFrame) -> DataFrame:
    """The head of each source so far; a running aggregate whose state is one row a source."""
    return changes.groupBy("source_id").agg(F.max("change_id").alias("head"), F.count("*").alias("changes"))


def run_on_change(changes: DataFrame, run_batch: Callable[[], object], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Call run_batch for every micro-batch with rows; once over what there is, or at an interval. An error ends the stream."""

    def each(batch: DataFrame, _: int) -> None:
        if batch.take(1):
            run_batch()

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class Follower:
    """Runs for micro-batches, where a run that fails is told and skipped, and made up for by the next.

    What a run reads is decided by the store's watermark, which only a run that publishes moves: the changes of a failed run
    are all in the next one's window, whichever micro-batch that belongs to. So a failed micro-batch need not be given again,
    and one bad batch does not end the stream. Failures are kept, logged, and handed to told (batch number, error). owed is
    true while the last run has failed: settle() tries once more.
    """

    def __init__(self, run_batch: Callable[[], object], told: Callable[[int, str], None] | None = None):
        self.run_batch, self.told = run_batch, told
        self.failures: list[str] = []
        self.owed = False

    def _try(self, number: int) -> None:
        try:
            self.run_batch()
            self.owed = False
        except Exception as wrong:  # whatever a run raises
            self.owed = True
            self.failures.append(f"batch {number}: {type(wrong).__name__}: {wrong}")
            _log.exception("a run failed; the next one makes up for it", extra={"batch": number})
            if self.told:
                self.told(number, self.failures[-1])

    def each(self, batch: DataFrame, number: int) -> None:
        if self.owed or batch.take(1):
            self._try(number)

    def settle(self) -> bool:
        """Run once more if the last run failed; whether nothing is owed."""
        if self.owed:
            self._try(-1)
        return not self.owed

    def start(self, changes: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(self.each).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
