"""One list of a source's files a run: head, changed keys, parent and children are all read from it.

Tables are folders of Parquet files that only grow or are replaced whole. The change log is listed first, so that what it
tells is in the tables that are listed after it. Files that come later belong to the next run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LOG = "record_change"
PINNED = "table string, file string"


@dataclass(frozen=True)
class Snapshot:
    """files: of each table. schemas: as DDL, given where a table has no file."""

    files: dict[str, list[str]]
    schemas: dict[str, str]

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        read = lambda n, held: spark.read.schema(self.schemas[n]).parquet(*held) if held else spark.createDataFrame([], self.schemas[n])
        return {n: read(n, held) for n, held in self.files.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, f) for n, held in self.files.items() for f in held], PINNED)


def pin(spark: SparkSession, folder: str, names: list[str]) -> Snapshot:
    """The files of <folder>/<name>.parquet for each name as they are now, the log's first."""
    files, schemas = {}, {}
    for name in sorted(names, key=lambda n: (n != LOG, n)):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        files[name] = sorted(df.inputFiles())
        schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return Snapshot(files, schemas)
