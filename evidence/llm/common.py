"""What the training-data operators share: reading, shared tables, Arrow iteration, word splitting.

Words are runs of characters other than space and U+0009..U+000D. A null text is an empty text everywhere.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence.workers import bounded_batches, delete_on_exit, on_workers, shared_dir

WORD = re.compile(r"[^\x20\t-\r]+")
_ODD_SPACE = re.compile(r"[^\S\x20\t-\r]")
_ODD_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Rows handed from Arrow to Python at once; bounds what a worker holds besides its Arrow batch.
SLICE = 128
#: A side of a join is broadcast only if its counted rows are no more than this.
BROADCAST_ROWS = 200_000


def words(text: str) -> list[str]:
    """The words of a text; str.split() where it splits at the same characters."""
    odd = any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD_SPACE.search(text)
    return WORD.findall(text) if odd else text.split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (never null) of documents, and no other column but those asked for."""
    on_workers(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def bucket(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the shared folder. What is written there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/evidence/{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, outlives executors. Removed when the driver ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Slices of at most SLICE rows, as tuples of Python values. A worker outlives its task, and gives back what Arrow held."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))
    pa.default_memory_pool().release_unused()


def by_bytes(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.Table]:
    """The rows in tables of one chunk with about most bytes in a column, or one row with more."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most - size, side="right")))
            held.append(batch.slice(at, end - at))
            size, at = size + int(sizes[end - 1]) - before, end
            if size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    pa.default_memory_pool().release_unused()


def batch_of(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def hashed_below(share: float, *key: str) -> Column:
    """About that share of all rows, the same ones every time, by the hash of their key."""
    return F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))


def commonest(counts: DataFrame, most: int, *key: str) -> list[tuple]:
    """About most rows (key, n) of the greatest n, largest first. Nothing but those and a histogram reaches the driver.

    All rows above a level of n are taken, and of those at it the share that is left, by hash.
    """
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.lit(4096) + F.floor((F.log2(F.col("n")) - 12) * 64)).cast("long")
    room, cut, share = most, -1, 1.0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r[1] > room:
            cut, share = r[0], room / r[1]
            break
        room -= r[1]
    kept = counts.where((level > cut) | ((level == cut) & hashed_below(share, *key))).select(*key, "n").collect()
    return sorted((tuple(r) for r in kept), key=lambda r: (-r[-1], r[:-1]))


def small(df: DataFrame, n: int) -> DataFrame:
    """df, to be broadcast if its n counted rows are few; else joined by shuffle."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
