"""Best-fit packing of token ids into sequences of at most CAPACITY tokens, planned on the histogram of lengths.

1. One pass encodes every text, appends the end id, cuts what is longer than CAPACITY into pieces of CAPACITY tokens,
   and writes a row a piece: no ids, but length, crc32, the partition it was made in and its number among the pieces
   of that length there.
2. Counts of lengths are one small aggregate (at most CAPACITY rows). The driver plans best-fit decreasing over those
   counts: bins are contiguous ranges of sequence numbers, and all bins of a range get as many items of a length as
   fit at once. The plan is a list of runs (length, first rank, last rank, first bin, items a bin, offset); there are
   at most CAPACITY ranges to split a length, so the plan's size follows the number of distinct lengths, not of texts.
3. The rank of a piece within its length is the number of such pieces in earlier partitions, from a window over the
   counts a partition and length, plus its number in its partition; no task sees all pieces of a length.
4. A piece takes the slot that the plan has for its rank.

Defined cases: a null or empty text is its end id alone. Rows that repeat a document are packed each. Rows without
doc_id are packed too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence.llm.common import batch_of, materialise, texts
from evidence.llm.tokens import encoded

CAPACITY = 4096

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    def run(batches):
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for doc_ids, ids, starts in encoded(batches, tokenizer, end_id):
            out, data, ends = [], memoryview(ids.tobytes()), starts.tolist()
            for doc_id, first, end in zip(doc_ids.to_pylist(), ends, ends[1:], strict=False):
                for piece, at in enumerate(range(first, end, capacity)):
                    n = min(capacity, end - at)
                    nth = seen[n] = seen.get(n, -1) + 1
                    out.append((doc_id, piece, at - first, n, zlib.crc32(data[4 * at : 4 * (at + n)]), part, nth))
            yield batch_of(out, _PIECES)

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts of lengths. Rows: length, first rank, end rank, first bin, items a bin, offset; and the number of bins.

    Open bins with equal room are ranges (first bin, end bin). Items of one length go to the least room that holds
    them, as many as fit a bin before the next bin.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    n_bins = 0

    def open_(room: int, first: int, end: int) -> None:
        if room and end > first:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, end))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, end: int, room: int, length: int = length) -> int:
            """Put items into bins [first, end); how many went."""
            nonlocal rank, left
            each = room // length
            whole = min(end - first, left // each)
            went = 0
            if whole:
                runs.append((length, rank, rank + whole * each, first, each, capacity - room))
                open_(room - each * length, first, first + whole)
                went += whole * each
            if whole < end - first:
                rest = left - went
                if rest:
                    runs.append((length, rank + went, rank + went + rest, first + whole, rest, capacity - room))
                    open_(room - rest * length, first + whole, first + whole + 1)
                    went += rest
                    whole += 1
                open_(room, first + whole, end)
            rank, left = rank + went, left - went
            return went

        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                break
            room = rooms[at]
            first, end = ranges[room].pop()
            if not ranges[room]:
                del ranges[room], rooms[at]
            fill(first, end, room)
        if left:
            each = capacity // length
            need = -(-left // each)
            n_bins += need
            fill(n_bins - need, n_bins, capacity)
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 6), n_bins


def place(pieces: DataFrame, runs: np.ndarray) -> DataFrame:
    """pieces (with length, rank) with sequence_id and offset."""
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(runs)
    kept = [f for f in pieces.schema if f.name != "rank"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def run(batches):
        r = shared.value
        # Runs are sorted by length, then rank; the two become one key.
        most = int(r[:, 2].max()) + 1 if len(r) else 1
        keys = r[:, 0] * most + r[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            length, rank = get("length"), get("rank")
            mine = r[np.searchsorted(keys, length * most + rank, side="right") - 1]
            bin_, in_bin = np.divmod(rank - mine[:, 1], mine[:, 4])
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(mine[:, 3] + bin_), pa.array(mine[:, 5] + in_bin * length)], names=[*(f.name for f in kept), "sequence_id", "offset"])

    return pieces.mapInArrow(run, out)


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = materialise(cut(docs, tokenizer, end_id, capacity))
    each = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(each.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    counts = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("n")).collect()}
    runs, _ = plan(counts, capacity)
    ranked = made.join(base.select("length", "part", "base"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    return place(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), runs)
