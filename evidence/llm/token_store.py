"""A store of token ids: each document a zstandard frame of its own, all with one shared dictionary.

The dictionary is trained on the serialised ids of a bounded sample of documents (SAMPLE documents by hash of doc_id, at
most SAMPLE_BYTES). Documents are encoded and compressed where they lie, dealt by ranges of doc_id, sorted, and written
as shards of about SHARD_BYTES by Spark's own writer, so that a lost executor leaves no half of a file. A shard is

    magic 8 | dictionary hash 8 | documents 4 | bytes an id 4 | ids before it in its range 8
    | doc_id 8 each | has doc_id 1 each | ids 8 each | frame offsets 8 each, one more than documents | frames

in little-endian order; an id takes 2 bytes if every id of the tokenizer fits, else 4. One document is read by its place
in the index, without its neighbours. Ranges ascend, shards of a range ascend, documents of a shard ascend by doc_id; rows
without doc_id come first. Those of one doc_id are in order of a hash of their ids, so a store doesn't depend on how rows lay.
A doc_id with more rows than a range holds, and rows without one, are dealt over several ranges by that hash.

A store is a folder: `shards`, and `about`, one row with the dictionary, the end id and the tokenizer's file name. It is
read by open_store() at any time.

Defined cases: a null or empty text is the end id alone. An empty table is a store without shards. Other columns are
ignored. Ranges are MAX_RANGES at most, so beyond RANGE_DOCS times that many documents each holds more of them; a shard is
about SHARD_BYTES all the same.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence.llm.common import batch_of, on_workers, rows, scratch, texts
from evidence.llm.tokens import encoded, encoder

MAGIC = b"EVTOKST1"
_HEAD = struct.Struct("<8sQIIq")
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8_000_000, 64 * 1024
SHARD_BYTES, RANGE_DOCS, MAX_RANGES, LEVEL = 2_000_000, 4000, 20_000, 3


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; their raw bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_hash(dictionary: bytes) -> int:
    return xxhash.xxh3_64_intdigest(dictionary)


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def shard(docs: list[tuple[int | None, int, bytes]], before: int, width: int, dictionary: bytes) -> bytes:
    """docs: doc_id, number of ids, frame, in order."""
    n = len(docs)
    ids = np.array([d[0] or 0 for d in docs], "<i8")
    known = np.array([d[0] is not None for d in docs], "u1")
    counts = np.array([d[1] for d in docs], "<i8")
    offsets = np.concatenate([[0], np.cumsum([len(d[2]) for d in docs])]).astype("<i8")
    head = _HEAD.pack(MAGIC, dictionary_hash(dictionary), n, width, before)
    return b"".join([head, ids.tobytes(), known.tobytes(), counts.tobytes(), offsets.tobytes(), *(d[2] for d in docs)])


class Shard:
    """A shard to read: doc_ids (None where unknown), counts, ids(i)."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, stamp, n, self.width, self.before = _HEAD.unpack_from(data)
        if magic != MAGIC or stamp != dictionary_hash(dictionary):
            raise ValueError("not a shard, or written with another dictionary")
        at = _HEAD.size
        ids = np.frombuffer(data, "<i8", n, at)
        known = np.frombuffer(data, "u1", n, at + 8 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.counts = np.frombuffer(data, "<i8", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<i8", n + 1, at + 17 * n)
        self.data, self.at = data, at + 17 * n + 8 * (n + 1)
        self.decompressor = zstandard.ZstdDecompressor(**_codec(dictionary))

    def ids(self, i: int) -> np.ndarray:
        frame = memoryview(self.data)[self.at + int(self.offsets[i]) : self.at + int(self.offsets[i + 1])]
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of one document, or None."""
        return self.ids(self.doc_ids.index(doc_id)) if doc_id in self.doc_ids else None


def id_bytes(tokenizer: str, end_id: int) -> int:
    """Bytes that hold any id of the tokenizer's and the end's."""
    return 2 if max(encoder(tokenizer).size, end_id + 1) <= 1 << 16 else 4


def _frames(batches, tokenizer: str, end_id: int, width: int):
    """doc_ids of a slice, and the serialised ids of each of its documents."""
    for doc_ids, ids, starts in encoded(batches, tokenizer, end_id):
        data, at = memoryview(ids.astype(f"<u{width}").tobytes()), (width * starts).tolist()
        yield doc_ids, np.diff(starts), [data[s:e] for s, e in zip(at, at[1:], strict=False)]


class TokenStore:
    """shards: range, seq, n_docs, n_tokens, shard; and the dictionary they need."""

    def __init__(self, shards: DataFrame, dictionary: bytes, end_id: int = 0):
        self.shards, self.dictionary, self.end_id = shards, dictionary, end_id

    def documents(self) -> DataFrame:
        """Read back, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
        totals = {r[0]: r[1] for r in self.shards.groupBy("range").agg(F.sum("n_tokens")).collect()}
        bases, base = {}, 0
        for k in sorted(totals):
            bases[k], base = base, base + totals[k]
        dictionary = self.dictionary
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    s = Shard(batch.column("shard")[i].as_py(), dictionary)
                    start = bases[batch.column("range")[i].as_py()] + s.before
                    out = []
                    for k, doc_id in enumerate(s.doc_ids):
                        ids = s.ids(k)
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                    yield batch_of(out, schema)

        return self.shards.select("range", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


_SHARDS = "range int, seq int, n_docs long, n_tokens long, shard binary"
_ABOUT = "dictionary binary, end_id int, tokenizer string"


def open_store(spark: SparkSession, path: str) -> TokenStore:
    """The store in a folder."""
    on_workers(spark)
    about = spark.read.schema(_ABOUT).parquet(f"{path}/about").first()
    return TokenStore(spark.read.schema(_SHARDS).parquet(f"{path}/shards"), bytes(about["dictionary"]), about["end_id"])


class Ranges:
    """Which range a document is in: by doc_id, and among rows of a doc_id that fills ranges of its own, by a hash."""

    def __init__(self, cuts: list[int], unknown: int):
        """cuts: quantiles of doc_id, one of them more than once if it fills ranges. unknown: ranges for rows without doc_id."""
        values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        full = values[times > 1]
        # A doc_id that fills ranges has a range that ends with it and one that ends just before it.
        self.bounds = np.union1d(values, full - 1)
        parts = np.ones(len(self.bounds) + 1, np.int64)
        parts[np.searchsorted(self.bounds, full)] = times[times > 1]
        self.parts = np.concatenate([[max(unknown, 1)], parts])
        self.first = np.cumsum(self.parts) - self.parts

    def __len__(self) -> int:
        return int(self.parts.sum())

    def of(self, ids: np.ndarray, known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """hashes: unsigned; ranges of one doc_id ascend with them."""
        at = np.where(known, 1 + np.searchsorted(self.bounds, ids), 0)
        return (self.first[at] + ((hashes >> np.uint64(40)).astype(np.int64) * self.parts[at] >> 24)).astype(np.int32)


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> TokenStore:
    """Encode all texts, end each with end_id, write them in ascending doc_id order to a folder (None: a scratch one)."""
    spark = docs.sparkSession
    on_workers(spark)
    width = id_bytes(tokenizer, end_id)
    n, unknown = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    share = max(1, min(1 << 20, -(-(SAMPLE << 20) // max(n, 1))))
    sampled = texts(docs).where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share)

    def encode_sample(batches):
        for _, _, own in _frames(batches, tokenizer, end_id, width):
            yield pa.RecordBatch.from_pydict({"ids": pa.array(map(bytes, own), pa.binary())})

    samples, size = [], 0
    for r in sampled.mapInArrow(encode_sample, "ids binary").toLocalIterator():
        if size + len(r[0]) > SAMPLE_BYTES:
            break
        samples.append(bytes(r[0]))
        size += len(r[0])
    dictionary = train_dictionary(samples)
    n_ranges = max(1, min(-(-n // RANGE_DOCS), MAX_RANGES))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n_ranges for i in range(1, n_ranges)], 10 * n_ranges)).first()[0] if n_ranges > 1 else None
    ranges = Ranges(cuts or [], -(-unknown * n_ranges // max(n, 1)))

    def encode_all(batches):
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_dict_id=False, **_codec(dictionary))
        for doc_ids, sizes, own in _frames(batches, tokenizer, end_id, width):
            hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in own], np.uint64)
            at = ranges.of(doc_ids.fill_null(0).to_numpy(), ~np.asarray(doc_ids.is_null()), hashes)
            # As signed numbers the hashes keep their order.
            order = (hashes ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), doc_ids, pa.array(order), pa.array(sizes), pa.array(map(press.compress, own), pa.binary())], names=["range", "doc_id", "h", "n", "frame"])

    framed = texts(docs).mapInArrow(encode_all, "range int, doc_id long, h long, n long, frame binary")
    # A range is a partition and a file's worth of documents; RANGE_DOCS decides its size, not a hash.
    dealt = framed.repartitionById(len(ranges), "range").sortWithinPartitions("range", F.asc_nulls_first("doc_id"), "h", "n")

    def write(batches):
        schema = pa.schema([("range", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.binary())])
        at, seq, before, held, size = None, 0, 0, [], 0

        def flush():
            nonlocal seq, before, held, size
            total = sum(d[1] for d in held)
            out = batch_of([(at, seq, len(held), total, shard(held, before, width, dictionary))], schema)
            seq, before, held, size = seq + 1, before + total, [], 0
            return out

        for part in rows(batches):
            for where, doc_id, _, n_ids, frame in part:
                if held and (where != at or size >= SHARD_BYTES):
                    yield flush()
                if where != at:
                    at, seq, before = where, 0, 0
                held.append((doc_id, n_ids, frame))
                size += len(frame)
        if held:
            yield flush()

    if path is None:
        path = scratch(spark)
    dealt.mapInArrow(write, _SHARDS).write.parquet(f"{path}/shards")
    spark.createDataFrame([(bytearray(dictionary), end_id, os.path.basename(tokenizer))], _ABOUT).coalesce(1).write.parquet(f"{path}/about")
    return open_store(spark, path)
