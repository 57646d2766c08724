"""Language-model scores of whole texts by a gated recurrent network, beside a smoothed unigram base.

Tokens of a text are its words with A-Z in lower case, then one end. Learning is from documents whose crc32(doc_id as
text) mod 10 is not 0.

1. All training tokens are counted: combined a partition, then one aggregate by word. The counts of all words stay a
   table; the TOP commonest also go to the workers.
2. The network names the gru.VOCABULARY commonest tokens; each other word belongs to one of gru.RARE classes by its
   look, in which its share is its smoothed count over the class's. So the model is a distribution over all words.
3. One pass turns every text into network ids, with what its score needs of the counts. The words beyond the TOP are
   written out as (row, word, times), joined with the table of counts, and their logarithms added up a row; the rest is
   known to the worker.
4. The network trains on every training document once: a hash deals them to ROUNDS, and in a round to shards of about
   SHARD_TOKENS. How many shards there are follows from the tokens alone (at most MAX_SHARDS), a shard's texts come in
   the order of their hash, and all start from the same parameters; their mean by tokens, added up in groups of FAN,
   starts the next round. So the model is a function of the rows, however they lie.
5. A pass over the ids scores every text.

Defined cases: a null or empty text is its end alone. Rows without doc_id are learnt from and scored (held_out false).
Repeated rows are scored each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm import gru
from evidence.llm.common import batch_of, bucket, by_bytes, commonest, materialise, rows, texts, words

HOLD_OUT = 10
TOP = 300_000
ROUNDS, FAN = 2, 16
SHARD_TOKENS, MAX_SHARDS = 2_000_000, 16_384
#: Tokens laid into lanes at once; bounds a worker's memory.
GROUP = 3_000_000
SLICE_BYTES = 4_000_000
#: The end, a token that no word can be.
END = " "

_ODD = re.compile(r"[^a-z]")
_STOPS = ".,;:!?"
LN10 = math.log(10)


def tokens(text: str) -> list[str]:
    # bytes.lower() touches A-Z only
    return [*words(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")), END]


def split(texts_: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of many texts, without their ends, as numbers of distinct words; those; and how many words each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts_))
    listed = pc.ascii_split_whitespace(trimmed)
    none = np.asarray(pc.equal(trimmed, ""))
    words_ = listed.flatten()
    if none.any():
        words_ = words_.filter(pc.not_equal(words_, ""))
    found = words_.dictionary_encode()
    return np.asarray(found.indices), found.dictionary.cast(pa.string()), np.diff(np.asarray(listed.offsets)) - none


def rare_class(word: str) -> int:
    """The class of a word by its look: its marks, its letters beyond ASCII, or its length."""
    bare = word.rstrip(_STOPS)
    odd = _ODD.search(bare)
    if not odd:
        return min(len(bare) // 3, 5) + (6 if len(bare) < len(word) else 0)
    c = odd[0]
    if c.isdigit():
        return 12
    if c.isascii():
        return 13 + ord(c) % 7
    return 20 + (ord(c) % 6) + (6 if len(bare) < len(word) else 0)


def _counts(docs: DataFrame) -> DataFrame:
    """word, n of all training tokens."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for part in by_bytes(batches, SLICE_BYTES):
            which, names, _ = split(part.column("text").chunk(0))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(which, minlength=len(names)))], schema=schema)
            yield batch_of([(END, part.num_rows)], schema)

    learn = texts(docs).where(F.coalesce(bucket(F.col("doc_id"), HOLD_OUT), F.lit(1)) != 0).select("text")
    return materialise(learn.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


class Vocabulary:
    """What workers know of the counts: the top words, their network ids and logarithms, and the size of each rare class."""

    def __init__(self, counts: DataFrame):
        top = commonest(counts, TOP, "word")
        self.rank = {r[0]: i for i, r in enumerate(top)}
        if END not in self.rank:
            own = counts.where(F.col("word") == END).first()
            self.rank = {END: 0} | {w: i + 1 for w, i in self.rank.items()}
            top = [(END, own["n"] if own else 0), *top]
        n = np.array([r[1] for r in top], np.float64)
        # The end is among the network's own words, as there is one in each text.
        end = self.rank[END]
        order = np.concatenate([[end], np.delete(np.arange(len(top)), end)])
        self.ids = np.empty(len(top), np.int32)
        self.ids[order] = np.arange(len(top))
        names = list(self.rank)
        for r in order[gru.VOCABULARY :]:
            self.ids[r] = gru.VOCABULARY + rare_class(names[r])
        self.log = np.log10(n + 0.1)
        self.known = n > 0
        sizes = self._sizes(counts, [names[r] for r in order[: gru.VOCABULARY]])
        self.total, self.distinct = sizes.pop(-1, (0, 0))
        self.log_total = math.log10(self.total + 0.1 * (self.distinct + 1))
        self.log_size = np.array([math.log10(t + 0.1 * (v + 1)) for t, v in (sizes.get(k, (0, 0)) for k in range(gru.RARE))])
        own = np.zeros(gru.START)
        own[: min(len(order), gru.VOCABULARY)] = n[order[: gru.VOCABULARY]]
        own[gru.VOCABULARY :] = [sizes.get(k, (0, 0))[0] for k in range(gru.RARE)]
        self.unigram = own

    @staticmethod
    def _sizes(counts: DataFrame, own: list[str]) -> dict[int, tuple[int, int]]:
        """Tokens and distinct words of each rare class, and of all words (-1)."""
        named = set(own)
        schema = pa.schema([("class", pa.int32()), ("n", pa.int64()), ("v", pa.int64())])

        def run(batches):
            n, v = Counter(), Counter()
            for part in rows(batches):
                for word, c in part:
                    for k in (-1,) if word in named else (-1, rare_class(word)):
                        n[k] += c
                        v[k] += 1
            yield batch_of([(k, n[k], v[k]) for k in n], schema)

        found = counts.mapInArrow(run, "class int, n long, v long").groupBy("class").agg(F.sum("n"), F.sum("v")).collect()
        return {r[0]: (r[1], r[2]) for r in found}


class _Reader:
    """Turns texts into network ids; remembers the classes of words beyond the top."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.classes = vocabulary, {}

    def rare(self, word: str) -> int:
        k = self.classes.get(word)
        if k is None:
            if len(self.classes) > 300_000:
                self.classes.clear()
            k = self.classes[word] = rare_class(word)
        return k

    def read(self, texts_: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], pa.Table]:
        """Network ids of all texts; where each text ends; of each text the tokens, those known, and sums of logarithms;
        and its words beyond the top: text (its number), word, times."""
        v = self.v
        which, names, n = split(texts_)
        listed = names.to_numpy(zero_copy_only=False).tolist()
        ranks = np.fromiter((v.rank.get(w, -1) for w in listed), np.int64, len(listed))
        beyond = np.flatnonzero(ranks < 0)
        own = v.ids[ranks] if len(ranks) else np.zeros(0, np.int32)
        own[beyond] = gru.VOCABULARY + np.fromiter((self.rare(listed[i]) for i in beyond.tolist()), np.int32, len(beyond))
        logs = np.where(ranks < 0, 0.0, v.log[ranks])
        known = np.where(ranks < 0, 0, v.known[ranks])
        of_class = own >= gru.VOCABULARY
        shares = np.where(of_class, logs - v.log_size[np.where(of_class, own - gru.VOCABULARY, 0)], 0.0)
        text = np.repeat(np.arange(len(n)), n)
        total = lambda each: np.bincount(text, each[which], len(n))
        end = v.rank[END]
        sums = {"n": n + 1, "known": total(known).astype(np.int64) + int(v.known[end]), "base": total(logs) + v.log[end], "shares": total(shares)}
        rare = np.flatnonzero(ranks[which] < 0)
        pairs, times = np.unique(text[rare] * max(len(listed), 1) + which[rare], return_counts=True)
        words_ = pa.table({"text": pa.array(pairs // max(len(listed), 1)), "word": names.take(pa.array(pairs % max(len(listed), 1))), "times": pa.array(times)})
        ends = np.cumsum(n)
        return np.insert(own[which], ends, v.ids[end]), ends + np.arange(1, len(n) + 1), sums, words_


_MADE = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("shares", pa.float64()),
    ("word", pa.string()), ("times", pa.int64()),
])
_MADE_SQL = "row long, doc_id long, h long, held_out boolean, ids binary, n long, known long, base double, shares double, word string, times long"


def _read(docs: DataFrame, shared) -> DataFrame:
    """A row for each text: network ids, tokens, those known, and what the worker knows of both scores; and a row for each word of a text beyond the top."""

    def run(batches):
        reader, row = _Reader(shared.value), TaskContext.get().partitionId() << 33
        for part in by_bytes(batches, SLICE_BYTES):
            ids, ends, sums, words_ = reader.read(part.column("text").chunk(0))
            data, cuts = memoryview(ids.astype("<u2").tobytes()), [0, *(2 * ends).tolist()]
            rows_ = row + np.arange(part.num_rows)
            own = {"row": pa.array(rows_), "ids": pa.array([data[s:e] for s, e in zip(cuts, cuts[1:], strict=False)], pa.binary()), **{k: pa.array(x) for k, x in sums.items()}}
            own |= {c: part.column(c).chunk(0) for c in ("doc_id", "h", "held_out")}
            rare = {"row": pa.array(rows_[np.asarray(words_["text"])]), "word": words_["word"].combine_chunks(), "times": words_["times"].combine_chunks()}
            for columns, size in ((own, part.num_rows), (rare, words_.num_rows)):
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _MADE], schema=_MADE)
            row += part.num_rows

    held_out = F.coalesce(bucket(F.col("doc_id"), HOLD_OUT) == 0, F.lit(False)).alias("held_out")
    known = texts(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"), held_out)
    return materialise(known.mapInArrow(run, _MADE_SQL))


_PART = pa.schema([("part", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary())])
_PART_SQL = "part long, tokens long, data binary"


def _total(found: list[tuple[int, int, bytes]]) -> tuple[int, bytes]:
    """Tokens, and the mean by tokens, of parameter rows, in the order of their parts."""
    n = sum(k for _, k, _ in found)
    return n, sum(np.frombuffer(d, np.float32) * np.float32(k / n) for _, k, d in sorted(found)).astype(np.float32).tobytes()


def _mean(parts: DataFrame) -> tuple[int, bytes] | None:
    """_total() of rows (part, tokens, data), added up in groups of FAN until few are left."""

    def group(table: pa.Table) -> pa.Table:
        found = list(zip(*(table.column(c).to_pylist() for c in ("part", "tokens", "data")), strict=True))
        return pa.Table.from_batches([batch_of([(found[0][0] // FAN, *_total(found))], _PART)])

    parts = materialise(parts)
    while parts.count() > FAN:
        parts = materialise(parts.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(group, _PART_SQL))
    found = [(r["part"], r["tokens"], r["data"]) for r in parts.collect()]
    return _total(found) if found else None


def _train_shards(given, unigram: np.ndarray, rate: float):
    def run(batches):
        """Each shard of a partition, its rows in order: (shard, tokens, parameters)."""
        at, p, n, held, size = None, None, 0, [], 0

        def learn():
            nonlocal p, n, held, size
            p, seen = gru.train(p, held, rate=rate)
            n, held, size = n + seen, [], 0

        for batch in batches:
            for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                if shard != at:
                    if at is not None:
                        learn()
                        yield batch_of([(at, n, gru.to_bytes(p))], _PART)
                    at, p, n = shard, gru.from_bytes(given.value, gru.initial(unigram)), 0
                held.append(np.frombuffer(ids.as_buffer(), "<u2").astype(np.int32))
                size += len(held[-1])
                if size > GROUP:
                    learn()
        if at is not None:
            learn()
            yield batch_of([(at, n, gru.to_bytes(p))], _PART)

    return run


def fit(made: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], int]:
    """The trained parameters, and the tokens that they were trained on. made: ids, h, held_out, n of texts."""
    spark = made.sparkSession
    start, trained = gru.initial(vocabulary.unigram), 0
    for k in range(rounds):
        chosen = made.where(~F.col("held_out") & (F.pmod("h", F.lit(rounds)) == k))
        tokens_ = chosen.agg(F.sum("n")).first()[0] or 0
        shards = max(1, min(MAX_SHARDS, round(tokens_ / SHARD_TOKENS)))
        dealt = chosen.select(F.pmod(F.xxhash64("h", F.lit(k)), F.lit(shards)).cast("int").alias("shard"), "h", "ids")
        # A shard is a partition; a shuffle by hash would put several into one.
        ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "h", "ids")
        run = _train_shards(spark.sparkContext.broadcast(gru.to_bytes(start)), vocabulary.unigram, 0.01 / (k + 1))
        if (mean := _mean(ordered.select("shard", "ids").mapInArrow(run, _PART_SQL))) is not None:
            start, trained = gru.from_bytes(mean[1], start), trained + mean[0]
    return start, trained


def lm_scoring(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = _counts(docs)
    vocabulary = Vocabulary(counts)
    made = _read(docs, spark.sparkContext.broadcast(vocabulary))
    own = made.where("word is null").drop("word", "times")
    model, unigram = spark.sparkContext.broadcast(gru.to_bytes(fit(own, vocabulary)[0])), vocabulary.unigram

    def run(batches):
        p = gru.from_bytes(model.value, gru.initial(unigram))
        parts, size = [], 0

        def flush():
            whole = pa.Table.from_batches(parts).combine_chunks()
            ids = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int32) for x in whole.column("ids")]
            scores = pa.array(gru.score(p, ids) / LN10)
            return pa.RecordBatch.from_arrays([*(whole.column(c).chunk(0) for c in kept), scores], names=[*kept, "score"])

        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                size += sum(batch.column("n").to_pylist())
            if size > GROUP:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    kept = ["row", "doc_id", "held_out", "n", "known", "base", "shares"]
    scored = own.select(*kept, "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n long, known long, base double, shares double, score double")
    rest = made.where("word is not null").select("row", "word", "times").join(counts, "word", "left")
    logs = F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1))
    rest = rest.groupBy("row").agg(F.sum(logs).alias("logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"))
    logs = F.coalesce(F.col("logs"), F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce(F.col("more"), F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n") * F.lit(vocabulary.log_total)).alias("base_score"), (F.col("score") + F.col("shares") + logs).alias("score"),
    )
