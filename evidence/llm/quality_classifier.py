"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

1. One pass turns every text into FEATURES statistics; they are written to the shared folder, so texts are read once.
2. The labelled rows that may be learnt from (crc32(doc_id as text) mod 5 is not 0) are split: remainders 1 to 3 fit the
   ridge, remainder 4 fits the calibration. About MAX_TRAIN labelled rows are used at most, chosen by the hash of
   doc_id; this bound is a parameter. Statistics are standardised with the mean and deviation of the fitting rows.
3. cos(Wx + b), with W Gaussian, approximates a Gaussian kernel. Each of at most SUM_PARTS partitions adds up its normal
   equations (Z'Z, Z'y); the driver adds those and solves.
4. Ridge scores of the calibration rows are added up in fixed bins over all partitions; pool-adjacent-violators on the
   bins gives the monotone map to [0, 1], linear between block centres so that the order of scores is kept.

Defined cases: null and empty texts are scored as a text without words. A document with several label rows counts
once, as 1 if at least half of its non-null labels are 1. Without labels of both kinds every score is the share of
label 1 (0.5 without any). Repeated rows get the same score, one row each. Other columns are ignored; language, source,
doc_id and labels are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import SLICE, batch_of, bucket, hashed_below, materialise, rows, texts
from evidence.llm.textstats import CLASSES, Stats

HOLD_OUT = 5
THRESHOLD = 0.3
MAX_TRAIN = 200_000
SUM_PARTS = 16
#: Random features, kernel width in standard deviations of the statistics, ridge penalty for a row, bins.
N_FOURIER, WIDTH, RIDGE, N_BINS = 256, 4.0, 1e-3, 2000
_LOW, _HIGH = -0.5, 1.5


def features(text: str) -> list[float]:
    s = Stats(text)
    n, chars = max(s.n_words, 1), max(int(s.classes.sum()), 1)
    share = (s.classes / chars).tolist()
    lengths = np.fromiter(map(len, s.words), np.int64, s.n_words) if s.n_words else np.zeros(1, np.int64)
    first_upper = sum(w[0].isupper() for w in s.words) / n
    all_upper = sum(w.isupper() and len(w) > 1 for w in s.words) / n
    alnum_end = sum(w[-1].isalnum() for w in s.words) / n
    return [
        *share, np.log1p(s.n_words), float(lengths.mean()), float(lengths.std()), float((lengths <= 3).mean()), first_upper, all_upper, alnum_end,
        1 - s.bins[-1] / n, s.distinct / n, s.top / n, s.n_dup_lines / max(s.n_lines, 1), s.n_repeat_words / n, np.log1p(n / max(s.n_lines, 1)),
    ]


N_FEATURES = len(CLASSES) + 13


def _extract(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    for part in rows(batches):
        yield batch_of([(doc_id, [float(v) for v in features(text)]) for doc_id, text in part], schema)


def fourier(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(N_FEATURES, N_FOURIER)) / WIDTH, rng.uniform(0, 2 * np.pi, N_FOURIER)


class Model:
    """What turns statistics into scores: standardisation, random features, weights, calibration."""

    def __init__(self, mean, deviation, weights, knots, values):
        self.mean, self.deviation, self.weights, self.knots, self.values = mean, deviation, weights, knots, values
        self.w, self.b = fourier()

    def z(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / N_FOURIER) * np.cos(scaled @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending at: centres and values of the blocks."""
    blocks: list[list[float]] = []
    for x, v, w in zip(at, y, weight, strict=True):
        blocks.append([x * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, N_FEATURES) if batch.num_rows else np.zeros((0, N_FEATURES))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(r[0], np.float64) for r in df.collect()]


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """measured: doc_id, x. labels: doc_id, quality."""
    gold = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg((F.col("quality") >= 1).cast("int")) >= 0.5).cast("double").alias("y"))
    gold = gold.where(bucket(F.col("doc_id"), HOLD_OUT) != 0)
    n_gold = gold.count()
    if n_gold > MAX_TRAIN:
        gold = gold.where(hashed_below(MAX_TRAIN / n_gold, "doc_id"))
    # The join runs wide; only what it leaves, the labelled rows, is read in few partitions.
    learn = materialise(measured.join(gold, "doc_id").select("x", "y", (bucket(F.col("doc_id"), HOLD_OUT) == HOLD_OUT - 1).alias("calibrate"))).coalesce(SUM_PARTS)
    fitting, calibrating = learn.where(~F.col("calibrate")), learn.where("calibrate")

    def moments(batches):
        total = np.zeros(2 * N_FEATURES + 3)
        for batch in batches:
            x, y = _matrix(batch), batch.column("y").to_numpy(zero_copy_only=False)
            total += np.concatenate([[len(x), y.sum(), 0], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    total = sum(_arrays(fitting.mapInArrow(moments, "v binary")), np.zeros(2 * N_FEATURES + 3))
    n, ones = total[0], total[1]
    share = ones / n if n else 0.5
    if not 0 < ones < n:
        flat = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FOURIER + 1), np.array([0.0, 1.0]), np.array([share, share]))
        return flat
    mean = total[3 : 3 + N_FEATURES] / n
    deviation = np.sqrt(np.maximum(total[3 + N_FEATURES :] / n - mean**2, 1e-12)) + 1e-6
    model = Model(mean, deviation, np.zeros(N_FOURIER + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    d = N_FOURIER + 1

    def normal(batches):
        a = np.zeros((d, d + 1))
        for batch in batches:
            z = model.z(_matrix(batch))
            a += z.T @ np.column_stack([z, batch.column("y").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_pydict({"v": [a.tobytes()]})

    a = sum(_arrays(fitting.mapInArrow(normal, "v binary")), np.zeros(d * (d + 1))).reshape(d, d + 1)
    penalty = RIDGE * n * np.eye(d)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(a[:, :d] + penalty, a[:, d])

    def binned(batches):
        out = np.zeros((N_BINS, 3))
        for batch in batches:
            raw, y = model.raw(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)
            k = np.clip(((raw - _LOW) / (_HIGH - _LOW) * N_BINS).astype(int), 0, N_BINS - 1)
            for j, v in enumerate((np.ones(len(y)), y, raw)):
                out[:, j] += np.bincount(k, v, N_BINS)
        yield pa.RecordBatch.from_pydict({"v": [out.tobytes()]})

    source = calibrating if calibrating.take(1) else fitting
    count, ones, raw = sum(_arrays(source.mapInArrow(binned, "v binary")), np.zeros(3 * N_BINS)).reshape(N_BINS, 3).T
    full = count > 0
    at, value = isotonic(raw[full] / count[full], ones[full] / count[full], count[full])
    model.knots, model.values = np.concatenate([[at[0] - 1], at, [at[-1] + 1]]), np.concatenate([[value[0] * 0.5], value, [(1 + value[-1]) / 2]])
    return model


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    measured = materialise(texts(docs).mapInArrow(_extract, "doc_id long, x array<double>"))
    model = fit(measured, labels)

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], names=["doc_id", "score"])

    scored = measured.mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(bucket(F.col("doc_id"), HOLD_OUT) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold; each judged where it lies."""
    model = fit(materialise(texts(docs).mapInArrow(_extract, "doc_id long, x array<double>")), labels)
    at_text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = np.array([features(t or "") for t in part.column(at_text).to_pylist()], float)
                yield part.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
