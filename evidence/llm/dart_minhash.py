"""Near-duplicate classes by DartMinHash.

A text is the bag of its 5-word shingles (a text of 1 to 4 words has one, all its words); a shingle's weight is how
often the text has it, and the similarity of two texts is their weighted Jaccard similarity, the sum of the lesser
weights over the sum of the greater. The sketch throws darts: a Poisson process over (shingle, weight, time), drawn by
hash, so that the same shingle meets the same darts in every text. A dart counts if it lands below the shingle's weight;
it names one of K coordinates; each coordinate keeps its earliest dart. Two texts agree on a coordinate with a
probability equal to their similarity. Time is walked in cells that double, and only until every coordinate of the text
has a dart, so the work is about K ln K darts however long the text is. BANDS x ROWS coordinates make band keys; at
similarity 0.8 a pair shares no band with a probability of 5e-6.

Classes, without all pairs of a group:
1. Rows with equal bags are one node, numbered by the least of its rows' numbers.
2. In each bucket (band key) the least node is its pivot. Every node is verified exactly against the least of its
   pivots; connected components of what holds are the first classes.
3. A bucket is settled if all its nodes are in one class. In the others nodes are verified against other pivots,
   PIVOTS times, which joins what a large group with an unlucky first pivot fell into; the first time against the node
   that meets most others, about which such a group lies. In what is still open every node outside the bucket's commonest
   class is compared with every node in another class. Where that is many pairs, first by short marks of the bags, which
   differ in no more places than the bags do: only nodes that may have a link by them go on, in blocks of bags that return
   only as many links as join their classes. So each pair that shares a bucket is in one class, or has been verified or
   ruled out: no candidate link is lost, and the bulk of a large group is never paired with itself.
4. Components of all verified links are the classes. A class is named by its least doc_id.

Defined cases: null, empty and blank texts have no shingles; each such row is a class of its own. Every row has a class
by its text, also where rows repeat a doc_id or have none: rows that repeat a doc_id with unlike texts are in different
classes. A class without any doc_id has a null class_id. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import BROADCAST_ROWS, batch_of, materialise, rows, small, texts, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
K = BANDS * ROWS
#: Rounds of other pivots.
PIVOTS = 2
#: Blocks in which large buckets with several classes are compared.
FEW_PAIRS, X_BLOCK, Y_BLOCK = 64, 128, 512
#: 64-bit words of a bag's marks, and how many outsiders' marks a task compares with a bucket.
MARKS, X_MARKS = 16, 2048

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
#: Odd multipliers for the words of a shingle, from the golden ratio.
_MULT = [_U((0x9E3779B97F4A7C15 * (2 * i + 1) + 2 * i) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(SHINGLE)]
#: Time cells: [0, 2**_FIRST), then doubling.
_FIRST, _LAST = -6, 14


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits: every input bit moves every output bit."""
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def _poisson_cdf(mean: float) -> np.ndarray:
    n = np.arange(int(mean + 12 * mean**0.5 + 30))
    log = -mean + n * np.log(mean) - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.minimum(np.cumsum(np.exp(log)), 1.0)


_CDF: dict[float, np.ndarray] = {}


class WordHashes(dict):
    """64-bit hashes of words, remembered for as many as LIMIT."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_HASHES = WordHashes()


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the text's shingles, and how often it has each."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))
    size = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - size + 1, _U(size))
        for i in range(size):
            total = mix(total * _MULT[i] + h[i : len(h) - size + 1 + i])
    return np.unique(total, return_counts=True)


def occurrences(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bag as a sorted set: the first, second and further occurrences of an element. Plain Jaccard similarity of
    such sets is weighted similarity of the bags."""
    if len(elements) == int(weights.sum()):
        return elements
    first = np.cumsum(weights) - weights
    nth = np.arange(int(weights.sum())) - np.repeat(first, weights)
    each = np.repeat(elements, weights)
    with np.errstate(over="ignore"):
        return np.sort(np.where(nth == 0, each, mix(each + nth.astype(np.uint64) * _MULT[1])))


def sketch(elements: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures, n x K, of n weighted sets; owner says whose each element is. Every set needs an element of weight over 0."""
    best = np.full(n * K, np.inf)
    signature = np.zeros(n * K, np.uint64)
    active = np.ones(n, bool)
    weights = None if weights is None or weights.max() == weights.min() == 1 else weights
    top = 1.0 if weights is None else float(weights.max())
    with np.errstate(over="ignore"):
        for j in range(_FIRST, _LAST + 1):
            on = active[owner]
            es, ow = elements[on], owner[on]
            ws = None if weights is None else weights[on]
            low, width = (0.0, 2.0**j) if j == _FIRST else (2.0 ** (j - 1), 2.0 ** (j - 1))
            floor, high, level = 0.0, 1.0, 0
            while floor < top:
                mean = width * (high - floor)
                if mean not in _CDF:
                    _CDF[mean] = _poisson_cdf(mean)
                e, o, w = (es, ow, None) if ws is None else (es[ws > floor], ow[ws > floor], ws[ws > floor])
                salt = _U((j - _FIRST + 1) * 1000 + level)
                count = np.searchsorted(_CDF[mean], unit(mix(e ^ mix(salt * _GOLD))), side="right")
                hit = np.flatnonzero(count)
                count = count[hit]
                first = np.cumsum(count) - count
                index = (np.arange(int(count.sum())) - np.repeat(first, count)).astype(np.uint64)
                dart = mix(mix(np.repeat(e[hit], count) + salt) + index * _GOLD)
                who = np.repeat(o[hit], count)
                if w is not None:
                    below = floor + (high - floor) * unit(mix(dart ^ _U(2))) < np.repeat(w[hit], count)
                    dart, who = dart[below], who[below]
                slot = who.astype(np.int64) * K + (dart % _U(K)).astype(np.int64)
                time = low + width * unit(mix(dart ^ _U(1)))
                earlier = time < best[slot]
                slot, time, dart = slot[earlier], time[earlier], dart[earlier]
                np.minimum.at(best, slot, time)
                won = time == best[slot]
                signature[slot[won]] = dart[won]
                floor, high, level = high, high * 2, level + 1
            active &= ~np.isfinite(best).reshape(n, K).all(1)
            if not active.any():
                break
    return signature.reshape(n, K)


def bands(signature: np.ndarray) -> np.ndarray:
    """Keys, n x BANDS; those of different bands differ."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(BANDS, dtype=np.uint64) * _GOLD, (len(signature), 1))
        for i in range(ROWS):
            key = mix(key * _MULT[0] + parts[:, :, i])
    return key.view(np.int64)


_SKETCHED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("set_key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
#: Nodes with more rows than this, or than their share of all rows, are joined by broadcast: no more than BROADCAST_ROWS.
HOT = 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes of both: rows that agree in them are the same row twice."""
    return texts(docs).withColumns({"k1": F.xxhash64("doc_id", "text", F.lit(7)), "k2": F.xxhash64("text", "doc_id", F.lit(11))})


def _sketch_rows(batches):
    row = TaskContext.get().partitionId() << 33
    for part in rows(batches):
        bags = [shingles(text) for _, text, _, _ in part]
        full = [i for i, (s, _) in enumerate(bags) if len(s)]
        keys: dict[int, list] = {}
        if full:
            owner = np.repeat(np.arange(len(full)), [len(bags[i][0]) for i in full])
            signed = sketch(np.concatenate([bags[i][0] for i in full]), owner, len(full), np.concatenate([bags[i][1] for i in full]))
            keys = dict(zip(full, bands(signed).tolist(), strict=True))
        out = []
        for i, ((doc_id, _, k1, k2), (s, w)) in enumerate(zip(part, bags, strict=True)):
            own = xxhash.xxh3_128_digest(s.tobytes() + w.tobytes()) if len(s) else None
            out.append((row, doc_id, k1, k2, own, int(w.sum()), keys.get(i, [])))
            row += 1
        yield batch_of(out, _SKETCHED)


def _set_rows(batches):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for part in rows(batches):
        yield batch_of([(i, occurrences(*shingles(text)).view(np.int64).tolist()) for i, text in part], schema)


def _mark_rows(batches):
    names = [f"m{k}" for k in range(MARKS)]
    schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), *((m, pa.int64()) for m in names)])
    for part in rows(batches):
        out = []
        for i, own in part:
            slot = (np.array(own, np.int64).view(np.uint64) % _U(64 * MARKS)).astype(np.int64)
            odd = np.packbits(np.bincount(slot, minlength=64 * MARKS).astype(np.uint8) & 1).view(np.int64)
            out.append((i, len(own), *odd.tolist()))
        yield batch_of(out, schema)


def marked(sets: DataFrame) -> DataFrame:
    """id, size and marks of sets: bits that say whether an odd number of the elements fall on them. What two sets share
    cancels out, so their marks differ in no more bits than the sets do in elements, and in fewer only where elements of
    the difference meet."""
    return sets.select("id", "shingles").mapInArrow(_mark_rows, ", ".join(["id long", "size int", *(f"m{k} long" for k in range(MARKS))]))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that Jaccard similarity."""
    of = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    least, most = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    shared = F.when(least >= most * F.lit(similarity), F.size(F.array_intersect("sa", "sb"))).otherwise(0)
    return both.select("a", "b", shared.alias("i"), (least + most).alias("t")).where(F.col("i") / (F.col("t") - F.col("i")) >= similarity).select("a", "b")


def rooted(links: DataFrame) -> DataFrame:
    """id, class_id, as components() has them, of links (a, b) in which a < b and each b has one a: trees, so that only
    labels jump, and only those that are not yet their root's. A round halves what is left of the paths."""
    labels = links.select(F.col("b").alias("id"), F.col("a").alias("class_id"))
    above, done, left = labels, [], labels
    while True:
        up = above.select(F.col("id").alias("class_id"), F.col("class_id").alias("next"))
        jumped = materialise(left.join(up, "class_id", "left").select("id", F.coalesce("next", "class_id").alias("class_id"), F.col("next").isNull().alias("root")))
        done.append(jumped.where("root").select("id", "class_id"))
        left = jumped.where("not root").select("id", "class_id")
        above = reduce(DataFrame.union, done, left)
        if not left.take(1):
            heads = above.select("class_id").distinct()
            return materialise(above.union(heads.select(F.col("class_id").alias("id"), "class_id")))


def components(edges: DataFrame) -> DataFrame:
    """id, class_id: of every end of an edge, the least id of its component.

    A round hangs each id under its least neighbour, which makes trees, and goes on with the edges between their roots. So
    an edge is read again only while its ends are in different trees; two rounds at least halve what roots are left.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = materialise(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("class_id")))
    while left.take(1):
        nearest = left.union(left.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")).where("up < id")
        trees = rooted(nearest.select(F.col("up").alias("a"), F.col("id").alias("b")))
        root = lambda x: trees.select(F.col("id").alias(x), F.col("class_id").alias(f"r{x}"))  # noqa: B023, E731
        ends = left.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        left = materialise(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        up = trees.select(F.col("id").alias("class_id"), F.col("class_id").alias("next"))
        labels = materialise(labels.join(up, "class_id", "left").select("id", F.coalesce("next", "class_id").alias("class_id")))
    return labels


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (id, class_id) after further links (a, b). What those join is found among classes, of which they touch few."""
    of = lambda x: classes.select(F.col("id").alias(x), F.col("class_id").alias(f"c{x}"))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = materialise(both)
    joined = components(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    fresh = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct().join(classes.select("id"), "id", "left_anti")
    known = classes.select("id", "class_id").union(fresh.select("id", F.col("id").alias("class_id")))
    moved = joined.select(F.col("id").alias("class_id"), F.col("class_id").alias("next"))
    return materialise(known.join(moved, "class_id", "left").select("id", F.coalesce("next", "class_id").alias("class_id")))


def _block(similarity: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of outsiders and members of a bucket, links that join their classes: fewer than there are classes."""
        out: list[tuple[int, int]] = []
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := joined.get(c, c)) != c:
                joined[c] = c = joined.get(up, up)
            return c

        left, right = rows[rows["outsider"]], rows[~rows["outsider"]]
        if len(left) and len(right):
            sizes = np.array([len(s) for s in right["shingles"]])
            flat = np.concatenate(right["shingles"].to_list())
            order = np.argsort(flat, kind="stable")
            flat, member = flat[order], np.repeat(np.arange(len(right)), sizes)[order]
            ids, classes = right["id"].to_numpy(), right["c"].to_numpy()
            for x, c, own in zip(left["id"].tolist(), left["c"].tolist(), left["shingles"], strict=True):
                low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                shared = np.bincount(member[at], minlength=len(right))
                near = np.flatnonzero((shared / (sizes + len(own) - shared) >= similarity) & (classes != c))
                near = near[np.unique(classes[near], return_index=True)[1]]
                for y, other in zip(ids[near].tolist(), classes[near].tolist(), strict=True):
                    if root(other) != root(c):
                        joined[root(other)] = root(c)
                        out.append((min(x, y), max(x, y)))
        return pd.DataFrame({"a": [a for a, _ in out], "b": [b for _, b in out]}, dtype="int64")

    return run


def placed(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """band, id, c (the class) and, where it is known, degree of the buckets that hold several classes."""
    more = [x for x in buckets.columns if x == "degree"]
    known = buckets.select("band", "id", *more).join(classes, "id", "left").select("band", "id", F.coalesce("class_id", "id").alias("c"), *more)
    several = known.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band")
    return materialise(known.join(several, "band"))


def degrees(open_: DataFrame) -> DataFrame:
    """open_ with degree, how many nodes a node meets in its buckets."""
    sizes = open_.groupBy("band").agg(F.count("*").alias("n"))
    degree = open_.join(sizes, "band").groupBy("id").agg(F.sum("n").alias("degree"))
    return materialise(open_.join(degree, "id"))


def by_pivots(open_: DataFrame, sets: DataFrame, similarity: float, seed: int) -> DataFrame:
    """Links of each node to one pivot of another class; pivots are a bucket's first by degree, with other seeds by a hash."""
    order = F.struct((-F.col("degree") if seed == 0 else F.lit(0)).alias("low"), F.xxhash64("id", F.lit(seed)).alias("h"), "id", "c")
    pivots = open_.groupBy("band").agg(F.min(order).alias("p"))
    pairs = open_.join(pivots, "band").where("c <> p.c").groupBy("id").agg(F.min("p").alias("p"))
    return materialise(verified(pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct(), sets, similarity))


def sized(open_: DataFrame) -> DataFrame:
    """band, id, c with pc, the bucket's commonest class, nx, how many of its nodes are outside that, and ny, all of them."""
    sizes = open_.groupBy("band", "c").count().groupBy("band").agg(F.max(F.struct("count", "c")).alias("most"), F.sum("count").alias("ny"))
    return materialise(open_.select("band", "id", "c").join(sizes.select("band", F.col("most.c").alias("pc"), (F.col("ny") - F.col("most.count")).alias("nx"), "ny"), "band"))


def near_others(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """band, id, c of the nodes whose marks allow a link between an outsider of the bucket and another class. open_: as
    sized() has it. A node is one row, however many it is near; a task compares about X_MARKS outsiders with a bucket."""
    full = materialise(open_.join(marked(sets.join(open_.select("id").distinct(), "id", "left_semi")), "id"))
    parts = F.greatest(F.ceil(F.col("nx") / F.lit(X_MARKS)).cast("int"), F.lit(1))
    own, every = F.pmod(F.xxhash64("id", F.lit(19)), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    names = ["id", "c", "size", *(f"m{k}" for k in range(MARKS))]
    side = lambda df, x, part: df.select("band", part.alias("part"), *(F.col(n).alias(f"{x}{n}") for n in names))
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"xm{k}").bitwiseXOR(F.col(f"ym{k}"))) for k in range(MARKS)))
    most = (F.col("xsize") + F.col("ysize")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    near = (F.col("xc") != F.col("yc")) & (differ <= most)
    outside, every_node = side(full.where("c <> pc"), "x", own), side(full, "y", every)
    on = lambda a, b: (a["band"] == b["band"]) & (a["part"] == b["part"]) & near
    x = materialise(outside.join(every_node, on(outside, every_node), "left_semi"))
    y = every_node.join(x, on(every_node, x), "left_semi")
    return x.select("band", F.col("xid").alias("id"), F.col("xc").alias("c")).union(y.select("band", "yid", "yc")).distinct()


def settled(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between classes in buckets that hold several. open_: band, id, c.

    The outsiders of a bucket are the nodes outside its commonest class. A bucket with few pairs of an outsider and a
    member (FEW_PAIRS) is joined with itself. Of a larger one the nodes stay whose marks allow a link; if they are many,
    they are compared in blocks: a task has at most about X_BLOCK outsiders and Y_BLOCK members, and returns no more links
    than join their classes.
    """
    open_ = sized(open_)
    few = F.col("nx") * F.col("ny") <= FEW_PAIRS
    if open_.where(~few).take(1):
        open_ = materialise(open_.where(few).unionByName(sized(near_others(open_.where(~few), sets, similarity))))
    outside = open_.where(few & (F.col("c") != F.col("pc"))).select("band", F.col("id").alias("x"), F.col("c").alias("cx"))
    inside = open_.where(few).select("band", F.col("id").alias("y"), F.col("c").alias("cy"))
    pairs = outside.join(inside, "band").where("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    parts = lambda n, size: F.ceil(F.col(n) / F.lit(size)).cast("int")
    own = lambda n, size: F.pmod(F.xxhash64("id", F.lit(13)), parts(n, size)).cast("int")
    every = lambda n, size: F.explode(F.sequence(F.lit(0), parts(n, size) - 1))
    x = open_.where(~few & (F.col("c") != F.col("pc"))).select("band", own("nx", X_BLOCK).alias("i"), "id", "c", every("ny", Y_BLOCK).alias("j"))
    y = open_.where(~few).select("band", own("ny", Y_BLOCK).alias("j"), "id", "c", every("nx", X_BLOCK).alias("i"))
    dealt = x.withColumn("outsider", F.lit(True)).unionByName(y.withColumn("outsider", F.lit(False))).join(sets, "id")
    links = dealt.groupBy("band", "i", "j").applyInPandas(_block(similarity), "a long, b long")
    return verified(pairs, sets, similarity).union(links).distinct()


def classed(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row: doc_id, k1, k2 (as keyed() has them), class_id, n_shingles, stays, copies.

    stays says whether the row is the one of its class that stays where one does, by the least doc_id, then k1 and k2;
    copies, how many rows have the same bag.
    """
    sketched = materialise(keyed(docs).select("doc_id", "text", "k1", "k2").mapInArrow(_sketch_rows, "row long, doc_id long, k1 long, k2 long, set_key binary, n long, bands array<long>"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("least")
    first = F.min(F.struct("row", "k1", "k2")).alias("first")
    nodes = materialise(sketched.where("n > 0").groupBy("set_key").agg(first, least, F.count("*").alias("copies")).select("set_key", F.col("first.row").alias("id"), F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), "least", "copies"))
    dealt = sketched.where("n > 0").join(nodes.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), F.explode("bands").alias("band"))
    pivots = dealt.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("band", "pivot")
    buckets = materialise(dealt.join(pivots, "band"))

    members = materialise(nodes.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "k1", "k2"))
    chosen = keyed(docs).select("k1", "k2", "text").join(small(members, members.count()), ["k1", "k2"]).select("id", "text").dropDuplicates(["id"])
    sets = materialise(chosen.mapInArrow(_set_rows, "id long, shingles array<long>"))

    to_pivot = buckets.where("id <> pivot").groupBy(F.col("id").alias("b")).agg(F.min("pivot").alias("a"))
    links = materialise(verified(to_pivot.select("a", "b"), sets, similarity))
    classes = rooted(links)
    open_ = placed(buckets, classes)
    for seed in range(PIVOTS):
        if not open_.take(1):
            break
        open_ = open_ if "degree" in open_.columns else degrees(open_)
        classes = merged(classes, by_pivots(open_, sets, similarity, seed))
        open_ = placed(open_, classes)
    more = materialise(settled(open_, sets, similarity))
    if more.take(1):
        classes = merged(classes, more)

    linked = classes.join(nodes.select("id", "least"), "id")
    heads = linked.groupBy("class_id").agg(F.min("least").alias("head"))
    linked = materialise(linked.select("id", "class_id").join(heads, "class_id").select("id", "head"))
    named = materialise(nodes.join(linked, "id", "left").select("set_key", F.coalesce("head", "least").alias("head"), "copies"))
    hot = max(HOT, sketched.count() // BROADCAST_ROWS)
    full = sketched.where("n > 0").select("doc_id", "k1", "k2", "n", "set_key")
    known = (F.col("k1") == F.col("head.k1")) & (F.col("k2") == F.col("head.k2"))
    shown = ["doc_id", "k1", "k2", F.col("head.doc_id").alias("class_id"), "n", known.alias("stays"), "copies"]
    hottest = named.where(F.col("copies") > hot)
    if hottest.take(1):
        # A row joins the hot nodes or the others, so that no task gets a whole hot group.
        cold = full.join(F.broadcast(hottest.select("set_key")), "set_key", "left_anti").join(named.where(F.col("copies") <= hot), "set_key")
        out = full.join(F.broadcast(hottest), "set_key").select(*shown).union(cold.select(*shown))
    else:
        out = full.join(named, "set_key").select(*shown)
    blank = sketched.where("n = 0").select("doc_id", "k1", "k2", F.col("doc_id").alias("class_id"), "n", F.lit(True).alias("stays"), F.lit(1).cast("long").alias("copies"))
    return out.union(blank).withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row: doc_id, class_id (the least doc_id of its class), n_shingles."""
    return classed(docs, similarity).select("doc_id", "class_id", "n_shingles")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the least doc_id. Rows without shingles all stay."""
    found = materialise(classed(docs, similarity))
    removed = materialise(found.where("not stays").select("k1", "k2").distinct())
    again = materialise(found.where("stays and copies > 1").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"))
    own = {"__k1": F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(7)), "__k2": F.xxhash64(F.coalesce("text", F.lit("")), "doc_id", F.lit(11))}
    on = lambda keys: small(keys.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), keys.count())
    rest = docs.withColumns(own).join(on(removed), ["__k1", "__k2"], "left_anti")
    if again.take(1):
        # The same row twice: one of it stays.
        once = rest.join(on(again), ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
        rest = rest.join(on(again), ["__k1", "__k2"], "left_anti").unionByName(once)
    return rest.select(*docs.columns)
