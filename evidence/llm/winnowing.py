"""Document fingerprints by winnowing, in SQL functions alone.

A gram is every run of GRAM bytes of the text's UTF-8; of the hashes in every window of WINDOW neighbouring grams the least
is chosen, the rightmost of equal ones, and kept with its position. So two texts that share a run of GRAM + WINDOW - 1 bytes
share a hash, and each of them has it inside that run. A text of fewer grams than a window has one window with all of
them; a text shorter than a gram is one gram; an empty text has none. Bytes, because cutting a gram out of code points
takes time by its distance from the start.

A text is read in pieces of SPAN windows that overlap by a window and a gram, so the work grows with its length. One fold
over a piece's hashes keeps the least of the window so far, passes over groups of grams that can't change it, and looks at
a whole window again only when the least leaves it. The last window of a piece is the first of the next one, which doesn't
repeat what that window chose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence.llm.common import materialise

GRAM, WINDOW, SPAN = 16, 48, 192
#: Bits of a hash, and of a position within a piece; both share a long.
HASH, PLACE = 31, 9
#: Grams that are looked at together.
GROUP = 8
_LAST = (1 << PLACE) - 1
#: Bytes that a piece reads: its windows, the next one's first, and the rest of the last gram.
READ = SPAN + WINDOW + GRAM - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: inside a lambda a plain expression is worked out at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chosen(piece: Column, starts: Column) -> Column:
    """What the windows of a piece choose, as (hash, place from the end) in longs, in order of place.

    starts: whether the piece begins the text; else its first window belongs to the piece before.
    """
    n_grams = F.greatest(F.octet_length(piece) - (GRAM - 1), F.lit(1))
    hashed = lambda i: F.xxhash64(F.substring(piece, i, F.lit(GRAM))).bitwiseAND(((1 << HASH) - 1) << PLACE)
    grams = F.transform(F.sequence(F.lit(1), n_grams), lambda i: hashed(i) + (F.lit(_LAST + 1) - i))

    def winnowed(h: Column) -> Column:
        place = lambda v: v.bitwiseAND(_LAST)
        state = lambda least, out: F.struct(least.alias("least"), out.alias("out"))
        taken = lambda s, v: state(v, F.concat(s["out"], F.array(v)))
        window = lambda x: F.slice(h, (F.lit(_LAST) - place(x)).cast("int") - (WINDOW - 2), F.lit(WINDOW))
        # Equal hashes: the later gram is the smaller long.
        step = lambda s, x: (
            F.when(x < s["least"], taken(s, x)).when(place(s["least"]) - place(x) >= WINDOW, _let(F.array_min(window(x)), lambda v: taken(s, v))).otherwise(s)
        )
        # Grams are passed over by groups in which none is smaller and the least so far doesn't leave the window.
        stays = lambda s, g: place(s["least"]) < _LAST - g * GROUP - (GROUP - 1)
        grouped = lambda s, g, own: F.when(stays(s, g) & (F.array_min(own) > s["least"]), s).otherwise(F.aggregate(own, s, step))
        first = F.array_min(F.slice(h, 1, WINDOW))
        zero = _let(first, lambda v: state(v, F.when(starts, F.array(v)).otherwise(F.array().cast("array<bigint>"))))
        groups = F.when(F.size(h) > WINDOW, F.sequence(F.lit(0), F.floor((F.size(h) - WINDOW - 1) / GROUP).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(groups, zero, lambda s, g: _let(F.slice(h, g * GROUP + (WINDOW + 1), F.lit(GROUP)), lambda own: grouped(s, g, own)), lambda s: s["out"])

    return _let(grams, winnowed)


def by_piece(data: Column, skipped: Column | None = None) -> Column:
    """The fingerprint of bytes, by piece: array<array<struct<hash int, pos int>>>; pos counts bytes from 0.

    skipped: how many pieces of the text come before these bytes.
    """
    before = F.lit(0) if skipped is None else skipped
    windows = F.greatest(F.octet_length(data) - (GRAM + WINDOW - 2), F.lit(1))
    numbers = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.floor((windows - 1) / SPAN).cast("int"))).otherwise(F.array().cast("array<int>"))
    point = lambda v, j: F.struct(F.shiftright(v, PLACE).cast("int").alias("hash"), ((before + j) * SPAN + _LAST - v.bitwiseAND(_LAST)).cast("int").alias("pos"))
    return F.transform(numbers, lambda j: F.transform(_let(F.substring(data, j * SPAN + 1, F.lit(READ)), lambda piece: _chosen(piece, before + j == 0)), lambda v: point(v, j)))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that isn't null: array<struct<hash int, pos int>> in order of pos."""
    return F.flatten(by_piece(text.cast("binary")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes as sets; 1 where both are empty."""
    ratio = lambda shared, both: F.when(both == 0, 1.0).otherwise(shared / (both - shared))
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return _let(F.struct(F.size(F.array_intersect(a, b)).alias("shared"), both.alias("both")), lambda n: ratio(n["shared"], n["both"]))


def shown(points: Column) -> Column:
    """A fingerprint as text: hash in hexadecimal and position of each point."""
    return F.array_join(F.transform(points, lambda p: F.concat(F.lower(F.hex(p["hash"])), F.lit(":"), p["pos"].cast("string"))), " ")


def _next(keys: DataFrame) -> DataFrame:
    """For each distinct document (known, id, h) the one after it in that order: q, copies, n_id, n_h. After the last comes the first.

    Ranges of keys are ordered by themselves; the last of a range is followed by the first of the next range. No texts here.
    """
    ranged = materialise(keys.repartitionByRange("known", "id", "h").withColumn("range", F.spark_partition_id()))
    key = F.struct("known", "id", "h")
    # One row for each range, that is for each partition: bounded by the number of partitions.
    starts = ranged.groupBy("range").agg(F.min(key).alias("start"))
    every = Window.orderBy("range")
    after = starts.select("range", F.coalesce(F.lead("start").over(every), F.first("start").over(every)).alias("following"))
    own = F.lead(key).over(Window.partitionBy("range").orderBy("known", "id", "h"))
    chained = ranged.withColumn("own", own).join(F.broadcast(after), "range").withColumn("n", F.coalesce("own", "following"))
    return chained.select("id", "h", "q", "copies", F.col("n.id").alias("n_id"), F.col("n.h").alias("n_h"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, and the text whose last quarter is replaced by the beginning of the next document.

    docs: doc_id, text (null: empty); other columns are left alone. Documents are in order of doc_id, nulls first; those of
    one doc_id in order of a hash of the text; after the last comes the first, so that a single document follows itself.
    Rows that are equal in both are followed by each other, the last of them by the next document. Every row has its result:
    doc_id, n_chars, edited_sha256, points, edited_points (arrays of hash and pos), near_edited, near_next.

    Texts are shuffled once, with their fingerprints, and their beginnings once more, to the document before. Copies of one
    row become one before the shuffle, so none of its keys is hot.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.col("doc_id").isNull(), text).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")
    )
    keys = keyed.groupBy("known", "id", "h").agg(F.floor(F.max(F.char_length("text")) / 4).cast("int").alias("q"), F.count("*").alias("copies"))
    chain = _next(keys)
    pieces = by_piece(F.col("text").cast("binary"))
    marked = keyed.withColumn("pieces", pieces)
    flat = lambda field: F.transform(F.flatten("pieces"), lambda p: p[field])
    counts = F.transform("pieces", lambda p: F.size(p))
    packed = marked.select("id", "h", F.struct("doc_id", "text", flat("hash").alias("hashes"), flat("pos").alias("places"), counts.alias("counts")).alias("doc"))
    # One row for each distinct document; both reads below are of the same shuffle, as both take the whole struct.
    whole = packed.groupBy("id", "h").agg(F.first("doc").alias("doc"))
    wanted = chain.select(F.col("n_id").alias("id"), F.col("n_h").alias("h"), F.col("id").alias("to_id"), F.col("h").alias("to_h"), "q", "copies")
    sent = whole.join(wanted, ["id", "h"]).select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), "q", "copies", F.expr("substring(doc.text, 1, q)").alias("begin"), F.col("doc.hashes").alias("n_hashes"))
    both = whole.join(sent, ["id", "h"])
    case = lambda begin, hashes, times: F.struct(begin.alias("begin"), hashes.alias("n_hashes"), times.alias("times"))
    cases = F.array(case(F.col("begin"), F.col("n_hashes"), F.lit(1).cast("long")), case(F.expr("substring(doc.text, 1, q)"), F.col("doc.hashes"), F.col("copies") - 1))
    rows = both.select("doc.*", "q", F.explode(F.filter(cases, lambda c: c["times"] > 0)).alias("case"))
    return _edited(rows)


def _edited(rows: DataFrame) -> DataFrame:
    """rows: doc_id, text, hashes, places, counts (points of each piece), q, case (begin, n_hashes, times)."""
    n = F.char_length("text")
    kept = rows.withColumn("n", n).withColumn("left", F.expr("substring(text, 1, n - q)")).withColumn("edited", F.concat("left", "case.begin"))
    # Pieces that read nothing but what is kept choose what they chose before.
    same = F.greatest(F.lit(0), F.floor((F.octet_length("left") - READ) / SPAN) + 1).cast("int")
    kept = kept.withColumn("same", same).withColumn("points", F.arrays_zip(F.col("hashes").alias("hash"), F.col("places").alias("pos")))
    held = F.aggregate(F.slice("counts", 1, F.col("same")), F.lit(0), lambda s, x: s + x)
    fresh = F.flatten(by_piece(F.expr(f"substring(cast(edited AS binary), same * {SPAN} + 1)"), F.col("same")))
    kept = kept.withColumn("edited_points", F.concat(F.slice("points", F.lit(1), held), fresh))
    out = kept.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "points", "edited_points",
        likeness(F.col("hashes"), F.col("edited_points.hash")).alias("near_edited"), likeness(F.col("hashes"), F.col("case.n_hashes")).alias("near_next"),
        F.col("case.times").alias("times"),
    )
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
