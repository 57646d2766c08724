"""URL filters: rules first, then naive Bayes over the words that Viterbi finds in host and path.

1. Host and path are cut from the url by SQL functions; the longest rule that fits decides.
2. Unigram counts of words come from the visible text of all pages, combined a partition before the shuffle. The
   counts of all words stay a table; workers hold the VOCABULARY commonest, SEEDS, and all of at most SHORT letters.
3. A run of letters in a host or path is cut into words by Viterbi: the split of highest unigram probability, where an
   unknown run costs the more the longer it is (10 / (N * 10^length); one of more than LONGEST letters is several). Each
   distinct run is cut once; the pieces of it that workers don't hold are joined with the table of counts. Words of more
   than LONGEST letters are words like any other: they are found by their first LONGEST letters. Long runs are taken apart
   in slices.
4. Multinomial naive Bayes with add-one smoothing learns from all pages that a rule decides, and from SEEDS, words of
   unwanted sites with pseudo-counts in both classes: SEED_ODDS in a table of any size, plus what ruled hosts say. Words
   that the rules themselves name are left out: the rules speak for those; so are words under WORD letters, which are
   codes rather than words ("es", "m"): what a rule says of a directory of a language says nothing of other sites. A url without a rule is blocked if its log odds exceed THRESHOLD, with even priors,
   so a url with no telling word is allowed.
5. Workers hold the words of the RUNS commonest runs and the odds of the TOKENS commonest tokens. All others are written
   out beside the pages and joined with the tables of runs and odds.

Defined cases: a null url, or one without "://", has empty host and path, no rule, and is allowed. Repeated rows are
judged alike; rows without page_id too. Null html adds no words. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import batch_of, commonest, materialise, on_workers, rows

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Words of host names that url blocklists are about.
SEEDS = "ads adult bet bets casino cheap dating escort farm free loans lottery malware phishing pills poker porn prizes scam sex spam track tracker viagra warez win xxx".split()
SEED_COUNT, SEED_SHARE, THRESHOLD = 10, 0.01, 4.0
#: Log odds of a seed that no ruled host has, in a table of any size.
SEED_ODDS = 5.0
VOCABULARY, RUNS, TOKENS, LONGEST, SHORT, WORD = 50_000, 100_000, 100_000, 24, 3, 3
#: Letters of a run whose pieces are listed at once; a longer run than KEY goes by a digest where it is joined.
SLICE, KEY = 2000, 64

#: An unclosed script goes to the end, and a "<" that no ">" follows before the next "<" is no tag, so a page is read once.
_TAG = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^<>]*>", re.S | re.I)
_LETTERS = re.compile(r"[a-z]+")
_PART = re.compile(r"[a-z]+|[0-9]+")


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, ruling: that of the longest rule that fits."""
    got = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = ruling = None
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        ruling = F.when(fits, verdict) if ruling is None else ruling.when(fits, verdict)
    return got.select("*", rule.alias("rule"), ruling.alias("ruling"))


def _counted(batches, words_of, schema, limit=200_000):
    """Counts of keys over a partition, flushed whenever there are too many to hold."""
    held: Counter = Counter()

    def flush():
        out = batch_of([(*k, n) for k, n in held.items()], schema)
        held.clear()
        return out

    for part in rows(batches):
        for row in part:
            held.update(words_of(row))
        if len(held) > limit:
            yield flush()
    yield flush()


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n of the pages' visible text."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        return _counted(batches, lambda row: ((w,) for w in _LETTERS.findall(_TAG.sub(" ", row[0] or "").lower())), schema)

    return materialise(pages.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def unigrams(counts: DataFrame) -> dict[str, int]:
    """The words that workers hold, and "" for the count of all."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = counts.where((F.length("word") <= SHORT) | F.col("word").isin(SEEDS)).collect()
    return with_seeds({r["word"]: r["n"] for r in own} | dict(commonest(counts, VOCABULARY, "word")) | {"": total})


def with_seeds(counts: dict[str, int]) -> dict[str, int]:
    """The seeds are words too: each counts as at least one in a hundred thousand."""
    least = max(1, counts.get("", 0) // 100_000)
    return counts | {w: max(counts.get(w, 0), least) for w in SEEDS}


class Segmenter(dict):
    """Words of a run of letters, by Viterbi; remembers LIMIT runs."""

    LIMIT = 200_000

    def __init__(self, counts: dict[str, int]):
        super().__init__()
        self.n = n = max(counts.get("", 0), 1)
        self.log = {w: math.log(c / n) for w, c in counts.items() if w}
        self.unknown = [0.0] + [math.log(10 / n) - k * math.log(10) for k in range(1, LONGEST + 1)]
        self.long = self._by_prefix(self.log)

    @staticmethod
    def _by_prefix(logs: dict[str, float]) -> dict[str, list[tuple[str, float]]]:
        """Words of more than LONGEST letters by their first LONGEST."""
        out: dict[str, list[tuple[str, float]]] = {}
        for w, log in logs.items():
            if len(w) > LONGEST:
                out.setdefault(w[:LONGEST], []).append((w, log))
        return out

    def __missing__(self, run: str) -> list[str]:
        out = self.cut(run, {})
        if len(self) >= self.LIMIT:
            self.clear()
        self[run] = out
        return out

    def cut(self, run: str, more: dict[str, int]) -> list[str]:
        """more: the counts of words of the run that aren't held."""
        logs = {w: math.log(c / self.n) for w, c in more.items()}
        ends: dict[int, list[tuple[float, int]]] = {}
        for known in (self.long, self._by_prefix(logs)):
            for s in range(len(run) - LONGEST) if known else ():
                for w, log in known.get(run[s : s + LONGEST], ()):
                    if run.startswith(w, s):
                        ends.setdefault(s + len(w), []).append((log, s))
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            score, start = max((best[s] + self.log.get(w := run[s:end], logs.get(w, self.unknown[end - s])), s) for s in range(max(0, end - LONGEST), end))
            for log, s in ends.get(end, ()):
                score, start = max((score, start), (best[s] + log, s))
            best.append(score)
            back.append(start)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        out.reverse()
        return out

    def lacking(self, run: str) -> Iterator[tuple[str, bool]]:
        """Pieces of a run that may be words but aren't held, and (True) the beginnings of longer ones; a slice tells none twice."""
        for at in range(0, len(run), SLICE):
            starts = range(at, min(at + SLICE, len(run)))
            pieces = {run[s : s + k] for s in starts for k in range(SHORT + 1, min(LONGEST, len(run) - s) + 1)}
            yield from ((w, False) for w in pieces if w not in self.log)
            yield from ((w, True) for w in {run[s : s + LONGEST] for s in starts if s + LONGEST < len(run)})


def parts(host: str, path: str, named: set[str]) -> list[tuple[str, str]]:
    """Runs of letters and numbers (as #) with the mark of where they are, without those that rules name."""
    found = [(mark, part) for mark, text in (("h:", host), ("p:", path.lower())) for part in _PART.findall(text) if part not in named]
    return [(mark, "#" if part[0].isdigit() else part) for mark, part in found]


def telling(words: list[str]) -> list[str]:
    return [w for w in words if len(w) >= WORD]


def tokens(host: str, path: str, segment: dict[str, list[str]], named: set[str]) -> list[str]:
    """Words of the host marked h:, of the path p:, numbers as #; without the words that rules name and short ones."""
    return [mark + w for mark, part in parts(host, path, named) for w in (["#"] if part == "#" else telling(segment[part]))]


def cut_runs(judged: DataFrame, counts: DataFrame, model, named: set[str]) -> DataFrame:
    """run, n, words (the telling ones) of every run of letters in hosts and paths. model: the broadcast words that workers hold."""
    schema = pa.schema([("run", pa.string()), ("n", pa.int64())])

    def find(batches):
        return _counted(batches, lambda r: ((part,) for _, part in parts(r[0], r[1], named) if part != "#"), schema)

    runs = materialise(judged.select("host", "path").mapInArrow(find, "run string, n long").groupBy("run").agg(F.sum("n").alias("n")))

    # A long run isn't repeated for each of its pieces.
    keyed = runs.withColumn("key", F.when(F.length("run") > KEY, F.concat(F.lit("#"), F.md5("run"))).otherwise(F.col("run")))

    def pieces(batches):
        segment, schema, out = Segmenter(model.value), pa.schema([("key", pa.string()), ("piece", pa.string()), ("long", pa.bool_())]), []
        for part in rows(batches):
            for key, run in part:
                for w, long in segment.lacking(run):
                    out.append((key, w, long))
                    if len(out) > 50_000:
                        yield batch_of(out, schema)
                        out = []
        yield batch_of(out, schema)

    def cut(batches):
        segment, schema = Segmenter(model.value), pa.schema([("run", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string()))])
        for part in rows(batches):
            yield batch_of([(run, n, telling(segment.cut(run, {x["word"]: x["c"] for x in more or []}))) for run, n, more in part], schema)

    long = F.length("word") > LONGEST
    words = counts.select("word", F.col("n").alias("c"), F.when(long, F.substring("word", 1, LONGEST)).otherwise(F.col("word")).alias("piece"), long.alias("long"))
    found = keyed.select("key", "run").mapInArrow(pieces, "key string, piece string, long boolean").join(words, ["piece", "long"])
    found = found.groupBy("key").agg(F.collect_set(F.struct("word", "c")).alias("more"))
    return materialise(keyed.join(found, "key", "left").select("run", "n", "more").mapInArrow(cut, "run string, n long, words array<string>"))


def named_by(rules: list[tuple[str, str, str]]) -> set[str]:
    return {w for host, path, _ in rules for w in _PART.findall(f"{host} {path}")}


def sizes_of(counts: dict[tuple[str, str], float]) -> dict[str, tuple[float, float, int]]:
    """For the tokens of hosts and of paths: the counts of block and of allow, and how many tokens there are."""
    total = lambda m, v: sum(c for (t, w), c in counts.items() if w == v and t.startswith(m))
    return {m: (total(m, "block"), total(m, "allow"), len({t for t, _ in counts if t.startswith(m)})) for m in ("h:", "p:")}


def bayes(counts: dict[tuple[str, str], float], sizes: dict[str, tuple[float, float, int]] | None = None) -> dict[str, float]:
    """Log odds of block for each token. Host and path tokens are multinomials of their own; unknown tokens tell nothing.

    sizes: of all counts, if these are a part of them.
    """
    sizes, out = sizes or sizes_of(counts), {}
    for t in {t for t, _ in counts}:
        block, allow, own = sizes[t[:2]]
        share = lambda v, n: math.log((counts.get((t, v), 0) + 1) / (n + own))  # noqa: B023, E731
        out[t] = share("block", block) - share("allow", allow)
    return out


def seed_counts(block: float, allow: float, own: int) -> dict[tuple[str, str], float]:
    """Pseudo-counts of every seed word in both classes, so that a seed that no ruled host has gets SEED_ODDS.

    block, allow: the counts of all host tokens; own: how many there are with SEEDS and "h:". Blocked hosts have a seed in
    SEED_SHARE of their words, at least SEED_COUNT times. What allowed hosts have follows from that, the sizes of both
    classes and the one that bayes() adds; it is below 0 if they are so few that the one is too much. The token "h:" stands
    for any word not seen, so neither class is made of seeds alone.
    """
    seen = max(SEED_COUNT, int(SEED_SHARE * block))
    share = (seen + 1) / (block + len(SEEDS) * seen + own) / math.exp(SEED_ODDS)
    less = share * (allow + own - len(SEEDS)) / (1 - len(SEEDS) * share) - 1
    return {("h:", "allow"): 0} | {(f"h:{w}", v): c for w in SEEDS for v, c in (("block", seen), ("allow", less))}


def seeded(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    block, allow, _ = sizes_of(counts)["h:"]
    own = {t for t, _ in counts if t.startswith("h:")} | {"h:"} | {f"h:{w}" for w in SEEDS}
    out = Counter(counts)
    out.update(seed_counts(block, allow, len(own)))
    return out


def token_odds(seen: DataFrame) -> DataFrame:
    """token, n, odds by bayes() of all seeded counts. seen: token, ruling, n."""
    spark = seen.sparkSession
    of = lambda v: F.sum(F.when(F.col("ruling") == v, F.col("n")).otherwise(0.0)).cast("double").alias(v)
    whole = lambda df: {r[0]: tuple(r)[1:] for r in df.groupBy(F.substring("token", 1, 2)).agg(of("block"), of("allow"), F.countDistinct("token")).collect()}
    seeds = ["h:", *(f"h:{w}" for w in SEEDS)]
    block, allow, own = whole(seen).get("h:", (0.0, 0.0, 0))
    own += len(seeds) - seen.where(F.col("token").isin(seeds)).select("token").distinct().count()
    extra = [(t, v, float(n)) for (t, v), n in seed_counts(block, allow, own).items()]
    every = seen.select("token", "ruling", F.col("n").cast("double").alias("n")).union(spark.createDataFrame(extra, "token string, ruling string, n double"))
    sizes = whole(every)

    def run(batches):
        schema = pa.schema([("token", pa.string()), ("n", pa.int64()), ("odds", pa.float64())])
        for part in rows(batches):
            odds = bayes({(t, v): n for t, b, a in part for v, n in (("block", b), ("allow", a))}, sizes)
            yield batch_of([(t, max(0, math.ceil(b + a)), odds[t]) for t, b, a in part], schema)

    return materialise(every.groupBy("token").agg(of("block"), of("allow")).mapInArrow(run, "token string, n long, odds double"))


_JUDGED = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "ruling")), ("odds", pa.float64()), *((c, pa.string()) for c in ("token", "mark", "run"))])


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, log_odds."""
    on_workers(pages.sparkSession)
    spark = pages.sparkSession
    counts = word_counts(pages)
    model = spark.sparkContext.broadcast(unigrams(counts))
    named = named_by(rules)
    judged = ruled(pages, rules)
    cut = cut_runs(judged, counts, model, named)
    held = spark.sparkContext.broadcast({run: words for run, words, _ in commonest(cut, RUNS, "run", "words")})
    marked = lambda df, *more: df.join(cut.select("run", "words"), "run").select(*more, F.explode("words").alias("word"), "mark").select(*more, F.concat("mark", "word").alias("token"))

    def learn(batches):
        schema = pa.schema([*((c, pa.string()) for c in ("token", "mark", "run", "ruling")), ("n", pa.int64())])
        runs = held.value | {"#": ["#"]}

        def keys(row):
            for mark, part in parts(row[0], row[1], named):
                if part in runs:
                    yield from ((mark + w, None, None, row[2]) for w in runs[part])
                else:
                    yield None, mark, part, row[2]

        return _counted(batches, keys, schema)

    seen = judged.where("ruling is not null").select("host", "path", "ruling").mapInArrow(learn, "token string, mark string, run string, ruling string, n long")
    seen = materialise(seen.groupBy("token", "mark", "run", "ruling").agg(F.sum("n").alias("n")))
    every_run = cut.count() <= len(held.value)
    known = seen.where("token is not null").select("ruling", "n", "token")
    if not every_run:
        known = known.union(marked(seen.where("run is not null").drop("token"), "ruling", "n"))
    odds = token_odds(materialise(known.groupBy("token", "ruling").agg(F.sum("n").alias("n"))))
    top = {t: x for t, x, _ in commonest(odds, TOKENS, "token", "odds")}
    every_token = odds.count() <= len(top)
    shared = spark.sparkContext.broadcast(top)

    def judge(batches):
        runs, of, row = held.value | {"#": ["#"]}, shared.value, TaskContext.get().partitionId() << 33
        for part in rows(batches):
            out = []
            for page in part:
                score = 0.0
                for mark, run in parts(page[1], page[2], named):
                    if run not in runs:
                        out.append((row, *[None] * 7, mark, run))
                        continue
                    for t in (mark + w for w in runs[run]):
                        if t in of:
                            score += of[t]
                        elif not every_token:
                            out.append((row, *[None] * 6, t, None, None))
                out.append((row, *page, score, None, None, None))
                row += 1
            yield batch_of(out, _JUDGED)

    made = judged.mapInArrow(judge, "row long, page_id long, host string, path string, rule string, ruling string, odds double, token string, mark string, run string")
    if not (every_run and every_token):
        made = materialise(made)
        rest = made.where("token is not null").select("row", "token").union(marked(made.where("run is not null").select("row", "mark", "run"), "row"))
        rest = rest.join(F.broadcast(spark.createDataFrame(list(top.items()), "token string, odds double")), "token", "left")
        beyond = rest.where("odds is null").select("row", "token").join(odds.select("token", "odds"), "token").select("row", "odds")
        rest = rest.where("odds is not null").select("row", "odds").union(beyond).groupBy("row").agg(F.sum("odds").alias("more"))
        made = made.where("host is not null").join(rest, "row", "left").withColumn("odds", F.col("odds") + F.coalesce("more", F.lit(0.0)))
    verdict = F.coalesce("ruling", F.when(F.col("odds") > THRESHOLD, "block").otherwise("allow"))
    return made.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("odds").alias("log_odds"))
