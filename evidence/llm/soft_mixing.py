"""Soft-membership mixing to target weights, in DataFrame and SQL functions only.

1. A labelled table (doc_id, domain) trains a naive Bayes classifier of words hashed to BUCKETS buckets. Its counts are
   one aggregate, combined before the shuffle; its log weights are one row of BUCKETS x domains numbers.
2. Every document gets posteriors p over the domains from all its words. A document counts as at most EVIDENCE words, so
   that long texts keep soft memberships.
3. Nonnegative rates w minimise half the sum over domains of (sum_i w_i t_i p_ik - b_k)^2 / b_k, for t_i tokens and
   targets b, by projected gradient from w = 1 in the metric of t: w <- max(0, w - step * sum_k p_ik r_k / b_k). The
   residual r of one step is one aggregate over all documents; only its K sums reach the driver. A document's rate
   follows from its posteriors and the residuals of all steps, so no state is kept a document. If STEPS don't meet the
   TOLERANCE, one more step max(0, w - p l) ends at the targets, or, where they can't be reached, at the least squares:
   Newton's method finds its K numbers l, an aggregate an iteration, and fits or fails.
4. A document is repeated floor(rate) times, and once more with the probability of the rest, decided by a hash of its id;
   where rows share an id or have none, by a hash of the row's number in the written table, so each draws for itself.

Defined cases: a null or empty text has no tokens and the prior as posterior. Rows are judged each by itself, repeated
rows alike but for their draws; rows without doc_id take part. Labels of unknown domains, null labels and label rows without a document
are ignored; a document labelled several times counts for each of its labels. Without labelled documents posteriors are
uniform. A domain without any mass can't reach its target; the others are fitted nevertheless.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import materialise, small

BUCKETS = 65_536
EVIDENCE = 200
STEPS, BATCH, TOLERANCE = 64, 8, 1e-3
#: Weight of the distance to the rates before the last step, and the most iterations for it.
NEAR, NEWTON = 1e-6, 200


def word_buckets(text: Column) -> Column:
    """The hashed words of a text, in order."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


class Posteriors:
    """The classifier: log priors and a one-row table of log weights, an array a domain."""

    def __init__(self, docs: DataFrame, labelled: DataFrame, domains: list[str]):
        self.domains = domains
        gold = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).select(F.col("doc_id").alias("__id"), F.col("domain").alias("__domain"))
        text = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
        counts = text.join(small(gold, gold.count()), "__id").select("__domain", F.explode(word_buckets(F.col("__text"))).alias("__b"))
        counts = materialise(counts.groupBy("__b", "__domain").agg(F.count("*").alias("__c")))
        held = text.select("__id").join(small(gold, gold.count()), "__id").groupBy("__domain").count().collect()
        n_docs = {r[0]: r[1] for r in held}
        sums = {r[0]: r[1] for r in counts.groupBy("__domain").agg(F.sum("__c")).collect()}
        total = sum(n_docs.values())
        self.prior = [math.log((n_docs.get(d, 0) + 1) / (total + len(domains))) for d in domains]
        per = [F.coalesce(F.max(F.when(F.col("__domain") == d, F.col("__c"))), F.lit(0)).alias(f"c{k}") for k, d in enumerate(domains)]
        every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("__b")).join(counts, "__b", "left").groupBy("__b").agg(*per)
        logs = [F.log((F.col(f"c{k}") + 1) / F.lit(float(sums.get(d, 0) + BUCKETS))) for k, d in enumerate(domains)]
        in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("__b", x.alias("v")))), lambda s: s.v)
        self.weights = materialise(every.agg(*(in_order(x).alias(f"w{k}") for k, x in enumerate(logs))))

    def add(self, docs: DataFrame) -> DataFrame:
        """docs with __tokens (long) and __p (array of doubles, in the order of the domains)."""
        got = docs.withColumn("__b", word_buckets(F.col("text")))
        view = f"mix_weights_{uuid.uuid4().hex}"
        self.weights.createTempView(view)
        for k in range(len(self.domains)):
            w = F.expr(f"(SELECT w{k} FROM {view})")
            got = got.withColumn(f"__w{k}", w)
            got = got.withColumn(f"__l{k}", F.expr(f"aggregate(__b, 0D, (a, b) -> a + __w{k}[b])")).drop(f"__w{k}")
        docs.sparkSession.catalog.dropTempView(view)
        n = F.size("__b")
        got = got.withColumn("__tokens", n.cast("long"))
        scale = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(n, F.lit(1)))
        logits = [F.lit(self.prior[k]) + F.col(f"__l{k}") * scale for k in range(len(self.domains))]
        top = F.greatest(*logits) if len(logits) > 1 else logits[0]
        got = got.withColumn("__e", F.array(*(F.exp(x - top) for x in logits)))
        whole = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
        got = got.withColumn("__p", F.transform("__e", lambda x: x / whole))
        return got.drop("__b", "__e", *(f"__l{k}" for k in range(len(self.domains))))


def rate(p: Column, steps: list[list[float]], start: Column) -> Column:
    """The rate after those steps, each the vector step * r_k / b_k."""
    w = start
    if steps:
        all_steps = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in steps))
        w = F.aggregate(all_steps, start, lambda w, g: F.greatest(F.lit(0.0), w - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    return w


def largest_eigenvalue(m: list[list[float]]) -> float:
    v = [1.0] * len(m)
    for _ in range(200):
        u = [sum(a * b for a, b in zip(row, v, strict=True)) for row in m]
        norm = math.sqrt(sum(x * x for x in u))
        if norm == 0:
            return 0.0
        v = [x / norm for x in u]
    return norm


def solved(m: list[list[float]], b: list[float]) -> list[float]:
    """x with m x = b, for a positive definite m."""
    rows = [[*row, y] for row, y in zip(m, b, strict=True)]
    n = len(b)
    for i in range(n):
        at = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[at] = rows[at], rows[i]
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][j] * x[j] for j in range(i + 1, n))) / rows[i][i]
    return x


def last_step(state: DataFrame, goal: list[float], scale: list[float]) -> list[float]:
    """The step l from the rates __w to those that meet the goal: u = max(0, __w - p l), the nearest to __w in the metric of tokens.

    l minimises sum(t u^2) / 2 + goal l + NEAR / 2 sum(scale l^2), which is convex; there the residual is NEAR scale l, so
    the rates are a least-squares solution where the goal can't be reached.
    """
    k = len(goal)
    p = [F.col("__p")[i] for i in range(k)]

    def at(step: list[float]):
        u = state.select("__tokens", "__p", rate(F.col("__p"), [step], F.col("__w")).alias("__u"))
        live = F.when(F.col("__u") > 0, F.col("__tokens")).otherwise(0)
        got = u.agg(F.sum(F.col("__tokens") * F.col("__u") * F.col("__u")), *(F.sum(F.col("__u") * F.col("__tokens") * p[i]) for i in range(k)), *(F.sum(live * p[i] * p[j]) for i in range(k) for j in range(k))).first()
        value = got[0] / 2 + sum(g * x + NEAR / 2 * s * x * x for g, s, x in zip(goal, scale, step, strict=True))
        residual = [got[1 + i] - goal[i] for i in range(k)]
        slope = [NEAR * s * x - r for s, x, r in zip(scale, step, residual, strict=True)]
        curve = [[got[1 + k + i * k + j] + (NEAR * scale[i] if i == j else 0.0) for j in range(k)] for i in range(k)]
        return value, residual, slope, curve

    size = lambda v: max(abs(x) / s for x, s in zip(v, scale, strict=True))
    step = [0.0] * k
    value, residual, slope, curve = at(step)
    for _ in range(NEWTON):
        if size(residual) < TOLERANCE or size(slope) < TOLERANCE / 100:
            return step
        way = solved(curve, [-x for x in slope])
        falls, length = sum(a * b for a, b in zip(way, slope, strict=True)), 1.0
        while True:
            new = [x + length * y for x, y in zip(step, way, strict=True)]
            found = at(new)
            if found[0] <= value + 1e-4 * length * falls or size(found[2]) < TOLERANCE / 100:
                break
            length /= 2
            if length < 1e-9:
                raise RuntimeError(f"mixing stopped with a residual of {size(residual):.3g} of the targets")
        step, (value, residual, slope, curve) = new, found
    raise RuntimeError(f"mixing stopped with a residual of {size(residual):.3g} of the targets after {NEWTON} iterations")


def _goals(total: int, targets: dict[str, float], domains: list[str]) -> tuple[list[float], list[float]]:
    """Tokens wanted of each domain, and what residuals are measured by."""
    share = sum(targets.values()) or 1.0
    goal = [total * targets.get(d, 0.0) / share for d in domains]
    return goal, [max(g, total * 1e-3) for g in goal]


def fit_rates(members: DataFrame, targets: dict[str, float], domains: list[str]) -> list[list[float]]:
    """The steps of the projected gradient. members: __tokens, __p; a written table."""
    k = len(domains)
    p = [F.col("__p")[i] for i in range(k)]
    sums = members.agg(F.sum("__tokens"), *(F.sum(F.col("__tokens") * p[i] * p[j]) for i in range(k) for j in range(k))).first()
    total = sums[0] or 0
    if not total:
        return []
    goal, scale = _goals(total, targets, domains)
    top = largest_eigenvalue([[sums[1 + i * k + j] / math.sqrt(scale[i] * scale[j]) for j in range(k)] for i in range(k)])
    if not top:
        return []
    history: list[list[float]] = []
    state, pending = members.withColumn("__w", F.lit(1.0)), []
    for _ in range(STEPS):
        w = rate(F.col("__p"), pending, F.col("__w"))
        got = state.select("__tokens", "__p", w.alias("__w")).agg(*(F.sum(F.col("__w") * F.col("__tokens") * p[i]) for i in range(k))).first()
        residual = [(got[i] or 0.0) - goal[i] for i in range(k)]
        if max(abs(r) / s for r, s in zip(residual, scale, strict=True)) < TOLERANCE:
            break
        pending.append([r / s / top for r, s in zip(residual, scale, strict=True)])
        history.append(pending[-1])
        if len(pending) == BATCH:
            state, pending = materialise(state.withColumn("__w", rate(F.col("__p"), pending, F.col("__w")))), []
    return history


def steps_to_targets(members: DataFrame, targets: dict[str, float], domains: list[str]) -> list[list[float]]:
    """The steps of fit_rates, and the last one if those have not met the tolerance."""
    steps = fit_rates(members, targets, domains)
    if len(steps) < STEPS:
        return steps
    goal, scale = _goals(members.agg(F.sum("__tokens")).first()[0], targets, domains)
    state = materialise(members.withColumn("__w", rate(F.col("__p"), steps, F.lit(1.0))))
    return [*steps, last_step(state, goal, scale)]


def drawn(members: DataFrame) -> DataFrame:
    """members with __own, what a row draws by: its doc_id, or its __row where others have that id or it has none."""
    again = materialise(members.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    own = F.when(F.col("doc_id").isNull(), F.col("__row"))
    if again.take(1):
        members = members.join(small(again.withColumn("__again", F.lit(True)), again.count()), "doc_id", "left")
        own = own.when(F.col("__again"), F.col("__row"))
    return members.withColumn("__own", F.xxhash64("doc_id", own))


def copies(own: Column, w: Column, seed: int = 11) -> Column:
    """floor(w + u) for u uniform by a hash: w on average."""
    return F.floor(w + F.pmod(F.xxhash64(own, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))).cast("long")


def soft_mixing(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row for each document: doc_id, tokens, p_<domain> for each domain of targets, rate, copies."""
    domains = sorted(targets)
    model = Posteriors(docs, labelled, domains)
    members = materialise(model.add(docs.select("doc_id", "text")).select("doc_id", "__tokens", "__p", F.monotonically_increasing_id().alias("__row")))
    w = rate(F.col("__p"), steps_to_targets(members.select("__tokens", "__p"), targets, domains), F.lit(1.0))
    out = drawn(members).select("doc_id", F.col("__tokens").alias("tokens"), *(F.col("__p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), w.alias("rate"), "__own")
    return out.withColumn("copies", copies(F.col("__own"), F.col("rate"))).drop("__own")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """docs, its columns and no others, each row as often as its rate says."""
    domains = sorted(targets)
    model = Posteriors(docs, labelled, domains)
    members = materialise(model.add(docs).withColumn("__row", F.monotonically_increasing_id()))
    steps = steps_to_targets(members.select("__tokens", "__p"), targets, domains)
    rated = drawn(members).withColumn("__n", copies(F.col("__own"), rate(F.col("__p"), steps, F.lit(1.0))))
    return rated.withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int")))).select(*docs.columns)
