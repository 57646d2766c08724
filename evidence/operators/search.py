"""Retrieval: exact vector search, rare-lexeme text search, reciprocal rank fusion, filters, sample questions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence.functions.text import tokens

RRF, MAX_PER_DOC, TOP_K, CANDIDATES = 60, 2, 8, 40
RARE_SHARE, RARE_TERMS, POSITION_WEIGHT = 0.10, 8, 0.1


_WHOLE = re.compile("-?[0-9]+")


class FilterError(ValueError):
    pass


def parse_filters(pairs: list[str]) -> dict[str, bool | int | str]:
    """name=value pairs: true and false are booleans, digits are numbers, the rest is text."""
    out: dict[str, bool | int | str] = {}
    for pair in pairs:
        name, sign, value = (x.strip() for x in pair.partition("="))
        if not sign or not name:
            raise FilterError(f"a filter reads name=value, not {pair!r}")
        low = value.lower()
        out[name] = low == "true" if low in ("true", "false") else int(value) if _WHOLE.fullmatch(value) else value
    return out


def metadata_filter(metadata: Column, filters: dict[str, object]) -> Column:
    """Containment in a JSON object: a number or boolean equals the same value or its text; other values only themselves."""
    v = F.try_parse_json(metadata)
    keep = F.lit(True)
    for name, value in filters.items():
        at = "$['" + name.replace("'", "\\'") + "']"
        member = F.try_variant_get(v, at, "variant")
        text = F.try_variant_get(v, at, "string")
        kind = F.schema_of_variant(member)
        scalar = ~(kind.startswith("ARRAY") | kind.startswith("OBJECT"))
        if isinstance(value, bool):
            keep &= F.coalesce(scalar & (text == F.lit(str(value).lower())), F.lit(False))
        elif isinstance(value, int):
            keep &= F.coalesce(scalar & (text == F.lit(str(value))), F.lit(False))
        elif isinstance(value, float):
            keep &= F.coalesce((kind != "STRING") & scalar & (F.try_variant_get(v, at, "double") == F.lit(value)), F.lit(False))
        else:
            keep &= F.coalesce((kind == "STRING") & (text == F.lit(str(value))), F.lit(False))
    return keep


def allowed(doc_types: list[str] | None = None, filters: dict[str, object] | None = None) -> Column:
    """Of a document (is_current, is_active, doc_type, metadata): whether a search may return it."""
    keep = F.col("is_current") & F.col("is_active")
    if doc_types:
        keep &= F.col("doc_type").isin(doc_types)
    return keep & metadata_filter(F.col("metadata"), filters) if filters else keep


def searchable(chunks: DataFrame, doc_types: list[str] | None = None, filters: dict[str, object] | None = None) -> DataFrame:
    """Chunks (with their document's is_current, is_active, doc_type, metadata) that a search may return."""
    return chunks.where(allowed(doc_types, filters))


def cosine_distance(embedding: Column, vector: list[float]) -> Column:
    """In double precision."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    e = F.transform(embedding, lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(e, q, lambda a, b: a * b))
    norms = F.sqrt(total(F.transform(e, lambda x: x * x))) * F.sqrt(total(F.transform(q, lambda x: x * x)))
    return 1 - F.when(norms > 0, dot / norms)


def vector_search(chunks: DataFrame, vector: list[float], limit: int = CANDIDATES) -> DataFrame:
    """The nearest chunks: chunk_id, doc_id, distance. Exact; a vector of another length has no distance."""
    fits = F.col("embedding").isNotNull() & (F.size("embedding") == len(vector))
    near = chunks.where(fits).select("chunk_id", "doc_id", cosine_distance(F.col("embedding"), vector).alias("distance"))
    return near.where("distance is not null").orderBy("distance", "chunk_id").limit(limit)


def shown(rows: DataFrame, name: str) -> DataFrame:
    """With a distance or score to 6 places, where engines that sum in another order agree; ranks come from the exact one."""
    return rows.withColumn(name, F.round(name, 6))


def lexeme_stats(chunks: DataFrame, terms: Column | None = None) -> DataFrame:
    """lexeme, ndoc: in how many chunks."""
    own = F.array_distinct(tokens(F.col("text")) if terms is None else terms)
    return chunks.select(F.explode(own).alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("ndoc"))


def rare_lexemes(stats: DataFrame, total: DataFrame, question: DataFrame) -> DataFrame:
    """The rarest terms of a question, those in at most a tenth of all chunks; a term that no chunk has counts as 0.

    total: one row (total). question: lexeme, distinct.
    """
    known = question.join(stats, "lexeme", "left").select("lexeme", F.coalesce("ndoc", F.lit(0)).alias("ndoc"))
    return known.join(F.broadcast(total)).where(F.col("ndoc") <= RARE_SHARE * F.col("total")).orderBy("ndoc", "lexeme").limit(RARE_TERMS).select("lexeme", "ndoc")


def question_terms(spark, question: str) -> DataFrame:
    return spark.createDataFrame([(question,)], "q string").select(F.explode(F.array_distinct(tokens(F.col("q")))).alias("lexeme"))


def term_frequencies(chunks: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """How many chunks there are, and how many hold each of a question's terms: one pass without a shuffle of lexemes."""
    held = tokens(F.col("text"))
    counted = [F.count_if(F.array_contains(F.col("held"), t)).alias(f"n{i}") for i, t in enumerate(terms)]
    got = chunks.select(F.filter(held, lambda x: x.isin(terms)).alias("held")).agg(F.count("*").alias("n"), *counted).first()
    return got["n"], {t: got[f"n{i}"] for i, t in enumerate(terms)}


def text_search(chunks: DataFrame, question: str, limit: int = CANDIDATES, everything: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """The best chunks for any of the rare terms: chunk_id, doc_id, score (a tenth for each position).

    everything: all chunks, for frequencies; chunks may be filtered. stats: a stored lexeme_stats() of everything, else the
    question's terms alone are counted. The rare terms are at most RARE_TERMS, so each chunk counts its own positions.
    """
    spark, everything = chunks.sparkSession, everything if everything is not None else chunks
    asked = question_terms(spark, question)
    if stats is None:
        total, found = term_frequencies(everything, [r[0] for r in asked.collect()])
        stats = spark.createDataFrame([(t, n) for t, n in found.items() if n], "lexeme string, ndoc long")
    else:
        stats, total = stats.where(F.col("lexeme").isin([r[0] for r in asked.collect()])), everything.count()
    rare = [r["lexeme"] for r in rare_lexemes(stats, spark.createDataFrame([(total,)], "total long"), asked).collect()]
    if not rare:
        return chunks.select("chunk_id", "doc_id", F.lit(0.0).alias("score")).limit(0)
    hits = chunks.select("chunk_id", "doc_id", F.size(F.filter(tokens(F.col("text")), lambda x: x.isin(rare))).alias("hits"))
    scored = hits.where("hits > 0").select("chunk_id", "doc_id", F.round(F.col("hits") * POSITION_WEIGHT, 6).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)


def fuse(vector_rows: DataFrame, text_rows: DataFrame, top_k: int = TOP_K, max_per_doc: int = MAX_PER_DOC) -> DataFrame:
    """Reciprocal rank fusion: chunk_id, doc_id, score, matched_by. Both inputs are bounded by their limits."""
    ranked = lambda d, by, name: d.select("chunk_id", "doc_id", F.row_number().over(Window.orderBy(by, "chunk_id")).alias(name))
    v = ranked(vector_rows, F.col("distance"), "vr")
    t = ranked(text_rows, F.desc("score"), "tr").withColumnRenamed("doc_id", "t_doc")
    share = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    by = F.when(F.col("vr").isNotNull() & F.col("tr").isNotNull(), "both").when(F.col("vr").isNotNull(), "vector").otherwise("text")
    both = v.join(t, "chunk_id", "full").select("chunk_id", F.coalesce("doc_id", "t_doc").alias("doc_id"), (share("vr") + share("tr")).alias("score"), by.alias("matched_by"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id")
    return both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_per_doc).drop("n").orderBy(F.desc("score"), "chunk_id").limit(top_k)


def hybrid_search(chunks: DataFrame, question: str, vector: list[float], top_k: int = TOP_K, candidates: int = CANDIDATES, doc_types: list[str] | None = None, filters: dict[str, object] | None = None, stats: DataFrame | None = None, text_rows: DataFrame | None = None, vector_rows: DataFrame | None = None) -> DataFrame:
    """Both searches over what the filters allow, fused. stats: a stored lexeme_stats(), else counted anew. text_rows,
    vector_rows: a search's rows where a stored index gave them."""
    if not question.strip():
        raise ValueError("the question is empty")
    rows = searchable(chunks, doc_types, filters)
    found = text_search(rows, question, candidates, everything=chunks, stats=stats) if text_rows is None else text_rows
    return fuse(vector_search(rows, vector, candidates) if vector_rows is None else vector_rows, found, top_k)


def sample_matched(chunks: DataFrame, question: str, first: int = 200, limit: int = 3, doc_types: list[str] | None = None) -> DataFrame:
    """Documents to suggest: the best chunks of all come first, filters after, then the best chunk of each document."""
    top = text_search(chunks, question, first)
    rows = searchable(chunks.join(F.broadcast(top.select("chunk_id", "score")), "chunk_id"), doc_types)
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("n", best).where("n = 1").orderBy(F.desc("score"), "chunk_id").limit(limit).select("doc_id", "chunk_id", "score")


def sample_recent(docs: DataFrame, limit: int = 3, field: str = "recall_date") -> DataFrame:
    """The latest documents by a date in their metadata, those without it last."""
    when = F.get_json_object("metadata", f"$.{field}")
    return docs.select("doc_id", when.alias("date")).orderBy(F.desc_nulls_last("date"), F.desc("doc_id")).limit(limit)


def count_by(docs: DataFrame, field: str) -> DataFrame:
    """How many documents have each value of a field of their metadata: the field as text, documents."""
    return docs.groupBy(F.get_json_object("metadata", f"$.{field}").alias(field)).agg(F.count("*").alias("documents"))


def latest(docs: DataFrame, filters: dict[str, object], field: str, limit: int = 50) -> DataFrame:
    """The latest documents that filters allow, by a date in their metadata, those without it last."""
    when = F.get_json_object("metadata", f"$.{field}")
    return docs.where(metadata_filter(F.col("metadata"), filters)).orderBy(F.desc_nulls_last(when), "doc_id").limit(limit)


# How titles of the two known document types begin, end and name nobody.
_HEADLINE, _CUTS, _NOBODY = "CPSC consumer product recall: ", (" Due to ", " Due To ", " due to ", ";"), "unknown firm"
_QUESTIONS = {"drug_recall": "Why did {} recall a drug?", "cpsc_recall": "What hazard did CPSC report for {}?"}


def title_subject(title: Column, doc_type: Column) -> Column:
    """What a title is about: the firm after " - ", or the headline up to its cause, as "product recalled by firm"."""
    t = F.trim(F.coalesce(title, F.lit("")))
    firm = F.trim(F.regexp_extract(t, r"^.*? - (.*)$", 1))
    firm = F.when((firm != "") & (F.lower(firm) != _NOBODY), firm)
    line = F.when(t.startswith(_HEADLINE), F.substring(t, len(_HEADLINE) + 1, 100_000)).otherwise(t)
    for cut in _CUTS:
        line = F.split_part(line, F.lit(cut), F.lit(1))
    line = F.regexp_replace(F.trim(line), r"[.,;]+$", "")
    who, what = F.trim(F.split_part(line, F.lit(" Recalls "), F.lit(1))), F.trim(F.regexp_extract(line, r"^.*? Recalls (.*)$", 1))
    turned = F.when(line.contains(" Recalls ") & (who != "") & (what != ""), F.concat(what, F.lit(" recalled by "), who)).otherwise(F.nullif(line, F.lit("")))
    return F.when(doc_type == "drug_recall", firm).otherwise(turned)


def sample_questions(docs: DataFrame, longest: int = 120) -> DataFrame:
    """doc_id, question: of titles with a subject, none longer than longest, each question once (least doc_id)."""
    subject = title_subject(F.col("title"), F.col("doc_type"))
    asked = F.concat(F.lit("What do the records say about "), subject, F.lit("?"))
    for kind, pattern in _QUESTIONS.items():
        before, after = pattern.split("{}")
        asked = F.when(F.col("doc_type") == kind, F.concat(F.lit(before), subject, F.lit(after))).otherwise(asked)
    rows = docs.select("doc_id", asked.alias("question")).where(F.col("question").isNotNull() & (F.length("question") <= longest))
    return rows.groupBy("question").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "question")


def context_block(hits: DataFrame, longest: int = 2000) -> DataFrame:
    """One row: the excerpts of ranked hits (rank, title, text), numbered, each cut at longest characters."""
    cut = F.when(F.length("text") > longest, F.concat(F.substring("text", 1, longest), F.lit(" ..."))).otherwise(F.col("text"))
    one = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), cut)
    listed = F.array_sort(F.collect_list(F.struct("rank", one.alias("s"))))
    return hits.agg(F.array_join(F.transform(listed, lambda x: x.s), "\n\n").alias("context"))
