"""The operators' queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence.llm.common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
#: After the quality stages of the pipeline only toxicity tells domains apart.
PIPELINE_TARGETS = {"clean": 0.98, "toxic": 0.02}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def domains(labels: DataFrame, low: bool = True) -> DataFrame:
    """The labelled table for mixing: doc_id, domain."""
    domain = F.when(F.col("toxic") == 1, "toxic")
    if low:
        domain = domain.when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.otherwise("clean").alias("domain"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.dart_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.projected_neighbours import projected_neighbours

    return projected_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.lm_scoring import lm_scoring

    return lm_scoring(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.token_store import write_store

    return write_store(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE)).documents()


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.soft_mixing import soft_mixing

    return soft_mixing(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.licences import licence_scan

    return licence_scan(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.whitening import whitening

    return whitening(table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.turn_repair import turn_repair

    return turn_repair(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidence.llm.winnowing import fingerprints, shown

    found = fingerprints(table(spark, sf_dir, "documents"))
    points = {"fingerprint": shown(F.col("points")), "edited_fingerprint": shown(F.col("edited_points"))}
    return found.select("doc_id", "n_chars", "edited_sha256", *(c.alias(name) for name, c in points.items()), "near_edited", "near_next")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_neighbours": op3_neighbours,
    "op4_url_filter": op4_url_filter,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_store": op6_token_store,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_licences": op10_licences,
    "op11_whitening": op11_whitening,
    "op12_turn_repair": op12_turn_repair,
    "op13_fingerprints": op13_fingerprints,
    "pipeline": pipeline,
}
#: All pairs of rows that share a shingle, exactly, and the transitive closure of those similar enough by weights.
_NEAR = r"""WITH RECURSIVE w AS (SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT row, g, count(*) AS c FROM (SELECT row, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w) GROUP BY 1, 2),
n AS (SELECT row, sum(c)::BIGINT AS n FROM s GROUP BY 1),
p AS (SELECT a.row AS a, b.row AS b, sum(least(a.c, b.c)) AS i FROM s a JOIN s b ON a.g = b.g AND a.row < b.row GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE i / (x.n + y.n - i) >= 0.8),
v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS row, a AS c FROM v UNION SELECT v.b, r.c FROM r JOIN v ON v.a = r.row),
k AS (SELECT row, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(m.doc_id, w.doc_id) AS class_id, coalesce(n.n, 0)::BIGINT AS n_shingles FROM w LEFT JOIN k ON k.row = w.row LEFT JOIN w m ON m.row = k.c LEFT JOIN n ON n.row = w.row"""

ORACLE_SQL: dict[str, str] = {"op1_near_dedup": _NEAR}
