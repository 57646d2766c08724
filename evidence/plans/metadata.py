"""An inverted index of metadata: for each scalar member of a document's JSON object, its name, kind and text.

A filter reads the buckets of its values and in them the rows that statistics leave, instead of parsing every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.sources.store import Manifest, Store, bucket_of

META = "pair string, doc_sk long, doc_id string"


def pairs(docs: DataFrame) -> DataFrame:
    """pair, doc_sk, doc_id of documents (doc_sk, doc_id, metadata): s, n or b for text, number and boolean. Members that are
    null, lists or objects can't be filtered by, and metadata that is no object has none."""
    spark = docs.sparkSession
    # Only an object has members by name; a list's places are no names.
    objects = docs.select("doc_sk", "doc_id", F.try_parse_json("metadata").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    members = objects.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    shape = F.schema_of_variant("value")
    kind = F.when(shape == "STRING", "s").when(shape == "BOOLEAN", "b").when(shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL"), "n")
    named = members.select("doc_sk", "doc_id", "key", kind.alias("kind"), F.try_variant_get("value", "$", "string").alias("text")).where("kind is not null and text is not null")
    return named.select(F.concat_ws("\x1f", "key", "kind", "text").alias("pair"), "doc_sk", "doc_id")


def wanted(name: str, value: object) -> list[str] | None:
    """The pairs that a filter takes, as search.metadata_filter() has it; None where an equal number may be written otherwise."""
    if isinstance(value, float):
        return None
    text = str(value).lower() if isinstance(value, bool) else str(value)
    kinds = "nbs" if isinstance(value, bool | int) else "s"
    return ["\x1f".join((name, kind, text)) for kind in kinds]


def update(store: Store, manifest: Manifest, tables: dict, added: DataFrame, removed: DataFrame, batch: int) -> None:
    """Bring the index in tables to where current versions (doc_sk, doc_id, metadata) came and went."""
    tables["meta"] = store.add_layer("meta", META, pairs(added), pairs(removed), batch, manifest)


def documents_with(store: Store, filters: dict[str, object], manifest: Manifest | None = None) -> DataFrame | None:
    """doc_sk, doc_id of the versions that all filters allow; None where there is no index, or a filter that it can't answer."""
    manifest = manifest or store.manifest()
    asked = {n: wanted(n, v) for n, v in filters.items()}
    if not filters or "meta" not in manifest.tables or None in asked.values():
        return None
    every = sorted({p for held in asked.values() for p in held})
    buckets = [r[0] for r in store.spark.createDataFrame([(p,) for p in every], "p string").select(bucket_of(F.col("p"), manifest.buckets)).distinct().collect()]
    rows = store.table("meta", META, manifest, buckets, F.col("pair").isin(every))
    held = rows.groupBy("doc_sk", "doc_id").agg(F.countDistinct(F.substring_index("pair", "\x1f", 1)).alias("n"))
    return held.where(F.col("n") == len(filters)).select("doc_sk", "doc_id")
