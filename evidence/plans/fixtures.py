"""The supplied tables in the roles of the engine: change log, parent and child rows, version tables, chunks, questions."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence.operators import mapping, scd2
from evidence.plans import index, metadata
from evidence.plans.vectors import build as build_vectors
from evidence.rules.spec import DocType
from evidence.sources.store import Manifest, Store
from evidence.workers import delete_on_exit, on_workers, shared_dir

T0, T1, T2 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1), datetime.datetime(2024, 3, 1)
CHANGE_ID, BATCH_ID = 77, 2
QUESTION = "idiot thonre ererati erhation the of"

CUSTOMER = DocType.of(
    {
        "doc_type": "customer",
        "source": {"source_id": "crm", "table": "customer", "key": "c_custkey"},
        "children": {
            "orders": {"table": "orders", "join": {"o_custkey": "c_custkey"}, "select": "o_orderkey", "order_by": "o_orderdate"},
            "priorities": {"table": "orders", "join": {"o_custkey": "c_custkey"}, "select": "o_orderpriority", "distinct": True},
            "open_orders": {"table": "orders", "join": {"o_custkey": "c_custkey"}, "select": "o_orderkey", "order_by": "o_orderkey", "where": {"column": "o_orderstatus", "eq": "O"}},
            "other_orders": {"table": "orders", "join": {"o_custkey": "c_custkey"}, "select": "o_orderkey", "order_by": "o_orderkey", "where": {"column": "o_orderstatus", "ne": "O"}},
        },
        "title": {"coalesce": [{"template": "{c_name} - {c_mktsegment}"}, {"const": "unknown customer"}]},
        "body": [
            {"label": "Segment", "value": {"field": "c_mktsegment"}},
            {"label": "Where", "value": {"join": ["c_mktsegment", "c_nationkey"], "separator": " / "}},
            {"label": "Balance", "value": {"field": "c_acctbal", "format": "thousands"}},
            {"label": "Orders", "value": {"field": "orders"}},
            {"label": "Priorities", "value": {"field": "priorities", "separator": "; "}},
            {"label": "Open", "value": {"field": "open_orders"}},
        ],
        "url": {"template": "https://example.org/customer/{c_custkey}"},
        "metadata": {"segment": {"field": "c_mktsegment"}, "nation": {"field": "c_nationkey"}, "key": {"field": "c_custkey"}},
        "quality": [{"rule": "not_null", "column": "c_name"}, {"rule": "unique", "column": "c_custkey"}],
    }
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("change_id"), F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("record_key"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").withColumn("is_active", F.col("c_custkey") % 7 != 0)


def customer_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return mapping.source_rows(CUSTOMER, customers(spark, d), dict.fromkeys(CUSTOMER.children, orders))


def _documents(rows: DataFrame, title, url, active) -> DataFrame:
    docs = rows.select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("doc_id"), F.lit("customer").alias("doc_type"), F.lit("crm").alias("source_id"),
        title.alias("title"), F.col("c_mktsegment").alias("body"), url.alias("url"), F.lit("{}").alias("metadata"), active.alias("is_active"),
    )
    hashed = mapping.content_hash(F.col("title"), F.col("body"))
    return docs.withColumn("content_hash", hashed).withColumn("tracked_hash", hashed).select(*scd2.DOCUMENT_COLUMNS)


def versions(spark: SparkSession, d: str) -> DataFrame:
    """A version table: nine tenths of the customers, first versions, one in five inactive."""
    rows = table(spark, d, "customer").where("c_custkey % 10 <> 0")
    docs = _documents(rows, F.col("c_name"), F.lit("https://example.org"), F.col("c_custkey") % 5 != 0)
    key = F.split_part("doc_id", F.lit(":"), F.lit(2)).cast("long")
    return docs.select(
        (key + 1).alias("doc_sk"), *scd2.DOCUMENT_COLUMNS, F.lit(1).alias("version"), F.lit(True).alias("is_current"), F.lit(T0).cast("timestamp").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"), F.lit("first seen").alias("change_reason"), F.lit(1).cast("long").alias("source_change_id"), F.lit(1).cast("long").alias("batch_id"),
    ).select(*scd2.VERSION_COLUMNS)


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """The next snapshot: other customers missing, some with new names, urls or activation."""
    rows = table(spark, d, "customer").where("c_custkey % 10 <> 1")
    k = F.col("c_custkey")
    title = F.when(k % 7 == 0, F.concat(F.col("c_name"), F.lit(" II"))).otherwise(F.col("c_name"))
    url = F.when(k % 3 == 0, "https://example.org/new").otherwise("https://example.org")
    return _documents(rows, title, url, F.when(k % 4 == 0, k % 5 == 0).otherwise(k % 5 != 0))


def decided(spark: SparkSession, d: str) -> DataFrame:
    return scd2.decide(scd2.current_versions(versions(spark, d)), incoming(spark, d))


def applied(spark: SparkSession, d: str) -> DataFrame:
    return scd2.apply(versions(spark, d), decided(spark, d), T1, CHANGE_ID, BATCH_ID)


def _chunks(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc:"), F.floor(F.col("doc_id") / 3).cast("string")).alias("doc_id"), F.col("lang").alias("doc_type"), F.lit(True).alias("is_current"),
        (F.col("doc_id") % 11 != 0).alias("is_active"), F.to_json(F.struct("n_chars", "source")).alias("metadata"), "text", *more,
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """documents as chunks of documents of three, with stored vectors where there are any."""
    return _chunks(table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left"), "embedding")


def whole(spark: SparkSession, d: str) -> DataFrame:
    """As chunks(), without vectors: texts stay where they lie."""
    return _chunks(table(spark, d, "documents"))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Chunk rows with text hashes; every second vector is there, of one of two models."""
    rows = chunks(spark, d).withColumn("text_hash", F.sha2("text", 256)).withColumn("doc_sk", F.floor(F.col("chunk_id") / 3))
    has = (F.col("chunk_id") % 2 == 0) & F.col("embedding").isNotNull()
    model = F.when(has, F.when(F.col("chunk_id") % 4 == 0, "m1").otherwise("m2"))
    return rows.select("chunk_id", "doc_sk", "text", "text_hash", F.when(has, F.col("embedding")).alias("embedding"), model.alias("embed_model"))


def indexed(spark: SparkSession, d: str, vectors: bool = False) -> Store:
    """A store that holds documents as chunks of their own documents, with the index of their words, or of their vectors."""
    path = f"{shared_dir(spark)}/evidence/index-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    store, manifest = Store(spark, path), Manifest(index={"analyser": "simple"})
    held = chunks(spark, d) if vectors else whole(spark, d)
    rows = held.withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn("doc_id", F.concat(F.lit("d"), "chunk_id"))
    docs = rows.select(F.xxhash64("chunk_id").alias("doc_sk"), "doc_id", "doc_type", "metadata", "is_current", "is_active")
    kept = "doc_sk long, doc_id string, doc_type string, metadata string, is_current boolean, is_active boolean"
    manifest.tables["document"] = store.add_layer("document", kept, docs, None, 1, manifest)
    if vectors:
        build_vectors(store, manifest, rows)
        return store
    manifest.chunks = rows.count()
    index.update(store, manifest, manifest.tables, rows, rows.limit(0), 1)
    store.publish(manifest)
    return store


def indexed_events(spark: SparkSession, d: str) -> Store:
    """A store with the metadata index of events as documents; every second one's number is written as text."""
    path = f"{shared_dir(spark)}/evidence/index-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    store, manifest = Store(spark, path), Manifest()
    props = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"))))
    docs = table(spark, d, "events").select(F.col("event_id").alias("doc_sk"), F.col("event_id").cast("string").alias("doc_id"), props.alias("metadata"))
    metadata.update(store, manifest, manifest.tables, docs, docs.limit(0), 1)
    store.publish(manifest)
    return store


def questions(spark: SparkSession, d: str) -> DataFrame:
    """First lines of user turns, some cut to a few characters or replaced, as questions."""
    n = F.col("conv_id") % 6
    told = F.when(n == 0, "  Hello!! ").when(n == 1, F.substring("text", 1, 2)).when(n == 2, F.concat(F.lit("How many\t "), F.substring("text", 1, 40))).when(n == 3, F.element_at(F.split("text", " "), 1)).otherwise(F.col("text"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", told.alias("question"), (F.col("conv_id") % 8).cast("int").alias("n_filters"), F.lit(1).alias("n_doc_types"), (F.col("turn") > 2).alias("is_follow_up"))


def turn_log(spark: SparkSession, d: str) -> DataFrame:
    """User turns as a query log: each with the next turn's text as its answer, some failed or blocked."""
    rows = table(spark, d, "conversations")
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    k = F.col("turn") + F.col("conv_id")
    return rows.where("role = 'user'").join(answers, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("conversation_id"), "turn", F.col("text").alias("question"), "answer", F.when(k % 13 == 0, "timeout").alias("error"), F.when(k % 5 == 0, "reject").when(k % 5 == 1, "pass").alias("decision")
    )
