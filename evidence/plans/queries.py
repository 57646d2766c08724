"""Every query of the engine by name, with the same in SQL where SQL can say it."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence.functions.chunking import chunks as cut
from evidence.functions.text import fold, normalise, strip
from evidence.operators import catalog, changes, conversation, gate, inverted, mapping, quality, scd2, search
from evidence.operators import chunks as ch
from evidence.plans import fixtures as fx
from evidence.plans import index, metadata, vectors
from evidence.plans import ingest as run
from evidence.rules.spec import Check

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Change log.
@query("SELECT coalesce(max(event_id), 0)::BIGINT AS head FROM events WHERE event_type = 'purchase'")
def source_head(s, d):
    return changes.source_head(fx.change_log(s, d), "purchase")


@query("""SELECT m.doc_type, m.source_id, count(*) FILTER (WHERE e.event_id > m.change_id) AS behind
FROM (VALUES ('a', 'view', 100), ('b', 'click', 500), ('c', 'nothing', 0)) m(doc_type, source_id, change_id)
LEFT JOIN events e ON e.event_type = m.source_id GROUP BY 1, 2""")
def changes_behind(s, d):
    marks = s.createDataFrame([("a", "view", 100), ("b", "click", 500), ("c", "nothing", 0)], "doc_type string, source_id string, change_id long")
    return changes.changes_behind(fx.change_log(s, d), marks)


_KEYS = "SELECT DISTINCT user_id::VARCHAR AS record_key FROM events WHERE event_type = 'click' AND event_id > 100 AND event_id <= (SELECT max(event_id) FROM events WHERE event_type = 'click')"


def _keys(s, d):
    log = fx.change_log(s, d)
    return changes.changed_keys(log, "click", 100, changes.source_head(log, "click").first()["head"])


def _parents(s, d):
    return fx.table(s, d, "customer").withColumn("record_key", F.col("c_custkey").cast("string"))


@query(_KEYS)
def changed_keys(s, d):
    return _keys(s, d)


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey::VARCHAR IN ({_KEYS})")
def changed_rows(s, d):
    return changes.changed_rows(_parents(s, d), _keys(s, d)).select("c_custkey", "c_name", "c_acctbal")


@query(f"SELECT record_key FROM ({_KEYS}) WHERE record_key NOT IN (SELECT o_orderkey::VARCHAR FROM orders)")
def missing_keys(s, d):
    # The log's keys against orders, whose keys have gaps.
    return changes.missing_keys(fx.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("record_key")), _keys(s, d))


# Mapping.
_CHILDREN = """SELECT o_custkey AS k, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderdate, o_orderkey) AS orders,
  array_to_string(list_sort(list(DISTINCT o_orderpriority)), '; ') AS priorities,
  coalesce(string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'O'), '') AS open_orders,
  coalesce(string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'O'), '') AS other_orders FROM orders GROUP BY 1"""


@query(f"SELECT c_custkey::VARCHAR AS record_key, coalesce(orders, '') AS orders, coalesce(priorities, '') AS priorities, coalesce(open_orders, '') AS open_orders, coalesce(other_orders, '') AS other_orders FROM customer LEFT JOIN ({_CHILDREN}) ON k = c_custkey")
def child_collections(s, d):
    joined = lambda c, by: F.coalesce(F.array_join(F.col(c).cast("array<string>"), by), F.lit("")).alias(c)
    return fx.customer_rows(s, d).select("record_key", joined("orders", ", "), joined("priorities", "; "), joined("open_orders", ", "), joined("other_orders", ", "))


_DOCS = f"""SELECT 'customer:' || c_custkey AS doc_id, c_name || ' - ' || c_mktsegment AS title,
  concat_ws(chr(10), 'Segment: ' || c_mktsegment, 'Where: ' || c_mktsegment || ' / ' || c_nationkey,
    CASE WHEN trunc(c_acctbal)::BIGINT <> 0 THEN 'Balance: ' || format('{{:,}}', trunc(c_acctbal)::BIGINT) END,
    'Orders: ' || nullif(orders, ''), 'Priorities: ' || nullif(priorities, ''), 'Open: ' || nullif(open_orders, '')) AS body,
  'https://example.org/customer/' || c_custkey AS url, '{{"key":' || c_custkey || ',"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}}' AS metadata, c_custkey % 7 <> 0 AS is_active
  FROM customer LEFT JOIN ({_CHILDREN}) ON k = c_custkey"""


def _docs(s, d):
    return mapping.build_documents(fx.CUSTOMER, fx.customer_rows(s, d))


@query(_DOCS)
def build_documents(s, d):
    return _docs(s, d).select("doc_id", "title", "body", "url", "metadata", "is_active")


@query(f"SELECT doc_id, sha256(title || chr(10) || body) AS content_hash FROM ({_DOCS})")
def content_hash(s, d):
    return _docs(s, d).select("doc_id", "content_hash")


@query(f"SELECT doc_id, sha256('body=' || body || chr(30) || 'metadata=' || metadata || chr(30) || 'title=' || title) AS tracked FROM ({_DOCS})")
def tracked_hash(s, d):
    return _docs(s, d).select("doc_id", mapping.tracked_hash({c: F.col(c) for c in ("title", "body", "metadata")}, ("title", "body", "metadata")).alias("tracked"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, year(o_orderdate)::INT AS year,
CASE WHEN trunc(o_totalprice)::BIGINT <> 0 THEN format('{:,}', trunc(o_totalprice)::BIGINT) END AS thousands, o_orderstatus AS stripped FROM orders""")
def value_formats(s, d):
    rows = fx.table(s, d, "orders")
    make = mapping.Compiler(rows.schema)
    return rows.select("o_orderkey", make.formatted("o_orderdate", "iso").alias("iso"), make.formatted("o_orderdate", "year").alias("year"), make.formatted("o_totalprice", "thousands").alias("thousands"), strip(F.concat(F.lit(" \t "), F.col("o_orderstatus"), F.lit("\n "))).alias("stripped"))


# History.
_OLD = "SELECT c_custkey AS k, 'customer:' || c_custkey AS doc_id, c_name AS title, c_mktsegment AS body, 'https://example.org' AS url, c_custkey % 5 <> 0 AS is_active, c_custkey + 1 AS doc_sk FROM customer WHERE c_custkey % 10 <> 0"
_NEW = """SELECT c_custkey AS k, 'customer:' || c_custkey AS doc_id, CASE WHEN c_custkey % 7 = 0 THEN c_name || ' II' ELSE c_name END AS title, c_mktsegment AS body,
CASE WHEN c_custkey % 3 = 0 THEN 'https://example.org/new' ELSE 'https://example.org' END AS url, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 5 = 0 ELSE c_custkey % 5 <> 0 END AS is_active FROM customer WHERE c_custkey % 10 <> 1"""
_DECIDED = f"""SELECT n.*, o.doc_sk AS p_doc_sk, o.is_active AS p_is_active,
CASE WHEN o.doc_sk IS NULL THEN 'insert' WHEN o.title <> n.title OR o.body <> n.body THEN 'new_version' WHEN o.is_active <> n.is_active THEN 'new_version_move_chunks' WHEN o.url <> n.url THEN 'overwrite' ELSE 'unchanged' END AS action,
CASE WHEN o.doc_sk IS NULL THEN 'first seen' WHEN o.title <> n.title OR o.body <> n.body THEN 'text changed' WHEN o.is_active <> n.is_active THEN 'activation changed' WHEN o.url <> n.url THEN 'attribute changed' ELSE 'no change' END AS reason
FROM ({_NEW}) n LEFT JOIN ({_OLD}) o USING (doc_id)"""
_OPENS = "action IN ('insert', 'new_version', 'new_version_move_chunks')"
_APPLIED = f"""SELECT o.doc_sk, o.doc_id, o.title, CASE WHEN c.action = 'overwrite' THEN c.url ELSE o.url END AS url, o.is_active, 1 AS version, coalesce(NOT {_OPENS}, true) AS is_current,
TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN {_OPENS} THEN TIMESTAMP '2024-02-01' END AS valid_to, 'first seen' AS change_reason, CASE WHEN c.action = 'overwrite' THEN 77 ELSE 1 END::BIGINT AS source_change_id
FROM ({_OLD}) o LEFT JOIN ({_DECIDED}) c USING (doc_id)
UNION ALL SELECT (SELECT coalesce(max(doc_sk), 0) FROM ({_OLD})) + row_number() OVER (ORDER BY substr(sha256(doc_id), 1, 3), doc_id), doc_id, title, url, is_active, CASE WHEN p_doc_sk IS NULL THEN 1 ELSE 2 END, true, TIMESTAMP '2024-02-01', NULL, reason, 77 FROM ({_DECIDED}) WHERE {_OPENS}"""


@query(f"SELECT doc_id, action, reason FROM ({_DECIDED})")
def scd2_decide(s, d):
    return fx.decided(s, d).select("doc_id", "action", "reason")


@query(_APPLIED)
def scd2_apply(s, d):
    out = fx.applied(s, d).select("doc_sk", "doc_id", "title", "url", "is_active", "version", "is_current", "valid_from", "valid_to", "change_reason", "source_change_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


@query(f"SELECT doc_id, 'new_version_move_chunks' AS action, 'not in the source any more' AS gone_reason FROM ({_OLD}) WHERE is_active AND doc_id NOT IN (SELECT doc_id FROM ({_NEW}))")
def scd2_deactivate_absent(s, d):
    current = scd2.current_versions(fx.versions(s, d))
    gone = scd2.vanished(current, fx.incoming(s, d))
    return scd2.decide(current, gone).select("doc_id", "action", "gone_reason")


@query(f"SELECT doc_id, version FROM ({_APPLIED}) WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' < valid_to)")
def scd2_as_of(s, d):
    return scd2.as_of(fx.applied(s, d), datetime.datetime(2024, 1, 15)).select("doc_id", "version")


@query(f"SELECT doc_id, version, change_reason FROM ({_APPLIED}) WHERE doc_id = 'customer:7'")
def document_history(s, d):
    return scd2.document_history(fx.applied(s, d), "customer:7").select("doc_id", "version", "change_reason")


@query(f"SELECT doc_id, title, version FROM ({_APPLIED}) WHERE is_current")
def current_documents(s, d):
    return scd2.current_versions(fx.applied(s, d)).select("doc_id", "title", "version")


@query(f"""SELECT count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'new_version') AS updated, count(*) FILTER (WHERE action = 'overwrite') AS refreshed,
count(*) FILTER (WHERE action = 'unchanged') AS unchanged, count(*) FILTER (WHERE action <> 'unchanged' AND p_is_active AND NOT is_active) AS deactivated, count(*) FILTER (WHERE action <> 'unchanged' AND NOT p_is_active AND is_active) AS reactivated,
count(*) FILTER (WHERE {_OPENS}) AS versions_created FROM ({_DECIDED})""")
def batch_stats(s, d):
    return scd2.batch_stats(fx.decided(s, d))


@query(f"""WITH todo AS (SELECT DISTINCT sha256(title || chr(10) || chr(10) || body) AS h, length(title || chr(10) || chr(10) || body) AS n FROM ({_DECIDED}) WHERE action IN ('insert', 'new_version')
  AND sha256(title || chr(10) || chr(10) || body) NOT IN (SELECT sha256(title || chr(10) || chr(10) || body) FROM ({_OLD})))
SELECT count(*) FILTER (WHERE action = 'insert') AS new_documents, count(*) FILTER (WHERE action = 'new_version') AS changed_documents, count(*) FILTER (WHERE action = 'unchanged') AS unchanged_documents,
count(*) FILTER (WHERE {_OPENS}) AS new_versions, (SELECT count(*) FROM todo) AS to_embed, (SELECT coalesce(sum(n), 0)::BIGINT FROM todo) AS characters FROM ({_DECIDED})""")
def plan_preview(s, d):
    text = mapping.document_text(F.col("title"), F.col("body"))
    decided = fx.decided(s, d)
    fresh = decided.where(F.col("action").isin("insert", "new_version")).select(text.alias("text"), F.sha2(text, 256).alias("text_hash"))
    return run.plan_preview(decided, fresh, fx.versions(s, d).select(F.sha2(text, 256).alias("text_hash")))


@query(f"""WITH v AS (SELECT doc_sk, doc_id, version, is_current AND k.c_custkey % 50 <> 3 AS is_current, valid_from, valid_to FROM ({_APPLIED}) JOIN customer k ON doc_id = 'customer:' || c_custkey)
SELECT doc_id, 'not one current version' AS problem FROM v GROUP BY 1 HAVING count(*) FILTER (WHERE is_current) <> 1
UNION ALL SELECT doc_id, 'current without open end' FROM v WHERE is_current <> (valid_to IS NULL)""")
def version_invariants(s, d):
    key = F.split_part("doc_id", F.lit(":"), F.lit(2)).cast("long")
    return scd2.violations(fx.applied(s, d).withColumn("is_current", F.col("is_current") & (key % 50 != 3)))


# Chunks and vectors.
@query()
def chunk_documents(s, d):
    return ch.chunk_rows(fx.table(s, d, "documents").select(F.col("doc_id").alias("doc_sk"), "text")).select("doc_sk", "ord", "text_hash", F.length("text").alias("n"))


@query("SELECT sha256(l) AS text_hash, count(*) AS times FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1 HAVING count(*) > 1")
def chunk_hash_dedup(s, d):
    lines = fx.table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    return ch.repeated_texts(lines)


_STORED = "SELECT c.doc_id AS chunk_id, c.doc_id // 3 AS doc_sk, c.text, sha256(c.text) AS text_hash, CASE WHEN c.doc_id % 2 = 0 THEN e.embedding END AS embedding, CASE WHEN c.doc_id % 2 = 0 AND e.embedding IS NOT NULL THEN CASE WHEN c.doc_id % 4 = 0 THEN 'm1' ELSE 'm2' END END AS embed_model FROM documents c LEFT JOIN embeddings e ON e.vec_id = c.doc_id"
_first = "round(embedding[1]::DOUBLE, 6)"


@query(f"""SELECT n.chunk_id, o.embed_model, round(o.embedding[1]::DOUBLE, 6) AS first FROM ({_STORED}) n
LEFT JOIN (SELECT * FROM ({_STORED}) WHERE embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY chunk_id) = 1) o USING (text_hash)""")
def vector_carry(s, d):
    old = fx.stored(s, d)
    return ch.carry_vectors(old.select("chunk_id", "text_hash"), old).select("chunk_id", "embed_model", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query(f"SELECT chunk_id, CASE WHEN doc_sk % 2 = 0 THEN doc_sk + 1000000 ELSE doc_sk END AS doc_sk FROM ({_STORED})")
def chunk_move(s, d):
    rows = fx.stored(s, d)
    moves = rows.where("doc_sk % 2 = 0").select(F.col("doc_sk").alias("old_sk"), (F.col("doc_sk") + 1_000_000).alias("new_sk")).distinct()
    return ch.move_chunks(rows, moves).select("chunk_id", "doc_sk")


@query(f"SELECT count(*) AS texts, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM (SELECT DISTINCT text_hash, text FROM ({_STORED}) WHERE embedding IS NULL) WHERE text_hash NOT IN (SELECT text_hash FROM ({_STORED}) WHERE embedding IS NOT NULL)")
def pending_cost(s, d):
    return ch.pending_cost(fx.stored(s, d))


@query(f"""SELECT n.chunk_id, coalesce(n.embed_model, o.embed_model) AS embed_model, round(coalesce(n.embedding, o.embedding)[1]::DOUBLE, 6) AS first FROM ({_STORED}) n
LEFT JOIN (SELECT * FROM ({_STORED}) WHERE embed_model = 'm1' QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY chunk_id) = 1) o USING (text_hash)""")
def reuse_embeddings(s, d):
    return ch.reuse_embeddings(fx.stored(s, d), "m1").select("chunk_id", "embed_model", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query(f"SELECT doc_sk, count(*) AS chunks FROM (SELECT chunk_id // 4 AS doc_sk, CASE WHEN chunk_id % 2 = 0 OR chunk_id % 3 = 0 THEN text END AS embedding FROM ({_STORED}) WHERE chunk_id % 4 <> 1) GROUP BY 1 HAVING count(*) = count(embedding)")
def mark_indexed(s, d):
    # Versions of three chunks, of which the one at 3 has a vector only where its number divides by 3.
    k = F.col("chunk_id")
    rows = fx.stored(s, d).where(k % 4 != 1).select(F.floor(k / 4).alias("doc_sk"), F.when((k % 2 == 0) | (k % 3 == 0), F.col("text")).alias("embedding"))
    return ch.mark_indexed(rows)


@query(f"SELECT count(*) AS pending FROM ({_STORED}) WHERE embedding IS NULL")
def pending_count(s, d):
    return ch.pending_count(fx.stored(s, d))


@query(f"SELECT text_hash, min(text) AS text FROM ({_STORED}) WHERE embedding IS NULL GROUP BY 1 ORDER BY 1 LIMIT 50")
def embed_budget(s, d):
    return ch.embed_budget(fx.stored(s, d), 50)


@query()
def embed_pending(s, d):
    todo = fx.stored(s, d).where("embedding is null").groupBy("text_hash").agg(F.min("text").alias("text"))
    return ch.embed(todo, ch.HashEmbedder()).select("text_hash", "embedding", "embed_model")


# Search.
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_CHUNKS = "SELECT c.doc_id AS chunk_id, 'doc:' || (c.doc_id // 3) AS doc_id, lang AS doc_type, c.doc_id % 11 <> 0 AS is_active, n_chars, source, text, embedding FROM documents c LEFT JOIN embeddings e ON e.vec_id = c.doc_id"
_STATS = f"SELECT lexeme, count(*) AS ndoc FROM (SELECT DISTINCT chunk_id, unnest({_TOKENS}) AS lexeme FROM ({_CHUNKS})) GROUP BY 1"
_RARE = f"""SELECT lexeme, coalesce(ndoc, 0)::BIGINT AS ndoc FROM (SELECT DISTINCT unnest(regexp_extract_all('{fx.QUESTION}', '[a-z]+')) AS lexeme) LEFT JOIN ({_STATS}) USING (lexeme)
WHERE coalesce(ndoc, 0) <= 0.1 * (SELECT count(*) FROM documents) ORDER BY 2, 1 LIMIT 8"""


def _text_sql(where: str, limit: int) -> str:
    return f"SELECT chunk_id, doc_id, round(count(*) * 0.1, 6) AS score FROM (SELECT chunk_id, doc_id, unnest({_TOKENS}) AS lexeme FROM ({_CHUNKS}) WHERE {where}) WHERE lexeme IN (SELECT lexeme FROM ({_RARE})) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT {limit}"


def _vector_sql(where: str, limit: int) -> str:
    return f"SELECT chunk_id, doc_id, round(d, 6) AS distance FROM (SELECT *, list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM ({_CHUNKS}) WHERE embedding IS NOT NULL AND {where}) ORDER BY d, 1 LIMIT {limit}"


def _fused_sql(where: str) -> str:
    return f"""SELECT chunk_id, doc_id, score, matched_by FROM (SELECT coalesce(v.chunk_id, t.chunk_id) AS chunk_id, coalesce(v.doc_id, t.doc_id) AS doc_id,
coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + tr), 0) AS s, round(s, 6) AS score, CASE WHEN vr IS NOT NULL AND tr IS NOT NULL THEN 'both' WHEN vr IS NOT NULL THEN 'vector' ELSE 'text' END AS matched_by
FROM (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS vr FROM ({_vector_sql(where, 40)})) v FULL JOIN (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS tr FROM ({_text_sql(where, 40)})) t ON v.chunk_id = t.chunk_id)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, chunk_id) <= 2 ORDER BY s DESC, chunk_id LIMIT 8"""


@query(_STATS)
def lexeme_stats(s, d):
    return search.lexeme_stats(fx.chunks(s, d))


@query()
def english_lexeme_stats(s, d):
    return inverted.counts_by(fx.whole(s, d), "english")


@query(_RARE)
def rare_lexemes(s, d):
    rows = fx.chunks(s, d)
    return search.rare_lexemes(search.lexeme_stats(rows), rows.agg(F.count("*").alias("total")), search.question_terms(s, fx.QUESTION))


@query(_text_sql("true", 40))
def text_search(s, d):
    return search.text_search(fx.chunks(s, d), fx.QUESTION)


_WHOLE = "SELECT doc_id::VARCHAR AS chunk_id, 'd' || doc_id AS doc_id, lang AS doc_type, doc_id % 11 <> 0 AS is_active, text FROM documents"


def _stored_text_sql(where: str) -> str:
    return f"SELECT chunk_id, doc_id, round(count(*) * 0.1, 6) AS score FROM (SELECT chunk_id, doc_id, unnest({_TOKENS}) AS lexeme FROM ({_WHOLE}) WHERE {where}) WHERE lexeme IN (SELECT lexeme FROM ({_RARE})) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 40"


@query(_stored_text_sql("true"))
def stored_text_search(s, d):
    return index.text_search(fx.indexed(s, d), fx.QUESTION)


@query(_stored_text_sql("is_active AND doc_type IN ('de', 'fr')"))
def stored_text_search_filtered(s, d):
    return index.text_search(fx.indexed(s, d), fx.QUESTION, allowed=search.allowed(["de", "fr"]))


@query(f"SELECT lexeme, chunk_id, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM (SELECT chunk_id, doc_id, unnest({_TOKENS}) AS lexeme, generate_subscripts({_TOKENS}, 1)::INT AS pos FROM ({_WHOLE})) WHERE lexeme IN (SELECT lexeme FROM ({_RARE})) GROUP BY 1, 2, 3")
def stored_postings(s, d):
    store = fx.indexed(s, d)
    terms = index.rare_terms(store, fx.QUESTION, store.manifest())
    return store.table("posting", inverted.POSTING, where=F.col("lexeme").isin(terms)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("SELECT vec_id::VARCHAR AS chunk_id, 'd' || vec_id AS doc_id, round(d, 6) AS distance FROM (SELECT vec_id, list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 11 <> 0 AND lang = 'fr') ORDER BY d, 1 LIMIT 40")
def stored_vector_search(s, d):
    found = vectors.vector_search(fx.indexed(s, d, vectors=True), fx.query_vector(s, d), allowed=search.allowed(["fr"]), exact=True)
    return search.shown(found.rows, "distance")


@query(_vector_sql("true", 40))
def vector_search(s, d):
    return search.shown(search.vector_search(fx.chunks(s, d), fx.query_vector(s, d)), "distance")


@query(_vector_sql("is_active AND doc_type IN ('en', 'fr') AND source = 'src1'", 40))
def vector_search_filtered(s, d):
    return search.shown(search.vector_search(search.searchable(fx.chunks(s, d), ["en", "fr"], {"source": "src1"}), fx.query_vector(s, d)), "distance")


@query(_fused_sql("true"))
def rrf_fuse(s, d):
    rows = fx.chunks(s, d)
    return search.shown(search.fuse(search.vector_search(rows, fx.query_vector(s, d)), search.text_search(rows, fx.QUESTION)), "score")


@query(_fused_sql("is_active"))
def hybrid_search(s, d):
    return search.shown(search.hybrid_search(fx.chunks(s, d), fx.QUESTION, fx.query_vector(s, d)), "score")


@query(f"""SELECT doc_id, chunk_id, score FROM ({_text_sql("true", 200)}) JOIN (SELECT chunk_id FROM ({_CHUNKS}) WHERE is_active) USING (chunk_id)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) = 1 ORDER BY score DESC, chunk_id LIMIT 3""")
def sample_matched(s, d):
    return search.sample_matched(fx.chunks(s, d), fx.QUESTION)


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders ORDER BY date DESC NULLS LAST, doc_id DESC LIMIT 3")
def sample_recent(s, d):
    day = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return search.sample_recent(fx.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct(day.alias("recall_date"))).alias("metadata")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_name || ' recalled by ' || p_brand ELSE p_name END AS subject FROM part""")
def title_subjects(s, d):
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, F.concat(F.lit("FDA drug recall "), F.col("p_name"), F.lit(" - "), F.col("p_brand"))).when(k == 1, F.concat(F.lit("CPSC consumer product recall: "), F.col("p_brand"), F.lit(" Recalls "), F.col("p_name"), F.lit(" Due to Fire; more"))).otherwise(F.concat(F.col("p_name"), F.lit(".;")))
    return fx.table(s, d, "part").select("p_partkey", search.title_subject(title, F.when(k == 0, "drug_recall").otherwise("cpsc_recall")).alias("subject"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def metadata_filter_number(s, d):
    # A number matches the number and its text.
    props = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"))))
    return fx.table(s, d, "events").where(search.metadata_filter(props, search.parse_filters(["k=7"]))).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 2 = 1 AND json_extract_string(props, '$.k') = '7'")
def metadata_filter_text(s, d):
    # A text matches text only, also one of digits.
    props = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"))))
    return fx.table(s, d, "events").where(search.metadata_filter(props, {"k": "7"})).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def stored_metadata_filter(s, d):
    return metadata.documents_with(fx.indexed_events(s, d), search.parse_filters(["k=7"])).select(F.col("doc_sk").alias("event_id"))


# Statistics and reports.
@query("""SELECT lang AS doc_type, count(*) FILTER (WHERE doc_id % 5 <> 0) AS documents, count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS active, count(*) AS versions,
count(*) FILTER (WHERE doc_id % 5 <> 0 AND c = e) AS indexed, coalesce(sum(c), 0)::BIGINT AS chunks, coalesce(sum(e), 0)::BIGINT AS embedded FROM documents LEFT JOIN (SELECT doc_id, count(*) AS c, count(quality) AS e FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1""")
def index_stats(s, d):
    versions = fx.table(s, d, "documents").select(F.col("doc_id").alias("doc_sk"), F.col("lang").alias("doc_type"), (F.col("doc_id") % 5 != 0).alias("is_current"), (F.col("doc_id") % 7 != 0).alias("is_active"))
    return ch.index_stats(versions, fx.table(s, d, "labels").select(F.col("doc_id").alias("doc_sk"), F.col("quality").alias("embedding")))


@query("SELECT lang AS doc_type, count(*) AS documents FROM documents GROUP BY 1")
def indexed_doc_types(s, d):
    return conversation.indexed_doc_types(fx.table(s, d, "documents").select(F.col("lang").alias("doc_type"), F.lit(True).alias("is_current"), F.lit(True).alias("is_active")))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS documents FROM orders GROUP BY 1")
def count_by_year(s, d):
    docs = fx.table(s, d, "orders").select(F.to_json(F.struct(F.year("o_orderdate").alias("year"))).alias("metadata"))
    return search.count_by(docs, "year").select(F.col("year").cast("int").alias("year"), "documents")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_filtered(s, d):
    meta = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date")))
    docs = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), meta.alias("metadata"), "o_orderdate")
    found = search.latest(docs, {"status": "F", "priority": "1"}, "date", 50)
    return found.select(F.col("doc_id").alias("o_orderkey"), "o_orderdate")


def _labelled(s, d):
    return fx.table(s, d, "documents").join(fx.table(s, d, "labels"), "doc_id", "left")


def _check(s, rows, check):
    return quality.run_checks(rows, (check,)).select("rule", "failed_rows", "total_rows", "passed")


_LABELLED = "documents LEFT JOIN labels USING (doc_id)"


@query(f"SELECT 'not_null' AS rule, count(*) FILTER (WHERE quality IS NULL) AS failed_rows, count(*) AS total_rows, count(*) FILTER (WHERE quality IS NULL) = 0 AS passed FROM {_LABELLED}")
def quality_not_null(s, d):
    return _check(s, _labelled(s, d), Check("not_null", "quality"))


@query("SELECT 'unique' AS rule, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS failed_rows, sum(n)::BIGINT AS total_rows, coalesce(sum(n) FILTER (WHERE n > 1), 0) = 0 AS passed FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def quality_unique(s, d):
    return _check(s, fx.table(s, d, "lineitem"), Check("unique", "l_orderkey"))


@query("SELECT 'allowed_values' AS rule, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS failed_rows, count(*) AS total_rows, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) = 0 AS passed FROM orders")
def quality_allowed_values(s, d):
    return _check(s, fx.table(s, d, "orders"), Check("allowed_values", "o_orderstatus", values=("O", "F")))


@query(f"SELECT 'max_null_fraction' AS rule, count(*) FILTER (WHERE quality IS NULL) AS failed_rows, count(*) AS total_rows, count(*) FILTER (WHERE quality IS NULL) <= 0.5 * count(*) AS passed FROM {_LABELLED}")
def quality_max_null_fraction(s, d):
    return _check(s, _labelled(s, d), Check("max_null_fraction", "quality", max=0.5))


@query("SELECT 'min_rows' AS rule, greatest(0, 5000 - count(*)) AS failed_rows, count(*) AS total_rows, count(*) >= 5000 AS passed FROM orders")
def quality_min_rows(s, d):
    return _check(s, fx.table(s, d, "orders"), Check("min_rows", min=5000))


# Questions and conversations.
_QUESTIONS = r"""SELECT conv_id, turn, conv_id % 8 AS n_filters, turn > 2 AS is_follow_up, CASE conv_id % 6 WHEN 0 THEN '  Hello!! ' WHEN 1 THEN substr(text, 1, 2) WHEN 2 THEN 'How many' || chr(9) || ' ' || substr(text, 1, 40) WHEN 3 THEN string_split(text, ' ')[1] ELSE text END AS question FROM conversations WHERE role = 'user'"""
_NORMAL = f"SELECT *, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS q, lower(strip_accents(trim(regexp_replace(question, '\\s+', ' ', 'g')))) AS f FROM ({_QUESTIONS})"
_BARE = """trim(f, ' .,!?;:"''`()[]…-')"""


@query(f"SELECT conv_id, turn, q AS normalised FROM ({_NORMAL})")
def normalise_question(s, d):
    return fx.questions(s, d).select("conv_id", "turn", normalise(F.col("question")).alias("normalised"))


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fold_text(s, d):
    return fx.table(s, d, "documents").select("doc_id", fold(F.col("text")).alias("folded"))


@query(f"""SELECT conv_id, turn, CASE r WHEN 'smalltalk' THEN 'clarify' WHEN 'limit:min_chars' THEN 'clarify' WHEN 'limit:min_words' THEN 'clarify' WHEN 'aggregate' THEN 'needs_sql' WHEN 'pass' THEN 'pass' ELSE 'reject' END AS decision, nullif(r, 'pass') AS rule_id FROM (
SELECT conv_id, turn, CASE WHEN {_BARE} IN ('hi', 'hello', 'hey', 'thanks', 'thank you', 'ok', 'bye') THEN 'smalltalk' WHEN length(q) < 3 THEN 'limit:min_chars' WHEN NOT is_follow_up AND len(string_split(q, ' ')) < 2 THEN 'limit:min_words'
WHEN length(q) > 2000 THEN 'limit:max_chars' WHEN n_filters > 5 THEN 'limit:max_filters' WHEN f LIKE '%ignore previous instructions%' OR f LIKE '%system prompt%' OR f LIKE '%disregard the above%' THEN 'injection'
WHEN f LIKE '%how many%' OR f LIKE '%total number%' OR f LIKE '%average %' OR f LIKE '%count of%' OR f LIKE '%tong so%' THEN 'aggregate' ELSE 'pass' END AS r FROM ({_NORMAL}))""")
def qualify(s, d):
    return gate.qualify(fx.questions(s, d), gate.DEFAULT).select("conv_id", "turn", "decision", "rule_id")


_LOG = """SELECT u.conv_id AS conversation_id, u.turn, u.text AS question, a.text AS answer, CASE WHEN (u.turn + u.conv_id) % 13 = 0 THEN 'timeout' END AS error, CASE (u.turn + u.conv_id) % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'pass' END AS decision
FROM (SELECT * FROM conversations WHERE role = 'user') u LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a USING (conv_id, turn)"""


@query(f"""SELECT conversation_id, turn, question, answer, row_number() OVER (PARTITION BY conversation_id ORDER BY turn)::INT AS n FROM (SELECT * FROM ({_LOG}) WHERE answer IS NOT NULL AND error IS NULL AND coalesce(decision, 'pass') = 'pass'
QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) <= 6)""")
def history_last6(s, d):
    return conversation.history(fx.turn_log(s, d))


@query(f"SELECT c.id AS conversation_id, coalesce(max(turn), 0) + 1 AS next_turn FROM (SELECT DISTINCT conv_id AS id FROM conversations UNION SELECT 999999) c LEFT JOIN ({_LOG}) ON conversation_id = c.id GROUP BY 1")
def next_turn(s, d):
    ids = fx.table(s, d, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct().union(s.range(999999, 1000000))
    return conversation.next_turn(ids, fx.turn_log(s, d))


@query(f"SELECT conversation_id, substr(arg_min(question, turn), 1, 120) AS title FROM ({_LOG}) GROUP BY 1")
def conversation_titles(s, d):
    return conversation.titles(fx.turn_log(s, d))


@query(f"SELECT c.conversation_id, c.created_at, count(turn) AS turns FROM (SELECT DISTINCT conv_id AS conversation_id, conv_id * 7 % 101 AS created_at FROM conversations) c LEFT JOIN ({_LOG}) l ON l.conversation_id = c.conversation_id GROUP BY 1, 2 ORDER BY 2 DESC, 1 LIMIT 20")
def conversation_list(s, d):
    ids = fx.table(s, d, "conversations").select(F.col("conv_id").alias("conversation_id"), (F.col("conv_id") * 7 % 101).alias("created_at")).distinct()
    return conversation.listed(ids, fx.turn_log(s, d), 20)


@query("SELECT count(*) AS used FROM events WHERE ts >= date_trunc('day', (SELECT max(ts) FROM events))")
def used_today(s, d):
    log = fx.table(s, d, "events").withColumnRenamed("ts", "asked_at")
    return conversation.used_today(log, log.agg(F.max("asked_at")).first()[0])


_CITED = "SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN '' ELSE ' [' || (turn + 1) || '] and [2, ' || (conv_id % 9) || ']' END AS answer FROM conversations WHERE role = 'assistant'"


@query(f"""SELECT conv_id, turn, array_to_string(CASE WHEN len(hit) > 0 THEN hit ELSE range(1, 6) END, ',') AS cited FROM (SELECT conv_id, turn,
list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(answer, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda x: string_split(x, ','))), lambda x: trim(x)::BIGINT), lambda x: x BETWEEN 1 AND 5))) AS hit FROM ({_CITED}))""")
def citations(s, d):
    tail = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] and [2, "), (F.col("conv_id") % 9).cast("string"), F.lit("]")))
    rows = fx.table(s, d, "conversations").where("role = 'assistant'").withColumn("answer", F.concat("text", tail))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(conversation.mark_cited(F.col("answer"), F.lit(5))).cast("array<string>"), ",").alias("cited"))


@query("""SELECT conv_id AS conversation_id, turn, n, 'doc:' || k AS doc_id, CASE WHEN k < 100 THEN 'T' || k END AS title FROM (SELECT conv_id, turn, 1 AS n, conv_id AS k FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 2, conv_id * 2 FROM conversations WHERE role = 'user')""")
def turn_sources(s, d):
    ids = F.array(F.concat(F.lit("doc:"), F.col("conv_id").cast("string")), F.concat(F.lit("doc:"), (F.col("conv_id") * 2).cast("string")))
    log = fx.table(s, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("conversation_id"), "turn", F.to_json(ids).alias("retrieved"))
    docs = s.range(100).select(F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("doc_id"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"))
    return conversation.turn_sources(log, docs)


@query("""SELECT string_agg('[' || r || '] d' || doc_id || chr(10) || CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || ' ...' ELSE text END, chr(10) || chr(10) ORDER BY r) AS context FROM (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text FROM documents ORDER BY doc_id LIMIT 5)""")
def context_block(s, d):
    top = fx.table(s, d, "documents").orderBy("doc_id").limit(5)
    ranks = top.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), "text", "doc_id")
    from pyspark.sql import Window

    return search.context_block(ranks.withColumn("rank", F.row_number().over(Window.orderBy("doc_id"))), 100)


# Catalog.
_TABLE_KEYS = [("region", ["r"]), ("nation", ["r", "n"]), ("customer", ["r", "n", "c"]), ("orders", ["o"]), ("lineitem", ["o", "l"]), ("notes", [])]


@query("""WITH k(table_name, key) AS (VALUES ('region', ['r']), ('nation', ['r', 'n']), ('customer', ['r', 'n', 'c']), ('orders', ['o']), ('lineitem', ['o', 'l']))
SELECT p.table_name AS parent, c.table_name AS child, array_to_string(p.key, ',') AS columns FROM k p JOIN k c ON len(c.key) > len(p.key) AND c.key[1:len(p.key)] = p.key""")
def infer_relationships(s, d):
    return catalog.infer_relationships(s.createDataFrame(_TABLE_KEYS, "table_name string, key array<string>"))


@query()
def schema_digest(s, d):
    names = ("region", "nation", "customer", "orders", "lineitem")
    found = catalog.read_catalog({n: fx.table(s, d, n) for n in names}, {"orders": ("o_orderkey",), "customer": ("c_custkey",)})
    return s.createDataFrame([(found.digest(), len(found.tables))], "digest string, tables int")


@query()
def question_chunks(s, d):
    turns = fx.table(s, d, "conversations").select("conv_id", "turn", F.explode(cut(F.col("text"), 400, 60)).alias("chunk"))
    return turns.groupBy("conv_id", "turn").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"))


# More of the same operators: re-chunking, suggestions, prompts, keys.
_LINES = "SELECT doc_id AS doc_sk, (ord - 1)::INT AS ord, CASE WHEN doc_id % 5 = 0 THEN l || '!' ELSE l END AS fresh, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)"


@query(f"SELECT doc_sk FROM (SELECT doc_sk, list(sha256(l) ORDER BY ord) AS was, list(sha256(fresh) ORDER BY ord) AS now FROM ({_LINES}) GROUP BY 1) WHERE was = now")
def same_chunks(s, d):
    lines = fx.table(s, d, "documents").select(F.col("doc_id").alias("doc_sk"), F.posexplode(F.split("text", "\n")).alias("ord", "l"))
    fresh = F.when(F.col("doc_sk") % 5 == 0, F.concat("l", F.lit("!"))).otherwise(F.col("l"))
    hashed = lambda c: lines.select("doc_sk", "ord", F.sha2(c, 256).alias("text_hash"))
    return ch.same_chunks(hashed(F.col("l")), hashed(fresh))


@query(f"""SELECT doc_id, CASE WHEN action IN ('insert', 'new_version') THEN action WHEN p_is_active <> is_active AND k % 2 = 1 THEN 'new_version' WHEN p_is_active <> is_active THEN 'new_version_move_chunks'
WHEN k % 2 = 1 THEN 'rechunk' ELSE action END AS action FROM ({_DECIDED})""")
def scd2_decide_rechunk(s, d):
    same = fx.incoming(s, d).select("doc_id").where(F.split_part("doc_id", F.lit(":"), F.lit(2)).cast("long") % 2 == 0)
    return scd2.decide(scd2.current_versions(fx.versions(s, d)), fx.incoming(s, d), rechunk_all=True, same_chunks=same).select("doc_id", "action")


@query(f"SELECT doc_id, CASE WHEN action = 'new_version_move_chunks' THEN 'overwrite' ELSE action END AS action FROM ({_DECIDED})")
def scd2_decide_in_place(s, d):
    from evidence.rules.spec import History

    return scd2.decide(scd2.current_versions(fx.versions(s, d)), fx.incoming(s, d), History(version_on_activation_change=False)).select("doc_id", "action")


@query("SELECT 'What do the records say about ' || p_brand || '?' AS question, min(p_partkey) AS doc_id FROM part GROUP BY 1")
def sample_questions(s, d):
    rows = fx.table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("title"), F.lit("other").alias("doc_type"))
    return search.sample_questions(rows)


@query("""SELECT conversation_id, string_agg('Q: ' || CASE WHEN length(question) > 80 THEN rtrim(substr(question, 1, 76), ' ') || ' ...' ELSE question END || chr(10) || 'A: ' || CASE WHEN length(answer) > 80 THEN rtrim(substr(answer, 1, 76), ' ') || ' ...' ELSE answer END, chr(10) ORDER BY turn) AS block
FROM (%s) WHERE answer IS NOT NULL GROUP BY 1""" % _LOG)
def history_block(s, d):
    return conversation.history_block(fx.turn_log(s, d).where("answer is not null"), 80)


@query(f"""SELECT conversation_id, string_agg(n || '. ' || question, chr(10) ORDER BY n) AS block FROM (SELECT conversation_id, question, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS n FROM (SELECT * FROM ({_LOG})
WHERE answer IS NOT NULL AND error IS NULL AND coalesce(decision, 'pass') = 'pass' QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) <= 6)) GROUP BY 1""")
def questions_block(s, d):
    return conversation.questions_block(conversation.history(fx.turn_log(s, d)))


@query(f"""SELECT conversation_id, turn, CASE WHEN k % 3 = 0 THEN 'before ' || question WHEN k % 3 = 1 THEN 'What about it now?'
WHEN length(regexp_replace('Well: ' || question, '\\s+', ' ', 'g')) >= 20 OR length(question) > 994 THEN question ELSE 'Well: ' || question END AS condensed
FROM (SELECT *, conversation_id + turn AS k FROM (SELECT conversation_id, turn, trim(string_split(replace(question, chr(34), ''), chr(10))[1], ' ''') AS question FROM ({_LOG}))) WHERE length(question) > 0""")
def condense(s, d):
    one = F.btrim(F.split_part(F.regexp_replace("question", '"', ""), F.lit("\n"), F.lit(1)), F.lit(" '"))
    rows = fx.turn_log(s, d).select("conversation_id", "turn", one.alias("question")).where("length(question) > 0")
    k = (F.col("conversation_id") + F.col("turn")) % 3
    rewrite = F.when(k == 0, F.lit(None)).when(k == 1, 'Question: "What about it now?"').otherwise(F.concat(F.lit("Well: "), F.col("question")))
    told = F.array(F.concat(F.lit("So.  well:  "), F.col("question"), F.lit(" Indeed.")))
    return rows.select("conversation_id", "turn", conversation.condensed(F.lit("before"), F.col("question"), rewrite, told).alias("condensed"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'That question was not answered.' ELSE 'No: ' || role END || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'SELECT 1' ELSE '' END AS answer FROM conversations")
def blocked_answers(s, d):
    message = F.when(F.col("turn") % 2 != 0, F.concat(F.lit("No: "), F.col("role")))
    return fx.table(s, d, "conversations").select("conv_id", "turn", gate.blocked_answer(message, F.when(F.col("conv_id") % 2 == 0, "SELECT 1")).alias("answer"))


@query("""SELECT 'orders' AS table_name, (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS holds
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) = 0""")
def verify_keys(s, d):
    keys = {"orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber")}
    return s.createDataFrame([(n, catalog.verify_key(fx.table(s, d, n), k)) for n, k in keys.items()], "table_name string, holds boolean")


_COLUMNS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"],
            "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}
_KEY_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT count(*) = count(DISTINCT {c}) FROM {t}) AS holds" for t, cs in _COLUMNS.items() for c in cs)
_REFERENCE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS child, '{c}' AS column_name, '{p}' AS parent, '{k}' AS key WHERE (SELECT count(*) = count(DISTINCT {k}) FROM {p}) AND (SELECT count({c}) > 0 FROM {t}) AND NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p}))"
    for t, cs in _COLUMNS.items() for c in cs for p, ks in _COLUMNS.items() for k in ks if (t, c) != (p, k)
)


def _keyed_tables(s, d):
    # Keys as long, whatever the files hold: columns of two kinds refer to nothing.
    return {t: fx.table(s, d, t).select(*(F.col(c).cast("long").alias(c) for c in cs)) for t, cs in _COLUMNS.items()}


@query(f"SELECT table_name, column_name FROM ({_KEY_SQL}) WHERE holds")
def found_keys(s, d):
    return s.createDataFrame([(t, c) for t, df in _keyed_tables(s, d).items() for c in catalog.find_keys(df)], "table_name string, column_name string")


@query(_REFERENCE_SQL)
def found_references(s, d):
    return s.createDataFrame(catalog.find_references(_keyed_tables(s, d)), "child string, column_name string, parent string, key string")


@query("SELECT event_type AS source_id, max(event_id) AS head, count(*) AS changes FROM events GROUP BY 1")
def heads_by_source(s, d):
    from evidence.streaming.changelog import head_by_source

    return head_by_source(fx.change_log(s, d))
