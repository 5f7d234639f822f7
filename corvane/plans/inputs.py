"""Engine inputs derived from the driver's tables.

Each derivation is one SQL text that Spark and DuckDB both run, so a query and its SQL
counterpart start from the same rows. None orders a whole table: every window has a key.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.index import Index, open_index, write_search_index
from corvane.session import shared_dir

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Ledger position used by the pinned queries, half of the head, and in SQL.
PIN = "(SELECT max(o_orderkey) // 2 FROM orders)"
HEAD = "(SELECT max(o_orderkey) FROM orders)"


def head_at(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "orders").agg({"o_orderkey": "max"}).first()[0]


def pin_at(spark: SparkSession, sf_dir: str) -> int:
    return head_at(spark, sf_dir) // 2


DERIVED = {
    "claims": """
        SELECT CONCAT('c', CAST(o_orderkey AS STRING)) AS id,
               CONCAT('v', CAST(LEAST(4, 1 + CAST(FLOOR(o_orderkey / 4000) AS BIGINT)) AS STRING)) AS version_id,
               o_orderkey AS seq,
               CASE WHEN n % 2 = 0 THEN 'correction' ELSE 'fact' END AS claim_type,
               CONCAT('cust-', CAST(o_custkey AS STRING)) AS subject,
               CASE WHEN o_orderkey % 7 = 0 THEN 'status' ELSE 'priority' END AS key,
               CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CONCAT('seg.', c_mktsegment) END AS scope_path,
               CASE WHEN o_orderstatus = 'P' THEN 'disputed' ELSE 'accepted' END AS status,
               CASE WHEN n % 2 = 0 THEN CONCAT('c', CAST(prev AS STRING)) END AS supersedes_id
        FROM (SELECT o.*, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
                     LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev
              FROM orders o) x
        JOIN customer ON c_custkey = o_custkey""",
    "versions": """
        SELECT * FROM (VALUES ('v1', CAST(NULL AS STRING), 'closed'), ('v2', 'v1', 'closed'), ('v3', 'v2', 'closed'),
                              ('v4', 'v3', 'open'), ('w2', 'v1', 'open'), ('w3', 'w2', 'open')) AS t(id, parent_id, status)""",
    "anchors": """
        SELECT CONCAT('a', CAST(o_orderkey AS STRING)) AS id, CONCAT('v', CAST(1 + o_orderkey % 4 AS STRING)) AS version_id,
               CONCAT('cust-', CAST(o_custkey AS STRING), '.priority') AS detail_key,
               o_orderpriority AS locked_value, o_orderkey AS seq, o_orderkey % 3 <> 0 AS locked
        FROM orders""",
    "promises": """
        SELECT CONCAT('p', CAST(o_orderkey AS STRING)) AS id, CONCAT('cust-', CAST(o_custkey AS STRING)) AS subject,
               o_orderkey AS seq, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS fulfilled_seq,
               CONCAT('ch', CAST(1 + o_orderkey % 9 AS STRING)) AS due_scope,
               CONCAT('order-', CAST(o_orderkey AS STRING)) AS key, CONCAT('ship ', o_orderpriority) AS description
        FROM orders""",
    "counters": """
        SELECT CONCAT('v', CAST(1 + o_orderkey % 4 AS STRING)) AS version_id, o_orderpriority AS key,
               c_mktsegment AS scope_path, CAST(1 + o_orderkey % 3 AS BIGINT) AS count,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(900 + o_custkey % 400 AS BIGINT) END AS budget, o_orderkey AS seq
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "candidates": """
        SELECT CONCAT('k', CAST(o_orderkey AS STRING)) AS cid,
               CASE WHEN o_orderkey % 3 = 0 THEN 'correction' ELSE 'fact' END AS claim_type,
               CONCAT('cust-', CAST(CASE WHEN o_orderkey % 8 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS STRING)) AS subject,
               'priority' AS key, CONCAT(' ', UPPER(o_orderpriority), CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' new' END) AS value,
               CASE WHEN o_orderkey % 9 = 0 THEN CONCAT('c', CAST(o_orderkey AS STRING)) END AS supersedes_id,
               CONCAT('Order ', o_orderpriority, CASE o_orderkey % 8 WHEN 0 THEN ' as an AI, I''m sorry, but [insert name]' WHEN 3 THEN ' Lorem Ipsum as a Language Model' WHEN 5 THEN ' the author: I CANNOT ASSIST' ELSE '' END) AS text
        FROM orders""",
    "interactions": """
        SELECT event_id AS id, CONCAT('u', CAST(user_id AS STRING)) AS uid,
               CASE WHEN user_id % 3 = 0 THEN NULL ELSE CONCAT('s', CAST(user_id % 40 AS STRING)) END AS session_id,
               event_type AS method, CASE WHEN event_id % 4 = 0 THEN CONCAT('rb-', CAST(event_id % 5 AS STRING)) END AS runbook_ref,
               CASE WHEN event_type = 'error' THEN 500 WHEN value < 5 THEN 404 ELSE 200 END AS status,
               CAST(ROUND(value * 10) AS BIGINT) AS latency_ms, ts AS created_at, props,
               CASE event_id % 4 WHEN 0 THEN SPLIT('docs,faq', ',') WHEN 1 THEN SPLIT('ops', ',') WHEN 2 THEN SPLIT('docs,ops,old', ',') END AS collection_ids
        FROM events""",
    "turns": """
        SELECT CONCAT('s', CAST(conv_id % 40 AS STRING)) AS session_id, conv_id, turn AS ordinal, role, text AS query,
               CAST(FLOOR(LENGTH(text) / 4) AS BIGINT) AS tokens,
               CASE role WHEN 'assistant' THEN 'modelA' WHEN 'user' THEN 'modelB' ELSE 'modelC' END AS model,
               CONCAT('prov', CAST(conv_id % 3 AS STRING)) AS provider, CONCAT('u', CAST(conv_id % 40 AS STRING)) AS uid,
               CASE WHEN turn % 3 <> 0 THEN CAST(FLOOR(LENGTH(text) / 4) AS BIGINT) END AS input_tokens, CAST(FLOOR(LENGTH(text) / 8) AS BIGINT) AS output_tokens,
               CASE conv_id % 3 WHEN 0 THEN SPLIT('docs,new', ',') WHEN 1 THEN SPLIT('faq', ',') END AS collections_searched,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (CAST(conv_id AS INT) % 600) AS created_at
        FROM conversations""",
    "sessions": """
        SELECT DISTINCT CONCAT('s', CAST(conv_id % 40 AS STRING)) AS id, CONCAT('u', CAST(conv_id % 40 AS STRING)) AS uid,
               CONCAT('rb-', CAST(conv_id % 40 % 7 AS STRING)) AS runbook_ref,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (CAST(conv_id % 40 AS INT) * 13) AS opened_at
        FROM conversations""",
    "sources": """
        SELECT CONCAT('src-', CAST(d.doc_id AS STRING)) AS source_id, lang AS collection, CONCAT(source, '/', CAST(d.doc_id AS STRING)) AS path,
               MD5(text) AS content_hash, text, COALESCE(toxic, 0) AS access_level,
               CASE WHEN d.doc_id % 5 = 0 THEN 'application/pdf' WHEN d.doc_id % 7 = 0 THEN 'text/markdown' ELSE 'text/plain' END AS media_type
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "publications": """
        SELECT CONCAT('pub', CAST(o_orderkey AS STRING)) AS id, CONCAT('doc', CAST(o_custkey AS STRING)) AS document_id,
               CONCAT('col', CAST(CAST(FLOOR(o_custkey / 2) AS BIGINT) AS STRING)) AS collection,
               CASE WHEN o_custkey % 37 = 5 THEN DATE '1996-01-01' ELSE CAST(o_orderdate AS DATE) END AS effective_from,
               CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + INTERVAL '400' DAY END AS effective_until,
               CASE WHEN o_custkey % 37 = 5 THEN 7 ELSE o_orderkey END AS published_at, CASE WHEN o_orderstatus = 'P' THEN 'withdrawn' ELSE 'published' END AS state
        FROM orders""",
    "relations": """
        SELECT CONCAT('doc', CAST(o_custkey AS STRING)) AS from_document, CONCAT('doc', CAST(o_custkey + 1 AS STRING)) AS to_document,
               CASE o_orderkey % 7 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'requires' WHEN 2 THEN 'conflicts' WHEN 3 THEN 'amends' WHEN 4 THEN 'applies-to' WHEN 5 THEN 'exception-to' ELSE 'cites' END AS kind,
               CAST(o_orderdate AS DATE) AS effective_from,
               CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) + INTERVAL '60' DAY END AS effective_until
        FROM orders""",
    "prices": """
        SELECT p_partkey AS id, CONCAT('prov', CAST(p_size % 3 AS STRING)) AS provider, SHA2(CONCAT('route', CAST(p_partkey % 2 AS STRING)), 256) AS route,
               CONCAT('m', CAST(p_partkey % 7 AS STRING)) AS model, CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
               CAST(DATE '1995-01-01' + INTERVAL '1' DAY * (p_size * 45) AS DATE) AS valid_from,
               CAST(DATE '1995-01-01' + INTERVAL '1' DAY * (p_size * 45 + 90) AS DATE) AS valid_until,
               CASE WHEN p_partkey % 3 = 0 THEN 'partitioned' ELSE 'inclusive' END AS basis, CAST(1000 + p_partkey % 3 AS BIGINT) AS per_tokens,
               CAST(ROUND(p_retailprice * 100) AS BIGINT) AS input_micro, CASE WHEN p_partkey % 11 <> 4 THEN CAST(ROUND(p_retailprice * 300) AS BIGINT) END AS output_micro,
               CASE WHEN p_partkey % 3 = 0 OR p_partkey % 13 = 1 THEN CAST(ROUND(p_retailprice * 10) AS BIGINT) END AS cache_micro,
               CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 5 AS BIGINT) END AS context_micro
        FROM part""",
    "attempts": """
        SELECT l_orderkey AS id, CONCAT('prov', CAST(l_orderkey % 3 AS STRING)) AS provider, SHA2(CONCAT('route', CAST(l_orderkey % 2 AS STRING)), 256) AS route,
               CONCAT('m', CAST(l_orderkey % 7 AS STRING)) AS model, CAST(MIN(l_shipdate) AS DATE) AS submitted_at, CAST(SUM(l_quantity) * 10 AS BIGINT) AS input,
               CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE CAST(SUM(l_linenumber) * 10 AS BIGINT) END AS output,
               CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(SUM(l_quantity) AS BIGINT) END AS cache_read,
               CASE WHEN l_orderkey % 17 = 0 THEN CAST(SUM(l_quantity) * 10 AS BIGINT) ELSE CAST(COUNT(*) AS BIGINT) END AS cache_write,
               CASE WHEN l_orderkey % 19 = 0 THEN CAST(SUM(l_linenumber) * 11 AS BIGINT) ELSE CAST(COUNT(*) AS BIGINT) END AS reasoning,
               CASE WHEN l_orderkey % 23 = 0 THEN CAST(4 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS context, l_orderkey % 29 = 0 AS unknown_categories
        FROM lineitem GROUP BY l_orderkey""",
    "observations": """
        SELECT l_orderkey AS attempt_id, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS BIGINT) AS revision,
               CASE WHEN l_returnflag = 'R' THEN 'partial' WHEN l_returnflag = 'A' THEN 'unknown' ELSE 'complete' END AS coverage,
               CAST(ROUND(l_extendedprice * 1000) AS BIGINT) AS micros, CASE WHEN l_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency
        FROM lineitem""",
    "reservations": """
        SELECT o_orderkey AS id, o_orderpriority AS config_name, c_mktsegment AS tier, CAST(o_orderdate AS DATE) AS day,
               CAST(ROUND(o_totalprice) AS BIGINT) AS units,
               CASE o_orderstatus WHEN 'O' THEN 'held' WHEN 'F' THEN 'settled' ELSE 'released' END AS state
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "limits": """
        SELECT DISTINCT o_orderpriority AS config_name, c_mktsegment AS tier, CAST(5000000 AS BIGINT) AS daily_limit
        FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '5-LOW'
        UNION ALL SELECT 'unused', 'NONE', CAST(1 AS BIGINT)""",
    "findings": """
        SELECT l_orderkey AS claim_no, CONCAT('rule_', l_returnflag, '.', CASE WHEN l_linenumber % 2 = 0 THEN 'x%y' ELSE 'x_y' END) AS rule_id,
               CASE l_linenumber % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' ELSE 'block' END AS severity,
               CONCAT('msg ', CAST(l_partkey AS STRING)) AS message, CONCAT('s', CAST(l_suppkey % 10 AS STRING)) AS scope_path,
               l_orderkey AS seq
        FROM lineitem""",
    "jobs": """
        SELECT event_id AS id, event_type AS queue, ts AS created_at,
               CASE user_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' ELSE 'done' END AS state,
               ts + INTERVAL '1' MINUTE * CAST(FLOOR(value) AS INT) AS lease_until, CAST(user_id % 5 AS INT) AS attempt
        FROM events""",
    "chain_events": """
        SELECT CONCAT('src', CAST(user_id AS STRING)) AS source, event_id, 1 AS epoch, event_id AS arrival,
               CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sequence,
               MD5(CONCAT(CAST(event_id AS STRING), event_type)) AS digest,
               CASE WHEN event_id % 89 = 0 THEN 'broken'
                    ELSE LAG(MD5(CONCAT(CAST(event_id AS STRING), event_type))) OVER (PARTITION BY user_id ORDER BY event_id) END AS prior_digest
        FROM events""",
    "lex": """
        SELECT lang AS pool, CONCAT('d', CAST(doc_id AS STRING)) AS chunk_id, CAST(n_chars AS DOUBLE) AS score, doc_id % 2 = 0 AS is_probe,
               CONCAT('dom', CAST(doc_id % 3 AS STRING)) AS domain
        FROM documents""",
    "vec": """
        SELECT lang AS pool, CONCAT('d', CAST(doc_id AS STRING)) AS chunk_id, CAST((n_chars * 7919) % 1009 AS DOUBLE) / 1009 AS score, doc_id % 2 = 0 AS is_probe,
               CONCAT('dom', CAST(doc_id % 3 AS STRING)) AS domain
        FROM documents""",
    "when_facts": """
        SELECT subject, key, seq, claim_id, candidate, way, day,
               CASE way WHEN 0 THEN iso WHEN 1 THEN SUBSTRING(iso, 1, 7) WHEN 2 THEN y WHEN 3 THEN CONCAT(mon, ' ', y) WHEN 4 THEN CONCAT('circa ', y)
                        WHEN 5 THEN CONCAT('approx. ', y) WHEN 6 THEN CONCAT('~', mon, ' ', y) WHEN 7 THEN CONCAT(mon, ' ', CAST(dd AS STRING), ', ', y)
                        WHEN 8 THEN CONCAT(CAST(dd AS STRING), CASE WHEN dd IN (1, 21, 31) THEN 'st' WHEN dd IN (2, 22) THEN 'nd' WHEN dd IN (3, 23) THEN 'rd' ELSE 'th' END, ' ', mon, ' ', y)
                        WHEN 9 THEN CONCAT(y, ' to ', CAST(CAST(y AS INT) + 3 AS STRING)) WHEN 10 THEN CONCAT('Jan-April ', y) WHEN 11 THEN CONCAT('Spring ', y)
                        WHEN 12 THEN CONCAT('winter ', y) WHEN 13 THEN CONCAT('janx ', y) ELSE CONCAT(SUBSTRING(iso, 1, 7), '-5') END AS value
        FROM (SELECT CONCAT('cust-', CAST(o_custkey AS STRING)) AS subject,
                     CASE o_orderkey % 4 WHEN 0 THEN 'start_date' WHEN 1 THEN 'end_date' WHEN 2 THEN 'filed_on' ELSE 'review_due' END AS key,
                     o_orderkey AS seq, CONCAT('c', CAST(o_orderkey AS STRING)) AS claim_id, o_orderkey % 10 IN (0, 3) AS candidate,
                     CASE WHEN o_orderkey % 3 = 0 THEN CAST((o_orderkey * 7) % 15 AS INT) ELSE 0 END AS way, CAST(o_orderdate AS DATE) AS day,
                     CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso, SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) AS y,
                     CAST(SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) AS INT) AS dd,
                     CASE SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) WHEN '01' THEN 'January' WHEN '02' THEN 'Feb' WHEN '03' THEN 'mar.' WHEN '04' THEN 'April'
                          WHEN '05' THEN 'May' WHEN '06' THEN 'june' WHEN '07' THEN 'JUL' WHEN '08' THEN 'Aug.' WHEN '09' THEN 'Sept' WHEN '10' THEN 'October' WHEN '11' THEN 'Nov' ELSE 'december' END AS mon
              FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 2 = 1 THEN TIMESTAMP '1998-03-04 00:00:00' ELSE o_orderdate END AS o_orderdate FROM orders) o) x""",
    "metrics": """
        SELECT l_returnflag AS profile, l_linestatus AS layer, CAST(l_partkey % 5 AS INT) AS refusals_code, l_discount > 0.05 AS complete,
               CAST(ROUND(l_extendedprice) AS BIGINT) AS latency_ms, l_quantity > 40 AS refused
        FROM lineitem""",
    "manifest": """
        SELECT CONCAT(source, '/', CAST(doc_id AS STRING)) AS path,
               CASE WHEN doc_id % 6 = 0 THEN MD5(CONCAT(text, 'x')) ELSE MD5(text) END AS content_hash, doc_id % 5 = 0 AS binds
        FROM documents WHERE lang <> 'es'""",
    "stored": """
        SELECT CONCAT(source, '/', CAST(doc_id AS STRING)) AS path, MD5(text) AS content_hash, doc_id % 2 = 0 AS bound
        FROM documents WHERE source <> 'src1'""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input. The driver's tables are bound as arguments, not as global views."""
    sql = DERIVED[name]
    frames = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES if _names(sql, t)}
    bound = reduce(lambda s, t: _bind(s, t), frames, sql)
    return spark.sql(bound, **frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return ";".join(sorted(f"{f.getPath()},{f.getLen()},{f.getModificationTime()}" for f in files))


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    """The search index over all documents, a chunk each, with the embeddings of those that have one.

    Built by the first query of an application that needs it, and opened by the others as long as the tables' files are the same.
    """
    base = sf_dir.rstrip("/")
    state = hashlib.sha256("|".join(_state(spark, f"{base}/{t}.parquet") for t in ("documents", "embeddings")).encode()).hexdigest()
    path = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/documents-{state[:16]}"
    found = open_index(spark, path)
    if found is None:
        docs = table(spark, sf_dir, "documents").select(
            F.col("lang").alias("collection"), F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"), F.col("doc_id").alias("vec_id"), "text"
        )
        vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        found = write_search_index(docs.join(vectors, "vec_id", "left").drop("vec_id"), path)
    return found


def _names(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) is not None


def _bind(sql: str, name: str) -> str:
    return re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", sql)


def ctes(*names: str) -> str:
    """``WITH`` clause of the derived inputs, for the SQL counterparts. Only the hash function has another name there."""
    said = {n: re.sub(r"SHA2\((.*?), 256\)", r"SHA256(\1)", DERIVED[n].strip()) for n in names}
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in said.items())
