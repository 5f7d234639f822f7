"""Registered queries of whole turns, the life of runs and sessions, and analysis of English."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.analyzer import english_lexemes, structured_tokens
from corvane.operators import governance, orchestration
from corvane.operators.access import Principal
from corvane.operators.retrieval import RetrievalSpec
from corvane.plans.inputs import ctes, derived, document_index, table
from corvane.plans.queries_reports import _DAY, _RULING, _verdicts
from corvane.plans.queries_retrieval import _NEAR, _parts_sql, _query_vector, _sum, _tok
from corvane.plans.registry import query
from corvane.session import small_batches


def _pools_sql(score: str, least: str, n: int) -> tuple[str, str]:
    """The best ``n`` of each pool in either leg, as SQL over ``parts`` and ``near``."""
    lexical = f"""SELECT * FROM (SELECT collection AS pool, chunk_id, {score} AS score, row_number() OVER (PARTITION BY collection ORDER BY {score} DESC, chunk_id) AS rank FROM parts
        WHERE {least} >= 1) WHERE rank <= {n}"""
    vector = f"SELECT * FROM (SELECT collection AS pool, chunk_id, score, row_number() OVER (PARTITION BY collection ORDER BY score, chunk_id) AS rank FROM near) WHERE rank <= {n}"
    return lexical, vector


_FUSE = """r AS (SELECT pool, chunk_id, (CASE WHEN is_probe THEN 0.5 ELSE 1.0 END) / (60 + row_number() OVER (PARTITION BY is_probe ORDER BY score DESC, chunk_id)) AS part FROM ml
        UNION ALL SELECT pool, chunk_id, (CASE WHEN is_probe THEN 0.5 ELSE 1.0 END) / (60 + row_number() OVER (PARTITION BY is_probe ORDER BY score, chunk_id)) FROM mv)"""


def _retrieve_sql(top: int) -> str:
    """Probe with 'idiot de la', choose two collections, search them with 'moron' besides, merge."""
    o, w = _sum("p", 3), _sum("p", 4)
    lp, vp = _pools_sql(o, _sum("m", 3), 50)
    ld, vd = _pools_sql(f"0.5 * ({o}) + 0.5 * ({w})", _sum("m", 4), 100)
    return f"""{_parts_sql(["idiot", "de", "la", "moron"])}, {_NEAR}, lp AS ({lp}), vp AS ({vp}), ld AS ({ld}), vd AS ({vd}),
        hits AS (SELECT * FROM (SELECT pool, chunk_id, row_number() OVER (PARTITION BY pool ORDER BY sum(part) DESC, chunk_id) AS n
            FROM (SELECT pool, chunk_id, 1.0 / (60 + rank) AS part FROM lp UNION ALL SELECT pool, chunk_id, 1.0 / (60 + rank) FROM vp) GROUP BY pool, chunk_id) WHERE n <= 50),
        ph AS (SELECT pool, count(*) FILTER (contains(t, ' idiot de ') OR contains(t, ' de la ')) / count(*) AS f
            FROM hits JOIN (SELECT 'd' || CAST(doc_id AS VARCHAR) AS chunk_id, ' ' || array_to_string({_tok()}, ' ') || ' ' AS t FROM documents) USING (chunk_id) GROUP BY pool),
        a AS (SELECT pool, sum(score) AS le FROM lp WHERE rank <= 3 GROUP BY 1), b AS (SELECT pool, -sum(score) AS ve FROM vp WHERE rank <= 3 GROUP BY 1),
        ev AS (SELECT pool, row_number() OVER (ORDER BY le * (1 + 3.0 * coalesce(f, 0)) DESC NULLS LAST, ve DESC NULLS LAST, pool) AS rk FROM a FULL OUTER JOIN b USING (pool) LEFT JOIN ph USING (pool)),
        ml AS (SELECT pool, chunk_id, score, false AS is_probe FROM ld WHERE pool IN (SELECT pool FROM ev WHERE rk <= 2) UNION ALL SELECT pool, chunk_id, score, true FROM lp WHERE pool NOT IN (SELECT pool FROM ev WHERE rk <= 2)),
        mv AS (SELECT pool, chunk_id, score, false AS is_probe FROM vd WHERE pool IN (SELECT pool FROM ev WHERE rk <= 2) UNION ALL SELECT pool, chunk_id, score, true FROM vp WHERE pool NOT IN (SELECT pool FROM ev WHERE rk <= 2)),
        {_FUSE},
        best AS (SELECT pool AS collection, chunk_id, sum(part) + coalesce(0.5 / (60 + any_value(rk)), 0) AS score FROM r LEFT JOIN ev USING (pool) GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT {top})"""


_SPEC = RetrievalSpec(
    max_collections=2, collection_evidence_weight=0.5, unselected_pool_weight=0.5, query_expansions=[(["idiot"], ["moron"])], query_expansion_weight=0.5
)


@query("retrieve_documents", f"WITH {_retrieve_sql(10)} SELECT collection, chunk_id, round(score, 9) AS score FROM best")
def retrieve_documents(spark, d):
    """Probe, choose, search, merge."""
    found = orchestration.retrieve_documents(document_index(spark, d), "idiot de la", _SPEC, query_vector=_query_vector(spark, d))
    return found.withColumn("score", F.round("score", 9))


_VL, _VV = _pools_sql(_sum("p", 3), _sum("m", 3), 100)


@query(
    "vocabulary_search",
    f"""WITH {_parts_sql(["fool", "idiot", "moron"])}, {_NEAR}, ml AS (SELECT *, false AS is_probe FROM ({_VL})), mv AS (SELECT *, false AS is_probe FROM ({_VV})), {_FUSE}
        SELECT pool AS collection, chunk_id, round(sum(part), 9) AS score FROM r GROUP BY 1, 2 ORDER BY sum(part) DESC, chunk_id LIMIT 10""",
)
def vocabulary_search(spark, d):
    found = orchestration.vocabulary_search(document_index(spark, d), "fool", [["fool", "idiot", "moron"]], query_vector=_query_vector(spark, d))
    return found.withColumn("score", F.round("score", 9))


def _governed_sql(policies: str) -> str:
    """Passages of governing documents of the policies asked; none if a document of one of them is undecided."""
    return f"""{_RULING.replace("WITH ", "WITH RECURSIVE ", 1)}, {_retrieve_sql(100)},
        asked AS (SELECT * FROM ruling r WHERE {policies}),
        docs AS (SELECT * FROM documents WHERE doc_id % 3 <= 1 AND NOT EXISTS (SELECT 1 FROM asked WHERE verdict IN ('ambiguous', 'review'))),
        hit AS (SELECT collection, chunk_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS cost, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM best JOIN docs ON 'd' || CAST(doc_id AS VARCHAR) = chunk_id
            WHERE 'doc' || CAST(doc_id AS VARCHAR) IN (SELECT document_id FROM asked WHERE verdict = 'governs')),
        go AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, false AS taken UNION ALL
            SELECT h.rank, CASE WHEN used + cost <= 4000 THEN used + cost ELSE used END, used + cost <= 4000 FROM go JOIN hit h ON h.rank = go.k + 1 AND h.rank <= 10)
        SELECT collection, chunk_id, CAST(rank AS INT) AS rank, cost FROM hit JOIN go ON go.k = hit.rank AND go.taken"""


_DECIDED = "NOT EXISTS (SELECT 1 FROM ruling x WHERE x.collection = r.collection AND x.verdict IN ('ambiguous', 'review'))"


def _governed(spark, d, policies):
    docs = table(spark, d, "documents").select(
        F.col("lang").alias("collection"), F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"), F.concat(F.lit("doc"), F.col("doc_id")).alias("document_id"),
        (F.col("doc_id") % 3).alias("level"), F.expr("cast(array() as array<string>)").alias("compartments"),
    )
    publications, relations = derived(spark, d, "publications"), derived(spark, d, "relations")
    return orchestration.governed_query(document_index(spark, d), docs, publications, relations, Principal(1), _DAY, "idiot de la", 4000, _SPEC, _query_vector(spark, d), policies)


@query("governed_query", _governed_sql(_DECIDED))
def governed_query(spark, d):
    """Publications of customers' documents govern the documents of the same number; asked are the policies in which all is decided."""
    return _governed(spark, d, governance.governing(_verdicts(spark, d)).select("collection").distinct())


@query("governed_query_undecided", _governed_sql("true"))
def governed_query_undecided(spark, d):
    """All policies are asked, of which some need review, so nothing is answered."""
    return _governed(spark, d, None)


@query("chunk_locations")
def chunk_locations(spark, d):
    """Where each chunk lies in its text; chunks are cut at UTF-8 bytes, which SQL can't say. Golden cases in the tests."""
    return orchestration.locations(derived(spark, d, "sources"))


_VOCAB = """SELECT lang AS collection, COUNT(*) > 10 AS active FROM {documents} GROUP BY lang"""
_TRIED = """SELECT lang AS collection, CASE WHEN MIN(doc_id) % 2 = 1 THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '2024-01-01 00:00:00' END AS attempted_at,
    true AS enabled, CASE WHEN lang = 'es' THEN 'manual' ELSE 'generated' END AS origin FROM {documents} WHERE lang <> 'de' GROUP BY lang"""


@query(
    "vocabulary_candidates",
    f"""WITH c AS ({_VOCAB.format(documents="documents")}), v AS ({_TRIED.format(documents="documents")})
        SELECT c.collection, attempted_at FROM c LEFT JOIN v ON v.collection = c.collection WHERE active AND (attempted_at IS NULL OR attempted_at < TIMESTAMP '2024-06-01 00:00:00')
        AND coalesce(enabled, true) AND coalesce(origin, 'none') <> 'manual' AND c.collection <> 'fr' ORDER BY attempted_at NULLS FIRST, c.collection LIMIT 50""".replace(
        "SELECT c.collection, attempted_at FROM c", "SELECT c.collection, CAST(attempted_at AS VARCHAR) AS attempted_at FROM c"
    ),
)
def vocabulary_candidates(spark, d):
    docs = table(spark, d, "documents")
    recent = spark.createDataFrame([("fr",)], "collection string")
    out = orchestration.vocabulary_candidates(spark.sql(_VOCAB, documents=docs), spark.sql(_TRIED, documents=docs), recent, "2024-06-01 00:10:00")
    return out.withColumn("attempted_at", F.col("attempted_at").cast("string"))


_RUNS = "SELECT DISTINCT uid AS run_id, CONCAT('rb-', CAST(LENGTH(uid) AS STRING)) AS runbook FROM interactions"


def _runs(spark, d):
    i = derived(spark, d, "interactions")
    runs = i.select(F.col("uid").alias("run_id"), F.concat(F.lit("rb-"), F.length("uid").cast("string")).alias("runbook")).distinct()
    steps = i.where("runbook_ref IS NOT NULL").select(F.col("uid").alias("run_id"), F.col("method").alias("state"), F.col("created_at").alias("updated_at"))
    return runs, steps


@query(
    "runs_last_step",
    f"""{ctes("interactions")}, r AS ({_RUNS}), s AS (SELECT uid AS run_id, max(created_at) AS last_step, count(*) AS steps FROM interactions WHERE runbook_ref IS NOT NULL GROUP BY 1)
        SELECT r.run_id, runbook, strftime(last_step, '%Y-%m-%d %H:%M:%S') AS last_step, coalesce(steps, 0) AS steps FROM r LEFT JOIN s ON s.run_id = r.run_id""",
)
def runs_last_step(spark, d):
    out = orchestration.runs_last_step(*_runs(spark, d))
    return out.withColumn("last_step", F.date_format("last_step", "yyyy-MM-dd HH:mm:ss"))


@query(
    "steps_by_state",
    f"""{ctes("interactions")}, r AS ({_RUNS}) SELECT runbook, method AS state, count(*) AS n FROM interactions JOIN r ON run_id = uid WHERE runbook_ref IS NOT NULL GROUP BY 1, 2""",
)
def steps_by_state(spark, d):
    return orchestration.steps_by_state(*_runs(spark, d))


@query(
    "idle_sessions",
    f"""{ctes("sessions", "turns")}, l AS (SELECT session_id, max(created_at) AS t FROM turns GROUP BY 1)
        SELECT s.id AS session_id FROM sessions s LEFT JOIN l ON l.session_id = s.id WHERE coalesce(t, opened_at) < TIMESTAMP '2024-01-12 00:00:00' - INTERVAL '1 day'""",
)
def idle_sessions(spark, d):
    return orchestration.idle_sessions(derived(spark, d, "sessions"), derived(spark, d, "turns"), "2024-01-12 00:00:00")


@query(
    "missing_builds",
    """SELECT o_orderkey AS version_id, CASE WHEN o_orderkey % 4 = 0 THEN 'resume' ELSE 'build' END AS action FROM orders WHERE o_orderkey % 4 IN (0, 1)""",
)
def missing_builds(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"))
    built = o.where("version_id % 4 <> 1").withColumn("state", F.when(F.col("version_id") % 4 == 0, "begun").otherwise("complete"))
    return orchestration.missing_builds(o, built)


@query("english_lexemes")
def lexemes(spark, d):
    """Stemmed lexemes and how many texts have them; DuckDB has no stemmer here. Golden words in the tests."""
    docs = small_batches(table(spark, d, "documents").where("lang = 'en'"), 200)
    return docs.select(F.explode(F.array_distinct(english_lexemes("text"))).alias("lexeme")).groupBy("lexeme").agg(F.count(F.lit(1)).alias("ndoc"))


@query("structured_tokens")
def structured(spark, d):
    """Tokens that carry a digit, by frequency."""
    docs = small_batches(table(spark, d, "documents"), 200).select(F.explode(structured_tokens("text")).alias("token"))
    return docs.where(F.regexp_like("token", F.lit("[0-9]"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
