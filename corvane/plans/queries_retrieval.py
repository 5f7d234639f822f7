"""Registered queries of the corpus pipeline, retrieval and fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.vectors import cosine_distance, embed, in_blocks, nearest_of
from corvane.operators import corpus, fusion, retrieval
from corvane.operators.ann import build_cells
from corvane.operators.graph import build_graph_index
from corvane.operators.retrieval import Demotion, RetrievalSpec
from corvane.plans.inputs import ctes, derived, document_index, table
from corvane.plans.registry import query
from corvane.session import shared_dir

#: The word rule as DuckDB SQL.
_TOK = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _tok(t: str = "text") -> str:
    return _TOK.format(t=t)


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("lang").alias("collection"), F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"), "text")


TERMS = ["idiot", "zu", "menttre", "handea"]


def _parts_sql(terms: list[str]) -> str:
    """``parts``: what each term adds to the score of each chunk (``p0``, ``p1``, …), and whether it has it (``m0``, …)."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = ", ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS p{i}, (tf{i} > 0)::INT AS m{i}" for i in range(len(terms))
    )
    return f"""c AS MATERIALIZED (SELECT lang AS collection, 'd' || CAST(doc_id AS VARCHAR) AS chunk_id, len(w) AS dl, {tf}
            FROM (SELECT *, {_tok()} AS w FROM documents)),
        st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c),
        parts AS MATERIALIZED (SELECT collection, chunk_id, {part} FROM c, st)"""


def _sum(letter: str, n: int) -> str:
    return " + ".join(f"{letter}{i}" for i in range(n))


def _bm25_sql(terms: list[str], least: int) -> str:
    n = len(terms)
    return f"{_parts_sql(terms)}, scored AS (SELECT collection, chunk_id, {_sum('p', n)} AS score FROM parts WHERE {_sum('m', n)} >= {least})"


@query("bm25_topn", f"WITH {_bm25_sql(TERMS, 1)} SELECT collection, chunk_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 50")
def bm25_topn(spark, d):
    top = retrieval.top_leg(document_index(spark, d).bm25(TERMS), 50)
    return top.select("collection", "chunk_id", F.round("score", 6).alias("score"))


@query("bm25_two_terms", f"WITH {_bm25_sql(['the', 'and', 'idiot'], 2)} SELECT collection, count(*) AS n, round(sum(score), 4) AS total FROM scored GROUP BY 1")
def bm25_two_terms(spark, d):
    scored = document_index(spark, d).bm25(["the", "and", "idiot"], least=2)
    return scored.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("bm25_unindexed", f"WITH {_bm25_sql(['the', 'and', 'idiot'], 2)} SELECT collection, count(*) AS n, round(sum(score), 4) AS total FROM scored GROUP BY 1")
def bm25_unindexed(spark, d):
    """The same without an index, by two passes over the texts."""
    scored = retrieval.bm25(_chunks(spark, d), ["the", "and", "idiot"], 2)
    return scored.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(
    "index_contents",
    f"""WITH t AS (SELECT lang AS collection, doc_id, {_tok()} AS w FROM documents), p AS (SELECT collection, doc_id, unnest(w) AS lexeme FROM t),
        a AS (SELECT collection, count(*) AS n_chunks, CAST(sum(len(w)) AS BIGINT) AS words FROM t GROUP BY 1),
        b AS (SELECT collection, count(DISTINCT lexeme) AS lexemes, count(DISTINCT lexeme || ' ' || CAST(doc_id AS VARCHAR)) AS postings, count(*) AS tokens FROM p GROUP BY 1),
        v AS (SELECT lang AS collection, count(*) AS vectors FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY 1)
        SELECT collection, n_chunks, words, lexemes, postings, tokens, coalesce(vectors, 0) AS vectors FROM a JOIN b USING (collection) LEFT JOIN v USING (collection)""",
)
def index_contents(spark, d):
    index = document_index(spark, d)
    postings = index.part("postings").groupBy("collection").agg(
        F.sum(F.size("tf")).alias("postings"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda n, x: n + x)).alias("tokens")
    )
    terms = index.part("terms").groupBy("collection").agg(F.count(F.lit(1)).alias("lexemes"))
    vectors = index.chunks().groupBy("collection").agg(F.count("embedding").alias("vectors"))
    return index.part("stats").join(postings, "collection").join(terms, "collection").join(vectors, "collection")


_VEC = """SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS dist
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"""


@query(
    "vector_topk",
    f"""SELECT query_id, id, round(dist, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM ({_VEC}))
        WHERE rank <= 10""",
)
def vector_topk(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding")
    return nearest_of(table(spark, d, "embeddings"), asked, 10).withColumn("distance", F.abs(F.round("distance", 6)))


@query("vector_cells")
def vector_cells(spark, d):
    """The same queries over an index of cells: approximate, held against the exact answer in the tests."""
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding")
    path = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/cells-{uuid.uuid4().hex}"
    index = build_cells(table(spark, d, "embeddings"), path, cells=16)
    return in_blocks(lambda some: index.search(some, 10, probes=12), asked)


@query("vector_graph")
def vector_graph(spark, d):
    """The same queries over a neighbour graph: approximate, its recall held against the exact answer in the tests."""
    vectors = table(spark, d, "embeddings")
    path = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex}"
    found = build_graph_index(vectors, path).search(vectors.where("vec_id % 100 = 0").select("vec_id", "embedding"), 10)
    return found.select("query_id", "id", F.round("distance", 5).alias("distance"), "rank")


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query(
    "query_words",
    f"""WITH t AS (SELECT conv_id, turn, {_tok()} AS w FROM conversations), p AS (SELECT conv_id, turn, w, list_filter(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda x: x[1] NOT IN ({_STOP}) AND x[2] NOT IN ({_STOP})) AS p FROM t)
        SELECT conv_id, turn, len(list_distinct(list_filter(w, lambda x: x NOT IN ({_STOP})))) AS n_terms, len(list_distinct(list_transform(p, lambda x: x[1] || ' ' || x[2]))) AS n_phrases,
               array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x[1] || ' ' || x[2]))), ',') AS phrases FROM p""",
)
def query_words(spark, d):
    phrases = tx.query_phrases(F.col("text"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.size(tx.content_terms(F.col("text"))).cast("long").alias("n_terms"), F.size(phrases).cast("long").alias("n_phrases"), F.array_join(F.array_sort(phrases), ",").alias("phrases")
    )


@query(
    "cosine_pairs",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("eb"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(cosine_distance(F.col("embedding"), F.col("eb")), 6).alias("distance"))


_QUERY, _EXPANSIONS = "handea of the fool menttre", [(["the fool"], ["idiot"])]
_NEAR = f"""near AS MATERIALIZED (SELECT lang AS collection, 'd' || CAST(id AS VARCHAR) AS chunk_id, dist AS score FROM ({_VEC}) JOIN documents ON doc_id = id WHERE query_id = 0)"""


def _legs_sql(lexical: str, near: str) -> str:
    return f"""lex AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS lexical_rank FROM ({lexical}) ORDER BY 2 LIMIT 50),
    vec AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS vector_rank FROM ({near}) ORDER BY 2 LIMIT 50),
    fused AS (SELECT chunk_id, lexical_rank, vector_rank, coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0) AS score
              FROM lex FULL OUTER JOIN vec USING (chunk_id))"""


_LEGS = f"""WITH {_bm25_sql(["handea", "fool", "menttre", "idiot"], 1)}, {_NEAR}, {_legs_sql("SELECT * FROM scored", "SELECT * FROM near")}"""
_BEST = """SELECT lang AS collection, chunk_id, sha256(text) AS text_sha256, lexical_rank, vector_rank, round(score, 9) AS score
        FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 10) JOIN documents ON 'd' || CAST(doc_id AS VARCHAR) = chunk_id"""


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query("rrf_fusion", f"{_LEGS} SELECT lang AS collection, chunk_id, lexical_rank, vector_rank, round(score, 9) AS score FROM fused JOIN documents ON 'd' || CAST(doc_id AS VARCHAR) = chunk_id")
def rrf_fusion(spark, d):
    index = document_index(spark, d)
    lexical = retrieval.top_leg(index.bm25(["handea", "fool", "menttre", "idiot"]), 50)
    vector = retrieval.top_leg(retrieval.vector_leg(index, _query_vector(spark, d)), 50, descending=False)
    return retrieval.rrf(lexical, vector).withColumn("score", F.round("score", 9))


@query("hybrid_search", f"{_LEGS} {_BEST}")
def hybrid_search(spark, d):
    """Flagship: both legs over the stored index, fused."""
    spec = RetrievalSpec(query_expansions=_EXPANSIONS)
    return retrieval.hybrid_search(document_index(spark, d), _QUERY, spec, _query_vector(spark, d)).withColumn("score", F.round("score", 9))


_RULES = [Demotion("license", 0.5, 0.2, "phrase"), Demotion("$$$", 0.1, 0.5, except_collections=["de"])]
_FACTORS = f"""fac AS MATERIALIZED (SELECT 'd' || CAST(doc_id AS VARCHAR) AS chunk_id,
        least(CASE WHEN contains(lower(text), '$$$') AND lang <> 'de' THEN 0.1 ELSE 1.0 END, CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' license ') THEN 0.5 ELSE 1.0 END)::DOUBLE AS mul,
        greatest(CASE WHEN contains(lower(text), '$$$') AND lang <> 'de' THEN 0.5 ELSE 0.0 END, CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' license ') THEN 0.2 ELSE 0.0 END)::DOUBLE AS pen
        FROM (SELECT *, {_tok()} AS w FROM documents))"""


@query(
    "hybrid_search_demoted",
    f"""WITH {_bm25_sql(["idiot", "clown", "trash"], 1)}, {_NEAR}, {_FACTORS},
        {_legs_sql("SELECT collection, chunk_id, score * mul AS score FROM scored JOIN fac USING (chunk_id)",
                   "SELECT chunk_id, score + pen AS score FROM (SELECT * FROM near ORDER BY score, chunk_id LIMIT 200) JOIN fac USING (chunk_id)")} {_BEST}""",
)
def hybrid_search_demoted(spark, d):
    spec = RetrievalSpec(content_demotions=_RULES)
    found = retrieval.hybrid_search(document_index(spark, d), "Idiot clown of trash", spec, _query_vector(spark, d))
    return found.withColumn("score", F.round("score", 9))


_FUSED = """{ctes}, r AS (
    SELECT pool, chunk_id, (CASE WHEN is_probe THEN 0.25 ELSE 1.0 END) * 1.0 / (60 + row_number() OVER (PARTITION BY is_probe ORDER BY score DESC, chunk_id)) AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY pool, is_probe ORDER BY score DESC, chunk_id) AS n FROM lex) WHERE n <= 100
    UNION ALL
    SELECT pool, chunk_id, (CASE WHEN is_probe THEN 0.25 ELSE 1.0 END) * 2.0 / (60 + row_number() OVER (PARTITION BY is_probe ORDER BY score, chunk_id))
    FROM (SELECT *, row_number() OVER (PARTITION BY pool, is_probe ORDER BY score, chunk_id) AS n FROM vec) WHERE n <= 100),
    ev AS (SELECT pool, row_number() OVER (ORDER BY pool) AS rk FROM (SELECT DISTINCT pool FROM lex))
    SELECT pool, chunk_id, round(sum(part) + coalesce(0.5 / (60 + any_value(rk)), 0), 9) AS score FROM r LEFT JOIN ev USING (pool) GROUP BY 1, 2"""


@query("fuse_pools_weighted", _FUSED.replace("{ctes}", ctes("lex", "vec")))
def fuse_pools_weighted(spark, d):
    lex, vec = derived(spark, d, "lex"), derived(spark, d, "vec")
    evidence = lex.select("pool").distinct()
    evidence = evidence.join(
        evidence.select(F.col("pool").alias("other")), F.col("other") <= F.col("pool")
    ).groupBy("pool").agg(F.count(F.lit(1)).alias("rank"))
    return fusion.fuse_pools(lex, vec, 60, 1.0, 2.0, evidence, 0.5, 0.25, depth=100).withColumn("score", F.round("score", 9))


@query(
    "interleave_domains",
    f"{ctes('vec')} SELECT domain, chunk_id, row_number() OVER (PARTITION BY domain ORDER BY score, chunk_id) AS rank FROM vec",
)
def interleave_domains(spark, d):
    return fusion.interleave_domains(derived(spark, d, "vec"), descending=False)


_DENSITY = """a AS (SELECT pool, sum(score) AS le FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, chunk_id) AS r FROM lex) WHERE r <= 3 GROUP BY 1),
    b AS (SELECT pool, -sum(score) AS ve FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score, chunk_id) AS r FROM vec) WHERE r <= 3 GROUP BY 1)"""


@query("density_evidence", f"{ctes('lex', 'vec')}, {_DENSITY} SELECT pool, round(le, 6) AS lexical_evidence, round(ve, 6) AS vector_evidence FROM a FULL OUTER JOIN b USING (pool)")
def density_evidence(spark, d):
    e = fusion.density_evidence(derived(spark, d, "lex"), derived(spark, d, "vec"))
    return e.select("pool", F.round("lexical_evidence", 6).alias("lexical_evidence"), F.round("vector_evidence", 6).alias("vector_evidence"))


@query(
    "collection_selection",
    f"{ctes('lex', 'vec')}, {_DENSITY} SELECT pool FROM a FULL OUTER JOIN b USING (pool) ORDER BY le DESC NULLS LAST, ve DESC NULLS LAST, pool LIMIT 2",
)
def collection_selection(spark, d):
    return fusion.select_collections(fusion.density_evidence(derived(spark, d, "lex"), derived(spark, d, "vec")), 2).select("pool")


@query(
    "routing_rank",
    f"""WITH h AS (SELECT lang AS pool, doc_id, CAST(n_chars AS DOUBLE) AS score, {_tok()} AS w FROM documents),
        e AS (SELECT pool, row_number() OVER (PARTITION BY pool ORDER BY score DESC, 'd' || CAST(doc_id AS VARCHAR)) AS place, score,
                     list_contains(w, 'the') AS t1, list_contains(w, 'de') AS t2, list_contains(w, 'idiot') AS t3,
                     contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AS phrase FROM h),
        s AS (SELECT pool, count(*) AS hits, (bool_or(t1)::INT + bool_or(t2)::INT + bool_or(t3)::INT) / 3 AS coverage,
                     count(*) FILTER (t1::INT + t2::INT + t3::INT >= 2) / count(*) AS multi, count(*) FILTER (phrase) / count(*) AS phrase,
                     CASE WHEN max(score) FILTER (place = 3) IS NULL OR max(score) <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (max(score) - max(score) FILTER (place = 3)) / max(score))) END::DOUBLE AS margin FROM e GROUP BY pool)
        SELECT pool, hits, round((coverage + multi) / 2 * (1 + 3 * phrase), 6) AS routing, round(margin, 9) AS margin,
               row_number() OVER (ORDER BY (coverage + multi) / 2 * (1 + 3 * phrase) DESC, margin DESC, hits DESC, pool) AS rank FROM s""",
)
def routing_rank(spark, d):
    hits = table(spark, d, "documents").select(
        F.col("lang").alias("pool"), F.concat(F.lit("d"), F.col("doc_id")).alias("chunk_id"), "text", F.col("n_chars").cast("double").alias("score")
    )
    ranked = fusion.routing_rank(fusion.routing_score(fusion.routing_evidence(hits, ["the", "de", "idiot"], ["of the"])))
    return ranked.select("pool", "hits", F.round("routing", 6).alias("routing"), F.round("margin", 9).alias("margin"), "rank")


@query(
    "leg_comparison",
    f"""{ctes("lex", "vec")}, a AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS ra FROM (SELECT * FROM lex ORDER BY score DESC, chunk_id LIMIT 100)),
        b AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS rb FROM (SELECT * FROM vec ORDER BY score, chunk_id LIMIT 100))
        SELECT count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS overlap,
               round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / greatest(count(ra), count(rb), 1), 6) AS fraction,
               round(avg(abs(ra - rb)), 6) AS mean_move, max(abs(ra - rb)) AS max_move FROM a FULL OUTER JOIN b USING (chunk_id)""",
)
def leg_comparison(spark, d):
    return fusion.leg_comparison(
        retrieval.top_leg(derived(spark, d, "lex"), 100), retrieval.top_leg(derived(spark, d, "vec"), 100, descending=False)
    )


@query(
    "shadow_identity",
    """WITH a AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS chunk_id, md5(text) AS h FROM documents WHERE lang <> 'es'),
        b AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN source = 'src3' THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE lang <> 'fr')
        SELECT chunk_id, CASE WHEN a.h IS NULL THEN 'only_right' WHEN b.h IS NULL THEN 'only_left' ELSE 'differs' END AS state
        FROM a FULL OUTER JOIN b USING (chunk_id) WHERE a.h IS DISTINCT FROM b.h""",
)
def shadow_identity(spark, d):
    docs = table(spark, d, "documents").withColumn("chunk_id", F.concat(F.lit("d"), F.col("doc_id")))
    a = docs.where("lang <> 'es'").select("chunk_id", F.md5("text").alias("hash"))
    b = docs.where("lang <> 'fr'").select("chunk_id", F.md5(F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return fusion.shadow_identity(a, b)


@query(
    "budget_pack",
    """WITH RECURSIVE p AS (SELECT conv_id AS request, 't' || CAST(turn AS VARCHAR) AS chunk_id, length(text) AS cost,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn, 't' || CAST(turn AS VARCHAR), length(text)) AS k FROM conversations),
        r AS (SELECT DISTINCT request, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, '' AS taken FROM p
              UNION ALL SELECT r.request, p.k, CASE WHEN used + cost <= 800 THEN used + cost ELSE used END,
                  CASE WHEN used + cost > 800 THEN taken WHEN taken = '' THEN chunk_id ELSE taken || ',' || chunk_id END FROM r JOIN p ON p.request = r.request AND p.k = r.k + 1)
        SELECT request, used, taken FROM r WHERE k = (SELECT max(k) FROM p WHERE p.request = r.request)""",
)
def budget_pack(spark, d):
    """Greedy with skips, per conversation."""
    p = table(spark, d, "conversations").select(
        F.col("conv_id").alias("request"), F.col("turn").alias("rank"), F.concat(F.lit("t"), F.col("turn")).alias("chunk_id"), F.length("text").cast("long").alias("cost")
    )
    return fusion.budget_pack(p, 800)


@query(
    "passage_dedup",
    """SELECT request, source_id, hash, min(rank) AS rank FROM (SELECT doc_id % 7 AS request, source AS source_id, n_chars % 3 AS hash, text, doc_id AS rank FROM documents) GROUP BY 1, 2, 3, text""",
)
def passage_dedup(spark, d):
    p = table(spark, d, "documents").select((F.col("doc_id") % 7).alias("request"), F.col("source").alias("source_id"), (F.col("n_chars") % 3).alias("hash"), "text", F.col("doc_id").alias("rank"))
    return fusion.drop_repeats(p).drop("text")


@query("demotion_factors", f"WITH {_FACTORS} SELECT CAST(substr(chunk_id, 2) AS BIGINT) AS doc_id, mul AS multiplier, pen AS penalty FROM fac")
def demotion_factors(spark, d):
    m, p = retrieval.demotion_factors(_RULES, F.col("text"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", m.alias("multiplier"), p.alias("penalty"))


_N = "(SELECT count(*) FROM documents)"


@query(
    "lexeme_df",
    f"""SELECT lexeme, count(*) AS ndoc FROM (SELECT unnest(list_distinct({_tok()})) AS lexeme FROM documents) GROUP BY 1 HAVING count(*) >= greatest(2, {_N} // 100)
        UNION ALL SELECT '', count(*) FROM documents""",
)
def lexeme_df(spark, d):
    docs = table(spark, d, "documents")
    return corpus.document_frequency(docs, "doc_id", docs.count())


@query(
    "stop_terms",
    f"SELECT lexeme FROM (SELECT unnest(list_distinct({_tok()})) AS lexeme FROM documents) GROUP BY 1 HAVING count(*) > 0.2 * {_N}",
)
def stop_terms(spark, d):
    docs = table(spark, d, "documents")
    n = docs.count()
    return corpus.stop_terms(corpus.document_frequency(docs, "doc_id", n), 0.2, n)


#: Texts with numbers as patents, cases and counts are written.
_NUMBERED = """SELECT doc_id, CONCAT(text, ' US', CAST(4000000 + doc_id * 37 AS STRING), ' EPO', CAST(doc_id AS STRING), ' abcde', CAST(10000 + doc_id AS STRING), ' ',
    CAST(50000 + doc_id % 9 AS STRING), ' no', CAST(50000 + doc_id % 9 AS STRING)) AS text FROM {documents}"""
_NUM = f"""SELECT DISTINCT regexp_replace(lexeme, '[^0-9]', '', 'g') AS digits, lexeme FROM (SELECT unnest({_tok()}) AS lexeme FROM ({_NUMBERED.format(documents="documents")}))
    WHERE regexp_matches(lexeme, '^[a-z]{{1,4}}[0-9]{{5,}}$')"""


def _numbers(spark, d):
    return corpus.number_lexemes(spark.sql(_NUMBERED, documents=table(spark, d, "documents")))


@query("number_lexemes", _NUM)
def number_lexemes(spark, d):
    return _numbers(spark, d)


@query("number_forms", f"SELECT digits, string_agg(lexeme, ' ' ORDER BY lexeme) AS forms FROM ({_NUM}) GROUP BY digits")
def number_forms(spark, d):
    return _numbers(spark, d).groupBy("digits").agg(F.array_join(F.array_sort(F.collect_set("lexeme")), " ").alias("forms"))


@query(
    "corpus_fingerprint",
    f"{ctes('sources')} SELECT collection, md5(string_agg(source_id || ':' || content_hash, ',' ORDER BY source_id || ':' || content_hash)) AS fingerprint FROM sources GROUP BY 1",
)
def corpus_fingerprint(spark, d):
    return corpus.corpus_fingerprint(derived(spark, d, "sources"))


@query(
    "index_identity",
    f"""{ctes("sources")} SELECT collection, 'idx-' || substr(sha256(collection || '|doc@1|para@2|local-hash@1|text@1|' ||
        string_agg(source_id || ':' || content_hash, ',' ORDER BY source_id || ':' || content_hash)), 1, 16) AS index_id FROM sources GROUP BY collection""",
)
def index_identity(spark, d):
    return corpus.index_id(derived(spark, d, "sources"), "doc@1", "para@2", "local-hash@1", "text@1")


@query("chunk_build")
def chunk_build(spark, d):
    """Chunks of all sources; cutting UTF-8 at byte counts has no SQL. Tested against a plain loop."""
    return corpus.build_chunks(derived(spark, d, "sources")).select("collection", "chunk_id", "ordinal", "text_sha256")


@query("chunk_embeddings")
def chunk_embeddings(spark, d):
    return corpus.build_chunks(derived(spark, d, "sources")).select("chunk_id", embed("text").alias("embedding"))


@query(
    "index_verify",
    f"""{ctes("sources")}, c AS (SELECT collection, source_id AS chunk_id, {_tok()} AS w FROM sources),
        f AS (SELECT collection, count(*) AS n_chunks, array_to_string(arg_min(w, chunk_id)[1:5], ' ') AS probe FROM c GROUP BY 1)
        SELECT f.collection, any_value(n_chunks) AS n_chunks, any_value(probe) AS probe,
               count(*) FILTER (contains(' ' || array_to_string(w, ' ') || ' ', ' ' || probe || ' ')) AS probe_hits FROM f JOIN c USING (collection) GROUP BY 1""",
)
def index_verify(spark, d):
    return corpus.verify_index(derived(spark, d, "sources").select("collection", F.col("source_id").alias("chunk_id"), "text"))


_VERSIONS = """SELECT 'v' || CAST(o_orderkey AS STRING) AS version_id, o_orderpriority AS collection, CAST(o_orderdate AS TIMESTAMP) AS built_at,
    o_orderkey % 40 = 0 AS active, o_orderkey % 3 = 0 AS activated,
    CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '500' DAY END AS deactivated_at FROM {orders}"""


@query(
    "retire_old",
    f"""WITH v AS ({_VERSIONS.format(orders="orders")}) SELECT collection, version_id FROM (
        SELECT *, row_number() OVER (PARTITION BY collection ORDER BY built_at DESC, version_id) AS n FROM v WHERE NOT active) WHERE n > 2""",
)
def retire_old(spark, d):
    return corpus.retire(spark.sql(_VERSIONS, orders=table(spark, d, "orders")), 2)


@query(
    "required_versions",
    f"""WITH v AS ({_VERSIONS.format(orders="orders")}) SELECT version_id, collection, active FROM v
        WHERE active OR (activated AND coalesce(deactivated_at, built_at) >= TIMESTAMP '2001-01-01 00:00:00')""",
)
def required_versions(spark, d):
    v = corpus.required_versions(spark.sql(_VERSIONS, orders=table(spark, d, "orders")), "2001-01-01 00:00:00")
    return v.select("version_id", "collection", "active")


@query(
    "manifest_diff",
    f"""{ctes("manifest", "stored")} SELECT m.path, CASE WHEN s.content_hash IS NULL THEN 'new' WHEN s.content_hash <> m.content_hash THEN 'changed'
        WHEN bound OR NOT binds THEN 'skipped_existing' ELSE 'bind_only' END AS state FROM manifest m LEFT JOIN stored s USING (path)""",
)
def manifest_diff(spark, d):
    return corpus.manifest_diff(derived(spark, d, "manifest"), derived(spark, d, "stored"))


@query(
    "bulk_counts",
    f"""{ctes("manifest", "stored")}, x AS (SELECT CASE WHEN s.content_hash IS NULL THEN 'new' WHEN s.content_hash <> m.content_hash THEN 'changed'
        WHEN bound OR NOT binds THEN 'skipped_existing' ELSE 'bind_only' END AS state FROM manifest m LEFT JOIN stored s USING (path))
        SELECT count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'skipped_existing') AS skipped,
               count(*) FILTER (state = 'bind_only') AS bind_only FROM x""",
)
def bulk_counts(spark, d):
    diff = corpus.manifest_diff(derived(spark, d, "manifest"), derived(spark, d, "stored"))
    return diff.agg(
        *(F.count_if(F.col("state") == s).alias(n) for s, n in (("new", "new"), ("changed", "changed"), ("skipped_existing", "skipped"), ("bind_only", "bind_only")))
    )


@query("upsert_sources", f"{ctes('manifest', 'stored')} SELECT path, coalesce(m.content_hash, s.content_hash) AS content_hash FROM manifest m FULL OUTER JOIN stored s USING (path)")
def upsert_sources(spark, d):
    keep = lambda n: derived(spark, d, n).select("path", "content_hash")
    return corpus.upsert_sources(keep("stored"), keep("manifest"))


@query(
    "bind_sources",
    f"""{ctes("sources")} SELECT DISTINCT collection, source_id FROM sources WHERE media_type = 'text/plain' AND NOT (access_level = 0 AND collection = 'en')""",
)
def bind_sources(spark, d):
    s = derived(spark, d, "sources")
    return corpus.bind_sources(s.where("access_level = 0 AND collection = 'en'").select("collection", "source_id"), s.where("media_type = 'text/plain'"))


@query("export_page", f"{ctes('sources')} SELECT source_id AS chunk_id, path FROM sources WHERE source_id > 'src-5' ORDER BY source_id LIMIT 100")
def export_page(spark, d):
    return corpus.export_page(derived(spark, d, "sources").select(F.col("source_id").alias("chunk_id"), "path"), "src-5", 100)


@query(
    "export_with_sources",
    f"""{ctes("sources")}, c AS (SELECT source_id || '#0' AS chunk_id, source_id, 'old/' || path AS source_path, 'old' AS source_hash, access_level FROM sources),
        now AS (SELECT * FROM sources WHERE media_type <> 'text/markdown')
        SELECT chunk_id, c.source_id, coalesce(now.path, source_path) AS path, coalesce(content_hash, source_hash) AS content_hash, c.access_level FROM (SELECT * FROM c WHERE chunk_id > 'src-3' ORDER BY chunk_id LIMIT 200) c
        LEFT JOIN now ON now.source_id = c.source_id""",
)
def export_with_sources(spark, d):
    """Sources that were removed since are told as the index has them."""
    s = derived(spark, d, "sources")
    chunks = s.select(
        F.concat("source_id", F.lit("#0")).alias("chunk_id"), "source_id", F.concat(F.lit("old/"), "path").alias("source_path"), F.lit("old").alias("source_hash"), "access_level"
    )
    return corpus.export_with_sources(chunks, s.where("media_type <> 'text/markdown'"), "src-3", 200)


@query(
    "stratified_sample",
    f"""{ctes("sources")} SELECT source_id, media_type FROM (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY source_id) AS n FROM sources)
        ORDER BY n, media_type LIMIT 20""",
)
def stratified_sample(spark, d):
    return corpus.stratified_sample(derived(spark, d, "sources"), 20)


@query("index_sources", f"{ctes('sources')} SELECT DISTINCT source_id, content_hash FROM sources")
def index_sources(spark, d):
    return corpus.index_sources(derived(spark, d, "sources"))


@query(
    "sorted_provenance",
    "SELECT lang, list_sort(list(DISTINCT source)) AS sources, list_sort(list(DISTINCT n_chars % 7)) AS marks FROM documents GROUP BY lang",
)
def sorted_provenance(spark, d):
    per = table(spark, d, "documents").groupBy("lang").agg(F.collect_set("source").alias("s"), F.collect_set(F.col("n_chars") % 7).alias("m"))
    return per.select("lang", corpus.sorted_distinct(F.col("s")).alias("sources"), corpus.sorted_distinct(F.col("m")).alias("marks"))


@query(
    "text_functions",
    f"""SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, substr(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 16) AS fingerprint,
        CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS INT) AS n_the FROM (SELECT *, {_tok()} AS w FROM documents)""",
)
def text_functions(spark, d):
    t, w = F.col("text"), tx.word_tokens(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        tx.query_fingerprint(t).alias("fingerprint"), tx.count_pattern(t, F.lit("the")).alias("n_the"),
    )


@query(
    "normalized_claims",
    f"""{ctes("claims")} SELECT id, subject || '.' || key || '=' || trim(value) AS line, subject, key, trim(value) AS value FROM claims""",
)
def normalized_claims(spark, d):
    lines = derived(spark, d, "claims").select("id", tx.normalized_claim(F.col("subject"), F.col("key"), F.col("value")).alias("line"))
    return lines.select("id", "line", tx.split_normalized(F.col("line")).alias("x")).select("id", "line", "x.*")


@query(
    "sample_text",
    """SELECT doc_id, CASE WHEN length(text) <= 126 THEN text ELSE left(text, 40) || chr(10) || '…' || chr(10) || substr(text, CAST(floor(length(text) / 2 - 20.0) AS INT) + 1, 40)
        || chr(10) || '…' || chr(10) || right(text, 40) END AS sample FROM documents""",
)
def sample_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.sample_text(F.col("text"), 126).alias("sample"))
