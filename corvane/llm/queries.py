"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import html_text, pii, quality, toxicity, warc
from corvane.llm.collocations import collocations
from corvane.llm.common import scratch_path, table
from corvane.llm.decontamination import contamination
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.near_dup import near_duplicates
from corvane.llm.packing import pack, tokenizer_path
from corvane.llm.pitman_yor import language_scores
from corvane.llm.sharding import interleave
from corvane.llm.vector_codes import encode, fingerprint

#: Rule of the digest queries for words, as DuckDB SQL over a column ``t``.
WORDS_SQL = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)


OP4_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = interleave(
        table(spark, sf_dir, "documents"),
        shards=16,
        carry={
            "size": (F.octet_length(text) + 1).cast("long"),
            "text_crc32": F.crc32(text.cast("binary")),
        },
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.arrays_zip("hit_starts", "hit_ends"), F.lit(0).cast("long"), lambda a, x: a + (x["hit_ends"] - x["hit_starts"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_starts") > 0).alias("contaminated"),
        "hit_starts",
        "hit_ends",
    )


OP1_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({WORDS_SQL.format(t="text")}, []) AS w FROM documents),
b AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL.format(t="text")} AS w FROM benchmark
      WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
grams AS MATERIALIZED (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS MATERIALIZED (SELECT doc_id, win.k, i, item FROM grams JOIN win ON grams.k = win.k AND grams.g = win.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS its FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1),
runs AS (
  SELECT doc_id, list(a ORDER BY a) AS hit_starts, list(z ORDER BY a) AS hit_ends FROM (
    SELECT doc_id, CAST(min(p) - 1 AS INT) AS a, CAST(max(q) AS INT) AS z FROM (
      SELECT doc_id, p, q, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS grp FROM (
        SELECT doc_id, i AS p, i + k - 1 AS q,
               CASE WHEN i - 1 <= max(i + k - 1) OVER (PARTITION BY doc_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                    THEN 0 ELSE 1 END AS fresh
        FROM (SELECT DISTINCT doc_id, i, k FROM hits)))
    GROUP BY doc_id, grp) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(its, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(hit_starts, []) AS hit_starts, coalesce(hit_ends, []) AS hit_ends
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
top AS (SELECT digest, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN top ON p.digest = top.digest AND n >= 1000
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    order = {k: i for i, k in enumerate(pii.KINDS)}
    places = F.create_map(*[F.lit(v) for k, i in order.items() for v in (k, i)])
    every = F.array_sort(
        F.transform(
            F.concat("base", "added"),
            lambda x: F.struct(places[x["kind"]].alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")),
        )
    )
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in pii.BASE),
        F.sha2(pii.listing(F.col("base")), 256).alias("base_sha256"),
        pii.listing(every).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranking = quality.train(docs, quality.quality_labels(table(spark, sf_dir, "labels")))
    return quality.score(docs, ranking).select(
        "doc_id",
        F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.toxic_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


OP11_SQL = r"""
WITH toks AS MATERIALIZED (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
f AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM toks, (VALUES (1), (2), (3), (4)) x(k) WHERE len(w) >= k)
  GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE a >= 30),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM c WHERE k > 1),
scored AS (
  SELECT q.lang, q.phrase, q.a, x.a AS l, y.a AS r, cut, (2000000::HUGEINT * q.a) // (x.a + y.a) AS score
  FROM cuts q JOIN c x ON x.lang = q.lang AND x.phrase = array_to_string(q.w[:cut], ' ')
  JOIN c y ON y.lang = q.lang AND y.phrase = array_to_string(q.w[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) x(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT k.lang, row_number() OVER w AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept k JOIN n ON n.lang = k.lang WINDOW w AS (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The rounds one after another: places of the entries, sums of those nearest, floored means."""
    sql = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})] AS x FROM (SELECT *, unnest(range(0, {parts})) AS part FROM v)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""
    for i in range(rounds + 1):
        sql += f""",
d{i} AS MATERIALIZED (
  SELECT vec_id, label, p.part, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := entry)) AS n
  FROM p JOIN b{i} b ON b.part = p.part GROUP BY vec_id, label, p.part, x)"""
        if i < rounds:
            sql += f""",
m{i} AS (
  SELECT part, entry, list(m ORDER BY place) AS y FROM (
    SELECT part, entry, place, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (
      SELECT part, n.entry AS entry, unnest(x) AS c, unnest(range(0, len(x))) AS place FROM d{i}) GROUP BY part, entry, place)
  GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(list_transform(m.y, lambda z: CAST(z AS BIGINT)), b.y) AS y FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.entry = b.entry)"""
    return sql + f""",
e AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(n.entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM d{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM e
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_warc": op2_warc,
        "op3_html_text": op3_html_text,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_pii": op5_pii,
        "op6_packing": op6_packing,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_sharding": op10_sharding,
        "op11_collocations": op11_collocations,
        "op12_pitman_yor": op12_pitman_yor,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_warc": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op11_collocations": OP11_SQL, "op13_vector_codes": _vector_codes_sql()}
