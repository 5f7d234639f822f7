"""Hybrid retrieval: a lexical and a vector leg, fused by reciprocal ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import STOP_WORDS, has_phrase, number_digits, word_tokens
from corvane.functions.vectors import blend, local_embed
from corvane.operators.index import Index


@dataclass
class Demotion:
    """Passages that contain a marker count less."""

    contains: str
    lexical_multiplier: float = 1.0
    distance_penalty: float = 0.0
    match: str = "substring"
    except_collections: Sequence[str] = ()


@dataclass
class RetrievalSpec:
    """How a query is run; every field has the default of an unconfigured collection."""

    top_k: int = 10
    rrf_k: int = 60
    candidate_n: int = 50
    minimum_should_match: int = 1
    stop_term_fraction: float = 0.0
    query_expansions: Sequence[tuple[Sequence[str], Sequence[str]]] = ()
    query_expansion_weight: float = 1.0
    max_collections: int = 0
    probe_candidate_n: int = 50
    candidate_pool_per_collection: int = 100
    phrase_boost: float = 3.0
    lexical_weight: float = 1.0
    vector_weight: float = 1.0
    collection_evidence_weight: float = 0.0
    unselected_pool_weight: float = 1.0
    content_demotions: Sequence[Demotion] = field(default_factory=list)


def query_terms(query: str, stop: Sequence[str] = ()) -> list[str]:
    """Distinct words of a query that aren't stop words or terms the index has too often."""
    words = "".join(c.lower() if c.isalnum() else " " for c in query).split()
    drop = {*STOP_WORDS, *stop}
    return list(dict.fromkeys(w for w in words if w not in drop))


def expand_query(query: str, expansions: Sequence[tuple[Sequence[str], Sequence[str]]]) -> list[str]:
    """Terms added by every expansion one of whose triggers occurs as whole words in the query."""
    words = "".join(c.lower() if c.isalnum() else " " for c in query).split()
    text = f" {' '.join(words)} "
    added: list[str] = []
    for triggers, terms in expansions:
        if any(f" {' '.join(t.lower().split())} " in text for t in triggers):
            added += [t.lower() for t in terms if t.lower() not in words and t.lower() not in added]
    return added


@dataclass
class Prepared:
    """What a query looks for in an index, computed once for all collections."""

    original: list[str]
    expanded: list[str]
    candidates: list[str]
    vector: np.ndarray


def prepare(index: Index, query: str, spec: RetrievalSpec, collections: Sequence[str] | None = None, query_vector: Sequence[float] | None = None) -> Prepared:
    """Words of the query, with numbers as the index spells them; expansions; those of both that aren't too common; and the vector.

    Without a vector given, that of the query and that of the query with its expansions are mixed by the expansion's weight.
    """
    forms = index.number_forms(number_digits(query))
    original = list(dict.fromkeys(query_terms(query) + forms))
    added = [t for t in expand_query(query, spec.query_expansions) if t not in original]
    stop = index.common([*original, *added], spec.stop_term_fraction, collections) if spec.stop_term_fraction else []
    candidates = [t for t in [*original, *added] if t not in stop] or [*original, *added]
    if query_vector is not None:
        vector = np.asarray(query_vector, dtype=np.float64)
    else:
        own = local_embed(query)
        vector = blend(own, local_embed(" ".join([query, *added])), min(1.0, max(0.0, spec.query_expansion_weight))) if added else own
    return Prepared(original, added, candidates, vector)


def lexical_leg(index: Index, asked: Prepared, spec: RetrievalSpec, collections: Sequence[str] | None = None) -> DataFrame:
    """``collection, chunk_id, score`` of all chunks that meet the query, with what the demotions leave of it."""
    scored = index.bm25(asked.original, asked.expanded, spec.query_expansion_weight, spec.minimum_should_match, asked.candidates, collections)
    if not spec.content_demotions:
        return scored
    multiplier, _ = demotion_factors(spec.content_demotions, F.col("text"), F.col("collection"))
    factors = index.chunks(collections).select("collection", "chunk_id", multiplier.alias("m"))
    return scored.join(factors, ["collection", "chunk_id"]).select("collection", "chunk_id", (F.col("score") * F.col("m")).alias("score"))


def vector_leg(index: Index, query_vector: Sequence[float], collections: Sequence[str] | None = None) -> DataFrame:
    """``collection, chunk_id, score``: distance of every chunk that has an embedding."""
    q = np.asarray(query_vector, dtype=np.float64)
    norm = np.linalg.norm(q)
    unit = q / norm if norm else q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n = np.linalg.norm(x, axis=1)
            score = 1 - np.divide(x @ unit, n, out=np.zeros(len(n)), where=n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["collection", "chunk_id", "score"])

    rows = index.chunks(collections).where("embedding IS NOT NULL").select("collection", "chunk_id", "embedding")
    return rows.mapInArrow(run, "collection string, chunk_id string, score double")


def penalised(index: Index, near: DataFrame, spec: RetrievalSpec) -> DataFrame:
    """The rows of ``near`` (few) with the penalty of the demotions added to their distance."""
    _, penalty = demotion_factors(spec.content_demotions, F.col("text"), F.col("collection"))
    texts = index.chunks().select("collection", "chunk_id", penalty.alias("p"))
    return texts.join(F.broadcast(near), ["collection", "chunk_id"]).select("collection", "chunk_id", (F.col("score") + F.col("p")).alias("score"))


def demotion_factors(rules: Sequence[Demotion], text: Column, collection: Column) -> tuple[Column, Column]:
    """The least multiplier and the largest penalty of all rules that match."""
    multiplier, penalty = F.lit(1.0), F.lit(0.0)
    for r in rules:
        hit = has_phrase(word_tokens(text), r.contains) if r.match == "phrase" else F.contains(F.lower(text), F.lit(r.contains.lower()))
        if r.except_collections:
            hit = hit & ~collection.isin(list(r.except_collections))
        multiplier = F.least(multiplier, F.when(hit, r.lexical_multiplier).otherwise(1.0))
        penalty = F.greatest(penalty, F.when(hit, r.distance_penalty).otherwise(0.0))
    return multiplier, penalty


def bm25(chunks: DataFrame, terms: Sequence[str], minimum_should_match: int = 1, k1: float = 1.2, b: float = 0.75, rules: Sequence[Demotion] = ()) -> DataFrame:
    """``collection, chunk_id, score`` of chunks with enough of the terms.

    One pass counts the terms over all chunks (a row of numbers comes back), one pass scores.
    Neither shuffles anything but those counts.
    """
    # counted by pattern, so that no array of tokens is built for a text
    low = F.lower("text")
    counted = chunks.select(
        "collection",
        "chunk_id",
        *(["text"] if rules else []),
        F.regexp_count("text", F.lit(rf"{_WORD_CHAR}+")).alias("dl"),
        *(_count(low, t).alias(f"tf{i}") for i, t in enumerate(terms)),
    )
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        idf = float(np.log(1 + (stats.n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        f = F.col(f"tf{i}")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(float(stats.avgdl or 1.0))))
        matched = matched + (f > 0).cast("int")
    multiplier = demotion_factors(rules, F.col("text"), F.col("collection"))[0] if rules else F.lit(1.0)
    return counted.where(matched >= minimum_should_match).select("collection", "chunk_id", (score * multiplier).alias("score"))


_WORD_CHAR = r"[\p{IsAlphabetic}\p{N}]"


def _count(low: Column, term: str) -> Column:
    """Occurrences of a term as a whole word of a lower-cased text. Texts without it are passed over."""
    literal = rf"\Q{term}\E"
    pattern = rf"{literal}(?<!{_WORD_CHAR}{literal})(?!{_WORD_CHAR})"
    return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(pattern))).otherwise(0)


#: What names a chunk: a source that is in two collections has the same chunk id in both.
KEY = ("collection", "chunk_id")


def _key(df: DataFrame) -> list[str]:
    """The parts of the key that a table has, the chunk's id first, as ties are broken."""
    return [c for c in reversed(KEY) if c in df.columns]


def top_leg(scored: DataFrame, n: int, descending: bool = True) -> DataFrame:
    """The best ``n`` with their rank; ties by id and collection, what isn't a number last."""
    bad = F.col("score").isNull() | F.isnan("score")
    best = F.col("score").desc() if descending else F.col("score")
    order = [bad, best, *_key(scored)]
    # over n rows only
    return scored.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def rrf(lexical: DataFrame, vector: DataFrame, k: int = 60, lexical_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """``collection, chunk_id, lexical_rank, vector_rank, score`` of the union of two ranked legs; without ``collection`` if they have none."""
    key = [c for c in KEY if c in lexical.columns]
    a = lexical.select(*key, F.col("rank").alias("lexical_rank"))
    b = vector.select(*key, F.col("rank").alias("vector_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return a.join(b, key, "full_outer").withColumn("score", part(lexical_weight, "lexical_rank") + part(vector_weight, "vector_rank"))


def final_top(fused: DataFrame, top_k: int) -> DataFrame:
    return fused.orderBy(F.col("score").desc(), *_key(fused), *(["pool"] if "pool" in fused.columns else [])).limit(top_k or 10)


def hybrid_search(index: Index, query: str, spec: RetrievalSpec | None = None, query_vector: Sequence[float] | None = None, collections: Sequence[str] | None = None) -> DataFrame:
    """``collection, chunk_id, text_sha256, lexical_rank, vector_rank, score``: the best chunks for a query, with their place in either leg.

    With demotions, four times as many are fetched of the vector leg, and cut once penalties are in.
    """
    spec = spec or RetrievalSpec()
    asked = prepare(index, query, spec, collections, query_vector)
    lexical = top_leg(lexical_leg(index, asked, spec, collections), spec.candidate_n)
    near = vector_leg(index, asked.vector, collections)
    if spec.content_demotions:
        near = penalised(index, top_leg(near, max(4 * spec.candidate_n, 10), descending=False).drop("rank"), spec)
    vector = top_leg(near, spec.candidate_n, descending=False)
    best = final_top(rrf(lexical, vector, spec.rrf_k, spec.lexical_weight, spec.vector_weight), spec.top_k)
    texts = index.chunks(collections).select("collection", "chunk_id", F.sha2("text", 256).alias("text_sha256"))
    return texts.join(F.broadcast(best), list(KEY))
