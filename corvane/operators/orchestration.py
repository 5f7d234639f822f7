"""Whole turns: from a query over many collections to passages with their provenance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import STOP_WORDS, adjacent_pairs, query_phrases, word_tokens
from corvane.operators import fusion, governance, retrieval
from corvane.operators.access import Principal, permits
from corvane.operators.corpus import chunk_text
from corvane.operators.index import Index
from corvane.operators.retrieval import Prepared, RetrievalSpec


def chunk_locations(text: str, max_bytes: int) -> list[tuple[int, int] | None]:
    """Place (start, length in characters) of each chunk; after one that isn't found none is guessed."""
    out: list[tuple[int, int] | None] = []
    at = 0
    for chunk in chunk_text(text, max_bytes):
        start = text.find(chunk, at) if at is not None else -1
        if start < 0:
            at = None
            out.append(None)
        else:
            at = start + len(chunk)
            out.append((start, len(chunk)))
    return out


def locations(sources: DataFrame, max_bytes: int = 1200) -> DataFrame:
    """``chunk_id, start, length`` of every chunk of every source; null where it can't be told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, lengths = [], [], []
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, place in enumerate(chunk_locations(t or "", max_bytes)):
                    ids.append(f"{s}#{i}")
                    starts.append(place and place[0])
                    lengths.append(place and place[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["chunk_id", "start", "length"]
            )

    return sources.select("source_id", "text").mapInArrow(run, "chunk_id string, start long, length long")


def best_of_each(scored: DataFrame, n: int, descending: bool) -> DataFrame:
    """The best ``n`` of every collection, in one job for all of them."""
    order = (F.col("score").desc() if descending else F.col("score"), F.col("chunk_id"))
    by = Window.partitionBy("collection").orderBy(*order)
    # a rank that is only compared with a constant is cut off before the shuffle
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def _pools(index: Index, asked: Prepared, spec: RetrievalSpec, n: int, collections: Sequence[str] | None) -> tuple[DataFrame, DataFrame]:
    """The best ``n`` of every collection in either leg: ``pool, chunk_id, score, rank``."""
    lexical = best_of_each(retrieval.lexical_leg(index, asked, spec, collections), n, True)
    near = retrieval.vector_leg(index, asked.vector, collections)
    if spec.content_demotions:
        near = retrieval.penalised(index, best_of_each(near, max(4 * n, 10), False).drop("rank"), spec)
    return lexical.withColumnRenamed("collection", "pool"), best_of_each(near, n, False).withColumnRenamed("collection", "pool")


def phrase_fraction(index: Index, lexical: DataFrame, vector: DataFrame, query: str, n: int, rrf_k: int = 60) -> DataFrame:
    """``pool, phrase_fraction``: the share of each pool's ``n`` best fused hits that contain two words of the query as they stand there."""
    part = lambda leg: leg.select("pool", "chunk_id", (1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("part"))
    fused = part(lexical).unionByName(part(vector)).groupBy("pool", "chunk_id").agg(F.sum("part").alias("score"))
    by = Window.partitionBy("pool").orderBy(F.col("score").desc(), "chunk_id")
    hits = fused.withColumn("n", F.row_number().over(by)).where(F.col("n") <= n).select(F.col("pool").alias("collection"), "chunk_id")
    spoken = F.array_distinct(adjacent_pairs(word_tokens(F.col("text"))))
    said = F.size(F.array_intersect(spoken, query_phrases(F.lit(query)))) > 0
    texts = index.chunks().select("collection", "chunk_id", "text").join(F.broadcast(hits), ["collection", "chunk_id"])
    return texts.groupBy(F.col("collection").alias("pool")).agg((F.count_if(said) / F.count(F.lit(1))).alias("phrase_fraction"))


def retrieve_documents(
    index: Index, query: str, spec: RetrievalSpec, collections: Sequence[str] | None = None, query_vector: Sequence[float] | None = None
) -> DataFrame:
    """``collection, chunk_id, score``: probe all collections, choose some, search those, merge.

    The probe asks the query itself, without expansions. The collections with the best evidence, which phrases of the query raise, are
    searched with them; ``max_collections`` 0 chooses all. What the probe saw of the others stays in the merge with a
    lower weight. All collections are searched in one job, each to the depth of its pool.
    """
    bare = replace(spec, query_expansions=(), query_expansion_weight=0.0)
    probe = retrieval.prepare(index, query, bare, collections, query_vector)
    lex, vec = _pools(index, probe, bare, spec.probe_candidate_n, collections)
    share = phrase_fraction(index, lex, vec, query, spec.probe_candidate_n, spec.rrf_k) if spec.phrase_boost else None
    evidence = fusion.density_evidence(lex.drop("rank"), vec.drop("rank"), share, max(0.0, spec.phrase_boost))
    # a row per collection
    order = Window.orderBy(F.desc_nulls_last("lexical_evidence"), F.desc_nulls_last("vector_evidence"), "pool")
    some = evidence.where("lexical_evidence IS NOT NULL OR vector_evidence IS NOT NULL")
    ranked = some.select("pool", F.row_number().over(order).alias("rank"))
    chosen = ranked if not spec.max_collections else ranked.where(F.col("rank") <= spec.max_collections)
    deep = retrieval.prepare(index, query, spec, collections, query_vector)
    deep_lex, deep_vec = _pools(index, deep, spec, spec.candidate_pool_per_collection, collections)

    def merged(found: DataFrame, probed: DataFrame) -> DataFrame:
        names = F.broadcast(chosen.select("pool"))
        here = found.join(names, "pool", "left_semi").withColumn("is_probe", F.lit(False))
        there = probed.join(names, "pool", "left_anti").withColumn("is_probe", F.lit(True))
        return here.unionByName(there).select("pool", "chunk_id", "score", "is_probe")

    fused = fusion.fuse_pools(
        merged(deep_lex, lex), merged(deep_vec, vec), spec.rrf_k, spec.lexical_weight, spec.vector_weight, ranked, spec.collection_evidence_weight, spec.unselected_pool_weight
    )
    return retrieval.final_top(fused, spec.top_k).withColumnRenamed("pool", "collection")


def governed_query(
    index: Index, governed: DataFrame, publications: DataFrame, relations: DataFrame, principal: Principal, day: str, query: str, budget: int,
    spec: RetrievalSpec | None = None, query_vector: Sequence[float] | None = None, policies: DataFrame | None = None,
) -> DataFrame:
    """``collection, chunk_id, rank, cost``: passages of governing documents that the principal may see, once each, that fit.

    ``governed``: ``collection, chunk_id, document_id, level, compartments`` of every chunk. ``policies`` (``collection``) are the governed collections
    that are asked, all without it. If a document of one of them is ambiguous or needs review, which passages govern isn't
    decided, and there is no answer. Collections that the principal may not see
    are not searched; of the others what doesn't govern is left out of what was found, before it counts against the budget.
    """
    spec = spec or RetrievalSpec()
    verdicts = governance.governing_publications(publications, relations, day)
    if policies is not None:
        verdicts = verdicts.join(policies.select("collection").distinct(), "collection", "left_semi")
    # a few columns of the publications, read by the question below and by the search
    verdicts = verdicts.select("document_id", "verdict")
    undecided = not verdicts.where(F.col("verdict").isin("ambiguous", "review")).isEmpty()
    ruling = verdicts.where("verdict = 'governs'").select("document_id")
    seen = governed.where(permits(principal, F.col("level"), F.col("compartments")))
    # a row per collection
    open_to = [] if undecided else sorted(r.collection for r in seen.select("collection").distinct().collect())
    if not open_to:
        return governed.sparkSession.createDataFrame([], "collection string, chunk_id string, rank int, cost long")
    wide = replace(spec, top_k=spec.candidate_pool_per_collection)
    hits = retrieve_documents(index, query, wide, open_to, query_vector)
    allowed = seen.join(ruling, "document_id", "left_semi").join(F.broadcast(hits), ["collection", "chunk_id"])
    # of the few that were found
    order = Window.orderBy(F.col("score").desc(), "chunk_id", "collection")
    ranked = allowed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (spec.top_k or 10))
    passages = index.chunks(open_to).select("collection", "chunk_id", "text").join(F.broadcast(ranked), ["collection", "chunk_id"]).select(
        F.lit(0).alias("request"), "rank", "collection", "chunk_id", F.col("document_id").alias("source_id"), F.md5("text").alias("hash"), "text",
        F.ceil(F.octet_length("text") / 4).cast("long").alias("cost"),
    )
    once = fusion.drop_repeats(passages)
    # ranks name the passages
    taken = fusion.budget_taken(once.select("request", "rank", F.col("rank").cast("string").alias("chunk_id"), "cost"), budget)
    return once.join(taken.select(F.col("chunk_id").cast("int").alias("rank")), "rank").select("collection", "chunk_id", "rank", "cost")


def vocabulary_search(
    index: Index, query: str, synonyms: Sequence[Sequence[str]], spec: RetrievalSpec | None = None, query_vector: Sequence[float] | None = None
) -> DataFrame:
    """A search in which a word of a group of synonyms stands for all of them."""
    spec = spec or RetrievalSpec()
    added = [*spec.query_expansions, *(([w], [x for x in group if x != w]) for group in synonyms for w in group)]
    return retrieve_documents(index, query, replace(spec, query_expansions=added), query_vector=query_vector)


def vocabulary_candidates(collections: DataFrame, vocabularies: DataFrame, recent: DataFrame, now: str, most: int = 50) -> DataFrame:
    """Active collections whose vocabulary is due: not tried lately, not made by hand, nothing bound just now."""
    at = F.lit(now).cast("timestamp")
    due = F.col("attempted_at").isNull() | (F.col("attempted_at") < at - F.expr("INTERVAL 10 MINUTES"))
    return (
        collections.where("active")
        .join(vocabularies, "collection", "left")
        .where(due & F.coalesce("enabled", F.lit(True)) & (F.coalesce("origin", F.lit("none")) != "manual"))
        .join(recent.select("collection").distinct(), "collection", "left_anti")
        .orderBy(F.asc_nulls_first("attempted_at"), "collection")
        .limit(most)
        .select("collection", "attempted_at")
    )


def runs_last_step(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Runs with when a step of theirs last changed; a run without steps stays."""
    last = steps.groupBy("run_id").agg(F.max("updated_at").alias("last_step"), F.count(F.lit(1)).alias("steps"))
    return runs.join(last, "run_id", "left").withColumn("steps", F.coalesce("steps", F.lit(0)))


def steps_by_state(runs: DataFrame, steps: DataFrame) -> DataFrame:
    return steps.join(runs.select("run_id", "runbook"), "run_id").groupBy("runbook", "state").agg(F.count(F.lit(1)).alias("n"))


def idle_sessions(sessions: DataFrame, turns: DataFrame, now: str, ttl: str = "INTERVAL 1 DAY") -> DataFrame:
    """Sessions without a turn for longer than their time to live."""
    last = turns.groupBy("session_id").agg(F.max("created_at").alias("last_turn"))
    joined = sessions.select(F.col("id").alias("session_id"), "opened_at").join(last, "session_id", "left")
    return joined.where(F.coalesce("last_turn", "opened_at") < F.lit(now).cast("timestamp") - F.expr(ttl)).select("session_id")


def missing_builds(required: DataFrame, built: DataFrame) -> DataFrame:
    """Versions that are required and not built: to build, or to resume where a build was begun."""
    known = built.select("version_id", "state")
    return required.join(known, "version_id", "left").where("state IS NULL OR state <> 'complete'").select(
        "version_id", F.when(F.col("state").isNull(), "build").otherwise("resume").alias("action")
    )


def publish_if(bindings: DataFrame, name: str, artifact: str, expected: str | None) -> DataFrame:
    """The binding table with ``name`` at ``artifact``, from staged to serving; refused unless at ``expected``."""
    now = bindings.where(F.col("name") == name).select("artifact").first()
    if (now.artifact if now else None) != expected:
        raise ValueError(f"{name} isn't at {expected}")
    spark = bindings.sparkSession
    return bindings.where(F.col("name") != name).unionByName(spark.createDataFrame([(name, artifact, "serving")], "name string, artifact string, state string"))


def paired_bootstrap(a: Sequence[float], b: Sequence[float], resamples: int = 10_000, seed: int = 13013) -> tuple[float, float, float]:
    """Mean difference of paired outcomes with a 95 % interval."""
    d = np.asarray(a, dtype=np.float64) - np.asarray(b, dtype=np.float64)
    if not len(d):
        return 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = np.sort([d[rng.integers(0, len(d), len(d))].mean() for _ in range(resamples)])
    return float(d.mean()), float(means[int(resamples * 0.025) - 1]), float(means[int(resamples * 0.975) - 1])


def runbook_problems(runbook: dict) -> list[str]:
    """Stable codes of what is wrong with a runbook's retrieval settings and steps."""
    out = []
    steps = runbook.get("steps", [])
    known = ("resolveSources", "buildIndex", "verify", "verifyDataViews", "cutover", "retireOld")
    out += [f"step.unknown:{s}" for s in steps if s not in known]
    out += [f"step.repeated:{s}" for s in sorted({s for s in steps if steps.count(s) > 1})]
    if "cutover" in steps and ("verify" not in steps or steps.index("verify") > steps.index("cutover")):
        out.append("cutover.unverified")
    r = runbook.get("retrieval", {})
    if r.get("minimumShouldMatch", 1) not in (1, 2):
        out.append("retrieval.minimum-should-match")
    fraction = r.get("stopTermFraction", 0)
    if fraction and not 0.05 <= fraction <= 0.9:
        out.append("retrieval.stop-term-fraction")
    if r.get("topK", 10) < 1:
        out.append("retrieval.top-k")
    for e in r.get("queryExpansions", []):
        if not e.get("whenAny") or not e.get("addTerms"):
            out.append("retrieval.empty-expansion")
        elif any(w in STOP_WORDS for w in e["whenAny"]):
            out.append("retrieval.stop-word-trigger")
    return out
