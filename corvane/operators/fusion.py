"""Merging results of many collections, and choosing which to search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import adjacent_pairs, word_tokens


def leg_ranks(candidates: DataFrame, *partition: str, descending: bool = True) -> DataFrame:
    """Place of each candidate in its leg, best first; what isn't a number comes last."""
    bad = F.col("score").isNull() | F.isnan("score")
    best = F.col("score").desc() if descending else F.col("score")
    ties = [c for c in ("chunk_id", "collection", "pool") if c in candidates.columns]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(bad, best, *ties)).cast("long"))


def fuse_pools(
    lexical: DataFrame,
    vector: DataFrame,
    k: int = 60,
    lexical_weight: float = 1.0,
    vector_weight: float = 1.0,
    evidence: DataFrame | None = None,
    evidence_weight: float = 0.0,
    unselected_weight: float = 1.0,
    depth: int | None = None,
) -> DataFrame:
    """``pool, chunk_id, score`` over pooled candidates (``pool, chunk_id, score, is_probe``).

    Ranks are taken over all pools together, apart for probed and selected ones; probes weigh
    ``unselected_weight``. ``evidence`` (``pool, rank``) adds a leg for how good a collection looks. With a ``depth`` each pool gives its best so
    many to either leg, which bounds what is ranked together; without one the caller's pools must be bounded.
    """
    if depth is not None:
        lexical = leg_ranks(lexical, "pool", "is_probe").where(F.col("rank") <= depth).drop("rank")
        vector = leg_ranks(vector, "pool", "is_probe", descending=False).where(F.col("rank") <= depth).drop("rank")
    legs = [(leg_ranks(lexical, "is_probe"), lexical_weight), (leg_ranks(vector, "is_probe", descending=False), vector_weight)]
    parts = [
        df.select(
            "pool", "chunk_id",
            (F.when(F.col("is_probe"), F.lit(float(unselected_weight))).otherwise(1.0) * F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part"),
        )
        for df, w in legs
    ]
    fused = parts[0].unionByName(parts[1]).groupBy("pool", "chunk_id").agg(F.sum("part").alias("score"))
    if evidence is not None and evidence_weight:
        bonus = F.coalesce(F.lit(float(evidence_weight)) / (F.lit(k) + F.col("pool_rank")), F.lit(0.0))
        fused = fused.join(evidence.select("pool", F.col("rank").alias("pool_rank")), "pool", "left").withColumn("score", F.col("score") + bonus).drop("pool_rank")
    return fused


def interleave_domains(candidates: DataFrame, descending: bool = True) -> DataFrame:
    """Candidates whose scores only compare within a domain: by rank in it, then domain, then id."""
    ranked = leg_ranks(candidates, "domain", descending=descending)
    return ranked.select("domain", "chunk_id", "rank")


def density_evidence(lexical: DataFrame, vector: DataFrame, phrase_fraction: DataFrame | None = None, boost: float = 3.0) -> DataFrame:
    """``pool, lexical_evidence, vector_evidence``: sums of the three best of either leg."""
    best = lambda c, up: F.aggregate(
        F.slice(F.sort_array(F.collect_list(c), asc=up), 1, 3), F.lit(0.0), lambda s, x: s + x
    )
    # three of each pool are enough, so the rank drops the rest before they meet
    a = leg_ranks(lexical, "pool").where("rank <= 3").groupBy("pool").agg(best("score", False).alias("lexical_evidence"))
    b = leg_ranks(vector, "pool", descending=False).where("rank <= 3").groupBy("pool").agg((-best("score", True)).alias("vector_evidence"))
    both = a.join(b, "pool", "full_outer")
    if phrase_fraction is not None:
        both = both.join(phrase_fraction, "pool", "left").withColumn(
            "lexical_evidence", F.col("lexical_evidence") * (1 + F.lit(boost) * F.coalesce("phrase_fraction", F.lit(0.0)))
        )
    return both.select("pool", "lexical_evidence", "vector_evidence")


def select_collections(evidence: DataFrame, most: int) -> DataFrame:
    """The collections with the best evidence; those without any are left out."""
    some = evidence.where("lexical_evidence IS NOT NULL OR vector_evidence IS NOT NULL")
    return some.orderBy(F.desc_nulls_last("lexical_evidence"), F.desc_nulls_last("vector_evidence"), "pool").limit(most)


def routing_evidence(hits: DataFrame, terms: list[str], phrases: list[str]) -> DataFrame:
    """Per pool over its hits (``pool, chunk_id, text, score``): how much of the query it covers.

    ``coverage``: share of terms some hit has; ``multi``: share of hits with two terms or more;
    ``phrase``: share of hits with a phrase; ``margin``: lead of the best score over the third, as a part of the best, 0 without a third. Scores that
    aren't numbers don't count for it; of distances, ``score`` is ``1 / (1 + distance)``.
    """
    tokens = word_tokens(F.col("text"))
    wanted = F.array(*[F.lit(t) for t in terms])
    spoken = F.array(*[F.lit(p) for p in phrases]) if phrases else F.expr("cast(array() as array<string>)")
    finite = F.coalesce(~F.isnan("score") & (F.abs("score") != float("inf")), F.lit(False))
    seen = hits.select(
        "pool", "score",
        F.array_intersect(wanted, tokens).alias("has"),
        F.arrays_overlap(spoken, adjacent_pairs(tokens)).alias("phrase"),
        F.row_number().over(Window.partitionBy("pool").orderBy(F.when(~finite, 1).otherwise(0), F.col("score").desc(), "chunk_id")).alias("place"),
        finite.alias("finite"),
    )
    return seen.groupBy("pool").agg(
        F.count(F.lit(1)).alias("hits"),
        (F.size(F.array_distinct(F.flatten(F.collect_set("has")))) / len(terms)).alias("coverage"),
        (F.count_if(F.size("has") >= 2) / F.count(F.lit(1))).alias("multi"),
        (F.count_if("phrase") / F.count(F.lit(1))).alias("phrase"),
        F.max(F.when(F.col("finite") & (F.col("place") == 1), F.col("score"))).alias("best"),
        F.max(F.when(F.col("finite") & (F.col("place") == 3), F.col("score"))).alias("third"),
    ).withColumn("margin", F.when(F.col("third").isNull() | (F.col("best") <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("best") - F.col("third")) / F.col("best"))))).drop("best", "third")


def routing_score(evidence: DataFrame, boost: float = 3.0) -> DataFrame:
    return evidence.withColumn("routing", (F.col("coverage") + F.col("multi")) / 2 * (1 + F.lit(boost) * F.col("phrase")))


def routing_rank(scored: DataFrame) -> DataFrame:
    """Pools by score, margin, hits and name. A row per collection."""
    by = Window.orderBy(F.col("routing").desc(), F.col("margin").desc(), F.col("hits").desc(), "pool")
    return scored.withColumn("rank", F.row_number().over(by).cast("long"))


def leg_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """``overlap, fraction, mean_move, max_move`` between two ranked lists (``chunk_id, rank``)."""
    both = a.select("chunk_id", F.col("rank").alias("ra")).join(b.select("chunk_id", F.col("rank").alias("rb")), "chunk_id", "full_outer")
    common = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    move = F.when(common, F.abs(F.col("ra") - F.col("rb")))
    return both.agg(
        F.count_if(common).alias("overlap"),
        F.round(F.count_if(common) / F.greatest(F.count("ra"), F.count("rb"), F.lit(1)), 6).alias("fraction"),
        F.round(F.avg(move), 6).alias("mean_move"),
        F.max(move).alias("max_move"),
    )


def shadow_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """``chunk_id, state``: what one side lacks, or has with another hash."""
    x = a.select("chunk_id", F.col("hash").alias("ha"))
    y = b.select("chunk_id", F.col("hash").alias("hb"))
    state = F.when(F.col("ha").isNull(), "only_right").when(F.col("hb").isNull(), "only_left").when(F.col("ha") != F.col("hb"), "differs")
    return x.join(y, "chunk_id", "full_outer").select("chunk_id", state.alias("state")).where("state IS NOT NULL")


def _fitting(passages: DataFrame, budget: int, by: str) -> DataFrame:
    """``by, used, ids``: what is taken of each request, in order."""
    listed = passages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "cost"))).alias("p"))
    taken = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<string>)").alias("ids")),
        lambda acc, x: F.when(
            acc["used"] + x["cost"] <= budget,
            F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["ids"], F.array(x["chunk_id"])).alias("ids")),
        ).otherwise(acc),
    )
    return listed.select(by, taken.alias("t")).select(by, "t.used", "t.ids")


def budget_pack(passages: DataFrame, budget: int, by: str = "request") -> DataFrame:
    """Per request, passages taken best first while they fit; one that doesn't is skipped. Their ids joined with commas, to be shown.

    ``passages``: ``request, rank, chunk_id, cost``; a request has as many as its search returned.
    """
    return _fitting(passages, budget, by).select(by, "used", F.array_join("ids", ",").alias("taken"))


def budget_taken(passages: DataFrame, budget: int, by: str = "request") -> DataFrame:
    """``request, chunk_id``: a row for each passage that :func:`budget_pack` takes, whatever characters its id has."""
    return _fitting(passages, budget, by).select(by, F.explode("ids").alias("chunk_id"))


def drop_repeats(passages: DataFrame) -> DataFrame:
    """The best ranked of passages with equal source, hash and text."""
    by = Window.partitionBy("request", "source_id", "hash", "text").orderBy("rank")
    return passages.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")
