"""Digests of the facts at a pin: per scope, per group of scopes, and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import claim_key, normalized_claim, scope_group
from corvane.session import materialise


def tier0(facts: DataFrame) -> DataFrame:
    """A text per scope: a count and one line per fact in order."""
    line = normalized_claim(F.col("subject"), F.col("key"), F.col("value"))
    per = facts.groupBy(F.coalesce("scope_path", F.lit("")).alias("scope")).agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.max("seq").alias("built_from_seq"),
        F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"),
    )
    text = F.concat(
        F.lit("["), F.col("scope"), F.lit("] "), F.col("n_facts").cast("string"), F.lit(" facts\n"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n"),
    )
    return per.select("scope", "n_facts", "built_from_seq", text.alias("text")).withColumn("sha256", F.sha2("text", 256))


def tier1(facts: DataFrame) -> DataFrame:
    """A summary per first segment of the scope: the claim keys, without values."""
    group = scope_group(F.coalesce("scope_path", F.lit(""))).alias("scope")
    keys = facts.select(group, claim_key(F.col("subject"), F.col("key")).alias("k")).distinct()
    listed = keys.groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list("k")), ", ").alias("keys"))
    per = facts.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_facts"), F.max("seq").alias("built_from_seq"), F.countDistinct("scope_path").alias("n_scopes")
    )
    text = F.concat(
        F.lit("[group "), F.col("scope"), F.lit("] "), F.col("n_facts").cast("string"), F.lit(" facts across "), F.col("n_scopes").cast("string"),
        F.lit(" scopes; keys: "), F.col("keys"),
    )
    return per.join(listed, "scope").select("scope", "n_facts", "built_from_seq", text.alias("text")).withColumn("sha256", F.sha2("text", 256))


def tier2(facts: DataFrame) -> DataFrame:
    """One summary of everything, of nothing too. Its scope is the empty one."""
    subjects = facts.select("subject").distinct().agg(
        F.count(F.lit(1)).alias("n_subjects"), F.array_join(F.array_sort(F.collect_list("subject")), ", ").alias("subjects")
    )
    all_ = facts.agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.coalesce(F.max("seq"), F.lit(0)).alias("built_from_seq"),
        F.countDistinct("scope_path").alias("n_scopes"),
    )
    text = F.concat(
        F.lit("[rollup] "), F.col("n_facts").cast("string"), F.lit(" facts, "), F.col("n_scopes").cast("string"), F.lit(" scopes, "),
        F.col("n_subjects").cast("string"), F.lit(" subjects: "), F.col("subjects"),
    )
    # both sides have one row
    both = all_.crossJoin(F.broadcast(subjects))
    return both.select(F.lit("").alias("scope"), "n_facts", "built_from_seq", text.alias("text")).withColumn("sha256", F.sha2("text", 256))


def ladder(facts: DataFrame) -> DataFrame:
    """All tiers. What the tiers need of the facts is written once, for every tier reads them more than once."""
    facts = materialise(facts.select("subject", "key", "value", "scope_path", "seq"), "facts")
    tiers = [t(facts).withColumn("tier", F.lit(i)) for i, t in enumerate((tier0, tier1, tier2))]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
