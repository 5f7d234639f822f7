"""Who may see what, and which collection a file belongs to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import word_tokens


@dataclass
class Principal:
    level: int
    compartments: Sequence[str] = field(default_factory=list)
    all_compartments: bool = False


def permits(principal: Principal, level: Column, compartments: Column) -> Column:
    """Level at least the row's, and every compartment of the row held."""
    high = level <= principal.level
    if principal.all_compartments:
        return high
    held = F.array(*[F.lit(c) for c in principal.compartments]) if principal.compartments else F.expr("cast(array() as array<string>)")
    return high & (F.size(F.array_except(compartments, held)) == 0)


@dataclass
class Binding:
    """Files of a collection: by any of the hashes, or by prefix and media type, whichever are set. A prefix that is empty but set has every path."""

    collection: str
    prefix: str | None = None
    media_types: Sequence[str] = ()
    content_hashes: Sequence[str] = ()


def binds(b: Binding, path: Column, media_type: Column, content_hash: Column) -> Column:
    """Whether a binding has a file; one with nothing set has none."""
    parts = [] if b.prefix is None else [path.startswith(b.prefix)]
    if b.media_types:
        parts.append(media_type.isin(list(b.media_types)))
    by_place = parts[0] if parts else F.lit(False)
    for p in parts[1:]:
        by_place = by_place & p
    return (content_hash.isin(list(b.content_hashes)) | by_place) if b.content_hashes else by_place


def matched_collections(files: DataFrame, bindings: Sequence[Binding]) -> DataFrame:
    """``source_id, collection`` for each collection that a file is bound to. Bindings are policy,
    so they are tests on each row and not a join."""
    hits = F.array_compact(
        F.array(*[F.when(binds(b, F.col("path"), F.col("media_type"), F.col("content_hash")), F.lit(b.collection)) for b in bindings])
    )
    return files.select("source_id", F.explode(F.array_distinct(hits)).alias("collection"))


def route_collections(queries: DataFrame, routes: Sequence[tuple[Sequence[str], Sequence[str]]], every: Sequence[str]) -> DataFrame:
    """``query_id, collections``: those of all routes whose trigger words, whatever their case, are all in the query; none means all."""
    tokens = word_tokens(F.col("query"))
    found = F.array_sort(
        F.array_distinct(
            F.flatten(
                F.array(
                    *[
                        F.when(
                            F.size(F.array_except(F.array(*[F.lit(t.strip().lower()) for t in triggers]), tokens)) == 0,
                            F.array(*[F.lit(c) for c in names]),
                        ).otherwise(F.expr("cast(array() as array<string>)"))
                        for triggers, names in routes
                    ]
                )
            )
        )
    )
    return queries.select("query_id", found.alias("f")).select(
        "query_id", F.when(F.size("f") > 0, F.col("f")).otherwise(F.array(*[F.lit(c) for c in sorted(every)])).alias("collections")
    )


def permitted_collections(collections: DataFrame, principal: Principal) -> DataFrame:
    return collections.where(F.col("active") & permits(principal, F.col("level"), F.col("compartments")))


def shadowed_prefixes(prefixes: DataFrame) -> DataFrame:
    """``outer, inner, outer_prefix, inner_prefix, message``: a collection whose prefix begins another's and that is less restricted.

    Less restricted is one of no higher level and no compartment that the other lacks, and strictly so in one of both.
    ``prefixes``: ``collection, prefix, level, compartments``. A prefix is matched by its own leading parts, of
    the lengths that prefixes have, so this is an equi-join and not a comparison of all pairs.
    """
    lengths = prefixes.select(F.char_length("prefix").alias("n")).distinct()
    side = lambda name: F.struct("collection", "prefix", "level", F.array_distinct("compartments").alias("held"), "compartments").alias(name)
    # as many lengths as the longest prefix has characters, at most
    lead = prefixes.select(side("b")).join(F.broadcast(lengths), F.col("n") <= F.char_length("b.prefix"))
    lead = lead.withColumn("lead", F.substring(F.col("b.prefix"), F.lit(1), F.col("n")))
    met = lead.join(prefixes.select(side("a"), F.col("prefix").alias("lead")), "lead")
    subset = F.size(F.array_except("a.held", "b.held")) == 0
    strictly = (F.col("a.level") < F.col("b.level")) | (F.size("a.held") < F.size("b.held"))
    shown = lambda x: F.concat(F.lit("["), F.array_join(F.transform(F.col(f"{x}.compartments"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ", "), F.lit("]"))
    text = lambda c: F.col(c).cast("string")
    message = F.concat(
        F.lit("collection '"), text("a.collection"), F.lit("' (level "), text("a.level"), F.lit(", compartments "), shown("a"), F.lit(") binds '"), text("a.prefix"),
        F.lit("', a prefix of the more-restricted '"), text("b.collection"), F.lit("' (level "), text("b.level"), F.lit(", "), shown("b"), F.lit(") binding '"), text("b.prefix"),
        F.lit("' — the restricted documents are also served to the wider audience; make the overlap a decision, not an accident"),
    )
    hits = met.where((F.col("a.collection") != F.col("b.collection")) & (F.col("a.level") <= F.col("b.level")) & subset & strictly)
    return hits.select(
        F.col("a.collection").alias("outer"), F.col("b.collection").alias("inner"), F.col("a.prefix").alias("outer_prefix"), F.col("b.prefix").alias("inner_prefix"), message.alias("message")
    )


def unreadable(sources: DataFrame, removals: DataFrame) -> DataFrame:
    """Sources that are under removal; reading is refused if there are any."""
    return sources.join(removals.select("source_id").distinct(), "source_id", "left_semi")
