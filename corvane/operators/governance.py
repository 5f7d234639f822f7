"""Which publication of a document governs on a day, and what needs review."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import value_equality
from corvane.operators.commits import HeadConflict
from corvane.session import materialise

#: Relations that need the document they point to, and those that amend it.
NEEDS = ("requires", "amends", "applies-to", "exception-to")
AMENDS = ("amends", "applies-to", "exception-to")


def active(at: Column, start: str = "effective_from", until: str = "effective_until") -> Column:
    """Half-open: from the first day on, before the last."""
    return (F.col(start) <= at) & (F.col(until).isNull() | (F.col(until) > at))


def _flag(documents: DataFrame, name: str, flag: str) -> DataFrame:
    return documents.select(F.col(name).alias("document_id")).distinct().withColumn(flag, F.lit(True))


def governing_publications(publications: DataFrame, relations: DataFrame, day: str) -> DataFrame:
    """``document_id, id, verdict``, and ``collection`` if there is one: the latest publication begun by ``day``, and what it comes to.

    A withdrawn latest one never lets an earlier one back; two latest ones are ambiguous. A document that a standing one
    supersedes is superseded, but if it supersedes another itself, the chain needs review. So do documents that
    govern and conflict with any other, or that require, amend, apply to or except one that doesn't govern.
    """
    at = F.lit(day).cast("date")
    begun = publications.where(F.col("effective_from") <= at)
    place = ["collection"] if "collection" in publications.columns else []
    order = F.struct("effective_from", "published_at")
    latest = begun.groupBy("document_id").agg(F.max(order).alias("top"))
    # of several latest ones the first by id stands for the others, deterministically
    top = (
        begun.join(latest, "document_id")
        .where(order == F.col("top"))
        .groupBy("document_id")
        .agg(F.countDistinct("id").alias("ties"), F.min_by(F.struct("id", "state", "effective_until", *place), "id").alias("x"))
    )
    # each is read by several of the questions below
    top = materialise(top, "latest")
    now = materialise(relations.where(active(at)).select("from_document", "to_document", "kind"), "relations")
    standing = (F.col("x.state") != "withdrawn") & (F.col("x.effective_until").isNull() | (F.col("x.effective_until") > at))
    known = top.select("document_id", standing.alias("stands"))
    ends = now.where("kind = 'supersedes'").join(known.where("stands").select(F.col("document_id").alias("from_document")), "from_document", "left_semi")
    replaced = _flag(ends, "to_document", "replaced")
    chained = _flag(now.where("kind = 'supersedes'").join(replaced.select(F.col("document_id").alias("from_document")), "from_document", "left_semi"), "from_document", "chained")
    governs = known.where("stands").join(replaced, "document_id", "left_anti").select("document_id")
    unmet = _flag(now.where(F.col("kind").isin(*NEEDS)).join(governs.select(F.col("document_id").alias("to_document")), "to_document", "left_anti"), "from_document", "unmet")
    clash = _flag(now.where("kind = 'conflicts'"), "from_document", "clash")
    verdict = (
        F.when(F.col("ties") > 1, "ambiguous")
        .when(F.col("chained"), "review")
        .when(F.col("x.state") == "withdrawn", "withdrawn")
        .when(F.col("x.effective_until") <= at, "expired")
        .when(F.col("replaced"), "superseded")
        .when(F.col("unmet") | F.col("clash"), "review")
        .otherwise("governs")
    )
    joined = top
    for side in (replaced, chained, unmet, clash):
        joined = joined.join(side, "document_id", "left")
    return joined.select("document_id", F.col("x.id").alias("id"), verdict.alias("verdict"), *(F.col(f"x.{c}").alias(c) for c in place))


def governing(verdicts: DataFrame) -> DataFrame:
    """The documents that govern, of collections in which nothing needs review.

    One ambiguous document, or one for review, leaves its whole collection undecided.
    """
    undecided = verdicts.where(F.col("verdict").isin("ambiguous", "review")).select("collection").distinct()
    return verdicts.where("verdict = 'governs'").join(undecided, "collection", "left_anti").select("collection", "document_id", "id")


def amendment_review(selected: DataFrame, relations: DataFrame, day: str) -> DataFrame:
    """Selected documents that an active amendment or exception touches, from either side."""
    touching = relations.where(active(F.lit(day).cast("date")) & F.col("kind").isin(*AMENDS))
    either = touching.select(F.explode(F.array("from_document", "to_document")).alias("document_id")).distinct()
    return selected.join(either, "document_id", "left_semi")


@dataclass
class ComparisonProfile:
    """How the values of named facts are compared: (subject, key) to a comparison policy."""

    values: dict[tuple[str, str], str] = field(default_factory=dict)

    def problems(self) -> list[str]:
        out = [f"policy subject/key must be nonempty, unpadded and dot-free: {p!r}" for k in self.values for p in k if not p or p.strip() != p or "." in p]
        for policy in self.values.values():
            try:
                value_equality(policy)
            except ValueError as e:
                out.append(str(e))
        return out

    def revision(self) -> str:
        """Names what the profile says, in whatever order it was said."""
        if wrong := self.problems():
            raise ValueError("; ".join(wrong))
        listed = [{"subject": s, "key": k, "comparison": p} for (s, k), p in sorted(self.values.items())]
        text = json.dumps({"schema_version": 1, "values": listed}, ensure_ascii=False, separators=(",", ":"))
        return f"governance-v1:{hashlib.sha256(text.encode()).hexdigest()}"

    def policies(self) -> dict[str, str]:
        """Claim key to policy, as the gates take them."""
        return {f"{s}.{k}": p for (s, k), p in self.values.items()}


def inherited_profile(
    parent: ComparisonProfile | None, own: ComparisonProfile | None, head: int, from_revision: str | None = None, expected_head: int | None = None, reason: str = ""
) -> tuple[ComparisonProfile, bool]:
    """The profile of a child version, and whether it changes its parent's, so that the parent's facts need assessing.

    Without one of its own a child has its parent's. A change must name the parent's revision and head as they are, and why.
    """
    old = parent or ComparisonProfile()
    new = old if own is None else own
    changed = new.revision() != old.revision()
    stated = from_revision is not None or expected_head is not None
    if stated and (parent is None or not changed):
        raise ValueError("governance transition requires a changed child policy")
    if changed and parent is not None:
        if from_revision is None:
            raise ValueError("policy change requires governance_transition")
        if from_revision != old.revision() or not reason.strip():
            raise ValueError("governance transition requires the current revision and a reason")
        if expected_head != head:
            raise HeadConflict(f"head is {head}, expected {expected_head}")
    return new, changed
