"""Governance gates: what speaks against a batch of candidate claims.

A finding has ``cid, rule_id, severity, message, claim_key, detail``. Candidates are a batch that
one writer proposes; the accepted facts may be many, so every gate is an equi-join on the key.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.similarity import ratio_at_least
from corvane.functions.text import claim_key, count_pattern, meta_markers, value_equality
from corvane.operators.ledger import latest_per_key

SEVERITY = {"info": 0, "warn": 1, "block": 2}

# What the rules are called.
RULE_ANCHOR = "gate.anchor-consistency"
RULE_LEDGER = "gate.ledger-conflict"
RULE_ORPHAN = "gate.orphaned-reference"
RULE_META = "gate.meta-leakage"
RULE_SIMILARITY = "gate.lexical-similarity"
SIMILARITY_THRESHOLD = 0.9


def told(*parts: Column | str) -> Column:
    """A message of texts and columns; an unknown value reads as nothing."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def detail(**values: Column) -> Column:
    """A JSON object, keys in alphabetical order, unknown values as null."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))), {"ignoreNullFields": "false"})


def _finding(rule: str, severity: str, message: Column, key: Column, about: Column) -> list[Column]:
    return [
        F.col("cid"),
        F.lit(rule).alias("rule_id"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        key.cast("string").alias("claim_key"),
        about.alias("detail"),
    ]


def keyed(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("claim_key", claim_key(F.col("subject"), F.col("key")))


def _locked(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates with the anchor of their key, null without one; anchors without an id get a null one."""
    known = F.col("id") if "id" in anchors.columns else F.lit(None).cast("string")
    named = anchors.select(F.col("detail_key").alias("claim_key"), "locked_value", known.alias("anchor_id"))
    return candidates.join(named, "claim_key", "left")


def _accepted(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates with the latest accepted fact of their key, null without one."""
    latest = latest_per_key(facts).select(
        "claim_key", F.col("value").alias("canon_value"), F.col("id").alias("canon_claim_id"), F.col("seq").alias("canon_seq")
    )
    return candidates.join(latest, "claim_key", "left")


def _differs(a: str, b: str, policies: Mapping[str, str]) -> Column:
    """Whether two values differ by the policy bound to their key; the legacy one where none is bound."""
    out = ~value_equality("legacy-text-v1")(F.col(a), F.col(b))
    for policy in sorted(set(policies.values())):
        bound = F.col("claim_key").isin([k for k, p in policies.items() if p == policy])
        out = F.when(bound, ~value_equality(policy)(F.col(a), F.col(b))).otherwise(out)
    return out


def _against_anchor(policies: Mapping[str, str] = {}) -> Column:  # noqa: B006
    return F.col("locked_value").isNotNull() & _differs("value", "locked_value", policies)


def _against_ledger(policies: Mapping[str, str] = {}) -> Column:  # noqa: B006
    new = (F.col("claim_type") != "correction") & F.col("supersedes_id").isNull()
    return F.coalesce(new & F.col("canon_value").isNotNull() & _differs("value", "canon_value", policies), F.lit(False))


def _anchor_finding() -> list[Column]:
    key, value, locked = F.col("claim_key"), F.col("value"), F.col("locked_value")
    message = told("claim '", key, "=", value, "' contradicts locked anchor value '", locked, "'")
    return _finding(RULE_ANCHOR, "block", message, key, detail(claim_key=key, proposed_value=value, locked_value=locked, anchor_id=F.col("anchor_id")))


def _ledger_finding() -> list[Column]:
    key, value, canon = F.col("claim_key"), F.col("value"), F.col("canon_value")
    message = told("claim '", key, "=", value, "' conflicts with accepted canon '", key, "=", canon, "' (use a correction to supersede)")
    about = detail(claim_key=key, proposed_value=value, canon_value=canon, canon_claim_id=F.col("canon_claim_id"), canon_seq=F.col("canon_seq"))
    return _finding(RULE_LEDGER, "block", message, key, about)


def anchor_gate(candidates: DataFrame, anchors: DataFrame, policies: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """A candidate with another value than a locked anchor of its key is blocked. ``policies``: claim key to comparison policy."""
    return _locked(keyed(candidates), anchors).where(_against_anchor(policies)).select(_anchor_finding())


def ledger_gate(candidates: DataFrame, facts: DataFrame, policies: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """A new fact with another value than the latest accepted one is blocked.

    Corrections, and candidates that name what they supersede, are exempt.
    """
    return _accepted(keyed(candidates), facts).where(_against_ledger(policies)).select(_ledger_finding())


def assess_transition(facts: DataFrame, anchors: DataFrame, policies: Mapping[str, str]) -> DataFrame:
    """``claim_id`` and a finding for each fact that conflicts under other comparison policies: with its anchor, or with
    the latest other fact of its key. Facts without findings have none; their status stays what it was."""
    by = Window.partitionBy("claim_key").orderBy(F.col("seq").desc(), F.col("id").desc())
    peer = lambda c: F.when(F.row_number().over(by) == 1, F.lead(c).over(by)).otherwise(F.first(c).over(by))
    rows = keyed(facts).withColumn("canon_value", peer("value")).withColumn("canon_claim_id", peer("id")).withColumn("canon_seq", peer("seq"))
    looked = _locked(rows, anchors).withColumn("cid", F.col("id")).withColumn("claim_type", F.lit("fact")).withColumn("supersedes_id", F.lit(None).cast("string"))
    found = looked.where(_against_anchor(policies)).select(_anchor_finding()).unionByName(looked.where(_against_ledger(policies)).select(_ledger_finding()))
    return found.withColumnRenamed("cid", "claim_id")


def orphan_gate(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """A correction of something not in the ledger. Subject and whole key must both be known,
    for dots in names make keys ambiguous."""
    corrections = keyed(candidates).where("claim_type = 'correction'")
    return corrections.join(_known(facts, "subject"), "subject", "left").join(_known(facts, "claim_key"), "claim_key", "left").where(_orphaned()).select(_orphan_finding())


def _known(facts: DataFrame, name: str) -> DataFrame:
    return keyed(facts).select(name).distinct().withColumn(f"known_{name}", F.lit(True))


def _orphaned() -> Column:
    return (F.col("claim_type") == "correction") & (F.col("known_subject").isNull() | F.col("known_claim_key").isNull())


def _orphan_finding() -> list[Column]:
    key = F.col("claim_key")
    return _finding(RULE_ORPHAN, "warn", told("correction targets '", key, "' but no such canon was established"), key, detail(claim_key=key))


def meta_gate(candidates: DataFrame) -> DataFrame:
    """One finding for each marker in a candidate's text."""
    marked = candidates.withColumn("marker", F.explode(meta_markers(F.col("text"))))
    message = told("output contains meta-leakage marker '", F.col("marker"), "'")
    return marked.select(_finding(RULE_META, "warn", message, F.lit(None), detail(marker=F.col("marker"))))


def similarity_ratio(a: str, b: str) -> float:
    """Twice the matching characters over all characters, ignoring case; two empty texts are equal."""
    return ratio_at_least(a.lower(), b.lower())


def similarity_gate(pairs: DataFrame, least: float = 0.9, keep: Sequence[str] = ("cid",)) -> DataFrame:
    """``pairs``: ``cid, text, previous``. Near repetitions of a previous text, with the columns to ``keep``.

    Pairs whose lengths rule the ratio out are dropped before the comparison, and the others are dealt to all tasks one by one, for they
    take far longer to compare than to move. Blank texts are skipped.
    """
    n, m = F.char_length("text"), F.char_length("previous")
    possible = pairs.where((F.trim("text") != "") & (F.trim("previous") != "") & (2 * F.least(n, m) >= least * (n + m)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ratio = [ratio_at_least(x.lower(), y.lower(), least) for x, y in zip(b["text"], b["previous"], strict=True)]
            out = b.assign(ratio=pd.Series(ratio, b.index, "float64"))
            yield out[out["ratio"].notna()][[*keep, "previous", "ratio"]]

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep)
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    dealt = possible.select(*keep, "text", "previous").repartition(tasks, *keep, "previous")
    return dealt.mapInPandas(run, f"{schema}, previous string, ratio double")


def repetition_gate(candidates: DataFrame, previous: DataFrame, least: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """One finding for each previous text that a candidate's text nearly repeats.

    ``previous``: ``cid, previous_index, previous``, the texts before each candidate in their order, from 0; without
    ``cid`` they stand before all of them.
    """
    new = candidates.select("cid", "text")
    if "cid" in previous.columns:
        near = similarity_gate(new.join(previous.select("cid", "previous_index", "previous"), "cid"), least, ("cid", "previous_index"))
    else:  # each text is compared once, however many candidates have it
        pairs = new.select("text").distinct().crossJoin(previous.select("previous_index", "previous"))
        near = new.join(similarity_gate(pairs.withColumn("same", F.col("text")), least, ("same", "previous_index")), F.col("text") == F.col("same"))
    index, ratio = F.col("previous_index").cast("int"), F.col("ratio")
    share = F.format_string("%.0f", F.bround(ratio * 100, 0))
    message = told("output is ", share, "% similar to previous unit ", index, f" (threshold {least:.0%})")
    return near.select(_finding(RULE_SIMILARITY, "warn", message, F.lit(None), detail(previous_index=index, ratio=ratio)))


def counter_gate(candidates: DataFrame, patterns: Sequence[tuple[str, int]]) -> DataFrame:
    """``cid, pattern, found, budget`` where a text uses a pattern more often than it may."""
    rules = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(b).alias("budget")) for p, b in patterns]))
    used = candidates.select("cid", "text", rules.alias("r")).select(
        "cid", "r.pattern", count_pattern(F.col("text"), F.col("r.pattern")).alias("found"), "r.budget"
    )
    return used.where("found > budget")


def run_gates(
    candidates: DataFrame, facts: DataFrame, anchors: DataFrame, extended: bool = True, previous: DataFrame | None = None,
    policies: Mapping[str, str] = {},  # noqa: B006
) -> DataFrame:
    """All five gates. A ledger finding goes where an anchor finding says the same of the same claim.

    ``previous`` are the texts before the candidates, as in ``repetition_gate``; without any, none can be repeated. Outside extended mode blocks are warnings.
    """
    # one pass over the candidates looks up anchor and fact, and each row tells what holds of it
    looked = _accepted(_locked(keyed(candidates), anchors), facts)
    looked = looked.join(_known(facts, "subject"), "subject", "left").join(_known(facts, "claim_key"), "claim_key", "left")
    names = ("cid", "rule_id", "severity", "message", "claim_key", "detail")
    of = lambda holds, finding: F.when(holds, F.struct(*(c.alias(n) for c, n in zip(finding, names, strict=True))))
    by_anchor = _against_anchor(policies)
    # within a candidate an anchor finding stands for a ledger finding of the same key
    subsumed = F.max(by_anchor).over(Window.partitionBy("cid", "claim_key"))
    looked = looked.withColumn("__subsumed", subsumed)
    found = F.array_compact(
        F.array(
            of(by_anchor, _anchor_finding()),
            of(_against_ledger(policies) & ~F.col("__subsumed"), _ledger_finding()),
            of(_orphaned(), _orphan_finding()),
        )
    )
    out = looked.select(F.explode(found).alias("f")).select("f.*").unionByName(meta_gate(candidates))
    if previous is not None:
        out = out.unionByName(repetition_gate(candidates, previous))
    return out if extended else downgrade(out)


def downgrade(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", F.when(F.col("severity") == "block", "warn").otherwise(F.col("severity")))


def disputed(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """Candidates with the status they are stored with."""
    blocked = findings.where("severity = 'block'").select("cid").distinct().withColumn("blocked", F.lit(True))
    return candidates.join(blocked, "cid", "left").withColumn(
        "status", F.when(F.col("blocked"), "disputed").otherwise("accepted")
    ).drop("blocked")


def findings_view(
    findings: DataFrame,
    rule: str | None = None,
    rule_prefix: str | None = None,
    severity: str | None = None,
    as_of_seq: int | None = None,
) -> DataFrame:
    """Findings by rule, literal prefix of the rule, severity and pin; each may be left out. See :func:`recent` for order and limit."""
    out = findings
    if rule is not None:
        out = out.where(F.col("rule_id") == rule)
    if rule_prefix is not None:
        out = out.where(F.col("rule_id").startswith(rule_prefix))
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    if as_of_seq is not None:
        out = out.where(F.col("seq") <= as_of_seq)
    return out


def recent(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The newest ``limit`` rows by ``order``, each column descending; the limit is the feature of a recent list."""
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(limit)


def _identity() -> list[Column]:
    """What makes two findings one: rule, evidence and claim where the detail has either, else rule, scope and message."""
    bare = F.col("evidence_ref").isNull() & F.col("claim_id").isNull()
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.col("rule_id").alias("i0"), F.when(bare, empty("scope_path")).otherwise(empty("evidence_ref")).alias("i1"), F.when(bare, F.col("message")).otherwise(empty("claim_id")).alias("i2")]


def dedup_findings(incoming: DataFrame, existing: DataFrame, *order: str) -> DataFrame:
    """Incoming findings (``rule_id, severity, message, scope_path, evidence_ref, claim_id``) that are new; of repeats in the batch the first by ``order`` stays.

    A batch with a block, a rule of governance or a finding without a rule is refused whole.
    """
    wrong = incoming.where((F.col("severity") == "block") | F.startswith("rule_id", F.lit("governance.")) | (F.trim("rule_id") == "") | F.col("rule_id").isNull())
    if first := wrong.select("rule_id", "severity").head(1):
        raise ValueError(f"finding {first[0].rule_id!r} of severity {first[0].severity}: only warnings and notes of rules outside governance are filed")
    key = ["i0", "i1", "i2"]
    named = incoming.select("*", *_identity())
    fresh = named.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n = 1").drop("n")
    return fresh.join(existing.select(*_identity()).distinct(), key, "left_anti").drop(*key)


def shape_validation(candidates: DataFrame, shape: dict) -> DataFrame:
    """Violations of a subset of JSON Schema on the columns of a claim: required, type, enum, pattern, lengths."""
    checks = []
    for name, rules in shape.get("properties", {}).items():
        c = F.col(name)
        if "enum" in rules:
            checks.append((name, "enum", ~c.isin(rules["enum"])))
        if "pattern" in rules:
            checks.append((name, "pattern", ~F.regexp_like(c, F.lit(rules["pattern"]))))
        if "minLength" in rules:
            checks.append((name, "minLength", F.char_length(c) < rules["minLength"]))
        if "maxLength" in rules:
            checks.append((name, "maxLength", F.char_length(c) > rules["maxLength"]))
        if rules.get("type") == "integer":
            checks.append((name, "type", ~F.regexp_like(c, F.lit("^-?[0-9]+$"))))
    for name in shape.get("required", []):
        checks.append((name, "required", F.col(name).isNull()))
    listed = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("field"), F.lit(r).alias("rule"))) for n, r, bad in checks])
    return candidates.select("cid", F.explode(F.array_compact(listed)).alias("v")).select(
        "cid", F.lit("shape.schema-violation").alias("rule_id"), F.lit("block").alias("severity"), "v.field", "v.rule"
    )
