"""Whether an answer is borne out by what was served: quotes, citations, references to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quotes shorter than this, in bytes, aren't checked.
LEAST_QUOTE = 15
_S = r"\p{IsWhite_Space}"


def _spaced(c: Column) -> Column:
    """White space collapsed; case stays."""
    return F.regexp_replace(F.regexp_replace(c, rf"^{_S}+|{_S}+$", ""), rf"{_S}+", " ")


def quoted_spans(answers: DataFrame) -> DataFrame:
    """``answer_id, quote`` of each span between two quotation marks, straight or curly, that is long enough.

    Any mark ends a span that any other began; one that none ends isn't a span.
    """
    pieces = F.split("answer", '["“”]', -1)
    inside = F.filter(pieces, lambda p, i: (i % 2 == 1) & (i < F.size(pieces) - 1))
    spans = answers.select("answer_id", F.explode(inside).alias("quote"))
    return spans.where(F.octet_length(F.regexp_replace("quote", rf"^{_S}+|{_S}+$", "")) >= LEAST_QUOTE)


def check_quotes(answers: DataFrame, served: DataFrame) -> DataFrame:
    """Quotes that no text served with the answer contains word by word, white space aside."""
    spans = quoted_spans(answers)
    borne = (
        spans.distinct()
        .join(served.select("answer_id", _spaced(F.col("text")).alias("t")), "answer_id")
        .where(F.contains("t", _spaced(F.col("quote"))))
        .select("answer_id", "quote")
        .distinct()
    )
    return spans.join(borne, ["answer_id", "quote"], "left_anti")


def check_citations(answers: DataFrame, served: DataFrame) -> DataFrame:
    """Labels in brackets with a '/' that weren't served with the answer, each once. Labels may have spaces, but no line ends."""
    tokens = F.transform(F.regexp_extract_all("answer", F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda t: F.regexp_replace(t, rf"^{_S}+|{_S}+$", ""))
    labels = F.filter(tokens, lambda t: F.contains(t, F.lit("/")) & ~F.contains(t, F.lit("\n")))
    cited = answers.select("answer_id", F.explode(F.array_distinct(labels)).alias("path"))
    return cited.join(served.select("answer_id", "path").distinct(), ["answer_id", "path"], "left_anti")


#: Fixed value: how a block of assertions begins.
FENCE = "```assertions"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_S}+|{_S}+$", "")


def _reference(ref: Column) -> Column:
    """``evidence_id, row_id`` of ``evidence/id#row``, the id ending at the first '#'; null for anything else."""
    rest = F.substring(ref, F.lit(10), F.char_length(ref))
    at = F.instr(rest, "#")
    whole = F.startswith(ref, F.lit("evidence/")) & (at > 1) & (at < F.char_length(rest))
    return F.when(whole, F.struct(F.substring(rest, F.lit(1), at - 1).alias("evidence_id"), F.substring(rest, at + 1, F.char_length(rest)).alias("row_id")))


def check_evidence_citations(answers: DataFrame, cells: DataFrame) -> DataFrame:
    """``answer_id, ref``: each ``[evidence/id#row]`` of an answer, once, that names a row which wasn't served (``evidence_id, row_id``)."""
    refs = F.transform(F.regexp_extract_all("answer", F.lit(r"\[([^\]]*)\]"), F.lit(1)), _trimmed)
    cited = answers.select("answer_id", F.explode(F.array_distinct(refs)).alias("ref")).withColumn("x", _reference(F.col("ref"))).where("x IS NOT NULL")
    served = cells.select("evidence_id", "row_id").distinct()
    return cited.select("answer_id", "ref", "x.*").join(served, ["evidence_id", "row_id"], "left_anti").select("answer_id", "ref")


def check_assertions(answers: DataFrame, cells: DataFrame) -> DataFrame:
    """``answer_id, value, ref, fault``: what is wrong with an answer's block of typed assertions (``[{"value", "evidence_refs"}]`` in JSON).

    Faults: ``unclosed`` and ``unparsed`` blocks; ``no_evidence``; ``not_a_reference``; ``not_served``; and ``not_in_row`` for an assertion with one
    reference, whose value must be a cell of that row, white space around either aside. A value with several references is
    derived from them and needn't be in any. Answers without a block have no faults. ``cells``: ``evidence_id, row_id, value``.
    """
    at = F.instr("answer", FENCE)
    body = F.substring(F.col("answer"), at + len(FENCE), F.char_length("answer"))
    end = F.instr(body, "```")
    kind = "array<struct<value: string, evidence_refs: array<string>>>"
    blocks = answers.where(at > 0).select("answer_id", (end == 0).alias("unclosed"), F.from_json(_trimmed(F.substring(body, F.lit(1), end - 1)), kind, {"mode": "PERMISSIVE"}).alias("said"))
    parsed = F.col("said").isNotNull() & F.forall("said", lambda x: x["value"].isNotNull())
    none = F.lit(None).cast("string")
    broken = blocks.where(F.col("unclosed") | ~F.coalesce(parsed, F.lit(False))).select("answer_id", none.alias("value"), none.alias("ref"), F.when(F.col("unclosed"), "unclosed").otherwise("unparsed").alias("fault"))
    said = blocks.where(~F.col("unclosed") & parsed).select("answer_id", F.posexplode("said").alias("n", "a")).select("answer_id", "n", "a.value", F.coalesce("a.evidence_refs", F.array().cast("array<string>")).alias("refs"))
    bare = said.where(F.size("refs") == 0).select("answer_id", "value", none.alias("ref"), F.lit("no_evidence").alias("fault"))
    each = said.select("answer_id", "value", F.size("refs").alias("m"), F.explode("refs").alias("ref")).withColumn("x", _reference(F.col("ref"))).select("answer_id", "value", "m", "ref", F.col("x").isNotNull().alias("ok"), "x.*")
    # a row has as many values as its table has columns
    rows = cells.groupBy("evidence_id", "row_id").agg(F.collect_set(_trimmed(F.col("value").cast("string"))).alias("served"))
    fault = (
        F.when(~F.col("ok"), "not_a_reference")
        .when(F.col("served").isNull(), "not_served")
        .when((F.col("m") == 1) & ~F.array_contains("served", _trimmed(F.col("value"))), "not_in_row")
    )
    judged = each.join(rows, ["evidence_id", "row_id"], "left").select("answer_id", "value", "ref", fault.alias("fault")).where("fault IS NOT NULL")
    return broken.unionByName(bare).unionByName(judged)


#: What an answer says that declares the evidence insufficient.
INSUFFICIENT = (
    "insufficient evidence", "does not establish", "cannot establish", "not enough evidence", "no evidence", "cannot answer", "not answerable",
    "do not have enough", "does not contain", "not found in the evidence",
)


def _verdict(checks: list[Column], without_answer: bool) -> Column:
    """Of checks that are true, false, not made (-1) or without an answer (null), as numbers: ``-``, ``FAIL``, ``n/a`` or ``PASS``."""
    made = F.filter(F.array(*checks), lambda x: x.isNull() | (x >= 0))
    undecided = F.lit("n/a" if without_answer else "FAIL")
    return F.when(F.size(made) == 0, "-").when(F.exists(made, lambda x: F.coalesce(x == 0, F.lit(False))), "FAIL").when(F.exists(made, lambda x: x.isNull()), undecided).otherwise("PASS")


def grade(answers: DataFrame, expectations: DataFrame, complete: bool = True) -> DataFrame:
    """``case_id, evidence, answer, hard_fail, leaked``: cases against what they should cite and say.

    ``answers``: ``case_id, answer`` (null if there is none) and ``cited``; ``expectations``: ``case_id`` and, each null where nothing is expected,
    ``cite_all, cite_any, must_not_cite`` (prefixes of paths), ``contains_all, conflict_cite_all, conflict_cite_any, sides`` (of a conflict, each with
    the words of which one must be said) and ``insufficient``. A cited path below a forbidden prefix fails the case for good. What an answer should say is judged only if
    an answer was asked for and came; else it is ``n/a``, or a failure if one was asked for.
    """
    j = answers.join(expectations, "case_id")
    text = F.lower(F.coalesce("answer", F.lit("")))
    ran = F.lit(complete) & (_trimmed(F.coalesce("answer", F.lit(""))) != "")
    leaked = F.filter("cited", lambda p: F.exists(F.coalesce("must_not_cite", F.array().cast("array<string>")), lambda x: F.startswith(p, x)))
    every = lambda c: F.size(F.array_except(c, "cited")) == 0
    some = lambda c: F.coalesce(F.arrays_overlap(c, "cited"), F.lit(False))
    made = lambda c, ok: F.when(F.col(c).isNull(), -1).otherwise(ok.cast("int"))
    said = lambda c, ok: F.when(F.col(c).isNull(), -1).when(ran, ok.cast("int"))
    evidence = [made("cite_any", some("cite_any")), made("cite_all", every("cite_all")), made("must_not_cite", F.size(leaked) == 0), made("conflict_cite_all", every("conflict_cite_all")), made("conflict_cite_any", some("conflict_cite_any"))]
    has = lambda t: F.contains(text, F.lower(t))
    declared = F.lit(False)
    for m in INSUFFICIENT:
        declared = declared | F.contains(text, F.lit(m))
    answer = [
        F.when(F.lit(not complete) | ran, -1),  # an answer that was asked for and didn't come
        said("contains_all", F.forall("contains_all", has)),
        said("sides", F.forall("sides", lambda side: F.exists(side, has))),
        F.when(~F.coalesce("insufficient", F.lit(False)), -1).when(ran, declared.cast("int")),
    ]
    return j.select("case_id", _verdict(evidence, False).alias("evidence"), _verdict(answer, not complete).alias("answer"), (F.size(leaked) > 0).alias("hard_fail"), leaked.alias("leaked"))


# What providers call their counts.
_OWN_INPUT = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
_TOTALS = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_tokens_details", "completion_tokens_details")
_DETAILS = {"prompt_tokens_details": "cached_tokens", "completion_tokens_details": "reasoning_tokens"}


def _other_than(parts: Column, allowed: str) -> Column:
    """Whether a map has a value other than zero under another key."""
    return F.exists(F.map_entries(parts), lambda e: (e["key"] != allowed) & ~e["value"].eqNullSafe(F.lit("0")))


def provider_usage(responses: DataFrame) -> DataFrame:
    """``id, input, output, cache_read, cache_write, reasoning, context, unknown_categories`` of answers in JSON (``id, provider, response``, and ``embedding``
    if some are), as :func:`corvane.operators.money.calculate` takes them.

    Only whole numbers of JSON count; what isn't said stays null and is never taken for none. One family of providers counts cached input apart from its
    input, so it is added; the other names cached and reasoning parts of its totals. A count of another name, unless it is a detail of zero, is an
    unknown category.
    """
    rows = responses.withColumn("v", F.try_parse_json("response")).withColumn("u", F.get_json_object("response", "$.usage"))
    embedding = F.col("embedding") if "embedding" in responses.columns else F.lit(False)
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    whole = lambda path: F.when((kind(path) == "BIGINT") & (F.try_variant_get("v", path, "bigint") >= 0), F.try_variant_get("v", path, "bigint"))
    keys = F.json_object_keys("u")
    has = lambda key: F.array_contains(keys, key)
    local, apart, told = F.col("provider") == "ollama", F.col("provider") == "anthropic", kind("$.usage").startswith("OBJECT")
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    optional = lambda key: F.when(~has(key), zero).otherwise(whole(f"$.usage.{key}"))
    read, write = optional("cache_read_input_tokens"), optional("cache_creation_input_tokens")
    odd_detail = F.lit(False)
    for name, allowed in _DETAILS.items():
        parts = F.from_json(F.get_json_object("u", f"$.{name}"), "map<string,string>")
        others = _other_than(parts, allowed)
        odd_detail = odd_detail | (has(name) & F.when(kind(f"$.usage.{name}").startswith("OBJECT"), F.coalesce(others, F.lit(False))).otherwise(True))
    known = lambda names: F.array(*map(F.lit, names))
    unknown = (F.size(F.array_except(keys, F.when(apart, known(_OWN_INPUT)).otherwise(known(_TOTALS)))) > 0) | odd_detail
    pick = lambda of_local, of_apart, other: F.when(local, of_local).when(told & apart, of_apart).when(told, other)
    out = F.when(local | told, F.when(embedding, zero).otherwise(pick(whole("$.eval_count"), whole("$.usage.output_tokens"), whole("$.usage.completion_tokens"))))
    return rows.select(
        "id",
        pick(whole("$.prompt_eval_count"), whole("$.usage.input_tokens") + read + write, whole("$.usage.prompt_tokens")).alias("input"),
        out.alias("output"),
        pick(none, read, whole("$.usage.prompt_tokens_details.cached_tokens")).alias("cache_read"),
        pick(none, write, zero).alias("cache_write"),
        pick(none, none, whole("$.usage.completion_tokens_details.reasoning_tokens")).alias("reasoning"),
        none.alias("context"),
        F.coalesce(~local & told & unknown, F.lit(False)).alias("unknown_categories"),
    )


#: Kinds of questions, in the order they are looked for.
INTENTS = ("lookup", "aggregation", "comparison", "enumeration", "timeline", "other")


def intent(label):
    """The first kind that a model's label names; null if it names none."""
    out = F.lit(None).cast("string")
    for kind in reversed(INTENTS):
        out = F.when(F.contains(F.lower(label), F.lit(kind)), kind).otherwise(out)
    return out


def model_expansion(raw, query, most: int = 12):
    """Terms that a model offered as a JSON list of texts, which may stand within other text; null if there is none to read.

    Kept are lower-case words of letters, hyphens and apostrophes, 2 to 40 bytes, that the query doesn't have, each once.
    """
    strict = lambda t: F.try_variant_get(F.try_parse_json(t), "$", "array<variant>")
    texts = lambda v: F.when(
        F.forall(v, lambda x: F.schema_of_variant(x) == "STRING"), F.transform(v, lambda x: F.try_variant_get(x, "$", "string"))
    )
    first, last = F.locate("[", raw), F.char_length(raw) - F.locate("]", F.reverse(raw)) + 1
    embedded = F.when((first > 0) & F.contains(raw, F.lit("]")) & (last > first), F.substring(raw, first, last - first + 1)).otherwise("[]")
    terms = F.transform(F.coalesce(texts(strict(raw)), texts(strict(embedded))), lambda x: F.regexp_replace(x, rf"^{_S}+|{_S}+$", ""))
    had = F.split(F.lower(query), r"[^\p{IsAlphabetic}\p{N}]+")
    good = F.filter(
        terms,
        lambda x: F.octet_length(x).between(2, 40)
        & (x == F.lower(x))
        & F.regexp_like(x, F.lit(r"^[\p{IsAlphabetic}'-]*\p{IsAlphabetic}[\p{IsAlphabetic}'-]*$"))
        & ~F.array_contains(had, x),
    )
    return F.slice(F.array_distinct(good), 1, most)


#: Fixed value: what stands for a response with a secret in it.
SECRET = '{"redacted":"response contains secret material; not stored"}'


def logged_body(body: Column, cap: int = 4096, secret: Column | None = None) -> Column:
    """What is logged of a body: JSON up to ``cap`` bytes as it is, else hash and length; a marker where it has a secret. An empty body is null."""
    size = F.octet_length(body)
    stand_in = F.concat(F.lit('{"bytes_len":'), size.cast("string"), F.lit(',"sha256":"'), F.sha2(body, 256), F.lit('"}'))
    kept = F.when(size == 0, None).when((size <= cap) & F.try_parse_json(body).isNotNull(), body).otherwise(stand_in)
    return kept if secret is None else F.when(F.coalesce(secret, F.lit(False)), SECRET).otherwise(kept)
