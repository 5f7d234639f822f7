"""Text functions as Column expressions, and the few that need Python as Arrow UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual English stop list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now"
).split()

# Phrases that give away an assistant or a template.
META_MARKERS = ("as an ai", "as a language model", "i cannot assist", "i'm sorry, but", "[insert", "lorem ipsum")


def normalized_claim(subject: Column, key: Column, value: Column) -> Column:
    """``subject.key=value``, each part trimmed."""
    return F.concat(F.trim(subject), F.lit("."), F.trim(key), F.lit("="), F.trim(value))


def split_normalized(c: Column) -> Column:
    """Struct ``subject, key, value``, each trimmed: the first ``=`` ends the name, its last ``.`` splits it.

    A name without ``.`` is a key without subject, a text without ``=`` a value without name.
    """
    named = c.contains("=")
    name = F.trim(F.substring_index(c, "=", 1))
    key = F.substring_index(name, ".", -1)
    subject = F.substring(name, F.lit(1), F.greatest(F.lit(0), F.char_length(name) - F.char_length(key) - 1))
    value = F.substring(c, F.char_length(F.substring_index(c, "=", 1)) + 2, F.char_length(c))
    return F.struct(
        F.when(named, F.trim(subject)).otherwise(F.lit("")).alias("subject"),
        F.when(named, F.trim(key)).otherwise(F.lit("")).alias("key"),
        F.trim(F.when(named, value).otherwise(c)).alias("value"),
    )


def claim_key(subject: Column, key: Column) -> Column:
    return F.concat(subject, F.lit("."), key)


def fold(c: Column) -> Column:
    """Equality of the legacy text policy: white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def value_equality(policy: str):
    """The comparison a policy id names; an unknown id is refused."""
    if policy == "legacy-text-v1":
        return lambda a, b: fold(a).eqNullSafe(fold(b))
    if policy == "exact-string-v1":
        return lambda a, b: a.eqNullSafe(b)
    raise ValueError(f"unknown comparison policy {policy!r}")


def scope_matches(scope: Column, prefix: str) -> Column:
    """The scope itself or one below it; a null scope matches no prefix."""
    return (scope == prefix) | scope.startswith(prefix + ".")


def scope_group(scope: Column) -> Column:
    return F.substring_index(scope, ".", 1)


def count_pattern(text: Column, pattern: Column) -> Column:
    """Case-insensitive occurrences that don't overlap; an empty pattern occurs nowhere."""
    t, p = F.lower(text), F.lower(pattern)
    rest = F.char_length(F.replace(t, p, F.lit("")))
    return F.when(F.char_length(p) == 0, 0).otherwise((F.char_length(t) - rest) / F.greatest(F.char_length(p), F.lit(1))).cast("int")


def word_tokens(text: Column) -> Column:
    """Runs of letters and numbers, lower-cased, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != "")


def content_terms(text: Column) -> Column:
    """Distinct tokens that aren't stop words, in order of first occurrence."""
    return F.array_distinct(F.filter(word_tokens(text), lambda x: ~x.isin(STOP_WORDS)))


def adjacent_pairs(tokens: Column) -> Column:
    """``a b`` for each two tokens in a row."""
    n = F.size(tokens)
    return F.when(
        n > 1,
        F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)),
    ).otherwise(F.expr("cast(array() as array<string>)"))


def query_phrases(text: Column) -> Column:
    """Distinct pairs of adjacent tokens, neither a stop word."""
    kept = lambda p: ~F.split(p, " ")[0].isin(STOP_WORDS) & ~F.split(p, " ")[1].isin(STOP_WORDS)
    return F.array_distinct(F.filter(adjacent_pairs(word_tokens(text)), kept))


def has_phrase(tokens: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` occur next to each other."""
    words = phrase.lower().split()
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")


def meta_markers(text: Column) -> Column:
    """The markers that a text contains, in the order listed."""
    return F.filter(F.array(*[F.lit(m) for m in META_MARKERS]), lambda m: F.contains(F.lower(text), m))


def glob(pattern: str) -> str:
    """Anchored, case-insensitive regular expression for a pattern with ``*``."""
    return "(?is)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def sample_text(text: Column, budget: int) -> Column:
    """Head, middle and tail of a text longer than ``budget`` characters."""
    n = F.char_length(text)
    if budget < 9:
        return F.when(n <= budget, text).otherwise(F.substring(text, 1, budget))
    width = (budget - 6) // 3
    middle = F.floor(n / 2 - F.lit(width) / 2).cast("int") + 1
    return F.when(n <= budget, text).otherwise(
        F.concat_ws("\n…\n", F.substring(text, F.lit(1), F.lit(width)), F.substring(text, middle, F.lit(width)), F.substring(text, n - width + 1, F.lit(width)))
    )


_NUMBERS = re.compile(r"[A-Za-z]{5,}|(?P<short>[A-Za-z]{1,4})(?P<serial>[0-9]*)|(?P<run>[0-9]+(?:,[0-9]{3}(?![0-9]))*)(?P<fraction>\.[0-9]+)?")


def number_digits(query: str, most: int = 8) -> list[str]:
    """Digits of the long numbers in a query: five or more, with groups joined or behind one to four letters.

    Neither amounts with a fraction count, nor eight digits that read as a date, nor what runs on in letters.
    """
    found: list[str] = []
    for m in _NUMBERS.finditer(query):
        if m["run"]:
            after_letter = m.start() > 0 and query[m.start() - 1].isascii() and query[m.start() - 1].isalpha()
            digits = m["run"].replace(",", "") if not m["fraction"] and not after_letter else ""
        else:
            goes_on = query[m.end() : m.end() + 1]
            digits = m["serial"] if m["serial"] and not (goes_on.isascii() and goes_on.isalnum()) else ""
        if len(digits) >= 5 and not (len(digits) == 8 and digits[:2] in ("19", "20")) and digits not in found:
            found.append(digits)
    return found[:most]


def query_fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(fold(text), 256), 1, 16)


def text_id(prefix: str, c: Column) -> Column:
    """Prefix and the first 16 hexadecimal digits of a SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 16))
