"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans. Four kinds have exact rules of their own; what those accept is always
kept. Wider patterns propose more (masked e-mail addresses, national phone numbers, IPv6,
secrets, account numbers). Labelers then vote on every proposed span: its pattern's own check,
gazetteers (domain endings, calling codes, card issuers, key prefixes), words around it,
its shape, and its surroundings' digits. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is; the labels that follow train a logistic
classifier of spans, and what it accepts is added.

The proposed spans of a document stay in an array in its row, so nothing is shuffled but the
counts. The vote patterns are bounded by construction (``MAX_PATTERNS``), so the driver may
hold their counts whatever the size of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialise

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "email", "ip", "phone", "secret")
KINDS = ("email", "ip", "card", "phone", "account", "secret")

# What the base rules match. Possessive where nothing may be given back, so that
# Java matches long runs without recursion; \G lets a match start where the last one ended.
BASE_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that no text with a match fails.
BASE_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
WIDE_PATTERN = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])",
    "secret": r"(?<![0-9A-Za-z_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}+|(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey) ?[=:] ?[\"']?[^\s\"',;]{8,}+)",
}
WIDE_HINT = {"email": "at", "ip": ":", "phone": "", "account": "", "secret": ""}

# Gazetteers.
DOMAIN_ENDINGS = "com org net edu gov mil int info biz io co dev app ai me tv us uk de fr es it nl be ch at pl ru cn jp br in ca au".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split()
CONTEXT = {
    "email": "mail e-mail email contact write kontakt correo courriel",
    "ip": "ip host server address adresse addr client login from",
    "card": "card visa mastercard amex credit debit karte tarjeta carte payment",
    "phone": "phone call tel telephone mobile fax cell telefon teléfono téléphone",
    "account": "ssn social security iban account konto cuenta compte bank",
    "secret": "key secret password token credential aws api login",
}

#: Words before what only looks like personal data.
CONTEXT_AGAINST = {
    "email": "example regex pattern template",
    "ip": "version release section chapter figure table build firmware",
    "card": "isbn issn order invoice tracking serial article doi hash checksum",
    "phone": "isbn issn order invoice tracking serial version id",
    "account": "isbn issn order invoice tracking serial part model",
    "secret": "example placeholder template sample dummy",
}

VOTERS = ("check", "gazetteer", "context", "shape", "neighbours")
#: Each voter says yes (2), no (0) or nothing (1); kinds and base or not tell patterns apart too.
MAX_PATTERNS = len(KINDS) * 2 * 3 ** len(VOTERS)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, block: int = 128) -> Column:
    """What ``step(state, item)`` puts out for each item, as an array of ``kind``; it gives the next state and the output.

    A fold that appends to one array copies it each time, which is quadratic; here arrays of a block are
    appended to, and then the blocks.
    """
    n = F.size(items)
    none, blocks = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def whole(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(items, b * block + 1, F.lit(block)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(numbers, F.struct(start.alias("state"), blocks.alias("out")), whole, lambda acc: F.flatten(acc["out"]))


_SPAN = "struct<s:int,e:int,m:string,before:string,after:string>"


def _spans(text: Column, pattern: str, where: Column) -> Column:
    """``array<_SPAN>``: start, end and text of all matches, leftmost first, in code points, with at most 40
    characters before each and the one after.

    What lies between matches comes from ``split`` with the same pattern, so places and surroundings follow
    from the pieces alone, and the text isn't walked through for each match.
    """

    def pieces(found: Column, gaps: Column) -> Column:
        return F.transform(
            found,
            lambda m, i: F.struct(
                m.alias("m"),
                F.get(gaps, i).alias("gap"),
                F.substring(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), 1, 1).alias("after"),
            ),
        )

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        before = F.right(F.concat(state["tail"], x["gap"]), F.lit(40))
        span = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), before.alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.right(F.concat(before, x["m"]), F.lit(40)).alias("tail")), span

    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    folded = _let(F.struct(found.alias("f"), gaps.alias("g")), lambda r: _let(pieces(r["f"], r["g"]), lambda p: _scan(p, start, step, _SPAN)))
    return F.when(where & F.regexp_like(text, F.lit(pattern)), folded).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(F.reverse(digits), i, F.lit(1)).cast("int")).otherwise(
            F.element_at(
                F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                F.substring(F.reverse(digits), i, F.lit(1)).cast("int") + 1,
            )
        ),
    )
    return total % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    """The base rule of a kind for a match of its pattern."""
    if kind == "ip":
        return F.forall(
            F.split(m, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
        )
    if kind == "card":
        d = _digits(m)
        return F.char_length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _gazetteer(kind: str, m: Column) -> Column:
    never = F.lit(False)
    if kind == "email":
        ending = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        return _vote(ending.isin(DOMAIN_ENDINGS), F.regexp_like(ending, F.lit("^[0-9-]+$")))
    if kind == "phone":
        codes = "|".join(CALLING_CODES)
        return _vote(F.regexp_like(m, F.lit(rf"^(?:\+(?:{codes})|\(?[2-9])")), F.regexp_like(m, F.lit(r"^\+0|^\(?[01]")))
    if kind == "card":
        return _vote(F.regexp_like(_digits(m), F.lit("^(?:4|5[1-5]|2[2-7]|3[47]|6)")), F.regexp_like(m, F.lit("^[0179]")))
    if kind == "ip":
        return _vote(never, F.regexp_like(m, F.lit(r"^(?:0|127|255)\.")))
    if kind == "secret":
        return _vote(F.regexp_like(m, F.lit(r"^(?:AKIA|gh[pousr]_|sk-)")), never)
    return _vote(F.regexp_like(m, F.lit("^[A-Z]{2}")), F.regexp_like(m, F.lit("^(?:000|666|9)")))


def _shape(kind: str, m: Column) -> Column:
    """Whether the span looks like others of its kind: lengths, grouping, variety."""
    n = F.char_length(m)
    if kind == "card":
        d = F.char_length(_digits(m))
        return _vote((d.between(15, 16)) & (F.regexp_like(m, F.lit("^(?:[0-9]+|(?:[0-9]{4}[ -]){3}[0-9]{4})$"))), (d < 13) | (d > 19))
    if kind == "phone":
        d = F.char_length(_digits(m))
        return _vote(d.between(10, 13), (d < 9) | (d > 15))
    if kind == "ip":
        return _vote(n.between(7, 39), n > 39)
    if kind == "email":
        return _vote(n.between(6, 64), n > 254)
    if kind == "secret":
        return _vote(F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]")), ~F.regexp_like(m, F.lit("[0-9]")))
    return _vote(n.between(11, 34), n > 34)


def _candidate(kind: str, x: Column, base: bool) -> Column:
    """The span with its vote pattern as one number below ``MAX_PATTERNS``."""
    m = x["m"]
    before = F.lower(x["before"])
    said = lambda words: F.regexp_like(before, F.lit(rf"(?<![\p{{L}}])(?:{'|'.join(words.split())})(?![\p{{L}}])"))
    if base:
        check = _vote(_passes(kind, m), ~_passes(kind, m))
    else:
        check = _vote(F.lit(kind in ("secret", "ip")), F.lit(False))
    context = _vote(said(CONTEXT[kind]), said(CONTEXT_AGAINST[kind]))
    glued = F.regexp_like(F.concat(F.right(before, F.lit(1)), x["after"]), F.lit("[0-9A-Za-z_/=]"))
    votes = (check, _gazetteer(kind, m), context, _shape(kind, m), _vote(~glued, glued))
    code = F.lit(KINDS.index(kind) * 2 + (0 if base else 1))
    for v in votes:
        code = code * 3 + v
    kept = _passes(kind, m) if base else F.lit(False)
    return F.struct(
        F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), kept.alias("base"), code.cast("int").alias("code")
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: all proposed spans of each row. Null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    t = F.col("t")
    raw = {}
    for kind in BASE:
        hint = t.contains(BASE_HINT[kind]) if BASE_HINT[kind] else F.regexp_like(t, F.lit("[0-9]"))
        raw[f"b_{kind}"] = _spans(t, BASE_PATTERN[kind], hint)
    for kind in ADDED:
        hint = t.contains(WIDE_HINT[kind]) if WIDE_HINT[kind] else F.lit(True)
        raw[f"w_{kind}"] = _spans(t, WIDE_PATTERN[kind], hint)
    rows = rows.select("doc_id", "t", *(c.alias(k) for k, c in raw.items()))

    def judged(kind: str, base: bool) -> Column:
        return F.transform(f"{'b' if base else 'w'}_{kind}", lambda x: _candidate(kind, x, base))

    base = F.concat(*(judged(k, True) for k in BASE))
    wide = F.concat(*(judged(k, False) for k in ADDED))
    return rows.select("doc_id", F.concat(base, wide).alias("spans"))


@dataclass
class Model:
    """What was learned: how often each voter is right, and the vote patterns accepted."""

    reliability: dict[str, float]
    probability: dict[int, float]

    def accepted(self, least: float = 0.9) -> list[int]:
        """Patterns of at least that probability; what fails a base rule is dropped for good."""
        return sorted(c for c, p in self.probability.items() if p >= least and _decode(c)[2][0] != 0)


def _decode(code: int) -> tuple[str, bool, list[int]]:
    votes = []
    for _ in VOTERS:
        votes.append(code % 3)
        code //= 3
    return KINDS[code // 2], code % 2 == 0, votes[::-1]


def learn(counts: dict[int, int], rounds: int = 50, steps: int = 300, rate: float = 0.5) -> Model:
    """EM over the counts of vote patterns, then a logistic classifier on the soft labels.

    A voter that speaks is right with its own probability, kept between 0.55 and 0.99 so that
    labels can't swap. Features of the classifier: kind, and each vote for or against.
    """
    rows = [(c, n, *_decode(c)) for c, n in sorted(counts.items())]
    total = sum(n for _, n, *_ in rows)
    if not total:
        return Model({v: 0.5 for v in VOTERS}, {})
    right, prior = [0.8] * len(VOTERS), {k: 0.5 for k in KINDS}
    belief: list[float] = []
    for _ in range(rounds):
        belief = []
        for _, _, kind, _, votes in rows:
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for p, v in zip(right, votes, strict=True):
                if v != 1:
                    yes += math.log(p if v == 2 else 1 - p)
                    no += math.log(1 - p if v == 2 else p)
            belief.append(1 / (1 + math.exp(max(-50.0, min(50.0, no - yes)))))
        for k in range(len(VOTERS)):
            good = sum(n * (b if votes[k] == 2 else 1 - b) for (_, n, _, _, votes), b in zip(rows, belief, strict=True) if votes[k] != 1)
            said = sum(n for _, n, _, _, votes in rows if votes[k] != 1)
            right[k] = min(0.99, max(0.55, (good + 4) / (said + 5)))
        for kind in KINDS:
            n = sum(r[1] for r in rows if r[2] == kind)
            prior[kind] = min(0.98, max(0.02, (sum(r[1] * b for r, b in zip(rows, belief, strict=True) if r[2] == kind) + 1) / (n + 2)))

    def features(kind: str, votes: list[int]) -> list[float]:
        return [float(kind == k) for k in KINDS] + [float(v == 2) for v in votes] + [float(v == 0) for v in votes]

    xs = [features(kind, votes) for _, _, kind, _, votes in rows]
    w = [0.0] * len(xs[0])
    g2 = [1e-8] * len(w)
    for _ in range(steps):
        g = [1e-4 * x for x in w]
        for (_, n, *_), x, b in zip(rows, xs, belief, strict=True):
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * c for a, c in zip(w, x, strict=True))))))
            for i, v in enumerate(x):
                if v:
                    g[i] += n / total * (p - b)
        for i, v in enumerate(g):
            g2[i] += v * v
            w[i] -= rate * v / math.sqrt(g2[i])
    probability = {
        r[0]: 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * c for a, c in zip(w, x, strict=True)))))) for r, x in zip(rows, xs, strict=True)
    }
    return Model(dict(zip(VOTERS, right, strict=True)), probability)


def vote_counts(proposed: DataFrame) -> dict[int, int]:
    """How often each vote pattern occurs; at most ``MAX_PATTERNS`` entries."""
    rows = proposed.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return {r.code: r.n for r in rows.collect()}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """``doc_id, base, added``: spans (``kind, s, e``) per row of ``docs``.

    ``base`` are the spans of the four exact rules, in the order of ``BASE`` and then by start.
    ``added`` are those the classifier accepts which overlap no base span, by start; of some that overlap one another
    the first stays, by start and then by kind. Null and empty texts have none; rows that repeat are searched one by one;
    an empty table gives no rows. Other columns are ignored.
    """
    proposed = materialise(candidates(docs, id_col, text_col), "pii")
    model = learn(vote_counts(proposed))
    codes = model.accepted(least)
    ok = F.array(*[F.lit(c) for c in codes]) if codes else F.expr("cast(array() as array<int>)")
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    base = F.transform(F.filter("spans", lambda x: x["base"]), plain)
    more = F.transform(F.filter("spans", lambda x: ~x["base"] & F.array_contains(ok, x["code"])), plain)
    clear = _clear(F.col("base"), F.col("more"))
    return proposed.select("doc_id", base.alias("base"), more.alias("more")).withColumn(
        "added", F.when(F.size("more") > 0, clear).otherwise(F.col("more"))
    ).drop("more")


def _clear(base: Column, more: Column) -> Column:
    """Those of ``more`` that overlap no span of ``base`` and none before them that is kept, in linear time once sorted."""
    kind = "struct<s:int,add:int,kind:string,e:int>"
    placed = lambda add: lambda x: F.struct(x["s"].alias("s"), F.lit(add).alias("add"), x["kind"].alias("kind"), x["e"].alias("e"))
    none = F.lit(None).cast(kind)

    def from_end(follows: Column, x: Column) -> tuple[Column, Column]:
        """State: where the next base span starts."""
        return F.when(x["add"] == 0, x["s"]).otherwise(follows), F.when((x["add"] == 0) | (follows >= x["e"]), x).otherwise(none)

    def from_start(taken: Column, x: Column) -> tuple[Column, Column]:
        """State: up to where text is taken. A base span always stays, an empty one takes nothing."""
        free = (x["add"] == 0) | (taken <= x["s"])
        return F.when(free, F.greatest(taken, x["e"])).otherwise(taken), F.when(free, x).otherwise(none)

    every = F.array_sort(F.concat(F.transform(base, placed(0)), F.transform(more, placed(1))))
    first = _let(F.reverse(every), lambda a: _scan(a, F.lit(2**31 - 1), from_end, kind))
    second = _let(F.reverse(F.array_compact(first)), lambda a: _scan(a, F.lit(0), from_start, kind))
    kept = F.filter(F.array_compact(second), lambda x: x["add"] == 1)
    return F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` and the text with every span replaced by its kind in brackets.

    Spans that overlap one before them are covered by that one's brackets as far as it goes. Null counts as empty. Rows
    are masked one by one, whether their ids are null or repeated. An empty table gives no rows. Other columns are
    left out.
    """
    rows = materialise(
        docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()), "numbered"
    )
    found = find(rows, id_col="row").select(F.col("doc_id").alias("at"), F.array_sort(F.concat(F.transform("base", _by_start), F.transform("added", _by_start))).alias("sp"))
    kind = "string"

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        """State: up to where the text is given out. The text between spans is cut from what is left of the start."""
        return F.greatest(end, x["e"]), F.when(
            x["s"] >= end, F.concat(F.substring(F.col("text"), end + 1, x["s"] - end), F.lit("["), x["kind"], F.lit("]"))
        ).otherwise(F.lit(""))

    last = F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform("sp", lambda x: x["e"])), F.lit(0)))
    out = F.concat(F.array_join(_scan(F.col("sp"), F.lit(0), step, kind), ""), F.substring(F.col("text"), last + 1, F.char_length("text")))
    return rows.join(found, F.col("row") == F.col("at")).select("doc_id", out.alias("text"))


def _by_start(x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))


def listing(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
