"""Calendar rules over dated facts. Only what is certain is reported.

A value is an interval of days with a precision; uncertain ones never violate a rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import claim_key, glob
from corvane.operators.gates import told

# Keys that hold dates unless told otherwise, and what the rules are called.
TEMPORAL_KEYS = ("*_date", "*_on", "date_*", "*_deadline", "*_due", "*_when")
RULE_ORDER = "gate.chronology-order"
RULE_DEADLINE = "gate.chronology-deadline"
RULE_DURATION = "gate.chronology-duration"

# The grammar's words.
MONTHS = "january february march april may june july august september october november december".split()
SEASONS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11), "winter": (12, 2)}
HEDGES = r"circa|ca\.?|c\.|~|approx(?:\.|imately)?|around|about"

_MONTH_NUMBER = {name[:n]: i for i, name in enumerate(MONTHS, 1) for n in (3, len(name))} | {"sept": 9}
_MONTH = "|".join(sorted(_MONTH_NUMBER, key=len, reverse=True))
_S = r"\p{IsWhite_Space}"
_TO = rf"{_S}*(?:-|–|—|to){_S}*"
_ORDINAL = "(?:st|nd|rd|th)?"


def _month_number(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in _MONTH_NUMBER.items() for x in pair])[F.lower(name)]


def _date(year: Column, month: Column | str, day: Column | str) -> Column:
    """Null where there is no such day; ``year`` and texts have their leading zeros."""
    two = lambda x: F.lit(x) if isinstance(x, str) else F.lpad(x.cast("string"), 2, "0")
    return F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day)).try_cast("date")


#: Forms: pattern, precision, first day and last day (of a day none) from the text and the pattern's groups.
_FORMS: tuple[tuple[str, str, Callable[[Column, Callable[[int], Column]], tuple[Column, Column | None]]], ...] = (
    (r"^\d{4}-\d{2}-\d{2}$", "day", lambda t, g: (t.try_cast("date"), None)),
    (r"^\d{4}-\d{2}$", "month", lambda t, g: (F.concat(t, F.lit("-01")).try_cast("date"), F.last_day(F.concat(t, F.lit("-01")).try_cast("date")))),
    (rf"^(\d{{4}}){_TO}(\d{{4}})$", "year", lambda t, g: (F.when(g(1) <= g(2), _date(g(1), "01", "01")), _date(g(2), "12", "31"))),
    (r"^\d{4}$", "year", lambda t, g: (_date(t, "01", "01"), _date(t, "12", "31"))),
    (
        rf"(?i)^({_MONTH})\.?{_TO}({_MONTH})\.?{_S}+(\d{{4}})$",
        "month",
        lambda t, g: (
            F.when(_month_number(g(1)) <= _month_number(g(2)), _date(g(3), _month_number(g(1)), "01")),
            F.last_day(_date(g(3), _month_number(g(2)), "01")),
        ),
    ),
    (rf"(?i)^({_MONTH})\.?{_S}+(\d{{1,2}}){_ORDINAL}(?:,{_S}*|{_S}+)(\d{{4}})$", "day", lambda t, g: (_date(g(3), _month_number(g(1)), g(2)), None)),
    (rf"(?i)^(\d{{1,2}}){_ORDINAL}{_S}+({_MONTH})\.?,?{_S}+(\d{{4}})$", "day", lambda t, g: (_date(g(3), _month_number(g(2)), g(1)), None)),
    (rf"(?i)^({_MONTH})\.?{_S}+(\d{{4}})$", "month", lambda t, g: (_date(g(2), _month_number(g(1)), "01"), F.last_day(_date(g(2), _month_number(g(1)), "01")))),
)
_SEASON = rf"(?i)^({'|'.join(SEASONS)}){_S}+(\d{{4}})$"


def parse_when(value: Column) -> Column:
    """``start, end, precision, uncertain`` of a date in words or digits; null for anything else.

    Days, months and years, ranges of years and of months, seasons (a winter runs into the next year), with or without a
    hedge. Precision is day, month or year. Seasons and hedged dates are uncertain.
    """
    strip = lambda c: F.regexp_replace(c, rf"^{_S}+|{_S}+$", "")
    whole = strip(value)
    bare = strip(F.regexp_replace(whole, rf"(?i)^(?:{HEDGES}){_S}*", ""))

    def found(start: Column, end: Column | None, precision: str, uncertain: Column) -> Column:
        last = F.lit(None).cast("date") if end is None else end
        return F.struct(start.alias("start"), last.alias("end"), F.lit(precision).alias("precision"), uncertain.alias("uncertain"))

    def read(x: Column) -> Column:
        t, hedged = x["bare"], x["bare"] != x["whole"]
        first, year = F.lower(F.regexp_extract(t, _SEASON, 1)), F.regexp_extract(t, _SEASON, 2)
        out = F.lit(None)
        for name, (begins, ends) in SEASONS.items():
            ends_in = year if ends > begins else F.lpad((year.cast("int") + 1).cast("string"), 4, "0")
            season = found(_date(year, f"{begins:02d}", "01"), F.last_day(_date(ends_in, f"{ends:02d}", "01")), "month", F.lit(True))
            out = F.when(first == name, season).otherwise(out)
        for pattern, precision, build in reversed(_FORMS):
            start, end = build(t, lambda i, p=pattern: F.regexp_extract(t, p, i))
            out = F.when(F.regexp_like(t, F.lit(pattern)), found(start, end, precision, hedged)).otherwise(out)
        return out

    def close(w: Column) -> Column:
        end = F.when(w["precision"] == "day", w["start"]).otherwise(w["end"])
        return F.struct(w["start"].alias("start"), end.alias("end"), w["precision"].alias("precision"), w["uncertain"].alias("uncertain"))

    # arrays of one element bind what each step finds once
    steps = F.transform(F.transform(F.array(F.struct(whole.alias("whole"), bare.alias("bare"))), read), close)
    return F.get(F.filter(steps, lambda w: w["start"].isNotNull() & w["end"].isNotNull()), F.lit(0))


def definitely_before(a: Column, b: Column) -> Column:
    return a["end"] < b["start"]


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def absolute(target: str) -> bool:
    """Whether a target names one fact, ``subject.key``, and not a pattern of keys."""
    return "." in target and "*" not in target


@dataclass(frozen=True)
class Rule:
    """``kind`` order, contains, overlap, deadline or duration over two targets; ``severity`` warn or block.

    Order: ``left`` before ``right``. Contains: ``left`` the outer. Deadline: ``right`` within ``days`` of ``left``. Duration
    from ``left`` to ``right``, at least and at most so many days.
    """

    kind: str
    left: str
    right: str
    severity: str = "warn"
    days: int = 0
    least: int | None = None
    most: int | None = None

    def document(self) -> Column:
        """The rule as its author wrote it."""
        names = {
            "order": ("before", "after"), "contains": ("outer", "inner"), "overlap": ("a", "b"), "deadline": ("due_from", "key"), "duration": ("from", "to"),
        }[self.kind]
        values = dict(zip(names, (F.lit(self.left), F.lit(self.right)), strict=True))
        if self.kind == "deadline":
            values["within_days"] = F.lit(self.days)
        elif self.kind == "duration":
            values |= {"min_days": F.lit(self.least).cast("int"), "max_days": F.lit(self.most).cast("int")}
        name = "forbid_overlap" if self.kind == "overlap" else self.kind
        return F.struct(F.struct(*(values[k].alias(k) for k in sorted(values))).alias(name))


def temporal(key: Column, patterns: Sequence[str] = TEMPORAL_KEYS, named: Sequence[str] = (), name: Column | None = None) -> Column:
    """Whether a key matches one of the patterns, or its whole name is one of ``named``."""
    hit = F.lit(False)
    for p in patterns or TEMPORAL_KEYS:
        hit = hit | F.regexp_like(key, F.lit(glob(p)))
    return hit | F.lower(name).isin([n.lower() for n in named]) if named else hit


def timeline(facts: DataFrame, rules: Sequence[Rule] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """``subject, key, claim_key, value, when, claim_id, candidate``: the latest value of each key, if it is a date.

    With ``rules`` only keys like one of the ``patterns`` (by default the usual ones) take part, and those that a rule
    names. Candidates come after all facts. A latest value that isn't a date removes its key. A candidate has
    no claim id yet.
    """
    named = [t for r in rules for t in (r.left, r.right) if absolute(t)]
    name = claim_key(F.col("subject"), F.col("key"))
    some = facts.where(temporal(F.col("key"), patterns, named, name)) if rules else facts
    latest = some.groupBy("subject", "key").agg(
        F.max_by(F.struct("value", "claim_id", "candidate"), F.struct("candidate", "seq")).alias("x")
    )
    return latest.select(
        "subject", "key", name.alias("claim_key"), "x.value", parse_when(F.col("x.value")).alias("when"),
        F.when(~F.col("x.candidate"), F.col("x.claim_id")).alias("claim_id"), "x.candidate",
    ).where("when IS NOT NULL")


def _like(events: DataFrame, target: str) -> DataFrame:
    if absolute(target):
        return events.where(F.lower("claim_key") == target.lower())
    return events.where(F.regexp_like("key", F.lit(glob(target))))


def pairs(events: DataFrame, left: str, right: str) -> DataFrame:
    """``a, b``: dated facts like ``left`` and like ``right``, not the same one.

    Both are of one subject, unless a target names one fact: then that one meets those of all subjects, and for it
    is one row, or as many as differ in case only, it is sent to the others.
    """
    names = ("subject", "key", "claim_key", "value", "when", "claim_id", "candidate")
    a = _like(events, left).select(F.struct(*names).alias("a"))
    b = _like(events, right).select(F.struct(*names).alias("b"))
    if absolute(left):
        both = b.crossJoin(F.broadcast(a))
    elif absolute(right):
        both = a.crossJoin(F.broadcast(b))
    else:
        both = a.join(b, F.col("a.subject") == F.col("b.subject"))
    return both.where(F.col("a.claim_key") != F.col("b.claim_key")).select("a", "b")


def _certain() -> Column:
    return ~F.col("a.when.uncertain") & ~F.col("b.when.uncertain")


def _new() -> Column:
    return F.col("a.candidate") | F.col("b.candidate")


def _said(side: str) -> Column:
    return told(F.col(f"{side}.claim_key"), "=", F.col(f"{side}.value"))


def _event(side: str, role: str) -> Column:
    """A fact in a finding's chain."""
    when = F.col(f"{side}.when")
    return F.struct(
        F.col(f"{side}.claim_key").alias("claim"),
        F.col(f"{side}.claim_id").alias("claim_id"),
        F.when(F.col(f"{side}.candidate"), "candidate").otherwise("ledger").alias("origin"),
        F.lit(role).alias("role"),
        F.col(f"{side}.value").alias("value"),
        F.struct(
            when["end"].cast("string").alias("end"), when["precision"].alias("precision"), when["start"].cast("string").alias("start"), when["uncertain"].alias("uncertain")
        ).alias("when"),
    )


def _told(hits: DataFrame, rule: Rule, rule_id: str, message: Column, roles: Sequence[tuple[str, str]], **extras: Column) -> DataFrame:
    """``rule_id, severity, message, claim_key, detail`` for each hit; the claim is the last candidate of the chain."""
    claim = F.lit(None).cast("string")
    for side, _ in roles:
        claim = F.when(F.col(f"{side}.candidate"), F.col(f"{side}.claim_key")).otherwise(claim)
    values = {"chain": F.array(*(_event(*r) for r in roles)), "kind": F.lit(rule.kind), "rule": rule.document()} | extras

    def about(more: dict[str, Column]) -> Column:
        every = values | more
        return F.to_json(F.struct(*(every[k].alias(k) for k in sorted(every))), {"ignoreNullFields": "false"})

    detail = F.when(claim.isNull(), about({})).otherwise(about({"claim_key": claim}))
    return hits.select(
        F.lit(rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), message.alias("message"), claim.alias("claim_key"), detail.alias("detail")
    )


def order_rule(events: DataFrame, rule: Rule) -> DataFrame:
    """The right one lies definitely before the left one."""
    hits = pairs(events, rule.left, rule.right).where(_new() & _certain() & definitely_before(F.col("b.when"), F.col("a.when")))
    message = told("chronology: '", _said("b"), "' must come after '", _said("a"), "' but is definitely before it")
    return _told(hits, rule, RULE_ORDER, message, (("a", "before"), ("b", "after")))


def contains_rule(events: DataFrame, rule: Rule) -> DataFrame:
    """Inner and outer have no day in common."""
    hits = pairs(events, rule.left, rule.right).where(_new() & _certain() & ~overlaps(F.col("a.when"), F.col("b.when")))
    message = told("chronology: '", _said("b"), "' must fall within '", _said("a"), "' but is definitely outside it")
    return _told(hits, rule, RULE_ORDER, message, (("a", "outer"), ("b", "inner")))


def forbid_overlap(events: DataFrame, rule: Rule) -> DataFrame:
    """Certain days that coincide; each pair is told once, as it comes first by subject and key."""
    is_day = (F.col("a.when.precision") == "day") & (F.col("b.when.precision") == "day")
    hits = pairs(events, rule.left, rule.right).where(_new() & _certain() & is_day & overlaps(F.col("a.when"), F.col("b.when")))
    lo, hi = F.least("a.claim_key", "b.claim_key"), F.greatest("a.claim_key", "b.claim_key")
    once = (
        hits.groupBy(lo.alias("lo"), hi.alias("hi"))
        .agg(F.min_by(F.struct("a", "b"), F.struct("a.subject", "a.key", "b.subject", "b.key")).alias("x"))
        .select("x.a", "x.b")
    )
    message = told("chronology: '", _said("a"), "' and '", _said("b"), "' must not overlap but definitely do")
    return _told(once, rule, RULE_ORDER, message, (("a", "a"), ("b", "b")))


def deadline_rule(events: DataFrame, rule: Rule, now: str | None = None) -> DataFrame:
    """The right one begins more than ``days`` after the left one ends; with ``now`` also if there is none by then,
    whether candidates are involved or not."""
    limit = F.date_add(F.col("a.when.end"), rule.days)
    both = pairs(events, rule.left, rule.right).where(~F.col("a.when.uncertain"))
    late = both.where(_new() & ~F.col("b.when.uncertain") & (F.col("b.when.start") > limit))
    message = told("chronology: '", _said("b"), "' is definitely later than the deadline ", limit, f" ({rule.days} days after '", _said("a"), "')")
    found = _told(late, rule, RULE_DEADLINE, message, (("a", "due_from"), ("b", "event")), deadline=limit.cast("string"))
    if now is None:
        return found
    names = ("subject", "key", "claim_key", "value", "when", "claim_id", "candidate")
    begun = _like(events, rule.left).where("NOT when.uncertain").select(F.struct(*names).alias("a"))
    met = both.select(F.col("a.claim_key").alias("met")).distinct()
    missing = begun.where(limit < F.lit(now).cast("date")).join(met, F.col("a.claim_key") == F.col("met"), "left_anti")
    absent = told(
        f"chronology: no '{rule.right}' event within {rule.days} days of '", _said("a"), "' — deadline ", limit, f" passed as of {now}"
    )
    return found.unionByName(
        _told(missing, rule, RULE_DEADLINE, absent, (("a", "due_from"),), deadline=limit.cast("string"), now=F.lit(now))
    )


def duration_rule(events: DataFrame, rule: Rule) -> DataFrame:
    """The gap is surely longer than ``most`` or shorter than ``least`` days."""
    gap_min = F.datediff(F.col("b.when.start"), F.col("a.when.end"))
    gap_max = F.datediff(F.col("b.when.end"), F.col("a.when.start"))
    problem = F.lit(None).cast("string")
    if rule.least is not None:
        problem = F.when(gap_max < rule.least, f"definitely under min_days={rule.least}")
    if rule.most is not None:
        problem = F.when(gap_min > rule.most, f"definitely exceeds max_days={rule.most}").otherwise(problem)
    hits = pairs(events, rule.left, rule.right).where(_new() & _certain() & problem.isNotNull())
    message = told("chronology: elapsed days from '", _said("a"), "' to '", _said("b"), "' (between ", gap_min, " and ", gap_max, ") ", problem)
    return _told(hits, rule, RULE_DURATION, message, (("a", "from"), ("b", "to")), gap_days_min=gap_min, gap_days_max=gap_max)


def check_chronology(facts: DataFrame, rules: Sequence[Rule], now: str | None = None, patterns: Sequence[str] = ()) -> DataFrame:
    """What the rules find against facts and candidates (``subject, key, seq, claim_id, candidate, value``) together."""
    if not rules:
        raise ValueError("no rules to check")
    events = timeline(facts, rules, patterns)
    run = {"order": order_rule, "contains": contains_rule, "overlap": forbid_overlap, "duration": duration_rule}
    found = [deadline_rule(events, r, now) if r.kind == "deadline" else run[r.kind](events, r) for r in rules]
    return reduce(DataFrame.unionByName, found)
