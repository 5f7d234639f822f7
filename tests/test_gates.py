import datetime as dt
import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.similarity import ratio_at_least
from corvane.functions.text import value_equality
from corvane.operators import chronology, gates, governance
from corvane.operators.ledger import HeadConflict

CAND = "cid string, claim_type string, subject string, key string, value string, supersedes_id string, text string"


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(
        [("f1", 1, "hero", "eyes", "Green"), ("f2", 2, "hero", "eyes", "green  ish"), ("f3", 3, "a.b", "c", "1")],
        "id string, seq long, subject string, key string, value string",
    )


def candidates(spark, *rows):
    return spark.createDataFrame(list(rows), CAND)


def test_ledger_gate_looks_at_the_latest_fact(spark, facts):
    c = candidates(
        spark,
        ("1", "fact", "hero", "eyes", "GREEN\tish ", None, ""),
        ("2", "fact", "hero", "eyes", "green", None, ""),
        ("3", "correction", "hero", "eyes", "green", None, ""),
        ("4", "fact", "hero", "eyes", "green", "f2", ""),
    )
    assert [(r.cid, r.message, r.detail) for r in gates.ledger_gate(c, facts).collect()] == [
        ("2", "claim 'hero.eyes=green' conflicts with accepted canon 'hero.eyes=green  ish' (use a correction to supersede)",
         '{"canon_claim_id":"f2","canon_seq":2,"canon_value":"green  ish","claim_key":"hero.eyes","proposed_value":"green"}')
    ]


def test_orphans_need_subject_and_key(spark, facts):
    c = candidates(spark, ("1", "correction", "a", "b.c", "x", None, ""), ("2", "correction", "a.b", "c", "x", None, ""))
    assert [r.cid for r in gates.orphan_gate(c, facts).collect()] == ["1"]


def test_anchor_findings_replace_ledger_findings_and_dispute(spark, facts):
    anchors = spark.createDataFrame([("hero.eyes", "green ish")], "detail_key string, locked_value string")
    c = candidates(spark, ("1", "fact", "hero", "eyes", "blue", None, "As an AI, I"), ("2", "fact", "hero", "age", "3", None, ""))
    found = gates.run_gates(c, facts, anchors)
    assert sorted((r.rule_id, r.message, r.claim_key, r.detail) for r in found.collect()) == [
        ("gate.anchor-consistency", "claim 'hero.eyes=blue' contradicts locked anchor value 'green ish'", "hero.eyes",
         '{"anchor_id":null,"claim_key":"hero.eyes","locked_value":"green ish","proposed_value":"blue"}'),
        ("gate.meta-leakage", "output contains meta-leakage marker 'as an ai'", None, '{"marker":"as an ai"}'),
    ]
    assert {r.cid: r.status for r in gates.disputed(c, found).collect()} == {"1": "disputed", "2": "accepted"}
    assert {r.severity for r in gates.run_gates(c, facts, anchors, extended=False).collect()} == {"warn"}


def test_similarity_is_that_of_difflib():
    """By parts, in a tenth of its time; a ratio below the least one isn't told."""
    dice = random.Random(5)
    text = lambda letters, n: "".join(dice.choice(letters) for _ in range(n))
    pairs = [(text(x, dice.randrange(60)), text(x, dice.randrange(60))) for x in ("ab", "abcde ", "aé\U0001f600 ßx", "the and or ") for _ in range(150)]
    pairs += [("a" * 1900, "a" * 1700 + "b"), ("ab" * 900, "ba" * 800), ("", "x"), ("", ""), ("abc", "abc"), ("abcd" * 9, "xabcdx" * 7)]
    for a, b in pairs:
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert ratio_at_least(a, b) == want
        assert ratio_at_least(a, b, 0.5) == (want if want >= 0.5 else None)


def test_pairs_are_dealt_to_many_tasks(spark):
    """Few rows of text were compared by one task, however long that took."""
    p = spark.createDataFrame([(str(i), f"some text {i}", f"some text {i + 1}") for i in range(200)], "cid string, text string, previous string")
    parts = gates.similarity_gate(p, 0.3).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > spark.sparkContext.defaultParallelism


def test_similarity(spark):
    assert gates.similarity_ratio("abcd", "BCDE") == 0.75
    assert gates.similarity_ratio("", "") == 1.0
    p = spark.createDataFrame([("1", "the same text", "The same text"), ("2", "", ""), ("3", "abc", "x" * 90)], "cid string, text string, previous string")
    assert [(r.cid, r.ratio) for r in gates.similarity_gate(p).collect()] == [("1", 1.0)]


def test_run_gates_warns_of_near_repetition(spark, facts):
    anchors = spark.createDataFrame([("hero.eyes", "green ish")], "detail_key string, locked_value string")
    c = candidates(spark, ("1", "fact", "hero", "age", "3", None, "Once upon a time."), ("2", "fact", "hero", "age", "3", None, "Else"), ("3", "fact", "x", "y", "z", None, None))
    own = spark.createDataFrame([("1", 0, "another beginning"), ("1", 1, "once upon a time"), ("2", 0, "once upon a time."), ("3", 0, "x"), ("2", 1, None)], "cid string, previous_index int, previous string")
    found = gates.run_gates(c, facts, anchors, previous=own).collect()
    assert [(r.cid, r.rule_id, r.severity, r.claim_key) for r in found] == [("1", "gate.lexical-similarity", "warn", None)]
    assert found[0].message == "output is 97% similar to previous unit 1 (threshold 90%)"
    assert found[0].detail.startswith('{"previous_index":1,"ratio":0.96')
    same = gates.run_gates(c, facts, anchors, previous=own.select("previous_index", "previous")).collect()
    assert sorted((r.cid, r.message[:17]) for r in same) == [("1", "output is 100% si"), ("1", "output is 97% sim")]
    assert {r.status for r in gates.disputed(c, gates.run_gates(c, facts, anchors, previous=own)).collect()} == {"accepted"}
    assert gates.run_gates(c, facts, anchors).count() == 0


def test_shape_and_dedup(spark):
    c = candidates(spark, ("1", "fact", "s", "k", "12", None, ""), ("2", "odd", "s", "k", "x", None, ""))
    shape = {"properties": {"value": {"type": "integer"}, "claim_type": {"enum": ["fact"]}}, "required": ["text"]}
    assert sorted((r.cid, r.field, r.rule) for r in gates.shape_validation(c, shape).collect()) == [("2", "claim_type", "enum"), ("2", "value", "type")]
    rows = [(1, "r", "warn", "m", 1, "s", None, None), (2, "r", "warn", "m", 2, "s", None, None), (3, "r", "warn", "x", 3, "s", "e", None), (4, "r", "warn", "y", 4, "t", "e", None), (5, "r", "warn", "m", 5, None, None, "c")]
    f = spark.createDataFrame(rows, "claim_no long, rule_id string, severity string, message string, seq long, scope_path string, evidence_ref string, claim_id string")
    assert sorted(r.claim_no for r in gates.dedup_findings(f, f.where("seq > 9"), "seq").collect()) == [1, 3, 5]
    assert sorted(r.claim_no for r in gates.dedup_findings(f, f.where("seq = 4"), "seq").collect()) == [1, 5]
    for bad in ({"severity": "block"}, {"rule_id": "governance.x"}, {"rule_id": " "}):
        with pytest.raises(ValueError):
            gates.dedup_findings(f.withColumns({k: F.lit(v) for k, v in bad.items()}), f, "seq")


WHEN = [
    ("2020-05-17", "2020-05-17", "2020-05-17", "day", False),
    ("2020-05", "2020-05-01", "2020-05-31", "month", False),
    ("1995", "1995-01-01", "1995-12-31", "year", False),
    ("1990-1995", "1990-01-01", "1995-12-31", "year", False),
    ("1901 to 1905", "1901-01-01", "1905-12-31", "year", False),
    ("1901 – 1905", "1901-01-01", "1905-12-31", "year", False),
    ("March-June 2020", "2020-03-01", "2020-06-30", "month", False),
    ("March-May 1990", "1990-03-01", "1990-05-31", "month", False),
    ("March to May 1990", "1990-03-01", "1990-05-31", "month", False),
    ("jan. — feb. 2024", "2024-01-01", "2024-02-29", "month", False),
    ("March 5, 2020", "2020-03-05", "2020-03-05", "day", False),
    ("MARCH 5th 2020", "2020-03-05", "2020-03-05", "day", False),
    ("5th March 2020", "2020-03-05", "2020-03-05", "day", False),
    ("5 Mar., 2020", "2020-03-05", "2020-03-05", "day", False),
    ("Sept 2020", "2020-09-01", "2020-09-30", "month", False),
    ("February 2024", "2024-02-01", "2024-02-29", "month", False),
    ("circa 1943", "1943-01-01", "1943-12-31", "year", True),
    ("~March 2020", "2020-03-01", "2020-03-31", "month", True),
    ("approx. 1950", "1950-01-01", "1950-12-31", "year", True),
    ("approx 1920", "1920-01-01", "1920-12-31", "year", True),
    ("approximately 1920", "1920-01-01", "1920-12-31", "year", True),
    ("~1920", "1920-01-01", "1920-12-31", "year", True),
    ("around 1920", "1920-01-01", "1920-12-31", "year", True),
    ("About 1920", "1920-01-01", "1920-12-31", "year", True),
    ("ca.1920", "1920-01-01", "1920-12-31", "year", True),
    ("c. 1920-05-01", "1920-05-01", "1920-05-01", "day", True),
    ("spring 2021", "2021-03-01", "2021-05-31", "month", True),
    ("Fall 2021", "2021-09-01", "2021-11-30", "month", True),
    ("winter 2020", "2020-12-01", "2021-02-28", "month", True),
    ("winter 2023", "2023-12-01", "2024-02-29", "month", True),
    ("\t 1995 \n", "1995-01-01", "1995-12-31", "year", False),
]
NO_DATE = [
    "1987-02-30", "1905-1901", "soon", "", None, "janx 1990", "1987-03-5", "2020-13", "2020-5", "circa", "~", "June-March 2020", "31 February 2020", "March 32, 2020",
    "spring of 2021", "Spring", "95", "2020/05/17", "2020-05-17T00:00", "May 2020 or so", "1990-1995-2000", "TO 1990", "1901 TO 1905", "March, 2020",
]


def test_parse_when(spark):
    rows = spark.createDataFrame([(v,) for v, *_ in WHEN], "v string").select("v", chronology.parse_when(F.col("v")).alias("w")).collect()
    day = dt.date.fromisoformat
    assert {r.v: tuple(r.w) for r in rows} == {v: (day(s), day(e), p, u) for v, s, e, p, u in WHEN}


def test_parse_when_gives_null_for_the_rest(spark):
    rows = spark.createDataFrame([(v,) for v in NO_DATE], "v string").select("v", chronology.parse_when(F.col("v")).alias("w")).collect()
    assert [r.v for r in rows if r.w is not None] == []


FACTS = "subject string, key string, seq long, claim_id string, candidate boolean, value string"


def test_chronology_reports_only_what_is_certain(spark):
    rows = [
        ("s", "start_date", 1, "a", True, "2000-05-01"),
        ("s", "end_date", 2, "b", False, "2000-04-01"),
        ("t", "start_date", 3, "c", True, "circa 2000"),
        ("t", "end_date", 4, "d", False, "1990"),
        ("u", "start_date", 5, "e", False, "2000-05-01"),
        ("u", "end_date", 6, "f", False, "2000-04-01"),
        ("w", "start_date", 7, "g", True, "2000-05-01"),
        ("w", "end_date", 8, "h", False, "2000-04-01"),
        ("w", "end_date", 9, "i", False, "unknown"),
    ]
    rule = chronology.Rule("order", "start_date", "end_date", "block")
    found = chronology.check_chronology(spark.createDataFrame(rows, FACTS), [rule]).collect()
    # t is uncertain, u has no candidate, w's end became unreadable
    assert [(r.rule_id, r.severity, r.message, r.claim_key) for r in found] == [
        ("gate.chronology-order", "block", "chronology: 's.end_date=2000-04-01' must come after 's.start_date=2000-05-01' but is definitely before it", "s.start_date")
    ]
    assert json.loads(found[0].detail) == {
        "kind": "order", "rule": {"order": {"before": "start_date", "after": "end_date"}}, "claim_key": "s.start_date",
        "chain": [
            {"role": "before", "claim_id": None, "claim": "s.start_date", "value": "2000-05-01", "origin": "candidate", "when": {"start": "2000-05-01", "end": "2000-05-01", "precision": "day", "uncertain": False}},
            {"role": "after", "claim_id": "b", "claim": "s.end_date", "value": "2000-04-01", "origin": "ledger", "when": {"start": "2000-04-01", "end": "2000-04-01", "precision": "day", "uncertain": False}},
        ],
    }


def test_deadlines_missed_are_told_of_every_start(spark):
    rows = [
        ("s", "start_date", 1, "a", False, "2000-05-01"),
        ("t", "start_date", 2, "b", True, "2000-05-01"),
        ("u", "start_date", 3, "c", False, "2000-05-01"),
        ("u", "review_due", 4, "d", False, "spring 2001"),
        ("v", "start_date", 5, "e", True, "2000-05-01"),
        ("v", "review_due", 6, "f", False, "2000-09-01"),
    ]
    facts = spark.createDataFrame(rows, FACTS)
    rule = chronology.Rule("deadline", "start_date", "review_due", days=30)
    got = {r.message: (r.claim_key, json.loads(r.detail).get("now")) for r in chronology.check_chronology(facts, [rule], "2000-06-01").collect()}
    missing = "chronology: no 'review_due' event within 30 days of '{}.start_date=2000-05-01' — deadline 2000-05-31 passed as of 2000-06-01"
    assert got == {
        missing.format("s"): (None, "2000-06-01"),
        missing.format("t"): ("t.start_date", "2000-06-01"),
        "chronology: 'v.review_due=2000-09-01' is definitely later than the deadline 2000-05-31 (30 days after 'v.start_date=2000-05-01')": ("v.start_date", None),
    }
    assert chronology.check_chronology(facts, [rule], "2000-05-31").count() == chronology.check_chronology(facts, [rule]).count() == 1


def test_a_target_that_names_a_fact_meets_all_subjects(spark):
    rows = [("War", "end", 1, "a", False, "1945-05-08"), ("s", "born_on", 2, "b", True, "1950"), ("t", "born_on", 3, "c", True, "1940"), ("t", "end", 4, "d", True, "1930")]
    facts = spark.createDataFrame(rows, FACTS)
    order = chronology.Rule("order", "war.end", "*_on")
    assert [r.claim_key for r in chronology.check_chronology(facts, [order]).collect()] == ["t.born_on"]
    late = chronology.Rule("deadline", "war.end", "*_on", days=10)
    assert [r.claim_key for r in chronology.check_chronology(facts, [late], "1990-01-01").collect()] == ["s.born_on"]
    gap = chronology.Rule("duration", "war.end", "*_on", most=1000)
    found = chronology.check_chronology(facts, [gap]).collect()
    assert [r.message for r in found] == ["chronology: elapsed days from 'War.end=1945-05-08' to 's.born_on=1950' (between 1699 and 2063) definitely exceeds max_days=1000"]


def test_a_pair_that_overlaps_is_told_once(spark):
    rows = [("s", "a_on", 1, "a", True, "2000-05-01"), ("s", "b_on", 2, "b", False, "2000-05-01"), ("s", "c_on", 3, "c", False, "2000-05")]
    found = chronology.check_chronology(spark.createDataFrame(rows, FACTS), [chronology.Rule("overlap", "*", "*_on")]).collect()
    assert [r.message for r in found] == ["chronology: 's.a_on=2000-05-01' and 's.b_on=2000-05-01' must not overlap but definitely do"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.fold(F.lit(" A  b\tC "))) == "a b c"
    assert one(tx.count_pattern(F.lit("aAaA"), F.lit("aa"))) == 2
    assert one(tx.count_pattern(F.lit("abc"), F.lit(""))) == 0
    assert one(tx.word_tokens(F.lit("Ünï-code, 42x!"))) == ["ünï", "code", "42x"]
    for given, parts in (("a.b.c=x=y", ("a.b", "c", "x=y")), (" a . b = c ", ("a", "b", "c")), (" nothing ", ("", "", "nothing")), ("key = v", ("", "key", "v")), ("=v", ("", "", "v")), (".k=", ("", "k", "")), ("", ("", "", ""))):
        assert tuple(one(tx.split_normalized(F.lit(given)))) == parts
    markers = "As an AI as a language model, I cannot assist; I'm sorry, but [insert name] Lorem Ipsum, the author in this chapter"
    assert one(tx.meta_markers(F.lit(markers))) == ["as an ai", "as a language model", "i cannot assist", "i'm sorry, but", "[insert", "lorem ipsum"]
    assert one(tx.sample_text(F.lit("abcdefghijklmnopqrstuvwxyz"), 12)).count("…") == 2
    with pytest.raises(ValueError):
        value_equality("new-policy")


def test_comparison_policies(spark, facts):
    anchors = spark.createDataFrame([("hero.eyes", "Green ish")], "detail_key string, locked_value string")
    c = candidates(spark, ("1", "fact", "hero", "eyes", "green ish", None, ""), ("2", "fact", "hero", "eyes", "Green ish", None, ""))
    rules = lambda p: sorted((r.cid, r.rule_id) for r in gates.run_gates(c, facts, anchors, policies=p).collect())
    assert rules({}) == []
    assert rules({"hero.eyes": "exact-string-v1"}) == [("1", "gate.anchor-consistency"), ("2", "gate.ledger-conflict")]
    with pytest.raises(ValueError):
        rules({"hero.eyes": "new-policy"})
    found = gates.assess_transition(facts, anchors, {"hero.eyes": "exact-string-v1"})
    assert sorted((r.claim_id, r.rule_id) for r in found.collect()) == [
        ("f1", "gate.anchor-consistency"), ("f1", "gate.ledger-conflict"), ("f2", "gate.anchor-consistency"), ("f2", "gate.ledger-conflict")
    ]
    assert sorted((r.claim_id, r.rule_id) for r in gates.assess_transition(facts, anchors, {}).collect()) == [
        ("f1", "gate.anchor-consistency"), ("f1", "gate.ledger-conflict"), ("f2", "gate.ledger-conflict")
    ]


def test_profiles_are_inherited():
    P, old = governance.ComparisonProfile, governance.ComparisonProfile({("a", "b"): "exact-string-v1"})
    assert P({("a", "b"): "exact-string-v1", ("c", "d"): "legacy-text-v1"}).revision() == P({("c", "d"): "legacy-text-v1", ("a", "b"): "exact-string-v1"}).revision()
    assert governance.inherited_profile(old, None, 7) == (old, False) and governance.inherited_profile(None, None, 0) == (P(), False)
    assert governance.inherited_profile(None, old, 0) == (old, True)
    new = P()
    assert governance.inherited_profile(old, new, 7, old.revision(), 7, "simpler") == (new, True)
    for bad in ({}, {"from_revision": "x", "expected_head": 7, "reason": "r"}, {"from_revision": old.revision(), "expected_head": 7, "reason": " "}):
        with pytest.raises(ValueError):
            governance.inherited_profile(old, new, 7, **bad)
    with pytest.raises(HeadConflict):
        governance.inherited_profile(old, new, 8, old.revision(), 7, "late")
    with pytest.raises(ValueError):
        governance.inherited_profile(old, old, 7, old.revision(), 7, "nothing changes")
    for wrong in ({("a.b", "c"): "exact-string-v1"}, {("", "c"): "exact-string-v1"}, {("a", "b"): "other"}):
        with pytest.raises(ValueError):
            P(wrong).revision()
