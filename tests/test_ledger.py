"""Golden cases of the ledger, and a property check against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import digests, ledger

COLUMNS = "id string, version_id string, seq long, claim_type string, subject string, key string, value string, scope_path string, status string, supersedes_id string"


def claims(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def hero(spark):
    return claims(
        spark,
        [
            ("a", "v1", 1, "fact", "hero", "eyes", "green", "book.ch1", "accepted", None),
            ("b", "v1", 2, "fact", "hero", "home", "harbor", "book.ch2", "accepted", None),
            ("c", "v2", 3, "correction", "hero", "eyes", "blue", "bookish", "accepted", "a"),
            ("d", "v2", 4, "fact", "hero", "age", "9", None, "disputed", "b"),
        ],
    )


def test_supersession_sees_only_what_the_pin_sees(hero):
    at = lambda pin: sorted(r.id for r in ledger.slice_facts(hero, pin).collect())
    assert at(2) == ["a", "b"]
    assert at(3) == ["b", "c"]
    assert at(None) == ["c"]  # a disputed claim supersedes too


def test_scope_is_a_dotted_prefix(hero):
    ids = lambda p: sorted(r.id for r in ledger.slice_facts(hero, 2, scope_prefix=p).collect())
    assert ids("book") == ["a", "b"]
    assert ids("book.ch1") == ["a"]
    assert sorted(r.id for r in ledger.slice_facts(hero, 3, scope_prefix="book").collect()) == ["b"]


def test_statuses_and_newest(hero):
    assert [r.id for r in ledger.slice_facts(hero, statuses=["accepted", "disputed"], limit=1).collect()] == ["d"]


def test_slice_equals_a_loop_at_every_pin(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(1, 61):
        sup = f"c{rnd.randint(1, i - 1)}" if i > 1 and rnd.random() < 0.4 else None
        rows.append((f"c{i}", "v", i, "fact", "s", "k", "x", None, rnd.choice(["accepted", "disputed"]), sup))
    df = claims(spark, rows).cache()
    for pin in range(0, 61, 6):
        seen = [r for r in rows if r[2] <= pin]
        gone = {r[9] for r in seen if r[9]}
        want = sorted(r[0] for r in seen if r[8] == "accepted" and r[0] not in gone)
        assert sorted(r.id for r in ledger.slice_facts(df, pin).collect()) == want


def test_lineage_and_anchor_precedence(spark):
    versions = spark.createDataFrame([("r", None), ("m", "r"), ("l", "m"), ("x", "r")], "id string, parent_id string")
    chain = ledger.lineage(spark, versions, "l")
    assert sorted((r.position, r.id) for r in chain.collect()) == [(0, "r"), (1, "m"), (2, "l")]
    anchors = spark.createDataFrame(
        [("r", "h.e", "old", 9, True), ("m", "h.e", "new", 2, True), ("x", "h.e", "other", 99, True), ("l", "h.e", "unlocked", 5, False)],
        "version_id string, detail_key string, locked_value string, seq long, locked boolean",
    )
    assert [(r.locked_value, r.seq) for r in ledger.anchors_at(anchors, chain).collect()] == [("new", 2)]
    assert ledger.anchors_at(anchors, chain, 1).count() == 0


def test_one_pin_script(spark):
    promises = spark.createDataFrame([("p1", "hero", 2, 6, "ch3", "reveal", "who did it")], "id string, subject string, seq long, fulfilled_seq long, due_scope string, key string, description string")
    state = lambda pin: [(r.status, r.fulfilled_seq) for r in ledger.promises_at(promises, pin).collect()]
    assert state(1) == []
    assert state(2) == [("open", None)]
    assert state(None) == [("fulfilled", 6)]
    late = ledger.overdue(ledger.promises_at(promises, 2), "ch3")
    assert [tuple(r) for r in late.collect()] == [
        ("p1", "gate.promise-unfulfilled", "warn", "promise 'reveal' was due at scope 'ch3' and is still open", "ch3", '{"promise_id":"p1","promise_key":"reveal"}')
    ]
    assert ledger.overdue(ledger.promises_at(promises, 2), "ch9").count() == 0
    assert ledger.overdue(ledger.promises_at(promises, 2), "ch9", final=True).first().message == "promise 'reveal' is still open at the final unit: who did it"


def test_counters_hide_behind_a_late_stamp(spark):
    rows = [("v", "flashback", "a", 1, 2, 3), ("v", "flashback", "a", 2, 2, 8)]
    c = spark.createDataFrame(rows, "version_id string, key string, scope_path string, count long, budget long, seq long")
    assert [(r["count"], r.budget) for r in ledger.counter_totals(c, 5).collect()] == [(1, 2)]
    assert ledger.counter_totals(c, 5, latest_only=True).count() == 0
    assert ledger.check_budgets(ledger.counter_totals(c, 5)).count() == 0
    found = ledger.check_budgets(ledger.counter_totals(c), "ch4").first()
    assert tuple(found) == (
        "flashback", "gate.counter-budget", "warn", "counter 'flashback' at 3 exceeds whole-document budget 2", "ch4", '{"budget":2,"counter_key":"flashback","total":3}'
    )


def test_directives(spark):
    totals = spark.createDataFrame([("flashback", 3, 2), ("storm", 1, 2), ("rain", 0, 2), ("unbudgeted", 9, None)], "key string, count long, budget long")
    assert {r.key: r.directive for r in ledger.directives(totals).collect()} == {
        "flashback": "flashback: used 3/2\nAVOID: 'flashback' — budget exhausted",
        "storm": "storm: used 1/2\nCAUTION: 'storm' — one use remaining",
        "rain": "rain: used 0/2",
    }


def test_append_checks_the_head(spark):
    batch = spark.createDataFrame([("b",), ("a",)], "cid string")
    assert [(r.cid, r.seq) for r in ledger.append_claims(7, batch, "cid", 7).orderBy("cid").collect()] == [("a", 8), ("b", 9)]
    with pytest.raises(ValueError):
        ledger.append_claims(7, batch, "cid", 6)


def test_digests(hero, spark):
    facts = ledger.slice_facts(hero, 2)
    assert sorted(r.text for r in digests.tier0(facts).collect()) == [
        "[book.ch1] 1 facts\nhero.eyes=green",
        "[book.ch2] 1 facts\nhero.home=harbor",
    ]
    assert [r.text for r in digests.tier1(facts).collect()] == ["[group book] 2 facts across 2 scopes; keys: hero.eyes, hero.home"]
    assert [(r.scope, r.text) for r in digests.tier2(facts).collect()] == [("", "[rollup] 2 facts, 2 scopes, 1 subjects: hero")]
    empty = digests.tier2(facts.where(F.lit(False))).collect()
    assert [(r.text, r.built_from_seq) for r in empty] == [("[rollup] 0 facts, 0 scopes, 0 subjects: ", 0)]


def test_snapshot_rebuilds_digests_under_the_pin(spark):
    claims = spark.createDataFrame(
        [("c1", 1, "s", "k", "v", "a.b", "accepted", None), ("c2", 2, "s", "j", "w", "c", "accepted", None), ("c3", 3, "s", "k", "x", "a.b", "accepted", "c1")],
        "id string, seq long, subject string, key string, value string, scope_path string, status string, supersedes_id string",
    )
    empty = lambda schema: spark.createDataFrame([], schema)
    stores = (
        empty("version_id string, detail_key string, locked_value string, seq long, locked boolean"),
        empty("id string, seq long, fulfilled_seq long, due_scope string, key string, description string"),
        empty("version_id string, key string, scope_path string, count long, budget long, seq long"),
        empty("id string, position int"),
    )
    at = lambda pin: {(r.tier, r.scope): r.n_facts for r in ledger.load_snapshot(claims, *stores, pin).digests.collect()}
    assert at(1) == {(0, "a.b"): 1, (1, "a"): 1, (2, ""): 1}
    assert at(None) == {(0, "a.b"): 1, (0, "c"): 1, (1, "a"): 1, (1, "c"): 1, (2, ""): 2}


SCHEMA = "id string, seq long, subject string, key string, value string, scope_path string, status string, supersedes_id string"


def proposed(spark, *rows):
    return spark.createDataFrame([(i, "s", "k", v, None, "accepted", None) for i, v in rows], SCHEMA.replace("seq long, ", ""))


def test_appends_are_gated_anew_when_the_head_moves(spark, tmp_path):
    store = ledger.LedgerStore(spark, str(tmp_path / "l"), SCHEMA)
    keep = lambda p, facts: p.select(*store.claims().columns[:1], *store.claims().columns[2:])
    order = store.claims().columns
    put = lambda df, at: store.append(ledger.append_claims(at, df, "id").select(*order), at)
    assert store.head() == 0
    seen = []

    def gate(p, facts):
        seen.append(facts.count())
        if len(seen) == 1:  # another writer comes first
            put(keep(proposed(spark, ("other", "v")), None), 0)
        return p

    class Ordered(ledger.LedgerStore):
        def append(self, batch, at):
            return super().append(batch.select(*order), at)

    mine = Ordered(spark, store.path, SCHEMA)
    assert ledger.append_gated(mine, proposed(spark, ("a", "v"), ("b", "v")), gate, "id") == 3 and seen == [0, 1]
    assert sorted((r.seq, r.id) for r in store.claims().collect()) == [(1, "other"), (2, "a"), (3, "b")]
    with pytest.raises(ledger.HeadConflict):
        ledger.append_gated(mine, proposed(spark, ("c", "v")), lambda p, f: p, "id", expected_head=2)
    never = lambda p, f: (put(proposed(spark, ("x", "v")), store.head()), p)[1]
    with pytest.raises(ledger.HeadConflict):
        ledger.append_gated(mine, proposed(spark, ("d", "v")), never, "id", attempts=2)
    assert store.head() == 5 and store.claims().where("id = 'd'").count() == 0


def test_long_lineages_by_doubling(spark):
    n = 10_000
    versions = spark.range(n).selectExpr("concat('v', id) AS id", "CASE WHEN id > 0 THEN concat('v', id - 1) END AS parent_id").repartition(4)
    got = ledger.lineage(spark, versions, f"v{n - 1}", small=0)
    assert got.count() == n and got.where("id <> concat('v', position)").isEmpty()
    every = ledger.lineages(versions)
    assert every.count() == n and every.where("root <> 'v0' OR id <> concat('v', depth)").isEmpty()
    assert [tuple(r) for r in ledger.lineage(spark, versions, "v2").orderBy("position").collect()] == [("v0", 0), ("v1", 1), ("v2", 2)]


def test_lineages_write_what_is_done_once(spark, monkeypatch):
    """Versions that have met their root stay out of later rounds."""
    sizes, write = [], ledger.materialise
    monkeypatch.setattr(ledger, "materialise", lambda df, name: (sizes.append((x := write(df, name)).count()), x)[1])
    v = spark.createDataFrame([(f"v{i}", f"v{i - 1}" if i % 10 else None) for i in range(100)], "id string, parent_id string")
    assert {(r.id, r.root, r.depth) for r in ledger.lineages(v).collect()} == {(f"v{i}", f"v{i - i % 10}", i % 10) for i in range(100)}
    assert sizes == [100, 90, 80, 60, 20]


def test_lineages_of_odd_versions(spark):
    rows = [("a", "gone"), ("b", "a"), ("c", None), ("d", "b")]
    v = spark.createDataFrame(rows, "id string, parent_id string")
    for small in (0, 100):
        walk = lambda leaf: [r.id for r in ledger.lineage(spark, v, leaf, small).orderBy("position").collect()]  # noqa: B023, E731
        assert walk("d") == ["a", "b", "d"] and walk("c") == ["c"] and walk("never") == []
    assert sorted(map(tuple, ledger.lineages(v).collect())) == [("a", "a", 0), ("b", "a", 1), ("c", "c", 0), ("d", "a", 2)]
    assert ledger.lineages(v.limit(0)).count() == 0
    ring = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("x", None)], "id string, parent_id string")
    for call in (lambda: ledger.lineage(spark, ring, "a", 0), lambda: ledger.lineage(spark, ring, "a"), lambda: ledger.lineages(ring)):
        with pytest.raises(ValueError, match="cycle"):
            call()


def test_events_are_taken_in_order(spark):
    rows = [
        ("s", 1, "a", 1, "da", None, 1),
        ("s", 1, "b", 3, "db", "da", 2),  # a gap
        ("s", 1, "b", 2, "db", "da", 3),
        ("s", 1, "a", 1, "da", None, 4),  # sent again
        ("s", 1, "a", 3, "other", "db", 5),  # the id with something else
        ("s", 1, "c", 3, "dc", "wrong", 6),
        ("s", 1, "c", 3, "dc", "db", 7),
        ("s", 2, "d", 2, "dd", "dc", 8),  # an epoch begins at 1
        ("s", 2, "d", 1, "dd", "anything", 9),
        ("t", 1, "a", 1, "x", None, 10),
    ]
    e = spark.createDataFrame(rows, "source string, epoch int, event_id string, sequence int, digest string, prior_digest string, arrival long").repartition(3)
    acks = [r.ack for r in ledger.accept_events(e).orderBy("arrival").collect()]
    assert acks == ["accepted", "refused", "accepted", "replayed", "mismatch", "refused", "accepted", "refused", "accepted", "accepted"]
    assert ledger.accept_events(e.limit(0)).count() == 0
