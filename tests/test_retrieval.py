import base64
import datetime as dt
import hashlib
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.canonical import float_text
from corvane.functions.vectors import blend, local_embed, nearest
from corvane.operators import access, context, corpus, evidence, fusion, governance, ledger, money, reports, retrieval, verification
from corvane.operators.access import Binding, Principal
from corvane.operators.evidence import EvidenceColumn, Layer, Manifest, View
from corvane.operators.retrieval import Demotion


def test_rrf_golden(spark):
    lex = spark.createDataFrame([("a", 9.0), ("b", 8.0)], "chunk_id string, score double")
    vec = spark.createDataFrame([("b", 0.1), ("c", 0.2)], "chunk_id string, score double")
    out = retrieval.final_top(retrieval.rrf(retrieval.top_leg(lex, 50), retrieval.top_leg(vec, 50, False)), 0).collect()
    assert [(r.chunk_id, r.lexical_rank, r.vector_rank) for r in out][0] == ("b", 2, 1)
    assert math.isclose(out[0].score, 1 / 62 + 1 / 61)


def test_nan_scores_come_last(spark):
    lex = spark.createDataFrame([("a", float("nan")), ("b", 1.0), ("c", 1.0)], "chunk_id string, score double")
    assert [r.chunk_id for r in retrieval.top_leg(lex, 3).orderBy("rank").collect()] == ["b", "c", "a"]


def test_bm25_against_a_loop(spark):
    texts = {"d1": "red fox jumps", "d2": "red red car", "d3": "blue sky over the red sea and sea", "d4": ""}
    chunks = spark.createDataFrame([("x", k, t) for k, t in texts.items()], "collection string, chunk_id string, text string")
    got = {r.chunk_id: r.score for r in retrieval.bm25(chunks, ["red", "sea"]).collect()}
    lens = {k: len(t.split()) for k, t in texts.items()}
    avg = sum(lens.values()) / 4
    want = {}
    for k, t in texts.items():
        s = 0.0
        for q in ("red", "sea"):
            df = sum(q in x.split() for x in texts.values())
            tf = t.split().count(q)
            s += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[k] / avg))
        if s:
            want[k] = s
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k]) for k in want)
    assert [r.chunk_id for r in retrieval.bm25(chunks, ["red", "sea"], 2).collect()] == ["d3"]
    half = {r.chunk_id: r.score for r in retrieval.bm25(chunks, ["red"], rules=[Demotion("red fox", 0.5, match="phrase")]).collect()}
    full = {r.chunk_id: r.score for r in retrieval.bm25(chunks, ["red"]).collect()}
    assert math.isclose(half["d1"], full["d1"] / 2) and half["d2"] == full["d2"]


def test_expansion_matches_whole_words():
    assert retrieval.expand_query("A Fool's day", [(["fool"], ["idiot", "day"]), (["day out"], ["trip"])]) == ["idiot"]
    assert retrieval.query_terms("The Red and the red fox") == ["red", "fox"]


def test_vectors(spark):
    assert not local_embed("").any()
    assert math.isclose(np.linalg.norm(local_embed("one two three")), 1, rel_tol=1e-6)
    a, b = local_embed("one"), local_embed("two")
    assert blend(a, b, 0) is a and blend(a, b, 1) is b
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = nearest(v, [(0, [1.0, 0.0])], 4).orderBy("rank").collect()
    assert [(r.id, round(r.distance, 6)) for r in out] == [(1, 0.0), (3, 0.0), (2, 1.0), (4, 2.0)]
    with pytest.raises(ValueError):
        nearest(v, [(0, [float("nan"), 0.0])], 1)


def test_chunks(spark):
    assert corpus.chunk_text("aa\n\n bb \n\n\n\ncc", 6) == ["aa\n\nbb", "cc"]
    assert corpus.chunk_text("éé", 3) == ["é", "é"]
    assert corpus.chunk_text("😀", 2) == ["😀"]
    assert corpus.chunk_text(" \n\n ", 5) == []
    long = "wörter und " * 500
    assert all(len(c.encode()) <= 100 for c in corpus.chunk_text(long, 100))
    df = spark.createDataFrame([("c", "s", "x" * 25), ("c", "e", None)], "collection string, source_id string, text string")
    assert [(r.chunk_id, r.text) for r in corpus.build_chunks(df, 10).orderBy("ordinal").collect()] == [("s#0", "x" * 10), ("s#1", "x" * 10), ("s#2", "x" * 5)]


def test_pack_skips_what_does_not_fit(spark):
    p = spark.createDataFrame([(1, 1, "a", 60), (1, 2, "b", 50), (1, 3, "c", 40)], "request int, rank int, chunk_id string, cost long")
    assert [(r.used, r.taken) for r in fusion.budget_pack(p, 100).collect()] == [(100, "a,c")]


def test_access_and_bindings(spark):
    df = spark.createDataFrame([("s1", "a/x", "m", "h", 1, ["eu"]), ("s2", "a%/y", "n", "g", 3, [])], "source_id string, path string, media_type string, content_hash string, level int, comp array<string>")
    see = lambda p: [r.source_id for r in df.where(access.permits(p, F.col("level"), F.col("comp"))).collect()]
    assert see(Principal(2)) == []
    assert see(Principal(2, ["eu", "us"])) == ["s1"]
    assert see(Principal(9, all_compartments=True)) == ["s1", "s2"]
    b = [Binding("c1", prefix="a%"), Binding("c2"), Binding("c3", prefix="zzz", content_hashes=["g2", "h"]), Binding("c4", prefix="a", media_types=["x", "n"]), Binding("c5", prefix="")]
    assert sorted((r.source_id, r.collection) for r in access.matched_collections(df, b).collect()) == [("s1", "c3"), ("s1", "c5"), ("s2", "c1"), ("s2", "c4"), ("s2", "c5")]


PUB = "id string, document_id string, collection string, effective_from string, effective_until string, published_at string, state string"
REL = "from_document string, to_document string, kind string, effective_from string, effective_until string"


def governed(spark, publications, relations, day):
    dated = lambda df: df.withColumn("effective_from", F.to_date("effective_from")).withColumn("effective_until", F.to_date("effective_until"))
    pubs = [(i, d, "c", a, u, f"{a}T00:00:00Z", s or "approved") for i, d, a, u, s in publications]
    rels = [(a, b, k, "2025-01-01", None) for k, a, b in relations]
    found = governance.governing_publications(dated(spark.createDataFrame(pubs, PUB)), dated(spark.createDataFrame(rels, REL)), day)
    return {r.document_id: r.verdict for r in found.collect()}, sorted(r.id for r in governance.governing(found).collect())


def test_withdrawal_and_expiry_never_resurrect(spark):
    one, two = ("one", "d", "2025-01-01", None, None), ("two", "d", "2025-06-01", None, None)
    assert governed(spark, [one, two], [], "2025-05-31")[1] == ["one"]
    assert governed(spark, [one, two], [], "2025-06-01")[1] == ["two"]
    assert governed(spark, [one, ("two", "d", "2025-06-01", None, "withdrawn")], [], "2025-06-01") == ({"d": "withdrawn"}, [])
    assert governed(spark, [one, ("two", "d", "2025-06-01", "2025-07-01", None)], [], "2025-07-01") == ({"d": "expired"}, [])


def test_two_latest_publications_leave_the_collection_undecided(spark):
    rows = [("one", "d", "2025-01-01", None, None), ("two", "d", "2025-01-01", None, None), ("x", "e", "2025-01-01", None, None)]
    assert governed(spark, rows, [], "2025-08-01") == ({"d": "ambiguous", "e": "governs"}, [])
    assert governed(spark, [*rows, ("three", "d", "2025-06-01", None, None)], [], "2025-08-01")[1] == ["three", "x"]


@pytest.mark.parametrize(
    ("relations", "want", "ruling"),
    [
        ([("requires", "a", "missing")], {"a": "review", "b": "governs"}, []),
        ([("amends", "a", "missing")], {"a": "review", "b": "governs"}, []),
        ([("applies-to", "a", "b")], {"a": "governs", "b": "governs"}, ["pa", "pb"]),
        ([("exception-to", "a", "b")], {"a": "governs", "b": "governs"}, ["pa", "pb"]),
        ([("conflicts", "a", "nowhere")], {"a": "review", "b": "governs"}, []),
        ([("conflicts", "nowhere", "a")], {"a": "governs", "b": "governs"}, ["pa", "pb"]),
        ([("supersedes", "a", "b")], {"a": "governs", "b": "superseded"}, ["pa"]),
        ([("supersedes", "gone", "b")], {"a": "governs", "b": "governs"}, ["pa", "pb"]),
        ([("supersedes", "a", "b"), ("requires", "a", "b")], {"a": "review", "b": "superseded"}, []),
        ([("supersedes", "a", "b"), ("conflicts", "b", "a")], {"a": "governs", "b": "superseded"}, ["pa"]),
        ([("supersedes", "a", "b"), ("supersedes", "b", "old")], {"a": "governs", "b": "review"}, []),
    ],
)
def test_relations(spark, relations, want, ruling):
    rows = [("pa", "a", "2025-01-01", None, None), ("pb", "b", "2025-01-01", None, None)]
    verdicts, ids = governed(spark, rows, relations, "2025-06-01")
    assert verdicts == want and ids == ruling


def test_amendments_touch_both_sides(spark):
    rel = spark.createDataFrame([("a", "b", "amends", "2025-01-01", None), ("c", "d", "requires", "2025-01-01", None), ("e", "f", "applies-to", "2025-01-01", "2025-02-01")], REL)
    rel = rel.withColumn("effective_from", F.to_date("effective_from")).withColumn("effective_until", F.to_date("effective_until"))
    picked = spark.createDataFrame([(x,) for x in "abcdef"], "document_id string")
    assert sorted(r[0] for r in governance.amendment_review(picked, rel, "2025-06-01").collect()) == ["a", "b"]


PRICE = "struct<id:string,provider:string,route:string,model:string,currency:string,basis:string,valid_from:timestamp,valid_until:timestamp,rates:map<string,struct<micro_units:bigint,per_tokens:bigint>>>"
USAGE = ("input", "output", "cache_read", "cache_write", "reasoning", "context")


def charged(spark, usage, basis="inclusive", drop=(), priced=True, **rates):
    given = {"input": (1, 3), "output": (0, 1)} | rates
    kinds = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1)
    price = ("v1", "p", "a" * 64, "m", "USD", basis, *kinds, {k: v for k, v in given.items() if k not in drop}) if priced else None
    row = (1, *(usage.get(k) for k in USAGE), usage.get("unknown", False), price)
    df = spark.createDataFrame([row], f"id int, {', '.join(f'{k} bigint' for k in USAGE)}, unknown_categories boolean, price {PRICE}")
    return money.calculate(df).first()


def test_money_rounds_up_and_zero_is_a_price(spark):
    assert [charged(spark, {"input": n, "output": 0}).micro_units for n in (0, 1, 3, 4)] == ["0", "1", "1", "2"]
    assert charged(spark, {"input": 1, "output": 0}, input=(0, 3)).micro_units == "0"


def test_unknown_money_is_never_free(spark):
    r = charged(spark, {"input": 1, "output": 0}, priced=False)
    assert (r.missing_price, r.micro_units, r.price_id) == (True, None, None)
    r = charged(spark, {})
    assert (r.missing_usage, r.micro_units, r.missing_price) == (True, None, False)
    assert charged(spark, {"input": 5}).micro_units is None
    assert charged(spark, {"input": 1, "output": 0}, drop=["output"]).missing_price
    r = charged(spark, {"input": 1, "output": 0, "unknown": True})
    assert r.unknown_categories and r.micro_units is None
    r = charged(spark, {"input": 1, "output": 0, "context": 2})
    assert r.unknown_categories and r.micro_units is None


def test_categories_are_charged_once(spark):
    usage = {"input": 10, "output": 20, "cache_read": 3, "cache_write": 2, "reasoning": 7, "context": 0}
    one = {k: (1, 1) for k in USAGE}
    assert charged(spark, usage, input=(1, 1), output=(1, 1)).micro_units == "30"
    assert charged(spark, usage, "partitioned", **one).micro_units == "30"
    assert charged(spark, usage, "partitioned", **(one | {"cache_read": (0, 1)})).micro_units == "27"
    assert charged(spark, {"input": 1, "output": 0}, "partitioned", **one).missing_usage
    for bad in ({"reasoning": 21}, {"cache_write": 8}):
        r = charged(spark, usage | bad, "partitioned", **one)
        assert (r.error, r.micro_units, r.missing_price) == ("usage subset exceeds parent total", None, None)
    assert charged(spark, usage, **one).error == "invalid price snapshot"  # inclusive rates are of input and output only
    assert charged(spark, usage, input=(1, 0)).error == "invalid price snapshot"
    assert charged(spark, {"input": 2**40, "output": 0}, input=(2**30, 1)).error == "monetary total exceeds u64 micro-units"
    assert charged(spark, {"input": 2**40, "output": 0}, input=(2**23, 1)).micro_units == str(2**63)


def test_prices_apply_by_route_and_time(spark):
    at = lambda x: F.to_timestamp(F.lit(x))
    a = spark.createDataFrame([(1, "p", "r1", "m", 5), (2, "p", "r2", "m", 5), (3, "p", "r1", "m", 9)], "id long, provider string, route string, model string, day int")
    a = a.withColumn("submitted_at", F.make_timestamp(F.lit(2020), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))
    p = spark.createDataFrame([(7, "p", "r1", "m"), (8, "p", "r1", "m")], "id long, provider string, route string, model string")
    p = p.withColumn("valid_from", at("2020-01-05")).withColumn("valid_until", F.when(F.col("id") == 7, at("2020-01-09")).otherwise(at("2020-01-06")))
    assert {r.id: r.price and r.price.id for r in money.applicable_prices(a, p).collect()} == {1: 8, 2: None, 3: None}
    endless = p.withColumn("valid_until", F.lit(None).cast("timestamp"))
    assert {r.id: r.price and r.price.id for r in money.applicable_prices(a, endless).collect()} == {1: 8, 2: None, 3: 8}


def test_sessions_and_turns_with_users_and_sessions(spark):
    at = lambda df, c: df.withColumn(c, F.to_timestamp(c))
    opened = at(spark.createDataFrame([("s1", "u1", "2024-01-01 01:00:00"), ("s2", "u1", "2024-01-01 02:00:00")], "id string, uid string, opened_at string"), "opened_at")
    said = [("s1", "u1", "2024-01-01 03:00:00"), ("s2", "u1", "2024-01-01 04:00:00"), ("s3", "u2", "2024-01-02 00:00:00")]
    report = reports.sessions_report(opened, at(spark.createDataFrame(said, "session_id string, uid string, created_at string"), "created_at")).orderBy("bucket")
    assert report.columns == ["bucket", "opened", "users", "turns", "active", "active_uids"]
    assert [tuple(r)[1:] for r in report.collect()] == [(2, 1, 2, 2, 1), (0, 0, 1, 1, 1)]


def test_a_whole_hash_is_sorted_by_many_tasks(spark):
    """Pieces of many partitions are hashed in order; the task that hashes sorts nothing."""
    df = spark.range(20_000).select(F.col("id").alias("k"), F.format_string("%030d", (F.col("id") * 7919) % 20_000).alias("v")).repartition(7)
    m = Manifest("m", [EvidenceColumn("k", "int64"), EvidenceColumn("v", "string")], order_by=["v"])
    found = evidence.logical_hashes(df, m)
    assert tuple(found.first()) == evidence.logical_hash(df, m)
    assert "Sort" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_prices_that_overlap(spark):
    """As a plain loop says, nested, endless, empty and equal validities included; an attempt never meets all the prices of its day."""
    dice = random.Random(3)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    p = [(i, dice.choice("pq"), "r", "m", day(s := dice.randrange(40)), dice.choice([None, *(day(s + n) for n in range(-1, 30))])) for i in range(300)]
    p += [(900, None, "r", "m", day(1), day(30)), (901, "p", "r", "m", None, day(30))]
    a = [(i, dice.choice(["p", "q", None]), "r", "m", dice.choice([None, *map(day, range(75))])) for i in range(400)] + [(None, "p", "r", "m", day(20))]
    prices = spark.createDataFrame(p, "id long, provider string, route string, model string, valid_from date, valid_until date").repartition(3)
    attempts = spark.createDataFrame(a, "id long, provider string, route string, model string, submitted_at date")

    def plain(x):
        hits = [(r[4], r[0]) for r in p if None not in (x[1], x[4], r[4]) and r[1] == x[1] and r[4] <= x[4] and (r[5] is None or x[4] < r[5])]
        return max(hits)[1] if hits else None

    found = money.applicable_prices(attempts, prices)
    assert found.columns == [*attempts.columns, "price"]
    assert sorted(((r.id, r.price and r.price.id) for r in found.collect()), key=str) == sorted(((x[0], plain(x)) for x in a), key=str)
    assert money.applicable_prices(attempts, prices.limit(0)).where("price IS NULL").count() == len(a)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]


def test_report_windows():
    assert reports.parse_window("24h") == (86_400, 900)
    with pytest.raises(ValueError):
        reports.parse_window("2h")


def test_evidence(spark, tmp_path):
    cols = [EvidenceColumn("k", "int64", False, key=True), EvidenceColumn("v", "decimal", scale=2), EvidenceColumn("s", "string")]
    rows = [(1, "-0.004", ""), (2, None, None), (3, "1.5", "x")]
    df = spark.createDataFrame(rows, "k long, v string, s string").withColumn("v", F.col("v").cast("decimal(38,3)"))
    text = [r.t for r in df.orderBy("k").select(evidence.canonical_row(cols).alias("t")).collect()]
    assert text == ["1\x1f0.00\x1f", "2\x1f\x00\x1f\x00", "3\x1f1.50\x1fx"]
    head = "canon@1\x1dk\x1fk\x1fint64\x1f\x00\x1f\x00\x1ffalse\x1ftrue\x1ev\x1fv\x1fdecimal\x1f2\x1f\x00\x1ftrue\x1ffalse\x1es\x1fs\x1fstring\x1f\x00\x1f\x00\x1ftrue\x1ffalse\x1dkeys\x1ffalse\x1f\x1d"
    m = Manifest("m", cols)
    want = (3, hashlib.sha256((head + "\x1e".join(sorted(text))).encode()).hexdigest())
    assert evidence.logical_hash(df, m) == evidence.logical_hash(df.orderBy(F.desc("k")), m) == want == tuple(evidence.logical_hashes(df.repartition(3), m).first())
    assert tuple(evidence.logical_hashes(df.limit(0), m).first()) == evidence.logical_hash(df.limit(0), m)
    others = [Manifest("m", [replace(cols[0], name="other"), *cols[1:]]), Manifest("m", cols, truncated=True), Manifest("m", cols, denied=["z"]), Manifest("m", cols, authorization="a")]
    assert len({evidence.logical_hash(df, x)[1] for x in [m, *others]}) == 5
    loose = [replace(c, key=False) for c in cols]
    with pytest.raises(ValueError, match="result_not_identifiable"):
        evidence.logical_hash(df, Manifest("m", loose))
    by = lambda *o: evidence.logical_hash(df, Manifest("m", loose, order_by=o))[1]
    assert by("k") != by("k DESC") and by("k") == evidence.logical_hashes(df, Manifest("m", loose, order_by=["k"])).first().logical_hash
    assert Manifest("m", [*cols, EvidenceColumn("k", "money")]).problems() == ["column ids repeat", "k: unknown type money"]
    sealed = evidence.seal(df, Manifest("m", cols), str(tmp_path / "t"))
    assert sealed.row_count == 3 and evidence.seal(df, Manifest("m", cols), str(tmp_path / "t")).logical_hash == want[1]
    assert spark.read.parquet(str(tmp_path / "t" / "data")).count() == 3
    with pytest.raises(ValueError, match="another table"):
        evidence.seal(df.where("k > 1"), Manifest("m", cols), str(tmp_path / "t"))
    with pytest.raises(ValueError):
        evidence.seal(df.where("k > 1"), Manifest("m", cols, logical_hash=want[1]), str(tmp_path / "u"))
    page = evidence.rows_page(df, Manifest("m", cols), Principal(0), ["k"], 1, 1).collect()
    assert [(r.k, r.total, r.has_more) for r in page] == [(2, 3, True)]
    assert evidence.rows_page(df, Manifest("m", cols, level=1), Principal(0), ["k"], 0).count() == 0


def test_canonical_values(spark):
    row = spark.range(1).select(
        F.lit(True).alias("bool"), F.lit("0.1").cast("double").alias("float64"), F.lit(b"\x00\xff" * 60).alias("bytes"), F.lit("2020-02-03").cast("date").alias("date"),
        F.lit("2020-02-03T04:05:06.7+02:00").cast("timestamp").alias("timestamp_tz"), F.lit("2020-02-03 04:05:06").cast("timestamp_ntz").alias("timestamp_naive"),
        F.lit("AB-c").alias("uuid"), F.lit('{"b": [1.0, 1e21, 1e-7, 0.000001, -0.0, 123.5], "a": "\u00e9"}').alias("json"), F.array(F.lit("x"), F.lit(None), F.lit("")).alias("array"),
        F.array(F.lit(True), F.lit(False)).alias("flags"),
    )
    text = lambda kind, c=None, **k: row.select(evidence.canonical_text(F.col(c or kind), kind, **k)).first()[0]
    assert [text(k) for k in ("bool", "float64", "date", "timestamp_naive", "uuid")] == ["true", "0.1", "2020-02-03", "2020-02-03T04:05:06.000000", "ab-c"]
    assert text("bytes") == base64.b64encode(b"\x00\xff" * 60).decode()
    assert text("json") == '{"a":"é","b":[1,1e+21,1e-7,0.000001,0,123.5]}'
    assert text("array") == "[x\x1f\x00\x1f]" and text("array", "flags", element="bool") == "[true\x1ffalse]"
    zone = spark.conf.get("spark.sql.session.timeZone")
    for z in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", z)
        assert text("timestamp_tz") == "2020-02-03T02:05:06.700000Z"
    spark.conf.set("spark.sql.session.timeZone", zone)
    values = [1.0, 1e21, -0.0, 1.5e-7, float("inf"), float("-inf"), 123456789.125]
    assert [float_text(v) for v in values] == ["1", "1000000000000000000000", "-0", "0.00000015", "inf", "-inf", "123456789.125"]


def test_plans_and_selection(spark):
    some = spark.range(3)
    got = evidence.execute_plan([Layer("a", lambda: some.where("id > 9")), Layer("b", lambda: some), Layer("c", lambda: some, fallback=True)])
    assert got["a"] == "empty" and got["c"] == "skipped"
    with pytest.raises(ValueError):
        evidence.execute_plan([Layer("a", lambda: None, required=True)])
    view = View({"n": F.count(F.lit(1))}, ["id"])
    with pytest.raises(ValueError):
        evidence.select_from(some, view, ["n"], ["secret"])
    with pytest.raises(ValueError):
        evidence.select_from(some, view, [])


def test_verification(spark):
    a = spark.createDataFrame([(1, 'It says "the  quick brown fox" and "The Quick brown fox" and “a made up sentence" [d/1] [ d/2 ] [one two/x y] [sic] [a\n/b] evidence/t#1 gives 7, "never closed at all')], "answer_id int, answer string")
    s = spark.createDataFrame([(1, "d/1", "so the quick\n brown fox ran")], "answer_id int, path string, text string")
    assert sorted(r.quote for r in verification.check_quotes(a, s).collect()) == ["The Quick brown fox", "a made up sentence"]
    assert sorted(r.path for r in verification.check_citations(a, s).collect()) == ["d/2", "one two/x y"]
    cells = spark.createDataFrame([("t", "r2", " 1 "), ("t", "r2", "north"), ("t", "r#3", "5")], "evidence_id string, row_id string, value string")
    block = lambda body, end="```": (1, f"so ```assertions {body} {end} and")
    faults = lambda *rows: sorted((r.fault, r.ref) for r in verification.check_assertions(spark.createDataFrame(rows, "answer_id int, answer string"), cells).collect())
    assert faults(block('[{"value": "10", "evidence_refs": ["evidence/t#r2"]}]')) == [("not_in_row", "evidence/t#r2")]
    assert faults(block('[{"value": "1", "evidence_refs": ["evidence/t#r2"]}, {"value": "5", "evidence_refs": ["evidence/t#r#3"]}]')) == []
    assert faults(block('[{"value": "9", "evidence_refs": ["evidence/t#r2", "evidence/t#r9"]}]')) == [("not_served", "evidence/t#r9")]
    assert faults(block('[{"value": "9", "evidence_refs": []}]')) == [("no_evidence", None)]
    assert faults(block('[{"value": "9", "evidence_refs": ["evidence/t", "x/t#1"]}]')) == [("not_a_reference", "evidence/t"), ("not_a_reference", "x/t#1")]
    assert faults(block("[{", "")) == [("unclosed", None)] and faults(block("[{")) == [("unparsed", None)] and faults((1, "none")) == []
    cited = spark.createDataFrame([(1, "a [evidence/t#r2] b evidence/t#r8 [ evidence/t#r9 ] [evidence/u#r2] [evidence/t]")], "answer_id int, answer string")
    assert sorted(r.ref for r in verification.check_evidence_citations(cited, cells).collect()) == ["evidence/t#r9", "evidence/u#r2"]
    show = lambda x, secret=False, cap=20: spark.range(1).select(verification.logged_body(F.lit(x), cap, F.lit(secret)).alias("r")).first().r
    assert show('{"a": 1}') == '{"a": 1}' and show("") is None and show("x", True) == '{"redacted":"response contains secret material; not stored"}'
    assert show("plain").startswith('{"bytes_len":5,"sha256":"') and show('{"password": "s3cret-and-long"}').startswith('{"bytes_len":31,')


def test_provider_usage(spark):
    cases = {
        "total": ("openai", '{"usage":{"prompt_tokens":10,"completion_tokens":20,"total_tokens":30,"prompt_tokens_details":{"cached_tokens":4},"completion_tokens_details":{"reasoning_tokens":8}}}', (10, 20, 4, 0, 8, None, False)),
        "apart": ("anthropic", '{"usage":{"input_tokens":3,"output_tokens":4,"cache_read_input_tokens":5,"cache_creation_input_tokens":2}}', (10, 4, 5, 2, None, None, False)),
        "other": ("openai", '{"usage":{"prompt_tokens":1,"completion_tokens":2,"context_tokens":3}}', (1, 2, None, 0, None, None, True)),
        "zero": ("openai", '{"usage":{"prompt_tokens":1,"completion_tokens":2,"prompt_tokens_details":{"audio":0}}}', (1, 2, None, 0, None, None, False)),
        "no object": ("openai", '{"usage":{"prompt_tokens":-1,"completion_tokens":2.0,"prompt_tokens_details":null}}', (None, None, None, 0, None, None, True)),
        "missing": ("openai", "{}", (None, None, None, None, None, None, False)),
        "broken": ("anthropic", "{", (None, None, None, None, None, None, False)),
        "null": ("anthropic", None, (None, None, None, None, None, None, False)),
        "local": ("ollama", '{"prompt_eval_count":7,"usage":{"x":1}}', (7, None, None, None, None, None, False)),
    }
    rows = spark.createDataFrame([(k, p, r) for k, (p, r, _) in cases.items()], "id string, provider string, response string")
    assert {r.id: tuple(r)[1:] for r in verification.provider_usage(rows).collect()} == {k: w for k, (_, _, w) in cases.items()}
    for provider, body in (("ollama", '{"prompt_eval_count":7}'), ("openai", '{"usage":{"prompt_tokens":7}}')):
        one = spark.createDataFrame([(1, provider, body, True)], "id int, provider string, response string, embedding boolean")
        assert verification.provider_usage(one).first().output == 0


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('["tide", " sea-wall ", "Tide", "x", "a1b", "o\'clock", "-\'", "flood", "tide"]', ["tide", "sea-wall", "o'clock"]),
        ('Here you are:\n```json\n["tide"]\n```', ["tide"]),
        ("no list here", []),
        ('["tide", 3]', None),
        ("[broken", []),
        ("x [broken] y", None),
        (f'["{"e" * 40}", "{"f" * 41}", "{"é" * 20}", "{"è" * 21}"]', ["e" * 40, "é" * 20]),
    ],
)
def test_model_expansion(spark, raw, want):
    assert spark.range(1).select(verification.model_expansion(F.lit(raw), F.lit("What of the Flood?")).alias("x")).first().x == want


def test_expansion_is_capped(spark):
    raw = '["' + '","'.join(f"ab{c}" for c in "cdefghijklmnop") + '"]'
    assert len(spark.range(1).select(verification.model_expansion(F.lit(raw), F.lit(""), 5).alias("x")).first().x) == 5


def test_less_restricted_prefixes_shadow(spark):
    long = "a/" * 50
    rows = [("o", long, 0, ["x"]), ("i", long + "x", 1, ["x", "y"]), ("s", "a/", 0, []), ("e", "", 0, ["z"]), ("n", None, 0, []), ("t", "a/b", 0, ["q"]), ("u", "a/bc", 0, ["q", "q"])]
    p = spark.createDataFrame(rows, "collection string, prefix string, level int, compartments array<string>")
    got = sorted((r.outer, r.inner, r.outer_prefix) for r in access.shadowed_prefixes(p).collect())
    assert got == [("o", "i", long), ("s", "i", "a/"), ("s", "o", "a/"), ("s", "t", "a/"), ("s", "u", "a/")]
    message = next(r.message for r in access.shadowed_prefixes(p).collect() if (r.outer, r.inner) == ("s", "u"))
    assert message == (
        "collection 's' (level 0, compartments []) binds 'a/', a prefix of the more-restricted 'u' (level 0, [\"q\", \"q\"]) binding 'a/bc'"
        " — the restricted documents are also served to the wider audience; make the overlap a decision, not an accident"
    )


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("case 07/638,337 no 1,234,567 of 2020-01-01 at 12345.5", ["638337", "1234567"]),
        ("US4436097 and EP1234567A1", ["4436097"]),
        ("patents 4,436,097 and 4436097", ["4436097"]),
        ("20240131 19991231 21240131", ["21240131"]),
        ("ABCDE12345 ABCDE1,234,567 x12345 12345", ["12345"]),
        ("1,23 1,2345 12,34567", ["34567"]),
        ("123,456.78 98765.", ["98765"]),
        (" ".join(str(10000 + i) for i in range(12)), [str(10000 + i) for i in range(8)]),
        ("", []),
    ],
)
def test_number_digits(query, want):
    assert tx.number_digits(query) == want


def snapshot(spark, facts=(), pin=None):
    claims = spark.createDataFrame([(f"c{q}", q, s, k, v, p) for q, s, k, v, p in facts], "id string, seq long, subject string, key string, value string, scope_path string")
    anchors = spark.createDataFrame([("h.e", "green")], "detail_key string, locked_value string")
    promises = spark.createDataFrame([("p1", 3, "open", "reveal", "who", "ch3"), ("p2", 1, "open", "storm", "rain", None), ("p3", 2, "fulfilled", "x", "y", "z")], "id string, seq long, status string, key string, description string, due_scope string")
    counters = spark.createDataFrame([("bell", 1, 2)], "key string, count long, budget long")
    return ledger.Snapshot(claims, anchors, promises, counters, ledger.ladder(claims), pin)


FACTS = [(1, "h", "a", "1", "x.one"), (2, "h", "b", "2", "x.two"), (3, "h", "c", "3", "y.one"), (4, "h", "d", "4", "y.one")]
TAIL = "## Locked details\nh.e=green [locked]\n\n## Open promises\n[storm] rain\n[reveal] who (due: ch3)\n\n## Frequency budgets\nbell: used 1/2\nCAUTION: 'bell' — one use remaining"


def test_contexts_have_six_sections_and_four_levels(spark):
    text = lambda *a, **k: context.render(context.compose_context(snapshot(spark, FACTS, k.pop("pin", None)), *a, **k)).first().text
    facts = "## Accepted facts\nh.a=1\nh.b=2\nh.c=3\nh.d=4\n\n" + TAIL
    scopes = "## Canon digest\n[x.one] 1 facts\nh.a=1\n[x.two] 1 facts\nh.b=2\n[y.one] 2 facts\nh.c=3\nh.d=4\n\n"
    active = "## Canon digest\n[x.one] 1 facts\nh.a=1\n[x.two] 1 facts\nh.b=2\n[group y] 2 facts across 1 scopes; keys: h.c, h.d\n\n"
    groups = "## Canon digest\n[group x] 2 facts across 2 scopes; keys: h.a, h.b\n[group y] 2 facts across 1 scopes; keys: h.c, h.d\n\n"
    rollup = "## Canon digest\n[rollup] 4 facts, 3 scopes, 1 subjects: h\n\n"
    assert text() == scopes + facts
    pin = "## Point-in-time pin\nThis brief reflects the ledger as of seq 9 (as of 2020-01-01). Later facts are not visible.\n\n"
    assert text(pin=9, as_of_date="2020-01-01") == pin + scopes + facts
    size = lambda t: len(t.encode()) // 4
    assert size(rollup + facts) < size(scopes + facts) < size(active + facts) < size(groups + facts)
    for budget in range(size(rollup + facts) - 12, size(groups + facts) + 2):
        want = next((t for t in (scopes + facts, active + facts, groups + facts, rollup + facts) if size(t) <= budget), None)
        if want is None:
            for keep in (3, 2, 1, 0):
                kept = "## Accepted facts\n" + "\n".join(f"h.{'abcd'[i]}={i + 1}" for i in range(4 - keep, 4)) + "\n\n" if keep else ""
                want = rollup + kept + TAIL
                if size(want) <= budget:
                    break
        assert text("x.two", budget) == want, budget


def test_an_empty_ledger_has_a_context(spark):
    assert context.render(context.compose_context(snapshot(spark), None, 1)).first().text == "## Canon digest\n[rollup] 0 facts, 0 scopes, 0 subjects: \n\n" + TAIL


def test_corpus_versions_and_identity(spark):
    p = spark.createDataFrame([("c", "v1")], "collection string, version_id string")
    assert [r.version_id for r in corpus.activate(p, "c", "v2", expected="v1").collect()] == ["v2"]
    with pytest.raises(ValueError):
        corpus.activate(p, "c", "v2", expected="v0")
    numbers = corpus.number_lexemes(spark.createDataFrame([("ab12345 12345 1234 abcde12345",)], "text string"))
    assert sorted((r.digits, r.lexeme) for r in numbers.collect()) == [("12345", "ab12345")]
