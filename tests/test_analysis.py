import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.analyzer import analyze, stem, tokens
from corvane.functions.canonical import canonical_json
from corvane.functions.vectors import blend, local_embed, nearest, nearest_of
from corvane.operators import fusion, orchestration, retrieval
from corvane.operators.access import Principal
from corvane.operators.index import build_collection_index, open_index, write_search_index
from corvane.operators.retrieval import RetrievalSpec


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CVE-2025-31337", ["CVE", "-2025", "-31337"]),
        ("07/638,337", ["07/638", "337"]),
        ("900000.50 vs 900000.5", ["900000.50", "vs", "900000.5"]),
        ("1.2e-9 at 198.51.100.140", ["1.2e-9", "at", "198.51.100.140"]),
        ("v4.2.1 manifest.json", ["v4.2.1", "manifest", "json"]),
        ("well-established", ["well-established", "well", "established"]),
        ("ABC-1234-XY", ["ABC", "-1234", "XY"]),
        ("US7654321B2 rc2 45eagles", ["US7654321B2", "rc2", "45eagles"]),
        ("+3.5%", ["+3.5"]),
        ("über_straße", ["über", "straße"]),
    ],
)
def test_structured_tokens(text, want):
    assert tokens(text) == want


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("consigned", "consign"), ("consistency", "consist"), ("knackeries", "knackeri"), ("kneeling", "kneel"), ("caresses", "caress"),
        ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"),
        ("relational", "relat"), ("national", "nation"), ("generously", "generous"), ("communism", "communism"), ("happy", "happi"), ("say", "say"),
        ("skies", "sky"), ("news", "news"), ("succeeding", "succeed"), ("electricity", "electr"), ("adjustment", "adjust"), ("controlling", "control"),
        ("at", "at"), ("by", "by"), ("archaeology", "archaeolog"), ("hopefulness", "hope"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def test_analysis_drops_stop_words_and_spares_numbers():
    assert analyze("The running Ecf8427e of 12 dogs") == ["run", "ecf8427e", "12", "dog"]
    assert analyze("x" * 300) == []


def test_canonical_json():
    assert canonical_json({"b": [1, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[1,null,true]}'
    for bad in ({"x": 1.5}, {"x": 2**63}):
        with pytest.raises(ValueError):
            canonical_json(bad)


def test_locations_stop_after_a_miss():
    assert orchestration.chunk_locations("aa\n\nbb\n\n\n\ncc", 100) == [None]
    assert orchestration.chunk_locations("aaa\n\nbbb", 3) == [(0, 3), (5, 3)]


def test_bootstrap_and_lint():
    assert orchestration.paired_bootstrap([1, 1, 1], [0, 0, 0], 100) == (1.0, 1.0, 1.0)
    assert orchestration.paired_bootstrap([], []) == (0.0, 0.0, 0.0)
    bad = {"steps": ["cutover", "verify", "dance"], "retrieval": {"minimumShouldMatch": 3, "queryExpansions": [{"whenAny": []}]}}
    assert orchestration.runbook_problems(bad) == ["step.unknown:dance", "cutover.unverified", "retrieval.minimum-should-match", "retrieval.empty-expansion"]


CHUNKS = "collection string, chunk_id string, text string"


def indexed(spark, tmp_path, texts):
    return write_search_index(spark.createDataFrame(texts, CHUNKS), str(tmp_path / "index"), buckets=4, splits=2)


def test_postings_of_odd_chunks(spark, tmp_path):
    """Ids with any characters, null collections and ids, repeated rows and empty texts; a row of postings holds many chunks."""
    texts = [("a", "50%", "red fox red"), ("a", "x\0y", "red"), (None, "%00", "fox"), ("b", "n", ""), ("b", "r", "red"), ("b", "r", "red"), ("b", None, "owl"), ("b", "%", None)]
    index = write_search_index(spark.createDataFrame(texts, CHUNKS).coalesce(1), str(tmp_path / "odd"), buckets=2, splits=2)
    got = {(r.lexeme, r.collection, r.chunk_id, r.tf, r.dl) for r in index.postings(["red", "fox", "owl"]).collect()}
    once = {("red", "a", "50%", 2, 3), ("fox", "a", "50%", 1, 3), ("red", "a", "x\0y", 1, 1), ("fox", None, "%00", 1, 1), ("owl", "b", None, 1, 1)}
    assert got == once | {("red", "b", "r", 2, 1)}
    assert index.frequency(["red", "fox"]) == {"red": 3, "fox": 2}
    many = write_search_index(spark.createDataFrame([("a", f"c{i}", "red fox") for i in range(500)], CHUNKS).coalesce(1), str(tmp_path / "many"))
    assert many.part("postings").count() == 2 and many.postings(["red"]).count() == 500


def test_index_scores_like_a_scan(spark, tmp_path):
    texts = [("a", "a1", "red fox jumps"), ("a", "a2", "Red red car"), ("b", "b1", "blue sky over the red sea and sea"), ("b", "b2", ""), ("b", "b3", None)]
    index = indexed(spark, tmp_path, texts)
    plain = spark.createDataFrame([t for t in texts if t[2] is not None], CHUNKS)
    scan = {r.chunk_id: r.score for r in retrieval.bm25(plain.unionByName(plain.limit(0)), ["red", "sea"]).collect()}
    n, avgdl = index.size()
    assert (n, round(avgdl * n)) == (5, 14) and index.frequency(["red", "sea", "none"]) == {"red": 3, "sea": 1}
    assert index.common(["red", "sea"], 0.5) == ["red"] and index.common(["red"], 0.5, ["a"]) == ["red"]
    got = {r.chunk_id: r.score for r in index.bm25(["red", "sea"]).collect()}
    assert got.keys() == scan.keys() == {"a1", "a2", "b1"} and max(got, key=got.get) == max(scan, key=scan.get)
    assert [r.chunk_id for r in index.bm25(["red", "sea"], least=2).collect()] == ["b1"]
    assert {r.chunk_id for r in index.bm25(["red", "sea"], collections=["a"]).collect()} == {"a1", "a2"}
    assert index.bm25(["none"]).count() == index.bm25([]).count() == 0
    mixed = {w: {r.chunk_id: r.score for r in index.bm25(["red"], ["sea"], w).collect()} for w in (0.0, 0.25, 1.0)}
    own, whole = mixed[0.0]["b1"], mixed[1.0]["b1"]
    assert own < mixed[0.25]["b1"] < whole and math.isclose(mixed[0.25]["b1"], 0.75 * own + 0.25 * whole) and math.isclose(whole, got["b1"])
    # what is common may count without being asked for
    assert {r.chunk_id for r in index.bm25(["red", "sea"], candidates=["sea"], least=2).collect()} == {"b1"}


def test_index_is_replaced_and_reopened(spark, tmp_path):
    indexed(spark, tmp_path, [("a", "a1", "red")])
    again = indexed(spark, tmp_path, [("a", "a2", "blue"), ("a", "a3", "blue")])
    assert {r.chunk_id for r in again.bm25(["blue"]).collect()} == {"a2", "a3"} and again.bm25(["red"]).count() == 0
    assert open_index(spark, str(tmp_path / "index")).size() == (2, 1.0) and open_index(spark, str(tmp_path / "none")) is None
    sources = spark.createDataFrame([("c", "s1", "h1", "one two\n\nthree"), ("c", "s2", "h2", None)], "collection string, source_id string, content_hash string, text string")
    version, first = build_collection_index(sources, str(tmp_path / "built"), "doc@1", "para@2", "hash@1", "text@1", max_bytes=8)
    assert version.startswith("idx-") and sorted(r.chunk_id for r in first.chunks().collect()) == ["s1#0", "s1#1"]
    same, _ = build_collection_index(sources.repartition(2), str(tmp_path / "built"), "doc@1", "para@2", "hash@1", "text@1", max_bytes=8)
    other, _ = build_collection_index(sources.withColumn("content_hash", F.lit("x")), str(tmp_path / "built"), "doc@1", "para@2", "hash@1", "text@1")
    assert same == version != other


def test_retrieval_over_collections_is_its_parts(spark, tmp_path):
    index = indexed(spark, tmp_path, [("a", "a1", "red fox"), ("a", "a2", "red car red"), ("b", "b1", "red sea"), ("c", "c1", "nothing")])
    spec = RetrievalSpec(max_collections=1, unselected_pool_weight=0.5, top_k=10)
    got = {r.chunk_id: round(r.score, 9) for r in orchestration.retrieve_documents(index, "red fox", spec).collect()}
    lex = index.bm25(["red", "fox"]).withColumnRenamed("collection", "pool").withColumn("is_probe", F.col("pool") != "a")
    vec = retrieval.vector_leg(index, local_embed("red fox")).withColumnRenamed("collection", "pool").withColumn("is_probe", F.col("pool") != "a")
    want = {r.chunk_id: round(r.score, 9) for r in fusion.fuse_pools(lex, vec, unselected_weight=0.5).collect()}
    assert got == want and max(got, key=got.get) == "a1"
    assert {r.collection for r in orchestration.retrieve_documents(index, "red fox", spec, ["b", "c"]).collect()} == {"b", "c"}
    every = replace(spec, max_collections=0)
    assert len(orchestration.retrieve_documents(index, "red fox", every).collect()) == 4


def test_phrases_choose_the_collection(spark, tmp_path):
    texts = [("a", f"a{i}", "washington washington george tour tour") for i in range(4)] + [("b", f"b{i}", "george washington") for i in range(4)]
    index = indexed(spark, tmp_path, texts)
    spec = RetrievalSpec(max_collections=1, vector_weight=0.0, unselected_pool_weight=0.0, top_k=1)
    chosen = lambda boost: orchestration.retrieve_documents(index, "tour of george washington", replace(spec, phrase_boost=boost)).first().collection
    assert (chosen(0.0), chosen(9.0)) == ("a", "b")
    both = orchestration._pools(index, retrieval.prepare(index, "george washington", spec), spec, 10, None)
    share = {r.pool: r.phrase_fraction for r in orchestration.phrase_fraction(index, *both, "george washington", 10).collect()}
    assert share == {"a": 0.0, "b": 1.0}


def test_searches_use_all_of_the_spec(spark, tmp_path):
    texts = [("a", "a1", "patent us4436097 of a pump"), ("a", "a2", "a pump in the patent"), ("b", "b1", "license pump and valve"), ("b", "b2", "pump")]
    index = indexed(spark, tmp_path, texts)
    asked = retrieval.prepare(index, "pump 4,436,097", RetrievalSpec())
    assert asked.original == ["pump", "4", "436", "097", "us4436097"] and asked.candidates == asked.original
    assert retrieval.prepare(index, "pump patent valve", RetrievalSpec(stop_term_fraction=0.5)).candidates == ["patent", "valve"]
    assert retrieval.prepare(index, "pump", RetrievalSpec(stop_term_fraction=0.5)).candidates == ["pump"]  # nothing else is left
    widened = RetrievalSpec(query_expansions=[(["valve"], ["Pump", "tap"])], query_expansion_weight=0.5)
    asked = retrieval.prepare(index, "valve", widened)
    assert (asked.original, asked.expanded) == (["valve"], ["pump", "tap"])
    assert np.allclose(asked.vector, blend(local_embed("valve"), local_embed("valve pump tap"), 0.5))
    assert np.allclose(retrieval.prepare(index, "valve", replace(widened, query_expansion_weight=0.0)).vector, local_embed("valve"))
    lexical_only = RetrievalSpec(vector_weight=0.0)
    assert orchestration.retrieve_documents(index, "4,436,097", lexical_only).first().chunk_id == "a1"
    rules = RetrievalSpec(content_demotions=[retrieval.Demotion("license", 0.5, 0.25)])
    score = lambda leg: {r.chunk_id: r.score for r in leg.collect()}
    plain = score(retrieval.vector_leg(index, [1.0] * 256))
    demoted = score(retrieval.penalised(index, retrieval.vector_leg(index, [1.0] * 256), rules))
    assert {k: round(demoted[k] - plain[k], 9) for k in plain} == {"a1": 0, "a2": 0, "b1": 0.25, "b2": 0}
    asked = retrieval.prepare(index, "pump", rules)
    plain, demoted = score(retrieval.lexical_leg(index, asked, RetrievalSpec())), score(retrieval.lexical_leg(index, asked, rules))
    assert {k: round(demoted[k] / plain[k], 9) for k in plain} == {"a1": 1, "a2": 1, "b1": 0.5, "b2": 1}


def test_vocabulary_search_leaves_the_spec_alone(spark, tmp_path):
    index = indexed(spark, tmp_path, [("a", "a1", "a moron"), ("a", "a2", "wise")])
    spec = RetrievalSpec(vector_weight=0.0)
    assert orchestration.vocabulary_search(index, "fool", [["fool", "moron"]], spec).first().chunk_id == "a1"
    assert spec.query_expansions == ()


def test_queries_in_blocks_are_the_same(spark):
    rows = [(i, [float((i * 7) % 5 - 2), float((i * 3) % 7 - 3), 1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = sorted(nearest(v, rows[:7], 3).collect())
    assert sorted(nearest_of(v, v.where("vec_id < 7"), 3, block=2).collect()) == want
    assert nearest_of(v, v.where("vec_id < 0"), 3).count() == 0


def test_bindings_move_only_from_what_was_expected(spark):
    b = spark.createDataFrame([("x", "a1", "serving")], "name string, artifact string, state string")
    assert [r.artifact for r in orchestration.publish_if(b, "x", "a2", "a1").collect()] == ["a2"]
    with pytest.raises(ValueError):
        orchestration.publish_if(b, "x", "a2", "a0")


def test_a_source_in_two_collections_is_two_chunks(spark, tmp_path):
    index = indexed(spark, tmp_path, [("a", "s#0", "red fox"), ("b", "s#0", "red fox"), ("b", "t#0", "blue sea")])
    found = retrieval.hybrid_search(index, "red fox").collect()
    assert sorted((r.collection, r.chunk_id) for r in found) == [("a", "s#0"), ("b", "s#0"), ("b", "t#0")]
    assert {(r.collection, r.lexical_rank) for r in found if r.chunk_id == "s#0"} == {("a", 1), ("b", 2)}


def test_governed_queries(spark, tmp_path):
    odd = "dir/a,b.txt#0"
    index = indexed(spark, tmp_path, [("a", odd, "red fox"), ("b", odd, "red fox runs"), ("b", "t#0", "red sea")])
    governed = spark.createDataFrame([("a", odd, "one"), ("b", odd, "two"), ("b", "t#0", "three")], "collection string, chunk_id string, document_id string").withColumns(
        {"level": F.lit(0), "compartments": F.expr("cast(array() as array<string>)")}
    )
    kind = "id string, document_id string, collection string, effective_from date, effective_until date, published_at long, state string"
    publish = lambda *rows: spark.createDataFrame([(f"p{i}", d, c, None, None, n, "published") for i, (d, c, n) in enumerate(rows)], kind).withColumn("effective_from", F.to_date(F.lit("2024-01-01")))
    relations = spark.createDataFrame([], "from_document string, to_document string, kind string, effective_from date, effective_until date")
    clear = publish(("one", "law", 1), ("two", "law", 1), ("three", "other", 1))
    ask = lambda pubs, **more: sorted((r.collection, r.chunk_id) for r in orchestration.governed_query(index, governed, pubs, relations, Principal(1), "2025-01-01", "red fox", 100, **more).collect())
    assert ask(clear) == [("a", odd), ("b", odd), ("b", "t#0")]
    # two publications of one document at once: which of them governs isn't decided, so nothing is answered
    unclear = publish(("one", "law", 1), ("one", "law", 1), ("two", "law", 1), ("three", "other", 1))
    assert ask(unclear) == []
    other = spark.createDataFrame([("other",)], "collection string")
    assert ask(unclear, policies=other) == [("b", "t#0")]
