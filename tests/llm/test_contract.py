"""The registered queries: columns and types as agreed, and their digests against plain Python."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
COLUMNS = {
    "op1_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op2_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op5_pii": {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")}, "base_sha256": "string", "spans": "string"},
    "op6_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_ngram_jaccard": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op12_pitman_yor": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op13_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    out = entry.queries()[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {k: kinds.get(k) for k in COLUMNS[name]} == COLUMNS[name]
    key = next(k for k in ("page_id", "vec_id", "doc_id") if k in kinds)
    table = {"page_id": "pages", "vec_id": "embeddings", "doc_id": "documents"}[key]
    ids = Counter(r[0] for r in out.select(key).collect())
    assert set(ids) == {r[key] for r in rows(table)}
    if name != "op6_packing":
        assert set(ids.values()) == {1}


def test_collocation_columns(spark):
    out = entry.queries()["op11_collocations"](spark, SF)
    assert dict(out.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", **{k: "bigint" for k in ("a", "l", "r", "n", "score")}}
    rows = out.collect()
    assert rows and all(r.a >= 30 and 2 <= len(r.phrase.split(" ")) <= 4 for r in rows)


def test_held_out_rows(spark):
    for name, m, r in (("op8_toxicity", 3, 1), ("op9_quality", 4, 2)):
        for x in entry.queries()[name](spark, SF).collect():
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % m == r)
            assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7)


def test_personal_data_digest(spark):
    text = {r["doc_id"]: r["text"] or "" for r in rows("documents")}
    for r in entry.queries()["op5_pii"](spark, SF).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text[r.doc_id])]
        assert [(int(a), int(b)) for k, a, b in spans if k == "email"][: len(emails)] == emails and r.n_email == len(emails)
        if len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone:
            assert hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256


def test_shards_by_plain_python(spark):
    docs = rows("documents")
    keys = spark.createDataFrame([(d["doc_id"],) for d in docs], "doc_id long")
    order = {r.doc_id: r.h for r in keys.withColumn("h", F.xxhash64(F.lit(17), "doc_id", F.lit("order"))).collect()}
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d["doc_id"])
    sources = spark.createDataFrame([(s,) for s in by], "s string")
    drawn = F.pmod(F.xxhash64(F.lit(17), F.concat(F.lit("s"), "s"), F.lit("offset")), F.lit(1 << 52))
    u = {r.s: (r.u + 0.5) / (1 << 52) for r in sources.withColumn("u", drawn).collect()}
    # buckets are of 24 bits below the top ones of the unsigned hash
    place = lambda i: ((order[i] % 2**64) >> 40) % 32
    fraction = {}
    for source, ids in by.items():
        for k, i in enumerate(sorted(ids, key=lambda i: (place(i), order[i], i)), 1):
            fraction[i] = ((k - u[source]) / len(ids), order[i], f"s{source}", i)
    n = len(docs)
    want = {}
    for p, i in enumerate(sorted(fraction, key=fraction.get)):
        s = p * 16 // n
        want[i] = (s, p - -(-s * n // 16))
    text = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    for r in entry.queries()["op10_sharding"](spark, SF).collect():
        assert (r.shard, r.slot) == want[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "rows", None)


def test_stages_are_four_or_five_functions():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(callable(f) for _, f in corpus_pipeline.STAGES) and corpus_pipeline.ORACLE_SQL is None
