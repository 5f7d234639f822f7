import hashlib
import io
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import corpus, evidence
from corvane.operators.evidence import EvidenceColumn, Manifest
from corvane.sources import documents
from corvane.streaming import streams


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_extraction_by_media_type(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.md").write_text(" \n ")
    (tmp_path / "c.docx").write_bytes(docx("one", "two"))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Hello) Tj T* (World) Tj ET\nendstream")
    (tmp_path / "f.bin").write_bytes(b"\x00\x01")
    (tmp_path / "g.html").write_text("<p>Hi<script>x()</script> there")
    by = {r.path.rsplit("/", 1)[1]: (r.status, r.text) for r in documents.extract(documents.read_objects(spark, str(tmp_path))).collect()}
    assert len(by) == 7
    assert by["a.txt"] == ("ok", "héllo")
    assert by["b.md"][0] == "empty"
    assert by["c.docx"] == ("ok", "one\n\ntwo")
    assert by["d.docx"] == ("failed", None)
    assert by["e.pdf"] == ("ok", "Hello\nWorld")
    assert by["f.bin"] == ("failed", None)
    assert by["g.html"] == ("ok", "Hi there")


def test_evidence_csv_takes_the_manifest(spark, tmp_path):
    (tmp_path / "t.csv").write_text('x,y\n1,"a ""q"", b"\n2,c\n')
    m = Manifest("m", [EvidenceColumn("k", "int64"), EvidenceColumn("s", "string")])
    assert [tuple(r) for r in documents.read_evidence_csv(spark, str(tmp_path / "t.csv"), m).collect()] == [(1, 'a "q", b'), (2, "c")]


@pytest.fixture
def log(spark, tmp_path):
    rows = [("b", "r1", "reserve", 10, "2024-01-01 00:00:00"), ("b", "r2", "reserve", 5, "2024-01-01 00:01:00"), ("b", "r1", "settle", 0, "2024-01-01 00:02:00"), ("b", "r2", "release", 0, "2024-01-01 00:03:00"), ("b", "r9", "settle", 1, "2024-01-01 00:04:00")]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["budget", "id", "event", "units", "created_at"])).withColumn("created_at", F.col("created_at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    return streams.read_log(spark, str(tmp_path / "log"), df.schema)


def test_reservations_equal_a_loop(log, tmp_path):
    out = streams.run_available(streams.reservations(log), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [(r.id, r.event, r.held, r.settled) for r in out] == [("r1", "reserve", 10, 0), ("r2", "reserve", 15, 0), ("r1", "settle", 5, 10), ("r2", "release", 0, 10)]


def test_object_store(spark, tmp_path):
    store = documents.ObjectStore(spark, f"file://{tmp_path}/o")
    assert store.get("a/b.txt") is None and not store.exists("a/b.txt") and not store.delete("a/b.txt")
    for content in (b"one\x00\xff", b"", b"two"):
        store.put("a/b.txt", content)
        assert store.get("a/b.txt") == content and store.exists("a/b.txt")
    assert store.delete("a/b.txt") and not store.exists("a/b.txt")
    with pytest.raises(ValueError):
        store.put("../x", b"")


def test_connector_rests_after_failures(spark, tmp_path):
    now = [0.0]
    breaker = documents.Breaker(2, 10, lambda: now[0])
    m = Manifest("m", [EvidenceColumn("k", "int64", key=True, nullable=False), EvidenceColumn("v", "decimal", scale=2)])
    ask = lambda path: documents.connector_rows(spark, m, breaker, "parquet", path=path)
    good = f"{tmp_path}/good"
    spark.createDataFrame([(1, 2.5, "more")], "k int, v double, x string").write.parquet(good)
    assert [tuple(map(str, r)) for r in ask(good).collect()] == [("1", "2.50")]
    for _ in range(2):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            ask(f"{tmp_path}/none")
    with pytest.raises(RuntimeError, match="resting"):
        ask(good)
    now[0] = 11.0
    assert ask(good).count() == 1


def test_declared_hashes_are_verified(spark):
    good = hashlib.sha256(b"x").hexdigest()
    rows = spark.createDataFrame([("a", bytearray(b"x"), good.upper()), ("b", bytearray(b"y"), good), ("c", None, good), ("d", bytearray(b"x"), None)], "path string, content binary, declared_sha256 string")
    taken, refused = corpus.verified(rows)
    assert [r.path for r in taken.collect()] == ["a"] and sorted(r.path for r in refused.collect()) == ["b", "c", "d"]


def test_sealed_tables_are_checked_when_opened(spark, tmp_path):
    m = Manifest("m", [EvidenceColumn("k", "int64", key=True, nullable=False)])
    sealed = evidence.seal(spark.range(5).withColumnRenamed("id", "k"), m, f"{tmp_path}/t")
    assert evidence.hydrate(spark, sealed, f"{tmp_path}/t").count() == 5
    spark.range(9).withColumnRenamed("id", "k").write.mode("overwrite").parquet(f"{tmp_path}/t/data")
    with pytest.raises(ValueError, match="quarantine"):
        evidence.hydrate(spark, sealed, f"{tmp_path}/t")
    assert (tmp_path / "t.quarantine").exists() and not (tmp_path / "t").exists()


def test_only_whole_indexes_are_exported(spark):
    rows = lambda *v: spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(v)], "chunk_id string, embedding array<float>")
    assert corpus.exportable(rows([1.0], [2.0])) == 2 and corpus.exportable(rows(None, None)) == 2
    for bad in (rows(), rows([1.0], None)):
        with pytest.raises(ValueError):
            corpus.exportable(bad)


def test_index_versions_are_replaced_not_doubled(spark, tmp_path):
    chunks = spark.createDataFrame([("c", "s", "s#0", "t")], "collection string, source_id string, chunk_id string, text string")
    for version in ("v1", "v1", "v2"):
        corpus.write_index(chunks, f"{tmp_path}/i", version)
    assert sorted(r.index_version for r in spark.read.parquet(f"{tmp_path}/i").collect()) == ["v1", "v2"]


def test_streams_tell_their_progress(spark, tmp_path):
    told = []
    listener = streams.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        spark.range(10).write.parquet(f"{tmp_path}/log")
        out = streams.run_available(streams.read_log(spark, f"{tmp_path}/log", "id long", 100), f"{tmp_path}/out", f"{tmp_path}/state")
        assert out.count() == 10
        for _ in range(50):
            if any(e["event"] == "ended" for e in told):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [e["event"] for e in told][0] == "started" and sum(e.get("rows", 0) for e in told) == 10 and told[-1]["event"] == "ended"
