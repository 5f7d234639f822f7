"""Sources: objects, text extraction by media type, sealed tables, and sinks."""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.evidence import Manifest

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class ObjectStore:
    """Single objects under a folder of any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _at(self, name: str):
        if ".." in name.split("/") or name.startswith("/"):
            raise ValueError(f"a name that leaves the store: {name!r}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, name: str, content: bytes) -> None:
        path, fs = self._at(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def get(self, name: str) -> bytes | None:
        path, fs = self._at(name)
        if not fs.exists(path):
            return None
        found = self.spark.read.format("binaryFile").load(path.toString()).select("content").first()
        return bytes(found.content) if found else b""  # the reader gives no row for an empty file

    def exists(self, name: str) -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def delete(self, name: str) -> bool:
        path, fs = self._at(name)
        return fs.delete(path, False)


class Breaker:
    """Stops asking a connector that failed ``limit`` times in a row, until ``rest`` seconds have gone by."""

    def __init__(self, limit: int = 3, rest: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.limit, self.rest, self.clock = limit, rest, clock
        self.failures, self.opened = 0, 0.0

    def call(self, ask: Callable[[], DataFrame]) -> DataFrame:
        if self.failures >= self.limit and self.clock() - self.opened < self.rest:
            raise RuntimeError("the connector is resting after repeated failures")
        try:
            found = ask()
        except Exception:
            self.failures, self.opened = self.failures + 1, self.clock()
            raise
        self.failures = 0
        return found


def connector_rows(spark: SparkSession, manifest: Manifest, breaker: Breaker, format: str, **options: str) -> DataFrame:
    """Rows of an outside source (``jdbc``, ``parquet`` or another reader of Spark's) in the shape of a manifest.

    Columns are those of the manifest, cast to its types; one that the source lacks is a failure.
    """

    def ask() -> DataFrame:
        rows = spark.read.format(format).options(**options).load()
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in manifest.schema().fields))

    return breaker.call(ask)


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, media_type, content, content_hash`` of every file; any store that Spark can list."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    media = (
        F.when(ending.isin("txt", "text", "log"), "text/plain")
        .when(ending.isin("md", "markdown"), "text/markdown")
        .when(ending.isin("html", "htm"), "text/html")
        .when(ending == "csv", "text/csv")
        .when(ending == "json", "application/json")
        .when(ending == "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .when(ending == "pdf", "application/pdf")
        .otherwise("application/octet-stream")
    )
    return files.select("path", media.alias("media_type"), "content", F.sha2("content", 256).alias("content_hash"))


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word document, one to a block."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for node in p.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag == f"{_W}tab":
                parts.append("\t")
            elif node.tag == f"{_W}br":
                parts.append("\n")
        if text := "".join(parts).strip():
            paragraphs.append(text)
    return "\n\n".join(paragraphs)


_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_PDF_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*Tj|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|\bTd\b|\bTD\b|\bET\b", re.S)
_PDF_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)


def pdf_text(content: bytes) -> str:
    """Text that a PDF shows with simple fonts. Scans and encoded fonts give nothing and need OCR."""
    import zlib

    out = []
    for m in _PDF_STREAM.finditer(content):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        line: list[str] = []
        for show in _PDF_SHOW.finditer(data):
            strings = _PDF_STRING.findall(show[0])
            if not strings:
                line.append("\n")
            for s in strings:
                line.append(re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1"))
        if text := re.sub(r"\n+", "\n", "".join(line)).strip():
            out.append(text)
    return "\n\n".join(out)


def extract(objects: DataFrame) -> DataFrame:
    """``path, text, status, method`` per object: ``ok``, ``empty`` (only white space) or ``failed``.

    Texts are decoded by the engine; documents in containers are parsed in Arrow batches.
    """
    plain = F.col("media_type").startswith("text/") | (F.col("media_type") == "application/json")
    texts = objects.where(plain & (F.col("media_type") != "text/html")).select(
        "path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.lit("text").alias("method")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, methods = [], []
            for media, content in zip(b.column("media_type").to_pylist(), b.column("content").to_pylist(), strict=True):
                method = "docx" if media.endswith("wordprocessingml.document") else "pdf-text" if media == "application/pdf" else "html"
                try:
                    if method == "html":
                        from html.parser import HTMLParser

                        parts: list[str] = []
                        parser = HTMLParser()
                        parser.handle_data = parts.append
                        parser.feed(re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", content.decode("utf-8")))
                        text = " ".join(" ".join(parts).split())
                    else:
                        text = docx_text(content) if method == "docx" else pdf_text(content)
                except Exception:  # any broken container is a failed extraction of that one object
                    text = None
                texts.append(text)
                methods.append(method)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), pa.array(methods, pa.string())], ["path", "text", "method"])

    parsed = objects.where(
        (F.col("media_type") == "text/html") | F.col("media_type").isin("application/pdf") | F.col("media_type").endswith("wordprocessingml.document")
    ).select("path", "media_type", "content").mapInArrow(run, "path string, text string, method string")
    refused = objects.where(F.col("media_type") == "application/octet-stream").select("path", F.lit(None).cast("string").alias("text"), F.lit("none").alias("method"))
    every = texts.unionByName(parsed).unionByName(refused)
    status = F.when(F.col("text").isNull(), "failed").when(F.regexp_like("text", F.lit(r"\S")), "ok").otherwise("empty")
    return every.withColumn("status", status)


def read_evidence_csv(spark: SparkSession, path: str | Sequence[str], manifest: Manifest) -> DataFrame:
    """A canonical CSV: its header is skipped, for the manifest names and types the columns."""
    return (
        spark.read.schema(manifest.schema()).option("header", "true").option("enforceSchema", "true").option("quote", '"').option("escape", '"')
        .option("mode", "FAILFAST").option("nullValue", "\x00").csv(path)
    )


def read_evidence_parquet(spark: SparkSession, path: str, manifest: Manifest) -> DataFrame:
    return spark.read.schema(manifest.schema()).parquet(path)


def append_interactions(rows: DataFrame, path: str) -> None:
    """Adds a batch to the log, a folder a day."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
