"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing. A page becomes a response record whose HTTP body is in chunked transfer framing, or a
revisit record where an equal payload is archived already. A block longer than
``segment_bytes`` is cut into a first record and continuations. Each record is one row of the
text sink whose line separator is the blank line that ends a WARC record, so Spark's own
committer writes the archives: gzip files of at most ``records_per_file`` records.

Equal payloads are found by their digests: only rows whose digest a bitmap of repeated ones may hold are
looked up and shuffled.

Reading. Each archive is parsed as a stream of records. Continuations are grouped by the id of
the record they continue, ordered by segment number, checked for gaps and against the total
length, and joined; then the HTTP headers come off and the chunked framing is decoded. Records
in one piece are never shuffled. Revisits are resolved against the response they refer to. What can't be read
becomes a row with a reason, and reading goes on.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Sketch, materialise, small_batches

CRLF = b"\r\n"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def encode_chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing: hexadecimal length, data, and a last chunk of length 0."""
    out = []
    for i in range(0, len(body), size):
        part = body[i : i + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def decode_chunked(framed: bytes) -> bytes:
    """Undoes :func:`encode_chunked`; extensions and trailers are skipped. Broken framing raises."""
    out, pos = [], 0
    while True:
        end = framed.find(CRLF, pos)
        if end < 0:
            raise ValueError("chunked framing ends early")
        n = int(framed[pos:end].split(b";", 1)[0].strip(), 16)
        pos = end + 2
        if n == 0:
            return b"".join(out)
        if len(framed) < pos + n + 2 or framed[pos + n : pos + n + 2] != CRLF:
            raise ValueError("a chunk isn't as long as it says")
        out.append(framed[pos : pos + n])
        pos += n + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the blank lines that end it."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block


class Gunzipped(io.RawIOBase):
    """The contents of a gzip file of any number of members, a piece at a time.

    What can't be decompressed ends the stream; ``fault`` then says why.
    """

    def __init__(self, content: bytes):
        self.content, self.at, self.rest = content, 0, b""
        self.member, self.fault = None, None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        out = b""
        while not out and self.fault is None:
            if not self.rest:  # small pieces, for what is left of one is copied at each member
                self.rest = self.content[self.at : self.at + 65_536]
                self.at += len(self.rest)
            ended = not self.rest
            if self.member is None:
                self.rest = self.rest.lstrip(b"\0")
                if ended:
                    return 0
                if not self.rest:
                    continue
                self.member = zlib.decompressobj(31)
            try:
                out = self.member.decompress(self.rest, len(buffer))
            except zlib.error as e:
                self.fault = f"the archive can't be read on: {e}"
                break
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, None
            else:
                self.rest = self.member.unconsumed_tail
                if ended and not out:
                    self.fault = "the archive ends within a gzip member"
        buffer[: len(out)] = out
        return len(out)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Headers (names in lower case), block and fault of each record; a fault is what isn't a record."""
    line = archive.readline()
    while line:
        if not line.strip():
            line = archive.readline()
            continue
        if not line.startswith(b"WARC/"):
            yield {}, b"", "no record where one should begin"
            while line and not line.startswith(b"WARC/"):
                line = archive.readline()
            continue
        headers: dict[str, str] = {}
        line = archive.readline()
        while line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
            line = archive.readline()
        stated = headers.get("content-length", "")
        if not stated.isdecimal():
            yield headers, b"", "no length"
        else:
            block = archive.read(int(stated))
            yield headers, block, None if len(block) == int(stated) else "the archive ends within the record"
        line = archive.readline()


def _urn(page: int | None, row: int) -> str:
    return f"<urn:corvane:page:{'' if page is None else page}:{row}>"


def page_records(page, url, row, body: bytes | None, size: int, digest: str, refers, segment: int, chunk: int) -> list[bytes]:
    """The records of one page; ``refers`` is (page, row) of the response to refer to, if any."""
    uri = " ".join((url or "").split())
    me = _urn(page, row)
    common = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", me), ("WARC-Refers-To", _urn(*refers)), ("WARC-Profile", PROFILE)]
        return [record([*own, *common], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block += encode_chunked(body, chunk)
    own = [("WARC-Type", "response"), ("WARC-Record-ID", me)]
    if len(block) <= segment:
        return [record([*own, *common], block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([*own, *common, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", me[:-1] + f":{k}>"),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Segment-Origin-ID", me),
            ("WARC-Segment-Number", str(k)),
        ]
        if k == len(parts):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(headers, part))
    return out


def write_archives(
    pages: DataFrame,
    path: str,
    revisit_bytes: int = 1000,
    segment_bytes: int = 16_384,
    chunk_bytes: int = 4096,
    records_per_file: int = 1024,
) -> None:
    """Writes an archive record for each row of ``pages`` (``page_id``, ``url``, ``html``) under ``path``.

    Null html is an empty payload. Of rows with equal payloads of at least ``revisit_bytes`` the
    one with the largest ``page_id`` is the response (of rows that repeat that id, the first);
    the others revisit it. Other columns are ignored. An empty table writes no record.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    # written once, so that a row has one number, whatever the table is read from
    rows = materialise(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.col("url").cast("string").alias("url"),
            body.alias("body"),
            F.sha1(body).alias("digest"),
            F.octet_length(body).alias("bytes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "pages",
    )
    best = materialise(
        rows.where(F.col("bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", (-F.col("row")).alias("r"))).alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("d2"), F.col("best.page_id").alias("to_page"), (-F.col("best.r")).alias("to_row")),
        "best",
    )
    may = (F.col("bytes") >= revisit_bytes) & F.col("__may")
    flagged = Sketch.sized(best.select(F.xxhash64("d2"))).flag(rows.withColumn("__h", F.xxhash64("digest")), "__h", "__may").drop("__h")
    looked_up = materialise(
        flagged.where(may)
        .select("page_id", "url", "row", "digest", "bytes")
        # dealt by another column: the join then shuffles both sides, and a hot payload can be split
        .join(best.repartition("to_row"), F.col("digest") == F.col("d2"), "left"),
        "looked-up",
    )
    # of the rows looked up only responses need their bodies
    stays = looked_up.where("to_row IS NULL OR to_row = row").select(F.col("row").alias("r2"))
    found = Sketch.sized(stays.select(F.xxhash64("r2"))).flag(flagged.where(may).withColumn("__h", F.xxhash64("row")), "__h", "__in").where("__in")
    none = F.lit(None).cast("long")
    names = ["page_id", "url", "row", "body", "digest", "bytes", "to_page", "to_row"]
    parts = (
        flagged.where(~may).withColumn("to_page", none).withColumn("to_row", none),
        found.join(stays, F.col("row") == F.col("r2"), "left_semi").withColumn("to_page", none).withColumn("to_row", none),
        looked_up.where("to_row <> row").withColumn("body", F.lit(None).cast("binary")),
    )
    dealt = reduce(DataFrame.unionByName, (p.select(*names) for p in parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for page, url, row, body, digest, size, to_page, to_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = None if to_row is None else (to_page, to_row)
                out += page_records(page, url, row, body, size, digest, refers, segment_bytes, chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (
        small_batches(dealt).mapInArrow(run, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


#: What a record of the archives gives; ``error`` says why one can't be used.
RECORD = {
    "type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "payload_digest": pa.string(), "refers_to": pa.string(),
    "origin_id": pa.string(), "segment": pa.int32(), "total_length": pa.int64(), "block": pa.binary(), "error": pa.string(),
}
#: What a whole record gives.
PAYLOAD = {
    "page_id": pa.int64(), "url": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "refers_to_id": pa.string(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "error": pa.string(),
}
_SQL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def _schema(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_SQL[t]}" for k, t in fields.items())


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), fields.values(), strict=True)], list(fields))


def _whole_number(text: str | None) -> int | None:
    return int(text) if text and text.isdecimal() else None


def _record_row(h: dict[str, str], block: bytes, fault: str | None) -> tuple:
    number, total = (_whole_number(h.get(f"warc-segment-{k}")) for k in ("number", "total-length"))
    if fault is None and "warc-segment-number" in h and not number:
        fault = "a segment number that is none"
    return (
        h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"),
        h.get("warc-segment-origin-id"), number, total, block, fault,
    )


def read_records(spark: SparkSession, path: str, glob: str = "*", batch_bytes: int = 4 << 20) -> DataFrame:
    """Every record of the archives under ``path``, as written, with a row for each fault.

    Any WARC writer's archives will do, gzipped as a whole or record by record, or not at all. An archive's compressed
    bytes are held in one task, of its contents one batch at a time. Files whose names begin with '_' or '.' are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, size = [], 0
                raw = Gunzipped(content) if content[:2] == b"\x1f\x8b" else None
                for h, block, fault in parse(io.BufferedReader(raw) if raw else io.BytesIO(content)):
                    rows.append(_record_row(h, block, fault))
                    size += len(block)
                    if size > batch_bytes:
                        yield _batch(rows, RECORD)
                        rows, size = [], 0
                if raw and raw.fault:
                    rows.append(_record_row({}, b"", raw.fault))
                if rows:
                    yield _batch(rows, RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")
    return files.mapInArrow(run, _schema(RECORD))


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: ``record_id, type, target_uri, payload_digest, refers_to, block, error``.

    Segments are grouped by the id of the record they belong to and joined in order. A missing or
    repeated segment, or a length other than the stated total, gives a row with that ``error`` and no block, and so
    do records that have an ``error`` already. Records that are no segments, with an id or without, repeated or
    not, go through one by one. No records give no rows.
    """
    names = ["type", "target_uri", "payload_digest", "refers_to"]
    single = F.col("segment").isNull() | F.col("error").isNotNull() | F.coalesce("origin_id", "record_id").isNull()
    block = F.when(F.col("error").isNull(), F.col("block")).alias("block")
    whole = records.where(single).select("record_id", *names, block, "error")
    segments = (
        records.where(~single)
        .withColumn("origin", F.coalesce("origin_id", "record_id"))
        .groupBy("origin")
        .agg(
            F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
            F.max("total_length").alias("total"),
            *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in names),
        )
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    fault = F.when(numbers != F.sequence(F.lit(1), F.size("parts")), "segments missing or repeated").when(
        length != F.coalesce("total", F.lit(-1)), "wrong total length"
    )
    # through hexadecimal text, whose pieces are joined all at once
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    return whole.unionByName(
        segments.withColumn("error", fault).select(
            F.col("origin").alias("record_id"), *names, F.when(F.col("error").isNull(), joined).alias("block"), "error"
        )
    )


def _page_of(urn: str | None) -> int | None:
    """The page of a record id that :func:`write_archives` made; others have none."""
    parts = (urn or "").strip("<>").split(":")
    page = parts[3] if parts[:3] == ["urn", "corvane", "page"] and len(parts) > 4 else ""
    return int(page) if page.removeprefix("-").isdecimal() else None


def _sha1(stated: str | None) -> str | None:
    """A stated digest as bare hexadecimal; null if none is stated, or by another algorithm."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 40:
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def _payload(kind: str | None, stated: str | None, block: bytes) -> tuple[int | None, str | None, bytes | None, str | None]:
    """Length, digest, payload and fault of a record's block."""
    body, headers = block, {}
    if block.startswith(b"HTTP/"):
        head, _, body = block.partition(CRLF + CRLF)
        for line in head.split(CRLF)[1:]:
            k, _, v = line.partition(b":")
            headers[k.strip().lower()] = v.strip().lower()
    if kind == "revisit":  # no payload of its own; what its headers say holds until it is resolved
        return _whole_number(headers.get(b"content-length", b"").decode("ascii", "replace")), _sha1(stated), None, None
    if headers.get(b"transfer-encoding") == b"chunked":
        try:
            body = decode_chunked(body)
        except ValueError as e:
            return None, None, None, str(e)
    digest = hashlib.sha1(body).hexdigest()
    if _sha1(stated) not in (None, digest):
        return None, None, None, "the payload doesn't match its digest"
    return len(body), digest, body, None


def payloads(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """``PAYLOAD`` per whole record, in any order.

    Payloads of responses are decoded, and their digest is checked against the record's if that states one. Other kinds
    of record have their block for payload. Revisits have none; length and digest are what they state.
    ``page_id`` and ``refers_to`` are null for records of other writers, whose ids stand beside them. A
    record that can't be decoded is a row with an ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for me, kind, uri, stated, refers, block, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, digest, body, fault = (None, None, None, error) if error else _payload(kind, stated, block or b"")
                to = refers if kind == "revisit" else None
                rows.append((_page_of(me), uri, me, kind, _page_of(to), to, size, digest, body if keep_payload else None, fault))
            if rows:
                yield _batch(rows, PAYLOAD)

    names = ("record_id", "type", "target_uri", "payload_digest", "refers_to", "block", "error")
    return small_batches(records).select(*names).mapInArrow(run, _schema(PAYLOAD))


def resolve(found: DataFrame) -> DataFrame:
    """Revisits with the length and digest of the response they refer to; one that refers to none has an ``error``.

    ``found`` is read twice. Of records that repeat an id any one answers for it.
    """
    revisits = found.where("record_type = 'revisit' AND error IS NULL")
    wanted = revisits.select(F.col("refers_to_id").alias("w")).where("w IS NOT NULL").distinct()
    answers = (
        found.where("record_type <> 'revisit' AND error IS NULL")
        .select(F.col("record_id").alias("answer"), F.struct("payload_bytes", "payload_digest").alias("a"))
        .join(wanted, F.col("answer") == F.col("w"), "left_semi")
        .groupBy("answer")
        .agg(F.min("a").alias("a"))
        # dealt by another column, so that the planner can split the revisits of one response
        .repartition(F.col("a.payload_digest"))
    )
    met = revisits.join(answers, F.col("refers_to_id") == F.col("answer"), "left")
    no_answer = F.when(F.col("answer").isNull(), "it refers to no record").when(
        F.col("payload_digest") != F.col("a.payload_digest"), "it refers to another payload"
    )
    met = met.withColumn("error", no_answer).withColumn("payload_bytes", F.col("a.payload_bytes")).withColumn("payload_digest", F.col("a.payload_digest"))
    rest = found.where("NOT (coalesce(record_type, '') = 'revisit' AND error IS NULL)")
    return rest.unionByName(met.select(*found.columns))


def read_pages(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Archived pages under ``path``, a row for each whole record; see :func:`payloads` and :func:`resolve`."""
    return resolve(materialise(payloads(reassemble(read_records(spark, path)), keep_payload), "payloads"))
