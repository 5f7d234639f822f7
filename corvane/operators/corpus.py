"""From sources to an index: chunking, statistics of lexemes, versions and their life."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import text_id, word_tokens


def chunk_text(text: str, max_bytes: int) -> list[str]:
    """Paragraphs, trimmed and packed up to ``max_bytes`` of UTF-8; one that is longer is cut
    between characters."""
    out: list[str] = []
    held, size = [], 0

    def give() -> None:
        nonlocal size
        if held:
            out.append("\n\n".join(held))
            held.clear()
        size = 0

    for para in (p.strip() for p in text.split("\n\n")):
        raw = para.encode()
        if not raw:
            continue
        if len(raw) > max_bytes:
            give()
            pos = 0
            while pos < len(raw):
                end = min(len(raw), pos + max_bytes)
                while end < len(raw) and end > pos + 1 and raw[end] & 0xC0 == 0x80:
                    end -= 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:  # a character longer than a chunk stays whole
                    end += 1
                piece = raw[pos:end].decode().strip()
                if piece:
                    out.append(piece)
                pos = end
            continue
        more = len(raw) + (2 if held else 0)
        if size + more > max_bytes:
            give()
            more = len(raw)
        held.append(para)
        size += more
    give()
    return out


def build_chunks(sources: DataFrame, max_bytes: int = 1200) -> DataFrame:
    """``collection, source_id, chunk_id, ordinal, text, text_sha256`` of all sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            collection, source, ordinal, text = [], [], [], []
            for c, s, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                for i, piece in enumerate(chunk_text(t or "", max_bytes)):
                    collection.append(c)
                    source.append(s)
                    ordinal.append(i)
                    text.append(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(collection, pa.string()), pa.array(source, pa.string()), pa.array(ordinal, pa.int32()), pa.array(text, pa.string())],
                ["collection", "source_id", "ordinal", "text"],
            )

    rows = sources.select("collection", "source_id", "text").mapInArrow(run, "collection string, source_id string, ordinal int, text string")
    return rows.withColumn("chunk_id", F.concat("source_id", F.lit("#"), F.col("ordinal").cast("string"))).withColumn("text_sha256", F.sha2("text", 256))


def index_id(sources: DataFrame, shape: str, chunker: str, embedder: str, extractors: str) -> DataFrame:
    """``collection, index_id``: the identity of an index is what goes into it."""
    listed = sources.groupBy("collection").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source_id", "content_hash"))), ",").alias("s")
    )
    return listed.select("collection", text_id("idx-", F.concat_ws("|", "collection", F.lit(shape), F.lit(chunker), F.lit(embedder), F.lit(extractors), "s")).alias("index_id"))


def corpus_fingerprint(sources: DataFrame) -> DataFrame:
    """``collection, fingerprint``: MD5 over the sorted ids and hashes of the sources."""
    return sources.groupBy("collection").agg(
        F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source_id", "content_hash"))), ",")).alias("fingerprint")
    )


def write_index(chunks: DataFrame, path: str, version: str) -> None:
    """Writes the chunks of one index version, a folder for each collection. Writing a version again replaces it."""
    rows = chunks.withColumn("index_version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "index_version").parquet(path)


def index_sources(rows: DataFrame) -> DataFrame:
    """``source_id, content_hash``: what an index was built from."""
    return rows.select("source_id", "content_hash").distinct()


def sorted_distinct(c: Column) -> Column:
    """An array of provenance, each value once and in order."""
    return F.array_sort(F.array_distinct(c))


def lexemes(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``id, lexeme``: distinct lexemes per text."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(word_tokens(F.col(text_col)))).alias("lexeme"))


def document_frequency(docs: DataFrame, id_col: str, total: int, text_col: str = "text") -> DataFrame:
    """``lexeme, ndoc`` where a hundredth of all texts, and two at least, have it; '' stands for all."""
    least = max(2, total // 100)
    counted = lexemes(docs, id_col, text_col).groupBy("lexeme").agg(F.count(F.lit(1)).alias("ndoc")).where(F.col("ndoc") >= least)
    return counted.unionByName(docs.agg(F.count(F.lit(1)).alias("ndoc")).select(F.lit("").alias("lexeme"), "ndoc"))


def stop_terms(frequency: DataFrame, fraction: float, total: int) -> DataFrame:
    """Lexemes in more than ``fraction`` of all texts."""
    return frequency.where((F.col("lexeme") != "") & (F.col("ndoc") > fraction * total)).select("lexeme")


def number_lexemes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``digits, lexeme`` of tokens that are a long number with one to four letters before it."""
    token = F.explode(F.array_distinct(word_tokens(F.col(text_col))))
    return (
        docs.select(token.alias("lexeme"))
        .where(F.regexp_like("lexeme", F.lit("^[a-z]{1,4}[0-9]{5,}$")))
        .select(F.regexp_replace("lexeme", "^[a-z]+", "").alias("digits"), "lexeme")
        .distinct()
    )


def number_forms(numbers: DataFrame, digits: list[str], most: int = 8) -> DataFrame:
    """How the index spells the numbers of a query."""
    return numbers.where(F.col("digits").isin(digits)).select("lexeme").distinct().orderBy("lexeme").limit(most)


def retire(versions: DataFrame, keep: int = 2) -> DataFrame:
    """Inactive versions beyond the ``keep`` newest of each collection."""
    by = Window.partitionBy("collection").orderBy(F.col("built_at").desc(), "version_id")
    return versions.where("NOT active").withColumn("n", F.row_number().over(by)).where(F.col("n") > keep).select("collection", "version_id")


def required_versions(versions: DataFrame, horizon: str) -> DataFrame:
    """Active versions, and those used until within the horizon; active first, then newest."""
    at = F.lit(horizon).cast("timestamp")
    return versions.where(F.col("active") | (F.col("activated") & (F.coalesce("deactivated_at", "built_at") >= at))).orderBy(
        F.col("active").desc(), F.col("built_at").desc(), "version_id"
    )


def activate(pointers: DataFrame, collection: str, version: str, expected: str | None = None) -> DataFrame:
    """The pointer table with one collection at ``version``; refused if it isn't at ``expected``."""
    if expected is not None:
        now = pointers.where(F.col("collection") == collection).select("version_id").first()
        if now is None or now.version_id != expected:
            raise ValueError(f"{collection} is at {now and now.version_id}, expected {expected}")
    return pointers.where(F.col("collection") != collection).unionByName(
        pointers.sparkSession.createDataFrame([(collection, version)], "collection string, version_id string")
    )


def verify_index(chunks: DataFrame) -> DataFrame:
    """``collection, n_chunks, probe, probe_hits``: chunks that contain the first five words of the first chunk."""
    first = chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"), F.min_by("text", "chunk_id").alias("t"))
    probe = first.select("collection", "n_chunks", F.array_join(F.slice(word_tokens(F.col("t")), 1, 5), " ").alias("probe"))
    # a row per collection, which is policy and not data
    hit = chunks.join(F.broadcast(probe.select("collection", "probe")), "collection").where(
        F.contains(F.concat(F.lit(" "), F.array_join(word_tokens(F.col("text")), " "), F.lit(" ")), F.concat(F.lit(" "), F.col("probe"), F.lit(" ")))
    )
    return probe.join(hit.groupBy("collection").agg(F.count(F.lit(1)).alias("probe_hits")), "collection", "left")


def manifest_diff(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, state`` of each file offered: equal and bound, or binding nowhere, is skipped."""
    known = stored.select("path", F.col("content_hash").alias("have"), "bound")
    return manifest.join(known, "path", "left").select(
        "path",
        F.when(F.col("have").isNull(), "new")
        .when(F.col("have") != F.col("content_hash"), "changed")
        .when(F.col("bound") | ~F.col("binds"), "skipped_existing")
        .otherwise("bind_only")
        .alias("state"),
    )


def upsert_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The latest bytes of each path; equal bytes at two paths are two sources."""
    every = existing.withColumn("v", F.lit(0)).unionByName(incoming.withColumn("v", F.lit(1)))
    names = [c for c in existing.columns if c != "path"]
    return every.groupBy("path").agg(F.max_by(F.struct(*names), "v").alias("x")).select("path", "x.*")


def verified(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (with ``content`` in bytes and ``declared_sha256``) whose bytes are what was declared, and the others, which are refused."""
    same = F.coalesce(F.sha2("content", 256) == F.lower("declared_sha256"), F.lit(False))
    return incoming.where(same), incoming.where(~same)


def bind_sources(bound: DataFrame, matched: DataFrame) -> DataFrame:
    """Pairs of collection and source that are new."""
    return matched.select("collection", "source_id").distinct().join(bound, ["collection", "source_id"], "left_anti")


def export_page(chunks: DataFrame, after: str, limit: int) -> DataFrame:
    """The next chunks by id."""
    return chunks.where(F.col("chunk_id") > after).orderBy("chunk_id").limit(limit)


def exportable(chunks: DataFrame) -> int:
    """How many chunks an index has to export; refused if there are none, or if some have an embedding and others lack it."""
    n, with_vector = chunks.agg(F.count(F.lit(1)), F.count("embedding")).first()
    if not n:
        raise ValueError("an index without chunks isn't exported")
    if 0 < with_vector < n:
        raise ValueError(f"{n - with_vector} of {n} chunks lack an embedding")
    return n


def export_with_sources(chunks: DataFrame, sources: DataFrame, after: str, limit: int) -> DataFrame:
    """The next chunks by id, each with the path and hash of its source as they are now, or else as the index has them.

    ``chunks``: ``chunk_id, source_id, source_path, source_hash`` and more; ``sources``: ``source_id, path, content_hash``.
    """
    page = export_page(chunks, after, limit)
    now = sources.select("source_id", "path", "content_hash")
    return page.join(now, "source_id", "left").select(
        "chunk_id", "source_id", F.coalesce("path", "source_path").alias("path"), F.coalesce("content_hash", "source_hash").alias("content_hash"),
        *(c for c in chunks.columns if c not in ("chunk_id", "source_id", "source_path", "source_hash")),
    )


def stratified_sample(sources: DataFrame, count: int) -> DataFrame:
    """Sources taken in turn from each media type. The feature is the limit."""
    by = Window.partitionBy("media_type").orderBy("source_id")
    # no type can give more than ``count``, so its rows beyond that are dropped within the rank
    return (
        sources.withColumn("n", F.row_number().over(by)).where(F.col("n") <= count).orderBy("n", "media_type").limit(count).select("source_id", "media_type")
    )
