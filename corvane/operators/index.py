"""A stored search index: postings, statistics and embeddings of chunks, written once and read by every query.

Postings lie in folders by bucket of the lexeme and are sorted by it within files, so a query reads the row groups of its own
terms. A row of them has a lexeme's chunks of one block of texts, for a row each would take many times the space on its way there. Embeddings are a column of the chunks. No query tokenises or embeds anything but itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import word_tokens
from corvane.functions.vectors import embed
from corvane.operators.corpus import build_chunks, index_id, number_forms
from corvane.session import small_batches

#: Changes with what the files hold, so that none of another make is read.
_LAYOUT = 2
#: Between the ids of a row of postings. In an id it is escaped, and a lone ``%`` is no id.
_END = "\0"


def _bucket(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """An index under ``path``, in ``buckets`` buckets."""

    spark: SparkSession
    path: str
    buckets: int

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def chunks(self, collections: Sequence[str] | None = None) -> DataFrame:
        """``collection, chunk_id, text, dl, embedding`` and what else the chunks had."""
        return _of(self.part("chunks"), collections)

    def _by_lexeme(self, name: str, lexemes: Sequence[str], collections: Sequence[str] | None) -> DataFrame:
        rows = self.part(name)
        hit = rows.sparkSession.createDataFrame([(x,) for x in lexemes], "lexeme string") if lexemes else None
        at = sorted({r[0] for r in hit.select(_bucket(F.col("lexeme"), self.buckets)).collect()}) if hit is not None else []
        return _of(rows.where(F.col("bucket").isin(at) & F.col("lexeme").isin(list(lexemes))), collections)

    def postings(self, lexemes: Sequence[str], collections: Sequence[str] | None = None) -> DataFrame:
        """``lexeme, collection, chunk_id, tf, dl``."""
        blocks = self._by_lexeme("postings", lexemes, collections)
        ids = F.transform(F.split("chunk_ids", _END), lambda x: F.nullif(x, F.lit("%")))
        plain = F.transform(ids, lambda x: F.replace(F.replace(x, F.lit("%00"), F.lit(_END)), F.lit("%25"), F.lit("%")))
        return blocks.select("lexeme", "collection", F.inline(F.arrays_zip(plain.alias("chunk_id"), "tf", "dl")).alias("chunk_id", "tf", "dl"))

    def size(self, collections: Sequence[str] | None = None) -> tuple[int, float]:
        """Chunks, and their mean length in words."""
        r = _of(self.part("stats"), collections).agg(F.sum("n_chunks"), F.sum("words")).first()
        return (r[0] or 0, (r[1] or 0) / r[0] if r[0] else 1.0)

    def frequency(self, lexemes: Sequence[str], collections: Sequence[str] | None = None) -> dict[str, int]:
        """How many chunks have each lexeme; a row for each term of a query comes back."""
        rows = self._by_lexeme("terms", lexemes, collections).groupBy("lexeme").agg(F.sum("ndoc").alias("n")).collect()
        return {r.lexeme: r.n for r in rows}

    def common(self, lexemes: Sequence[str], fraction: float, collections: Sequence[str] | None = None) -> list[str]:
        """Those of ``lexemes`` that more than ``fraction`` of all chunks have, and two at least."""
        n, _ = self.size(collections)
        return [x for x, k in self.frequency(lexemes, collections).items() if k >= 2 and k > fraction * n]

    def number_forms(self, digits: Sequence[str]) -> list[str]:
        """How the index spells the numbers of a query."""
        return [r.lexeme for r in number_forms(self.part("numbers"), list(digits)).collect()] if digits else []

    def bm25(
        self,
        original: Sequence[str],
        expanded: Sequence[str] = (),
        weight: float = 1.0,
        least: int = 1,
        candidates: Sequence[str] | None = None,
        collections: Sequence[str] | None = None,
        k1: float = 1.2,
        b: float = 0.75,
    ) -> DataFrame:
        """``collection, chunk_id, score`` of chunks with at least ``least`` of the ``candidates``, by default all terms.

        The score is that of the ``original`` terms and that of them with the ``expanded`` ones, in the proportion of ``weight``. Parts are
        added in the order of the terms, so equal chunks have equal scores.
        """
        words = list(dict.fromkeys([*original, *expanded]))
        n, avgdl = self.size(collections)
        df = self.frequency(words, collections)
        idf = {w: float(np.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))) for w in words}
        number = {w: i for i, w in enumerate(words)}
        pick = lambda values: F.coalesce(*(F.when(F.col("lexeme") == w, F.lit(v)) for w, v in values.items()), F.lit(None)) if values else F.lit(None)
        tf = F.col("tf")
        part = pick(idf).cast("double") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
        rows = self.postings(words, collections).select("collection", "chunk_id", pick(number).cast("int").alias("t"), part.alias("part"))
        met = rows.groupBy("collection", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("t", "part"))).alias("p"))
        total = lambda some: F.aggregate(F.filter("p", some), F.lit(0.0), lambda a, x: a + x["part"])
        whole = total(lambda x: F.lit(True))
        weight = min(1.0, max(0.0, weight))
        if not expanded or weight >= 1:
            score = whole
        else:
            score = total(lambda x: x["t"] < len(dict.fromkeys(original)))
            score = score if weight <= 0 else (1 - weight) * score + weight * whole
        wanted = [number[w] for w in (words if candidates is None else candidates) if w in number]
        enough = F.size(F.filter("p", lambda x: x["t"].isin(wanted))) >= max(1, min(least, len(wanted))) if wanted else F.lit(False)
        return met.where(enough).select("collection", "chunk_id", score.alias("score"))


def _of(rows: DataFrame, collections: Sequence[str] | None) -> DataFrame:
    return rows if collections is None else rows.where(F.col("collection").isin(list(collections)))


def posting_blocks(words: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``block, lexeme, collection, chunk_ids, tf, dl``: a lexeme's chunks of one collection in each block of about ``most`` words, ids in one text.

    ``words``: ``collection, chunk_id, dl, words``, a row for each chunk. Blocks are made where their texts are; their numbers only serve to deal them.
    """
    kind = dict(words.dtypes)

    def block(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        collection = t.column("collection").combine_chunks().dictionary_encode(null_encoding="encode")
        of = collection.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # chunks in the order of their collections
        order = np.argsort(of, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = t.column("words").combine_chunks()
        lexeme = lists.flatten().dictionary_encode()
        chunk = place[pc.list_parent_indices(lists).to_numpy()]
        key, tf = np.unique(lexeme.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(order) + chunk, return_counts=True)
        if not len(key):
            return
        code, chunk = key // len(order), order[key % len(order)]
        first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(of[chunk], prepend=-1) != 0))
        ends = pa.array(np.append(first, len(key)), pa.int32())
        listed = lambda values: pa.ListArray.from_arrays(ends, values)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(first), number), pa.int64()), lexeme.dictionary.take(pa.array(code[first])), collection.dictionary.take(pa.array(of[chunk][first])),
                pc.binary_join(listed(t.column("chunk_id").combine_chunks().take(pa.array(chunk))), _END), listed(pa.array(tf, pa.int32())), listed(t.column("dl").combine_chunks().take(pa.array(chunk))),
            ],
            ["block", "lexeme", "collection", "chunk_ids", "tf", "dl"],
        )
        for i in range(0, out.num_rows, 5000):
            yield out.slice(i, 5000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId(), [], 0
        for b in batches:
            held.append(b)
            n += len(b.column(3).flatten())
            if n >= most:
                yield from block(held, number)
                number, held, n = number + 1, [], 0
        if held:
            yield from block(held, number)

    schema = f"block long, lexeme string, collection {kind['collection']}, chunk_ids string, tf array<int>, dl array<int>"
    escaped = F.replace(F.replace(F.col("chunk_id").cast("string"), F.lit("%"), F.lit("%25")), F.lit(_END), F.lit("%00"))
    return words.select("collection", F.coalesce(escaped, F.lit("%")).alias("chunk_id"), "dl", "words").mapInArrow(run, schema)


def write_search_index(chunks: DataFrame, path: str, buckets: int = 16, splits: int = 8) -> Index:
    """Writes the index of ``chunks`` (``collection, chunk_id, text``, and ``embedding`` if there is one) and all their other columns.

    Writing again replaces it. A lexeme that most chunks have is spread over ``splits`` files. The mark that it is whole is written last.
    """
    spark = chunks.sparkSession
    rows = chunks.withColumn("dl", F.size(word_tokens(F.col("text"))))
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", embed("text"))
    index = Index(spark, path, buckets)
    save = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    save(rows, "chunks")
    words = small_batches(index.chunks()).select("collection", "chunk_id", "dl", word_tokens(F.col("text")).alias("words"))
    if not words.groupBy("collection", "chunk_id").count().where("count > 1").isEmpty():
        # rows of one chunk count as one
        words = words.groupBy("collection", "chunk_id", "dl").agg(F.flatten(F.collect_list("words")).alias("words"))
    dealt = posting_blocks(words).withColumn("bucket", _bucket(F.col("lexeme"), buckets)).repartition("bucket", F.pmod("block", F.lit(splits)))
    dealt.drop("block").sortWithinPartitions("bucket", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    terms = index.part("postings").groupBy("bucket", "lexeme", "collection").agg(F.sum(F.size("tf")).alias("ndoc"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    save(index.chunks().groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("dl").alias("words")), "stats")
    numbers = index.part("terms").where(F.regexp_like("lexeme", F.lit("^[a-z]{1,4}[0-9]{5,}$")))
    save(numbers.select(F.regexp_replace("lexeme", "[^0-9]", "").alias("digits"), "lexeme").distinct(), "numbers")
    save(spark.createDataFrame([(buckets, _LAYOUT)], "buckets int, layout int"), "whole")
    return index


def open_index(spark: SparkSession, path: str) -> Index | None:
    """The index under ``path``; none if it isn't there, isn't whole or has another layout."""
    try:
        r = spark.read.parquet(f"{path}/whole").first().asDict()
        return Index(spark, path, r["buckets"]) if r.get("layout") == _LAYOUT else None
    except AnalysisException:
        return None


def build_collection_index(sources: DataFrame, path: str, shape: str, chunker: str, embedder: str, extractors: str, max_bytes: int = 1200) -> tuple[str, Index]:
    """Chunks, postings and embeddings of ``sources`` (``collection, source_id, content_hash, text``), under the identity of what goes into them.

    An index that is there already under that identity is opened and not built again.
    """
    spark = sources.sparkSession
    made = index_id(sources, shape, chunker, embedder, extractors).select(F.sha2(F.array_join(F.array_sort(F.collect_list("index_id")), ","), 256)).first()[0]
    version = f"idx-{made[:16]}"
    at = f"{path}/{version}"
    return version, open_index(spark, at) or write_search_index(build_chunks(sources, max_bytes), at)
