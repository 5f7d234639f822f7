"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_dir, small_batches  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Byte table of the word rule: A-Z to lower case, digits, a-z and all bytes of
#: non-ASCII characters stay, every other ASCII byte becomes a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, as UTF-8; null has none."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


class WordHash(dict):
    """64-bit hash per word, remembered. Cleared beyond ``limit`` words to bound memory."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the engine's fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, LOWER)
    )


def scratch_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared folder and reads back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application's :func:`materialise` left. DataFrames that read it are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Sketch:
    """Membership of hashed keys in a bitmap of fixed size (``bits`` / 64 rows at most).

    The bitmap is broadcast: its size doesn't depend on the data. A hit may be false,
    so whatever follows must be exact; a miss never is.
    """

    def __init__(self, hashes: DataFrame, bits: int = 1 << 22):
        self.bits = bits
        h = hashes.columns[0]
        self.rows = (
            hashes.where(F.col(h).isNotNull())
            .select(
                F.expr(f"pmod(`{h}`, {bits}L) div 64").alias("__word"),
                F.expr(f"shiftleft(1L, cast(pmod(`{h}`, 64L) as int))").alias("__bit"),
            )
            .groupBy("__word")
            .agg(F.bit_or("__bit").alias("__mask"))
        )

    @classmethod
    def sized(cls, hashes: DataFrame) -> Sketch:
        """With a byte for each key, 8 MB at most. ``hashes`` is counted first."""
        return cls(hashes, min(1 << 26, max(1 << 22, 1 << (8 * hashes.count()).bit_length())))

    def flag(self, df: DataFrame, hash_col: str, out: str) -> DataFrame:
        """Adds boolean ``out``: whether the row's hash may be among the keys."""
        return (
            df.withColumn("__w", F.expr(f"pmod(`{hash_col}`, {self.bits}L) div 64"))
            .join(F.broadcast(self.rows), F.col("__w") == F.col("__word"), "left")
            .withColumn(
                out,
                F.coalesce(
                    F.expr(f"getbit(__mask, cast(pmod(`{hash_col}`, 64L) as int)) = 1"),
                    F.lit(False),
                ),
            )
            .drop("__w", "__word", "__mask")
        )


def drop_rows(docs: DataFrame, lost: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``lost`` (id, ``xxhash64`` of the text) names; columns as they were.

    A row is named by both, so that rows without an id, or with an id that others have, can be told
    apart by their texts. Only rows that the bitmap of lost ones may hold are shuffled; the rest, most
    of a corpus, goes through untouched.
    """
    i, t = lost.columns
    gone = materialise(lost.select(F.col(i).cast("long").alias("__lost"), F.col(t).alias("__text_hash")).distinct(), "lost")
    sketch = Sketch.sized(gone.select(F.xxhash64("__lost", "__text_hash")))
    named = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__t", F.xxhash64(F.col(text_col).cast("string")))
    flagged = sketch.flag(named.withColumn("__h", F.xxhash64("__id", "__t")), "__h", "__may").drop("__h")
    names = [F.col(f"`{c}`") for c in docs.columns]
    doubtful = flagged.where("__may")
    same = F.col("__id").eqNullSafe(F.col("__lost")) & (F.col("__t") == F.col("__text_hash"))
    return flagged.where("NOT __may").select(*names).unionByName(doubtful.join(gone, same, "left_anti").select(*names))
