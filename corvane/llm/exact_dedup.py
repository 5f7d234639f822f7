"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by length, then by a hash of their first characters, then by a hash
of the whole text. Each step reads more of the text, and only of rows whose group has
two members or more. Membership in surviving groups travels as a bitmap of fixed size
(:class:`~corvane.llm.common.Sketch`), so no text is shuffled and nothing that grows
with the data is broadcast. A false hit in a bitmap only costs one more hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Sketch, ascii_lower, drop_rows


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    digest: bool = False,
    text_hash: bool = False,
) -> DataFrame:
    """Decision per row: ``doc_id, keep_id, group_size, kept`` (and ``text_sha256``).

    Texts are equal if identical after lower-casing A-Z only; null counts as empty. The
    largest id of a group stays. Rows that repeat an id count as rows in ``group_size``,
    and all rows with the kept id are marked kept. An empty table gives no rows. Rows
    without an id take part and show a null ``keep_id`` only if no row of their group has
    an id. Other columns of ``docs``, whatever their names, are ignored. With ``digest``
    each row carries the SHA-256 of its normalised text, which reads all texts whole; with ``text_hash`` the
    ``xxhash64`` of the text as it is.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("__t"), *([F.xxhash64(text_col).alias("text_hash")] if text_hash else []))
    size = F.octet_length("__t").cast("long")
    head = F.xxhash64(size, ascii_lower(F.substring("__t", 1, prefix_chars)))
    full = F.sha2(ascii_lower(F.col("__t")), 256)

    lengths = rows.groupBy(size.alias("len")).count().where("count > 1")
    by_length = Sketch(lengths.select(F.xxhash64("len")))
    first = by_length.flag(rows.withColumn("__h", F.xxhash64(size)), "__h", "__in").where("__in")
    heads = first.groupBy(head.alias("head")).count().where("count > 1")
    by_head = Sketch(heads.select("head"))

    def survivors(df: DataFrame) -> DataFrame:
        return by_head.flag(df.withColumn("__h", head), "__h", "__in")

    groups = (
        survivors(rows)
        .where("__in")
        .groupBy(full.alias("sha"))
        .agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        # dealt by another column: the join below then shuffles both sides itself, and the
        # adaptive planner can split the partition of a hot group
        .repartition(F.col("keep"))
    )
    decided = survivors(rows)
    if digest:
        decided = decided.withColumn("text_sha256", full)
        key = F.when(F.col("__in"), F.col("text_sha256"))
    else:
        key = F.when(F.col("__in"), full)
    # rows out of the running get a key of their own, so that they spread evenly
    decided = decided.withColumn(
        "__key", F.coalesce(key, F.concat(F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ).drop("__t", "__h", "__in")
    out = decided.join(groups, decided["__key"] == groups["sha"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
        *(["text_sha256"] if digest else []),
        *(["text_hash"] if text_hash else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of largest id of each group of equal texts, all columns as they were.

    Null counts as empty. Rows that repeat the kept id and its text stay with it. Rows without an id go if one of their group
    has an id; a group in which none has stays as it is. Of rows that repeat an id with different texts each
    goes by its own text. An empty table gives no rows.
    """
    lost = exact_dedup(docs, id_col, text_col, text_hash=True).where("NOT kept").select("doc_id", "text_hash")
    return drop_rows(docs, lost, id_col, text_col)
