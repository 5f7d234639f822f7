"""Proportional stratified interleaving into shards, in DataFrame operations only.

Within each source, rows are ranked in a seeded random order; a row's fractional rank is
(rank - u) / rows of its source, where u between 0 and 1 is drawn once for each source. All rows
are then ordered by fractional rank and cut into runs of equal count, so each shard holds every source
in its share of the whole. Sources of a row or two fall anywhere, for u differs, and so the many of a
long tail spread over all shards as well; with the same u they would all meet in the middle.

No rank is taken over a whole source or over all rows at once. The random order is a
64-bit hash, so its leading bits split any source, however hot, into buckets of nearly
equal size; counts per bucket give each bucket's offset and row numbers are taken within
a bucket only. The same is done again for fractional ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialise


def interleave(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    carry: dict[str, Column] | None = None,
    rows_per_bucket: int = 512,
    max_buckets: int = 1 << 20,
) -> DataFrame:
    """Per row: ``doc_id, position, shard, slot`` and ``carry``; shard counts differ by one at most.

    The law held is that of rows. Groups of equal texts are many rows like any others: each has its own place and its own
    ``carry``, and a group may lie in several shards, for one that held a third of all rows would
    break the law.

    ``position`` runs from 0 over all rows in interleaved order; ``slot`` from 0 within a
    shard. Rows without a source form a source of their own. Rows that repeat an id are
    kept, in any order among themselves. An empty table gives no rows. ``carry`` names
    further expressions over ``docs`` to take along; its other columns are ignored.
    """
    extra = carry or {}
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("__s"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.lit("order")).alias("__h"),
        *(c.alias(k) for k, c in extra.items()),
    )
    total = docs.select(F.lit(1)).count()
    buckets = 1 << min(max_buckets, max(16, total // rows_per_bucket)).bit_length()
    rows = rows.withColumn("__b", F.expr(f"pmod(shiftrightunsigned(__h, 40), {buckets}L)"))

    per = rows.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        "__s",
        "__b",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"),
        F.sum("n").over(Window.partitionBy("__s")).alias("__of"),
    )
    within = Window.partitionBy("__s", "__b").orderBy("__h", "doc_id")
    ranked = (
        rows.withColumn("__r", F.row_number().over(within))
        .join(offsets, ["__s", "__b"])
        .withColumn("__f", (F.col("__before") + F.col("__r") - _offset(seed)) / F.col("__of"))
        .withColumn("__fb", F.expr(f"least(cast(floor(__f * {buckets}) as long), {buckets - 1}L)"))
        .select("doc_id", "__s", "__h", "__f", "__fb", *extra)
    )
    # at most max_buckets rows, whatever the data
    before_f = Window.orderBy("__fb").rowsBetween(Window.unboundedPreceding, -1)
    offsets_f = (
        ranked.groupBy("__fb")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("__fb", F.coalesce(F.sum("n").over(before_f), F.lit(0)).alias("__before"))
    )
    within_f = Window.partitionBy("__fb").orderBy("__f", "__h", "__s", "doc_id")
    placed = (
        ranked.withColumn("__r", F.row_number().over(within_f))
        .join(offsets_f, "__fb")
        .withColumn("position", F.col("__before") + F.col("__r") - 1)
        .withColumn("shard", F.expr(f"cast(position * {shards}L div {max(total, 1)}L as int)"))
    )
    # the first position p of shard s is the least with p * shards >= s * total
    slot = F.expr(f"position - (shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "position", "shard", slot.alias("slot"), *extra)


def _offset(seed: int) -> Column:
    """The u of a row's source."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col("__s"), F.lit("offset")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 17, rows_per_file: int = 100_000) -> None:
    """Writes ``docs`` with ``slot``, a folder for each shard.

    Rows are numbered, and places join by the number: rows without an id or with a repeated one are
    written like others, and texts are shuffled only by that join and to their files. Columns named ``shard`` or ``slot``
    are replaced. An empty table writes no file.
    """
    rows = materialise(docs.drop("shard", "slot").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    placed = interleave(rows, shards, seed, carry={"__at": F.col("__row")}).select("__at", "shard", "slot")
    (
        rows.join(placed, F.col("__row") == F.col("__at"))
        .drop("__row", "__at")
        .repartition("shard", F.expr(f"slot div {rows_per_file}"))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
