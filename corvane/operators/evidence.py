"""The evidence plane: sealed tables, their canonical hash, pages of rows, layered plans."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.canonical import float_text, jcs
from corvane.operators.access import Principal, permits
from corvane.session import shared_dir, small_batches

# The version of the canonical form, its separators, and the types it knows.
CANON = "canon@1"
FIELD, ROW, SECTION, NULL = "\x1f", "\x1e", "\x1d", "\x00"
TYPES = ("bool", "int64", "decimal", "float64", "string", "bytes", "date", "timestamp_tz", "timestamp_naive", "interval", "uuid", "json", "array")


@dataclass
class EvidenceColumn:
    id: str
    type: str
    nullable: bool = True
    scale: int | None = None
    key: bool = False
    unit: str | None = None
    additivity: str | None = None
    name: str | None = None
    element: str | None = None  # of an array


@dataclass
class Manifest:
    """What a sealed table says of itself."""

    id: str
    columns: Sequence[EvidenceColumn]
    level: int = 0
    compartments: Sequence[str] = field(default_factory=list)
    row_count: int | None = None
    logical_hash: str | None = None
    order_by: Sequence[str] = field(default_factory=list)  # a total order, where no column is a key
    truncated: bool = False
    denied: Sequence[str] = field(default_factory=list)  # columns that policy held back
    authorization: str = ""

    def problems(self) -> list[str]:
        """What is wrong with the structure; nothing for a sound manifest."""
        out = []
        ids = [c.id for c in self.columns]
        if len(set(ids)) != len(ids):
            out.append("column ids repeat")
        for c in self.columns:
            if c.type not in TYPES:
                out.append(f"{c.id}: unknown type {c.type}")
            if (c.type == "decimal") != (c.scale is not None):
                out.append(f"{c.id}: scale is for decimals and only for those")
            if c.key and c.nullable:
                out.append(f"{c.id}: a key can't be null")
        if self.row_count is not None and self.row_count < 0:
            out.append("negative row count")
        return out

    def schema(self) -> T.StructType:
        """Never inferred from data."""
        kinds = {
            "bool": T.BooleanType(), "int64": T.LongType(), "float64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(),
            "date": T.DateType(), "timestamp_tz": T.TimestampType(), "timestamp_naive": T.TimestampNTZType(), "uuid": T.StringType(),
            "json": T.StringType(), "interval": T.StringType(), "array": T.ArrayType(T.StringType()),
        }
        return T.StructType(
            [T.StructField(c.id, T.DecimalType(38, c.scale) if c.type == "decimal" else kinds[c.type], c.nullable) for c in self.columns]
        )


@F.pandas_udf(T.StringType())
def _float_text(x: pd.Series) -> pd.Series:
    return x.map(float_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _json_text(x: pd.Series) -> pd.Series:
    return x.map(lambda t: jcs(json.loads(t)), na_action="ignore")


def canonical_text(c: Column, kind: str, scale: int | None = None, element: str | None = None) -> Column:
    """The canonical text of a value; null is a byte of its own and not an empty string."""
    if kind == "bool":
        t = F.when(c, "true").otherwise("false")
    elif kind == "decimal":
        t = c.cast(T.DecimalType(38, scale or 0)).cast("string")
    elif kind == "float64":
        t = F.when(F.isnan(c), "NaN").otherwise(_float_text(F.nanvl(c, F.lit(0.0))))
    elif kind == "date":
        t = F.date_format(c, "yyyy-MM-dd")
    elif kind == "timestamp_tz":  # from the epoch, so that the session's zone has no say
        seconds = (F.unix_micros(c).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
        utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
        t = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif kind == "timestamp_naive":
        t = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif kind == "bytes":
        t = F.regexp_replace(F.base64(c), "[\r\n]", "")  # no lines, whatever the session says
    elif kind == "uuid":
        t = F.lower(c)
    elif kind == "json":
        t = _json_text(c)
    elif kind == "array":
        if element in ("float64", "json", "array"):
            raise ValueError(f"arrays of {element} have no canonical form here")
        t = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_text(x, element or "string", scale)), FIELD), F.lit("]"))
    else:
        t = c.cast("string")
    return F.when(c.isNull(), NULL).otherwise(t)


def canonical_row(columns: Sequence[EvidenceColumn]) -> Column:
    return F.concat_ws(FIELD, *[canonical_text(F.col(c.id), c.type, c.scale, c.element) for c in columns])


def row_rule(manifest: Manifest) -> str:
    """How rows are told apart: by key columns, as a multiset, or by their place in a total order, as a sequence."""
    if any(c.key for c in manifest.columns):
        return "keys"
    if manifest.order_by:
        return "position"
    raise ValueError("result_not_identifiable")


def canonical_head(manifest: Manifest) -> str:
    """Version, schema and identity of a table, as they go before its rows into the hash."""
    flag = lambda x: "true" if x else "false"
    said = lambda x: NULL if x is None else str(x)
    columns = (FIELD.join([c.id, c.name or c.id, c.type, said(c.scale), said(c.unit), flag(c.nullable), flag(c.key)]) for c in manifest.columns)
    identity = [row_rule(manifest), *manifest.order_by, flag(manifest.truncated), *sorted(manifest.denied), manifest.authorization]
    return SECTION.join([CANON, ROW.join(columns), FIELD.join(identity), ""])


def logical_hashes(df: DataFrame, manifest: Manifest, *group: str) -> DataFrame:
    """``n_rows, logical_hash`` for each value of ``group``, or of the whole table without one.

    SHA-256 of the head and of the encoded rows, which are sorted bytewise where columns are keys, and otherwise stand in the declared
    order. A hash takes its input in order, so one task streams the sorted rows of a group through it; they are sorted with
    spilling, and never held or collected. Those of a whole table are sorted and joined by many tasks, each a range of them, so that the
    one that hashes has nothing to sort.
    """
    head, names = canonical_head(manifest), list(group)
    order = ["__r"] if row_rule(manifest) == "keys" else [F.expr(o) for o in manifest.order_by]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.withColumn("__r", canonical_row(manifest.columns))
    if not names:
        return _whole_hash(rows.orderBy(*order).select("__r"), head)
    lined = rows.repartition(*names).sortWithinPartitions(*names, *order).select(*names, F.col("__r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n = None, None, 0

        def told() -> pa.RecordBatch:
            keys = [pa.array([v], t) for v, t in zip(now, types, strict=True)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], [*names, "n_rows", "logical_hash"])

        for b in batches:
            types = [b.column(i).type for i in range(len(names))]
            for *key, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        yield told()
                    now, digest, n = key, hashlib.sha256(head.encode()), 0
                digest.update((ROW if n else "").encode() + row.encode())
                n += 1
        if digest is not None:
            yield told()

    return lined.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in names), "n_rows long, logical_hash string"]))


def _whole_hash(lined: DataFrame, head: str, piece: int = 1 << 14) -> DataFrame:
    """``n_rows, logical_hash`` of a table that is sorted over all its partitions; an empty one has a hash as well."""
    spark = lined.sparkSession

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def told() -> pa.RecordBatch:
            columns = ([part], pa.int32()), ([number], pa.int64()), ([len(held)], pa.int64()), ([ROW.encode().join(held)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["part", "number", "n", "rows"])

        for b in batches:
            for r in b.column(0).to_pylist():
                held.append(r.encode())
                size += len(held[-1])
                if size >= piece:
                    yield told()
                    number, held, size = number + 1, [], 0
        if held:
            yield told()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n, last = hashlib.sha256(head.encode()), 0, (-1, -1)
        for b in batches:
            for *at, k, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tuple(at) <= last:
                    raise RuntimeError("sorted rows came out of order")
                last = tuple(at)
                digest.update((ROW.encode() if n else b"") + rows)
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["n_rows", "logical_hash"])

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # a checkpoint keeps the order of partitions, which one task then reads one after another
    pieces = small_batches(lined.mapInArrow(join, "part int, number long, n long, rows binary")).checkpoint()
    found = pieces.coalesce(1).mapInArrow(run, "n_rows long, logical_hash string")
    none = hashlib.sha256(head.encode()).hexdigest()
    return found.agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("logical_hash"), F.lit(none)).alias("logical_hash"))


def logical_hash(df: DataFrame, manifest: Manifest) -> tuple[int, str]:
    """Rows and hash of a whole table. Rows are sorted over all partitions, and come to the driver in a stream, a partition at a time."""
    order = ["__r"] if row_rule(manifest) == "keys" else [F.expr(o) for o in manifest.order_by]
    digest, n = hashlib.sha256(canonical_head(manifest).encode()), 0
    for r in df.withColumn("__r", canonical_row(manifest.columns)).orderBy(*order).select("__r").toLocalIterator():
        digest.update((ROW if n else "").encode() + r[0].encode())
        n += 1
    return n, digest.hexdigest()


def domain_key(tenant: str, logical: str, policy: str, level: int, compartments: Sequence[str]) -> Column:
    return F.sha2(F.lit(FIELD.join([tenant, logical, policy, str(level), *sorted(compartments)])), 256)


def seal(df: DataFrame, manifest: Manifest, path: str) -> Manifest:
    """Writes a table with its manifest beside it; an unsound manifest, or one that says otherwise, is refused.

    Sealing the same rows at the same place again changes nothing; other rows there are refused. The sidecar is written last, so
    what has none was never sealed, and is written anew.
    """
    if wrong := manifest.problems():
        raise ValueError("; ".join(wrong))
    shaped = df.select(*[F.col(c.id) for c in manifest.columns])
    rows, digest = logical_hash(shaped, manifest)
    if manifest.logical_hash and manifest.logical_hash != digest:
        raise ValueError("the table isn't what its manifest says")
    manifest.logical_hash, manifest.row_count = digest, rows
    spark = df.sparkSession
    try:
        there = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except AnalysisException:
        there = None
    if there is not None:
        if there["hash"] != digest:
            raise ValueError("another table is sealed there")
        return manifest
    shaped.write.mode("overwrite").parquet(f"{path}/data")
    sidecar = json.dumps({"canon": CANON, "id": manifest.id, "rows": rows, "hash": digest}, sort_keys=True)
    spark.createDataFrame([(sidecar,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def hydrate(spark: SparkSession, manifest: Manifest, path: str) -> DataFrame:
    """A sealed table, read with its manifest's schema and checked against its hash.

    One that isn't what its manifest says is moved to ``path`` + '.quarantine' and refused, so that it is never read by mistake.
    """
    rows = spark.read.schema(manifest.schema()).parquet(f"{path}/data")
    if logical_hash(rows, manifest) != (manifest.row_count, manifest.logical_hash):
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).rename(there, spark._jvm.org.apache.hadoop.fs.Path(f"{path}.quarantine"))
        raise ValueError("the table isn't what its manifest says; it is in quarantine")
    return rows


def rows_page(df: DataFrame, manifest: Manifest, principal: Principal, order: Sequence[str], start: int, limit: int = 100) -> DataFrame:
    """Rows ``start`` to ``start + limit`` in the declared order, each with the total and whether more follow.

    What the principal may not see has no rows. Only the rows up to the end of the page are kept
    while sorting.
    """
    limit = max(1, min(1000, limit))
    shown = df.where(permits(principal, F.lit(manifest.level), F.array(*[F.lit(c) for c in manifest.compartments]) if manifest.compartments else F.expr("cast(array() as array<string>)")))
    total = shown.count()
    page = shown.orderBy(*order).offset(start).limit(limit)
    return page.withColumn("total", F.lit(total).cast("long")).withColumn("has_more", F.lit(start + limit < total))


def purge_due(artifacts: DataFrame, now: str) -> DataFrame:
    """Committed artifacts past their retention and not on hold."""
    return artifacts.where((F.col("expires_at") <= F.lit(now).cast("timestamp")) & ~F.col("held") & (F.col("state") == "committed"))


@dataclass
class Layer:
    """A step of an evidence plan; ``run`` gives a DataFrame, or None if it refuses."""

    name: str
    run: Callable[[], DataFrame | None]
    required: bool = False
    fallback: bool = False


def execute_plan(layers: Sequence[Layer]) -> dict[str, DataFrame | str]:
    """Layers in order. A fallback is skipped once something was produced; a required refusal fails."""
    out: dict[str, DataFrame | str] = {}
    produced = False
    for layer in layers:
        if layer.fallback and produced:
            out[layer.name] = "skipped"
            continue
        got = layer.run()
        if got is None:
            if layer.required:
                raise ValueError(f"required layer {layer.name} refused")
            out[layer.name] = "refused"
            continue
        if got.isEmpty():
            out[layer.name] = "empty"
            continue
        out[layer.name] = got
        produced = True
    return out


def count_conflicts(counts: DataFrame) -> DataFrame:
    """Layers that count the same thing (``subject, layer, value``) differently, in pairs of one subject."""
    a = counts.select("subject", F.col("layer").alias("a"), F.col("value").alias("va"))
    b = counts.select("subject", F.col("layer").alias("b"), F.col("value").alias("vb"))
    return a.join(b, "subject").where("a < b AND va <> vb")


@dataclass
class View:
    """What a contract lets a selection choose from."""

    measures: dict[str, Column]
    dimensions: Sequence[str]
    filters: Sequence[str] = ()


def select_from(df: DataFrame, view: View, measures: Sequence[str], dimensions: Sequence[str] = (), filters: dict | None = None) -> DataFrame:
    """Measures by dimensions under filters; names that the view doesn't declare are refused."""
    filters = filters or {}
    for chosen, allowed in ((measures, view.measures), (dimensions, view.dimensions), (filters, view.filters)):
        if unknown := sorted(set(chosen) - set(allowed)):
            raise ValueError(f"not in the view: {', '.join(unknown)}")
    if not measures:
        raise ValueError("no measure is selected")
    for k, v in filters.items():
        df = df.where(F.col(k).isin(v) if isinstance(v, (list, tuple)) else F.col(k) == v)
    return df.groupBy(*dimensions).agg(*[view.measures[m].alias(m) for m in measures])


def fit_budget(passages: DataFrame, budget: int, group: str = "layer") -> DataFrame:
    """The longest prefix of each layer's passages, in order, whose lengths fit its budget."""
    run = Window.partitionBy(group).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return passages.withColumn("used", F.sum("length").over(run)).where(F.col("used") <= budget)


def plan_outcomes(layers: DataFrame) -> DataFrame:
    """``turn, place, layer, satisfied, refusal_code``: what became of each layer of many turns' plans that ran.

    ``layers``: ``turn, place, layer, requirement`` (required, supporting or fallback) ``, produced, refusal_code``. All layers run whatever the others did, but a
    fallback only if nothing before it produced evidence; one that was passed over has no outcome.
    """
    before = Window.partitionBy("turn").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.max(F.coalesce("produced", F.lit(False))).over(before), F.lit(False))
    ran = layers.withColumn("had", had).where("requirement <> 'fallback' OR NOT had")
    got = F.coalesce("produced", F.lit(False))
    return ran.select("turn", "place", "layer", got.alias("satisfied"), F.when(~got, F.coalesce("refusal_code", F.lit("unavailable"))).alias("refusal_code"))


def plan_decisions(layers: DataFrame) -> DataFrame:
    """``turn, layers, completeness_available, disclosed_conflicts, failed_layer, failed_code`` of each turn's plan.

    ``layers`` as in :func:`plan_outcomes`, with ``complete`` (what it produced can vouch for being all) and ``counted`` (the value of a count, else
    null). Conflicts are the pairs of layers that count differently. The first required layer without evidence, if there is one, refuses the turn.
    """
    ran = plan_outcomes(layers).join(layers.select("turn", "place", "requirement", "complete", "counted"), ["turn", "place"])
    value = F.when(F.col("satisfied"), F.col("counted"))
    # a value that m of n layers count is no conflict in m * (m - 1) / 2 of all pairs
    alike = ran.groupBy("turn", value.alias("v")).agg(F.count(value).alias("m")).groupBy("turn").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).cast("long").alias("disclosed_conflicts"))
    failed = F.min(F.when((F.col("requirement") == "required") & ~F.col("satisfied"), F.struct("place", "layer", "refusal_code")))
    each = ran.groupBy("turn").agg(
        F.count(F.lit(1)).alias("layers"), F.coalesce(F.max(F.col("satisfied") & F.coalesce("complete", F.lit(False))), F.lit(False)).alias("completeness_available"), failed.alias("f")
    )
    return each.join(alike, "turn").select("turn", "layers", "completeness_available", "disclosed_conflicts", F.col("f.layer").alias("failed_layer"), F.col("f.refusal_code").alias("failed_code"))


def compose_layers(items: DataFrame, layers: DataFrame, budget: int) -> DataFrame:
    """``turn, place, layer, state, kept, used``: how much of each layer goes into a turn's context.

    ``items``: ``turn, layer, ordinal, length`` as rendered; ``layers``: ``turn, layer, place, budget, preserve``. Layers take their room in order: what is
    left of the profile's budget, or their own if that is less. One that fits is ``whole``; one to be preserved is whole or ``dropped``; of others the longest
    run of first items that fits is kept (``partial``). Layers without items take no part. A turn has as many items as its search returned.
    """
    lengths = items.groupBy("turn", "layer").agg(F.array_sort(F.collect_list(F.struct("ordinal", "length"))).alias("x"))
    sums = F.aggregate(
        "x",
        F.expr("cast(array() as array<bigint>)"),
        lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + x["length"])),
    )
    plan = lengths.select("turn", "layer", sums.alias("sums")).join(layers.select("turn", "layer", "place", F.col("budget").cast("long").alias("own"), "preserve"), ["turn", "layer"])
    listed = plan.groupBy("turn").agg(F.array_sort(F.collect_list(F.struct("place", "layer", "own", "preserve", "sums"))).alias("l"))
    kind = "array<struct<place: int, layer: string, state: string, kept: int, used: bigint>>"

    def take(a: Column, x: Column) -> Column:
        room = F.least(a["left"], F.coalesce(x["own"], a["left"]))
        total = F.element_at(x["sums"], F.lit(-1))
        fits = F.when(total <= room, F.size(x["sums"])).when(F.coalesce(x["preserve"], F.lit(False)), 0).otherwise(F.size(F.filter(x["sums"], lambda c: c <= room)))
        used = F.when(fits > 0, F.element_at(x["sums"], F.greatest(fits, F.lit(1)))).otherwise(0)
        state = F.when(fits == 0, "dropped").when(fits == F.size(x["sums"]), "whole").otherwise("partial")
        one = F.struct(x["place"].cast("int").alias("place"), x["layer"].alias("layer"), state.alias("state"), fits.cast("int").alias("kept"), used.cast("long").alias("used"))
        return F.struct((a["left"] - used).cast("long").alias("left"), F.concat(a["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(kind).alias("out"))
    return listed.select("turn", F.explode(F.aggregate("l", start, take, lambda a: a["out"])).alias("o")).select("turn", "o.*")


def observations_to_claims(batch: DataFrame) -> DataFrame:
    """Typed observations as claims; one with several candidates for its entity is ambiguous and left out."""
    return batch.where(F.size("entity_candidates") == 1).select(
        F.concat(F.lit("obs-"), F.col("observation_id").cast("string")).alias("id"),
        F.get("entity_candidates", F.lit(0)).alias("subject"),
        F.col("property").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.when(F.col("change_kind") == "snapshot", "fact").otherwise("correction").alias("claim_type"),
        F.col("valid_from").cast("string").alias("valid_from"),
    )
