"""The append-only fact ledger: what was current at a position, along a lineage of versions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import claim_key, scope_matches
from corvane.operators.commits import CommitLog, HeadConflict
from corvane.operators.digests import ladder
from corvane.session import materialise


# What the rules are called.
RULE_COUNTER = "gate.counter-budget"
RULE_PROMISE = "gate.promise-unfulfilled"


def pinned(df: DataFrame, as_of_seq: int | None, seq: str = "seq") -> DataFrame:
    """Rows at or before the pin; no pin is the head."""
    return df if as_of_seq is None else df.where(F.col(seq) <= as_of_seq)


def lineage(spark: SparkSession, versions: DataFrame, leaf: str, small: int = 100_000) -> DataFrame:
    """``id, position``: the chain from the root (position 0) to ``leaf``. Cycles are refused.

    Up to ``small`` versions are followed in the driver. Beyond, pointers of 1, 2, 4 ... steps are joined: each round doubles the
    part of the chain that is known, so a chain of ten thousand takes fourteen. A parent that isn't there ends the chain.
    """
    known = versions.select("id", F.col("parent_id").alias("to"))
    few = known.limit(small + 1).collect()
    if len(few) <= small:
        up, chain, seen = {r.id: r.to for r in few}, [], set()
        at = leaf if leaf in up else None
        while at is not None:
            if at in seen:
                raise ValueError(f"the lineage of {leaf} has a cycle at {at}")
            seen.add(at)
            chain.append(at)
            at = up[at] if up[at] in up else None
        return spark.createDataFrame([(v, i) for i, v in enumerate(reversed(chain))], "id string, position int")
    jump = materialise(known.join(known.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to"), "jump")
    chain = materialise(known.where(F.col("id") == leaf).select("id", F.lit(0).cast("long").alias("step")), "chain")
    every, size = known.count(), chain.count()
    step = 1
    while size:
        chain = materialise(chain.unionByName(chain.join(jump, "id").select(F.col("to").alias("id"), (F.col("step") + step).alias("step"))), "chain")
        grown = chain.count()
        if grown > every:
            raise ValueError(f"the lineage of {leaf} has a cycle")
        if grown < 2 * size:
            break
        size, step = grown, 2 * step
        jump = materialise(_composed(jump, jump), "jump")
    last = chain.agg(F.max("step")).first()[0]
    return chain.select("id", (F.lit(last) - F.col("step")).cast("int").alias("position"))


def _composed(first: DataFrame, then: DataFrame) -> DataFrame:
    return first.join(then.select(F.col("id").alias("to"), F.col("to").alias("beyond")), "to").select("id", F.col("beyond").alias("to"))


def lineages(versions: DataFrame) -> DataFrame:
    """``id, root, depth`` of all versions at once, by pointer doubling; a parent that isn't there makes a root. Cycles are refused."""
    known = versions.select("id", F.col("parent_id").alias("to"))
    there = known.select(F.col("id").alias("to"), F.lit(True).alias("there")).distinct()
    root = F.col("there").isNull()
    start = known.join(there, "to", "left").select("id", F.when(root, F.col("id")).otherwise(F.col("to")).alias("to"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("done"))
    at = materialise(start, "pointers")
    # what has met its root is written once, and only pointed at from then on
    done, left = at.where("done"), at.where("NOT done")
    rounds = left.count().bit_length() + 1
    for _ in range(rounds):
        if left.isEmpty():
            return done.select("id", F.col("to").alias("root"), "depth")
        onward = done.unionByName(left).select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("depth").alias("more"), F.col("done").alias("met"))
        moved = left.join(onward, "to").select("id", F.col("beyond").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("met").alias("done"))
        at = materialise(moved, "pointers")
        done, left = done.unionByName(at.where("done")), at.where("NOT done")
    raise ValueError("versions have a cycle")


def chain_claims(claims: DataFrame, chain: Sequence[str]) -> DataFrame:
    """All raw claims of a version chain."""
    return claims.where(F.col("version_id").isin(list(chain)))


def get_claim(claims: DataFrame, claim_id: str) -> DataFrame:
    return claims.where(F.col("id") == claim_id)


def superseded_by(claims: DataFrame) -> DataFrame:
    """For each superseded claim the first claim that names it: ``id, by, by_seq``."""
    return (
        claims.where(F.col("supersedes_id").isNotNull())
        .groupBy(F.col("supersedes_id").alias("id"))
        .agg(F.min(F.struct("seq", "id")).alias("first"))
        .select("id", F.col("first.id").alias("by"), F.col("first.seq").alias("by_seq"))
    )


def slice_facts(
    claims: DataFrame,
    as_of_seq: int | None = None,
    scope_prefix: str | None = None,
    statuses: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Claims current at the pin.

    A claim is superseded if any pinned claim, whatever its status or scope, names it. No status
    means accepted only. ``limit`` keeps the newest.
    """
    visible = pinned(claims, as_of_seq)
    replaced = visible.where(F.col("supersedes_id").isNotNull()).select(F.col("supersedes_id").alias("__gone"))
    out = visible.join(replaced, visible["id"] == F.col("__gone"), "left_anti").where(
        F.col("status").isin(list(statuses) or ["accepted"])
    )
    if scope_prefix is not None:
        out = out.where(scope_matches(F.col("scope_path"), scope_prefix))
    if limit is not None:
        out = out.orderBy(F.col("seq").desc(), "id").limit(limit)
    return out


def latest_per_key(claims: DataFrame, *extra: str) -> DataFrame:
    """The claim of largest ``seq`` for each subject and key."""
    names = [c for c in claims.columns]
    return (
        claims.groupBy(claim_key(F.col("subject"), F.col("key")).alias("claim_key"))
        .agg(F.max_by(F.struct(*names), F.struct("seq", "id")).alias("x"))
        .select("claim_key", "x.*")
    )


def anchors_at(anchors: DataFrame, chain: DataFrame, as_of_seq: int | None = None) -> DataFrame:
    """Locked anchors along a chain: a later version wins, then a later ``seq``."""
    placed = pinned(anchors, as_of_seq).where("locked").join(
        F.broadcast(chain.select(F.col("id").alias("version_id"), "position")), "version_id"
    )
    names = [c for c in anchors.columns if c not in ("detail_key", "locked")]
    return (
        placed.groupBy("detail_key")
        .agg(F.max_by(F.struct(*names), F.struct("position", "seq")).alias("x"))
        .select("detail_key", "x.*")
    )


def promises_at(promises: DataFrame, as_of_seq: int | None = None) -> DataFrame:
    """Promises registered by the pin; one fulfilled after it reads as open."""
    seen = pinned(promises, as_of_seq)
    done = F.col("fulfilled_seq").isNotNull()
    if as_of_seq is not None:
        done = done & (F.col("fulfilled_seq") <= as_of_seq)
    return seen.withColumn("status", F.when(done, "fulfilled").otherwise("open")).withColumn(
        "fulfilled_seq", F.when(done, F.col("fulfilled_seq"))
    )


def overdue(promises: DataFrame, scope: str | None, final: bool = False) -> DataFrame:
    """A finding for each open promise due at ``scope``; at the final unit, for each open one.

    ``promise_id, rule_id, severity, message, scope_path, detail``.
    """
    late = promises.where("status = 'open'")
    key, due, about = F.col("key"), F.col("due_scope"), F.coalesce("description", F.lit(""))
    if final:
        message = F.concat(F.lit("promise '"), key, F.lit("' is still open at the final unit: "), about)
    else:
        late = late.where(due == F.lit(scope))
        message = F.concat(F.lit("promise '"), key, F.lit("' was due at scope '"), due, F.lit("' and is still open"))
    return late.select(
        F.col("id").alias("promise_id"),
        F.lit(RULE_PROMISE).alias("rule_id"),
        F.lit("warn").alias("severity"),
        message.alias("message"),
        F.lit(scope).alias("scope_path"),
        F.to_json(F.struct(F.col("id").alias("promise_id"), key.alias("promise_key")), {"ignoreNullFields": "false"}).alias("detail"),
    )


def counter_totals(counters: DataFrame, as_of_seq: int | None = None, latest_only: bool = False) -> DataFrame:
    """``key, count, budget``: sums and the largest budget.

    With ``latest_only`` each version, key and scope has only its newest row, stamped with its
    position, so a pin before that hides the counter.
    """
    rows = counters
    if latest_only:
        names = counters.columns
        rows = counters.groupBy("version_id", "key", "scope_path").agg(F.max_by(F.struct(*names), "seq").alias("x")).select("x.*")
    return pinned(rows, as_of_seq).groupBy("key").agg(F.sum("count").alias("count"), F.max("budget").alias("budget"))


def check_budgets(totals: DataFrame, scope: str | None = None) -> DataFrame:
    """A finding for each counter over its budget: ``key, rule_id, severity, message, scope_path, detail``."""
    message = F.concat(
        F.lit("counter '"), F.col("key"), F.lit("' at "), F.col("count").cast("string"),
        F.lit(" exceeds whole-document budget "), F.col("budget").cast("string"),
    )
    about = F.struct("budget", F.col("key").alias("counter_key"), F.col("count").alias("total"))
    return totals.where(F.col("count") > F.col("budget")).select(
        "key",
        F.lit(RULE_COUNTER).alias("rule_id"),
        F.lit("warn").alias("severity"),
        message.alias("message"),
        F.lit(scope).cast("string").alias("scope_path"),
        F.to_json(about, {"ignoreNullFields": "false"}).alias("detail"),
    )


def directives(totals: DataFrame) -> DataFrame:
    """``key, directive``: how much of a budget is used, and a line of advice at its end or one use before."""
    key, count, budget = F.col("key"), F.col("count"), F.col("budget")
    used = F.concat(key, F.lit(": used "), count.cast("string"), F.lit("/"), budget.cast("string"))
    advice = F.when(count >= budget, F.concat(F.lit("AVOID: '"), key, F.lit("' — budget exhausted"))).when(
        count + 1 == budget, F.concat(F.lit("CAUTION: '"), key, F.lit("' — one use remaining"))
    )
    return totals.where(budget.isNotNull()).select("key", F.concat_ws("\n", used, advice).alias("directive"))


def chain_head(claims: DataFrame, anchors: DataFrame, promises: DataFrame, counters: DataFrame) -> DataFrame:
    """The largest position anything is stamped with; 0 for an empty ledger."""
    tops = [df.agg(F.max("seq").alias("top")) for df in (claims, anchors, counters)]
    tops.append(promises.agg(F.greatest(F.max("seq"), F.max("fulfilled_seq")).alias("top")))
    every = tops[0].unionByName(tops[1]).unionByName(tops[2]).unionByName(tops[3])
    return every.agg(F.coalesce(F.max("top"), F.lit(0)).alias("head"))


def append_claims(ledger_head: int, proposed: DataFrame, order: str, expected_head: int | None = None) -> DataFrame:
    """Positions for a batch of claims, after the head, in the order of a column.

    The batch is atomic: a head other than the one expected refuses it all. A batch is what one
    writer proposes at once, so it is numbered in one window.
    """
    if expected_head is not None and expected_head != ledger_head:
        raise HeadConflict(f"head is {ledger_head}, expected {expected_head}")
    return proposed.withColumn("seq", F.row_number().over(Window.orderBy(order)) + F.lit(ledger_head).cast("long"))


@dataclass
class LedgerStore:
    """A ledger in a folder: batches of claims that a :class:`~corvane.operators.commits.CommitLog` puts in place.

    The head is in the last record, so nothing is scanned for it. Of two writers at one head the second is refused; a
    batch without rows commits nothing; a writer that dies leaves no trace that others see.
    """

    spark: SparkSession
    path: str
    schema: str

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.path)

    def claims(self) -> DataFrame:
        names = self.log.data(self.log.last())
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{n}" for n in names))

    def head(self) -> int:
        last = self.log.last()
        return self.log.record(last)["head"] if last else 0

    def append(self, batch: DataFrame, at: int) -> int:
        """Commits claims numbered from ``at`` + 1 and gives the head after; refused if the head isn't at ``at``."""
        log = self.log
        name, rows = log.write(batch)
        last = log.last()
        head = log.record(last)["head"] if last else 0
        if head != at or not rows:
            log.discard(name)
            if head != at:
                raise HeadConflict(f"head is {head}, expected {at}")
            return head
        try:
            log.put(last + 1, {"data": [name], "head": at + rows, "rows": rows})
        except HeadConflict:
            log.discard(name)
            raise
        return at + rows


def append_gated(
    store: LedgerStore, proposed: DataFrame, gate: Callable[[DataFrame, DataFrame], DataFrame], order: str, expected_head: int | None = None, attempts: int = 3
) -> int:
    """Gates claims against the ledger at its head and appends them there; gives the head after.

    ``gate`` takes the proposed claims and the facts, and gives the claims as they are to be stored, none perhaps. If the head moves meanwhile the claims are gated
    anew, ``attempts`` times in all; a writer that expects a head isn't moved to another, but refused.
    """
    for attempt in range(1, attempts + 1):
        head = store.head()
        batch = append_claims(head, gate(proposed, slice_facts(store.claims())), order, expected_head)
        try:
            return store.append(batch, head)
        except HeadConflict:
            if expected_head is not None or attempt == attempts:
                raise
    raise AssertionError("no attempts")


@dataclass
class Snapshot:
    """One pin over all stores."""

    facts: DataFrame
    anchors: DataFrame
    promises: DataFrame
    counters: DataFrame
    digests: DataFrame
    as_of_seq: int | None = None


def load_snapshot(
    claims: DataFrame, anchors: DataFrame, promises: DataFrame, counters: DataFrame, chain: DataFrame, as_of_seq: int | None
) -> Snapshot:
    facts = slice_facts(claims, as_of_seq)
    return Snapshot(
        facts,
        anchors_at(anchors, chain, as_of_seq),
        promises_at(promises, as_of_seq),
        counter_totals(counters, as_of_seq),
        ladder(facts),
        as_of_seq,
    )


EVENT_ACKS = "source string, epoch long, event_id string, sequence long, arrival long, ack string"


def accept_events(events: DataFrame) -> DataFrame:
    """``source, epoch, event_id, sequence, arrival, ack``: what becomes of each event of a source's epoch, in the order of arrival.

    An event is ``accepted`` if it has sequence 1 and is the epoch's first, or follows the last accepted one: by its sequence, and by naming its
    digest as the prior one. What is accepted already under the same id is ``replayed``, or a ``mismatch`` if its digest differs; all else is
    ``refused`` and moves nothing. Each epoch is a chain, so its events pass one task in order, which keeps the last one and the
    ids that occur more than once.
    """
    columns = ["source", "epoch", "event_id", "sequence", "digest", "prior_digest", "arrival"]
    named = events.select(*(F.col(c).cast("long") if c in ("epoch", "sequence", "arrival") else F.col(c).cast("string") for c in columns))
    again = named.groupBy("source", "epoch", "event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source", "epoch", "event_id", F.lit(True).alias("again"))
    marked = named.join(again, ["source", "epoch", "event_id"], "left").select(*columns, F.coalesce("again", F.lit(False)).alias("again"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, digest, taken = None, 0, None, {}
        for b in batches:
            acks = []
            for source, epoch, event, sequence, own, prior, _, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (source, epoch) != now:
                    now, last, digest, taken = (source, epoch), 0, None, {}
                if twice and event in taken:
                    acks.append("replayed" if taken[event] == own else "mismatch")
                elif sequence == last + 1 and (last == 0 or prior == digest):
                    acks.append("accepted")
                    last, digest = sequence, own
                    if twice:
                        taken[event] = own
                else:
                    acks.append("refused")
            yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 2, 3, 6)] + [pa.array(acks, pa.string())], ["source", "epoch", "event_id", "sequence", "arrival", "ack"])

    return marked.repartition("source", "epoch").sortWithinPartitions("source", "epoch", "arrival", "event_id").mapInArrow(fold, EVENT_ACKS)


def event_chain_check(events: DataFrame) -> DataFrame:
    """``source, epoch, event_id, sequence, ack`` of the events that a ledger doesn't take."""
    return accept_events(events).where("ack NOT IN ('accepted', 'replayed')").select("source", "epoch", "event_id", "sequence", "ack")
