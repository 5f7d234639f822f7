"""Streams over an append-only log: tumbling reports, idempotent replay, gated appends, reservations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts, errors and an approximate 95th percentile per bucket aligned to the epoch; later rows are dropped."""
    return (
        events.withWatermark("created_at", late)
        .groupBy(F.window("created_at", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("status") >= 500).alias("server_errors"),
            F.percentile_approx("latency_ms", 0.95, 10_000).alias("p95"),
        )
        .select(F.col("w.start").alias("bucket"), "requests", "server_errors", "p95")
    )


def idempotent(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of requests with one key and body; replays are dropped while the watermark remembers them."""
    return requests.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["idempotency_key", "body_hash"])


def conflicts(requests: DataFrame) -> DataFrame:
    """Keys that were used for different bodies; such a reuse is refused."""
    return requests.groupBy("idempotency_key").agg(F.countDistinct("body_hash").alias("bodies")).where("bodies > 1")


ACKNOWLEDGED = "idempotency_key string, request_id string, body_hash string, ack string"


class _Acknowledge(StatefulProcessor):
    """Of each key the body that was first, until a timer forgets it."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "body_hash string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.first.get() if self.first.exists() else None
        out, asked = [], []
        # a key has few rows, for which a sort and a loop of pandas would cost more than all the rest
        for b in rows:
            if b["created_at"].isna().any():
                raise ValueError("a request without a time")
            asked += zip(b["created_at"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), b["request_id"].tolist(), b["body_hash"].tolist(), strict=True)
        for us, request, body in sorted(asked, key=lambda r: (r[0], r[1] is None, r[1] or "")):
            at = us // 1000
            if known is None or at >= known[1]:
                if known is not None:
                    self.handle.deleteTimer(known[1])
                known = (body, at + self.keep_ms)
                self.first.update(known)
                self.handle.registerTimer(known[1])
                ack = "accepted"
            else:
                ack = "replayed" if body == known[0] else "refused"
            out.append((key[0], request, body, ack))
        yield pd.DataFrame(out, columns=["idempotency_key", "request_id", "body_hash", "ack"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.first.exists() and self.first.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.first.clear()
        yield pd.DataFrame([], columns=["idempotency_key", "request_id", "body_hash", "ack"])

    def close(self) -> None:
        pass


def acknowledged(requests: DataFrame, keep_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """An answer for each request (``idempotency_key, request_id, body_hash, created_at``): ``accepted``, ``replayed``, or ``refused`` for a key that was used with another body.

    A key is remembered for ``keep_ms`` after the request that was accepted; then it may be used anew, and once the watermark has passed that time
    its state is dropped by a timer. Run it with ``run_available(..., rocksdb=True)``: this kind of state is kept in RocksDB alone.
    """
    return (
        requests.withWatermark("created_at", late)
        .groupBy("idempotency_key")
        .transformWithStateInPandas(_Acknowledge(keep_ms), ACKNOWLEDGED, "append", "EventTime")
    )


RESERVED = "budget string, id string, event string, held long, settled long"


def reservations(events: DataFrame, hold_ms: int = 3_600_000) -> DataFrame:
    """Balance after each reservation event (``budget, id, event, units, created_at``).

    ``reserve`` holds units, ``settle`` and ``release`` end a hold. A hold that outlives its time is
    settled when the watermark passes it, for it may have been spent.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, units, ends, settled = state.get if state.exists else ([], [], [], 0)
        held = {i: (u, e) for i, u, e in zip(ids, units, ends, strict=True)}
        out = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs()
            for i in sorted(i for i, (_, e) in held.items() if e <= now):
                settled += held.pop(i)[0]
                out.append((key[0], i, "swept", sum(u for u, _ in held.values()), settled))
        else:
            rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
            for r in rows.itertuples(index=False):
                if r.event == "reserve" and r.id not in held:
                    held[r.id] = (int(r.units), int(r.created_at.timestamp() * 1000) + hold_ms)
                elif r.event in ("settle", "release") and r.id in held:
                    u = held.pop(r.id)[0]
                    settled += u if r.event == "settle" else 0
                else:
                    continue
                out.append((key[0], r.id, r.event, sum(u for u, _ in held.values()), settled))
        state.update((list(held), [u for u, _ in held.values()], [e for _, e in held.values()], settled))
        if held:
            state.setTimeoutTimestamp(max(min(e for _, e in held.values()), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["budget", "id", "event", "held", "settled"])

    return (
        events.withWatermark("created_at", "1 hour")
        .groupBy("budget")
        .applyInPandasWithState(
            step, RESERVED, "ids array<string>, units array<long>, ends array<long>, settled long", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def gated_append(stream: DataFrame, gate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs each micro-batch through a gate and appends what comes out; a batch is written once.

    The batch number is part of the path, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        gate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def _state_store(spark: SparkSession, rocksdb: bool) -> Iterator[None]:
    """While a stream starts, its state goes to RocksDB; the session is as before afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if rocksdb:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if rocksdb:
            spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", rocksdb: bool = False) -> DataFrame:
    """Runs a stream over what is there now into Parquet, and reads the result."""
    spark = stream.sparkSession
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:

        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    with _state_store(spark, rocksdb):
        q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


class Progress(StreamingQueryListener):
    """Gives an event (a dictionary) for each start, micro-batch and end of the session's streams to ``tell``."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell({"event": "started", "id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.tell({"event": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "watermark": p.eventTime.get("watermark")})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell({"event": "ended", "id": str(event.id), "error": event.exception})
