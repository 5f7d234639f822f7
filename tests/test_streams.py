"""Keyed state: answers to requests against a plain loop, over several batches, with keys that are forgotten."""

import datetime as dt

from corvane.streaming import streams

KIND = "idempotency_key string, request_id string, body_hash string, created_at timestamp"


def test_answers_against_a_plain_loop(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [("a", "r1", "x", at(0)), ("a", "r2", "x", at(1)), ("a", "r3", "y", at(2)), ("b", "r4", "z", at(2))],
        [("a", "r5", "y", at(9)), ("b", "r6", "z", at(3)), ("a", "r7", "x", at(8))],
        [("c", "r8", "q", at(60))],  # the watermark passes the other keys' time
        [("a", "r9", "y", at(61)), ("b", "s1", "w", at(62)), ("a", "s2", "x", at(63))],
    ]
    keep = 10 * 3_600_000
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = streams.read_log(spark, str(tmp_path / "log"), spark.createDataFrame([], KIND).schema)
        out = streams.run_available(streams.acknowledged(stream, keep, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"), rocksdb=True)
    got = {r.request_id: r.ack for r in out.collect()}
    want, known = {}, {}
    for rows in batches:
        for k, r, body, t in sorted(rows, key=lambda x: (x[3], x[1])):
            if k not in known or t >= known[k][1]:
                known[k] = (body, t + dt.timedelta(milliseconds=keep))
                want[r] = "accepted"
            else:
                want[r] = "replayed" if known[k][0] == body else "refused"
    assert got == want and want["r9"] == "accepted" and want["r5"] == "refused"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0
