"""The commit log under ledgers and pointers: races, empty batches, writers that die."""

import threading

import pytest

from corvane.operators import commits, ledger

SCHEMA = "id string, seq long"


def batch(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_two_writers_at_one_head(spark, tmp_path):
    store = ledger.LedgerStore(spark, str(tmp_path / "l"), SCHEMA)
    assert store.head() == 0 and store.claims().count() == 0
    assert store.append(batch(spark, ("a", 1), ("b", 2)), 0) == 2
    with pytest.raises(commits.HeadConflict):
        store.append(batch(spark, ("x", 1)), 0)
    assert store.append(batch(spark, ("c", 3)), 2) == 3
    assert sorted(map(tuple, store.claims().collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_of_many_at_once_one_takes_a_number(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "c"))
    done, refused = [], []

    def writer(k):
        try:
            log.put(1, {"data": [f"w{k}"]})
            done.append(k)
        except commits.HeadConflict:
            refused.append(k)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(done) == 1 and len(refused) == 7 and log.record(1) == {"data": [f"w{done[0]}"]} and log._names("new") == []


def test_a_batch_without_rows_commits_nothing(spark, tmp_path):
    store = ledger.LedgerStore(spark, str(tmp_path / "l"), SCHEMA)
    assert store.append(batch(spark), 0) == 0 and store.log.last() == 0
    whole = "id string, seq long, subject string, key string, value string, scope_path string, status string, supersedes_id string"
    assert ledger.append_gated(ledger.LedgerStore(spark, str(tmp_path / "l"), whole), spark.createDataFrame([("a",)], "id string"), lambda p, f: p.where("false"), "id") == 0
    assert store.append(batch(spark, ("a", 1)), 0) == 1



def test_a_writer_that_dies_is_not_seen_and_blocks_nobody(spark, tmp_path):
    store = ledger.LedgerStore(spark, str(tmp_path / "l"), SCHEMA)
    store.append(batch(spark, ("a", 1)), 0)
    lost, _ = store.log.write(batch(spark, ("dead", 2)))  # and then it dies
    (tmp_path / "l" / "new").mkdir(exist_ok=True)
    (tmp_path / "l" / "new" / "half").write_text('{"da')
    assert store.head() == 1 and store.claims().count() == 1
    assert store.append(batch(spark, ("b", 2)), 1) == 2
    assert store.log.sweep(3600) == [] and store.log.sweep(-5) == sorted([lost, "half"])
    assert sorted(r.id for r in store.claims().collect()) == ["a", "b"]


def test_long_logs_are_read_from_the_last_list(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "c"), every=3)
    for n in range(1, 9):
        log.put(n, {"data": [f"d{n}"]})
    read = []
    whole = log.record
    log.record = lambda n: read.append(n) or whole(n)
    assert log.data(8) == [f"d{n}" for n in range(1, 9)] and read == [8, 7, 6]


def test_pointers_move_by_generation(spark, tmp_path):
    store = commits.PointerStore(commits.CommitLog(spark, str(tmp_path / "p"), every=4))
    assert store.activate("c", "v1", 0) == 1 and store.activate("d", "w1", 0) == 1
    with pytest.raises(commits.NotAsExpected):
        store.activate("c", "v9", 0)
    for i in range(1, 7):
        assert store.activate("c", f"v{i + 1}", i) == i + 1
    assert [tuple(r) for r in store.table().collect()] == [("active/c", "v7", 7), ("active/d", "w1", 1)]


def test_a_change_in_between_refuses_only_its_own_pointer(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "p"))
    one, other = commits.PointerStore(log), commits.PointerStore(log)
    put, came = log.put, []

    def late(number, record):
        if not came:
            came.append(1)
            other.activate("d", "w", 0)
        put(number, record)

    log.put = late
    assert one.activate("c", "v", 0) == 1 and one.state() == {"active/c": ("v", 1), "active/d": ("w", 1)}
    came.clear()
    log.put = lambda number, record: (came or (came.append(1), other.activate("c", "theirs", 1)), put(number, record))[1]
    with pytest.raises(commits.NotAsExpected):
        one.activate("c", "mine", 1)
    assert one.state()["active/c"] == ("theirs", 2)


def test_what_serves_changes_by_promotion_alone(spark, tmp_path):
    store = commits.PointerStore(commits.CommitLog(spark, str(tmp_path / "p")))
    ok = {"a1", "a2"}
    with pytest.raises(ValueError, match="promotion"):
        store.bind("v", "serving", "a1", 0, ok)
    with pytest.raises(ValueError, match="verified"):
        store.bind("v", "staged", "bad", 0, ok)
    assert store.bind("v", "staged", "a1", 0, ok) == 1
    assert store.promote("v", 1, 0, ok) == 1 and store.state()["serving/v"] == ("a1", 1)
    with pytest.raises(commits.NotAsExpected):
        store.promote("v", 1, 1, ok)  # the staged slot was used up
    g = store.bind("v", "staged", "a2", 2, ok)
    with pytest.raises(commits.NotAsExpected):
        store.promote("v", g, 0, ok)
    assert store.promote("v", g, 1, ok) == 2 and store.state()["serving/v"] == ("a2", 2)
