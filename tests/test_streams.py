"""Streaming tables: what is visible, what a micro-batch reads, what a retry changes."""

import tempfile

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from vitrine.sources import commits
from vitrine.sources.commits import CommitConflict, CommitLog
from vitrine.streaming import jobs, keyindex
from vitrine.streaming.keyindex import KeyIndex

SCHEMA = "id long, name string, ts long"


@pytest.fixture
def base():
    return tempfile.mkdtemp(prefix="vitrine-stream-", dir="/tmp")


def land(spark, base, drop, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/landing/drop={drop}")


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def dedup(spark, base, checkpoint="checkpoint", **options):
    jobs.stream_dedup(spark, f"{base}/landing", f"{base}/table", f"{base}/{checkpoint}", schema(spark), ["id", "name"], ["ts"], **options)
    return sorted(map(tuple, CommitLog(spark, f"{base}/table").read(schema(spark)).collect()), key=str)


def ingest(spark, base, checkpoint="checkpoint", **options):
    jobs.stream_append_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/{checkpoint}", schema(spark), **options)
    return sorted(map(tuple, CommitLog(spark, f"{base}/table").read(schema(spark)).collect()), key=str)


def test_manifest_shows_what_is_committed(spark, base):
    log = CommitLog(spark, base)
    assert log.numbers() == [] and log.live() == {} and log.read("id long").count() == 0
    for i in range(2 * commits.SNAPSHOT_EVERY + 3):
        folder = log.new_folder("data")
        spark.range(i, i + 1).coalesce(1).write.parquet(f"{base}/{folder}")
        files = [p for p in log.files_under(folder) if "part-" in p]
        gone = [p for p in log.live() if i % 5 == 4][:1]
        assert log.commit([{"path": p, "kind": "data"} for p in files], gone) == i
    left = log.new_folder("data")
    spark.range(1000).write.parquet(f"{base}/{left}")  # written, not committed
    want = {r.id for r in log.read("id long").collect()}
    assert len(want) == 2 * commits.SNAPSHOT_EVERY + 3 - sum(i % 5 == 4 for i in range(2 * commits.SNAPSHOT_EVERY + 3)) and max(want) < 100
    opened = []
    entry = CommitLog.entry
    try:
        CommitLog.entry = lambda self, n: opened.append(n) or entry(self, n)
        log.live()
    finally:
        CommitLog.entry = entry
    assert len(opened) <= commits.SNAPSHOT_EVERY


def test_two_writers_of_one_number(spark, base, monkeypatch):
    log = CommitLog(spark, base)
    log.commit([{"path": "data/a", "kind": "data"}])
    monkeypatch.setattr(CommitLog, "numbers", lambda self: [])
    with pytest.raises(CommitConflict):
        log.commit([{"path": "data/b", "kind": "data"}])
    monkeypatch.undo()
    assert list(log.live()) == ["data/a"]


def test_bloom_filter_holds_and_rarely_errs():
    rng = np.random.default_rng(1)
    a, b, x, y = rng.integers(-(2**63), 2**63 - 1, (4, 5000))
    filter_ = keyindex.bloom(a, b)
    assert keyindex.may_hold(filter_, a, b).all() and keyindex.may_hold(filter_, x, y).mean() < 0.01


def test_key_index_compares_whole_keys_and_merges(spark, base):
    index = KeyIndex(CommitLog(spark, base), ["k", "n"], buckets=2, fan=3)
    frame = lambda rows: spark.createDataFrame(rows, "k string, n long")
    assert index.held(frame([("a", 1)])) is None
    rows = [(None if i % 7 == 0 else f"k{i}", i) for i in range(60)]
    for i in range(0, 60, 6):
        index.log.commit(index.write(frame(rows[i : i + 6])))
        index.compact()
        live = index.log.live("keys").values()
        for level in {f["level"] for f in live}:
            for bucket in (0, 1):
                assert len({f["unit"] for f in live if (f["level"], f["bucket"]) == (level, bucket)}) < 3
    asked = rows[::5] + [("k1", 2), (None, 1), ("other", 3)]
    assert sorted(map(tuple, index.held(frame(asked)).collect()), key=str) == sorted(rows[::5], key=str)


def test_dedup_reads_no_more_files_as_the_table_grows(spark, base, monkeypatch):
    opened = []
    held = KeyIndex.held

    def counted(self, batch):
        out = held(self, batch)
        opened.append(len(self.opened))
        return out

    monkeypatch.setattr(KeyIndex, "held", counted)
    want = []
    for d in range(14):
        rows = [(d * 50 + i, f"n{i}", d) for i in range(50)]
        land(spark, base, d, rows + [(i, n, 99) for i, n, _ in want[-50:][:4]])
        want += rows
        got = dedup(spark, base, buckets=2)
    assert got == sorted(want, key=str)
    # the four keys of the drop before lie in two buckets; a false hit now and then
    assert len(opened) == 14 and max(opened) <= 4 and sum(opened[8:]) <= sum(opened[2:8]) + 3


def test_dedup_orders_nulls_and_retries(spark, base):
    land(spark, base, 0, [(1, "a", 5), (1, "a", 3), (None, "x", 1), (None, "x", 2), (2, None, 1)])
    land(spark, base, 1, [(1, "a", 1), (2, None, 0), (3, "c", 1)])
    first = dedup(spark, base)
    assert first == sorted([(1, "a", 3), (None, "x", 1), (2, None, 1), (3, "c", 1)], key=str)
    # a stream that forgot what it did gets everything once more
    assert dedup(spark, base, checkpoint="other") == first
    assert dedup(spark, base) == first


def test_ingest_killed_before_its_commit_shows_nothing(spark, base, monkeypatch):
    land(spark, base, 0, [(1, "a", 1), (2, "b", 1)])
    commit = CommitLog.commit

    def die(self, *args, **kwargs):
        raise RuntimeError("killed")

    monkeypatch.setattr(CommitLog, "commit", die)
    with pytest.raises(StreamingQueryException):
        ingest(spark, base)
    log = CommitLog(spark, f"{base}/table")
    assert log.files_under("data") and log.read(SCHEMA).count() == 0
    monkeypatch.setattr(CommitLog, "commit", commit)
    assert ingest(spark, base) == [(1, "a", 1), (2, "b", 1)]


def test_ingest_refuses_files_delivered_twice(spark, base):
    land(spark, base, 0, [(1, "a", 1), (2, None, 1)])
    land(spark, base, 1, [(2, None, 1), (1, "a", 1)])  # the same rows in another order, in one micro-batch
    land(spark, base, 2, [(1, None, 1), (2, "a", 1)])  # the same cells in other rows
    want = sorted([(1, "a", 1), (2, None, 1), (1, None, 1), (2, "a", 1)], key=str)
    assert ingest(spark, base) == want
    land(spark, base, 3, [(1, "a", 1), (2, None, 1)])
    land(spark, base, 4, [(9, "z", 1)])
    assert ingest(spark, base, max_files=1) == sorted(want + [(9, "z", 1)], key=str)
    log = CommitLog(spark, f"{base}/table")
    assert any("drop=1" in f for n in log.numbers() for f in log.entry(n).get("refused", []))
    assert ingest(spark, base, checkpoint="other") == sorted(want + [(9, "z", 1)], key=str)
