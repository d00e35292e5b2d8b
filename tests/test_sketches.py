"""Stored distinct sketches: equal to exact counts where they are small, near them where they are large."""

import tempfile

from pyspark.sql import functions as F

from vitrine.sources.commits import CommitLog
from vitrine.sources.sketches import DistinctSketches
from vitrine.streaming.jobs import stream_append_ingest


def folder():
    return tempfile.mkdtemp(prefix="vitrine-sketch-", dir="/tmp")


def kept(spark, batches, columns, by, fan=16):
    log = CommitLog(spark, folder())
    sketches = DistinctSketches(log, columns, by, fan=fan)
    for b in batches:
        log.commit(sketches.write(b))
        sketches.compact()
    return sketches


def test_small_counts_are_exact_for_any_selection(spark):
    rows = [("s", "a", 1), ("s", "a", 2), ("s", None, 2), ("t", "a", None), ("t", "b", 3), ("t", "", 3), (None, "c", 3), (None, None, None)]
    df = spark.createDataFrame(rows, "store string, v string, n int")
    sketches = kept(spark, [df.limit(3), df, df.limit(0), df.where("store = 't'")], ["v", "n"], ["store"])
    whole = df.limit(3).union(df).union(df.where("store = 't'"))
    exact = lambda d: tuple(d.agg(F.count("*"), F.count_distinct("v"), F.count_distinct("n")).first())
    assert tuple(sketches.counts().first()) == exact(whole)
    got = {r.store: tuple(r)[1:] for r in sketches.counts(["store"]).collect()}
    assert got == {s: exact(whole.where(F.col("store").eqNullSafe(s))) for s in ("s", "t", None)}
    assert tuple(sketches.counts(where=F.col("store").isin("s", "t")).first()) == exact(whole.where("store in ('s', 't')"))
    assert tuple(sketches.counts(where=F.col("store") == "none").first()) == (0, 0, 0)


def test_no_batch_yet(spark):
    sketches = kept(spark, [], ["v", "n"], ["store"])
    assert tuple(sketches.counts().first()) == (0, 0, 0) and sketches.counts(["store"]).count() == 0


def test_error_of_large_counts_and_merged_files(spark):
    df = spark.range(200_000).select((F.col("id") % 7).cast("string").alias("store"), F.md5(F.col("id").cast("string")).alias("v"))
    parts = [df.where(F.pmod(F.xxhash64("v"), F.lit(9)) <= b) for b in range(9)]  # batches overlap
    sketches = kept(spark, parts, ["v"], ["store"], fan=4)
    assert len(sketches.log.live("sketches")) < 4
    assert abs(sketches.counts().first().n_v / 200_000 - 1) < 0.05
    for r in sketches.counts(["store"]).collect():
        assert abs(r.n_v / (200_000 / 7) - 1) < 0.07
    assert sketches.counts().first().n_rows == sum(p.count() for p in parts)


def test_sketches_tell_of_the_committed_rows(spark, monkeypatch):
    base = folder()
    df = spark.createDataFrame([(f"s{i % 3}", f"v{i % 40}", i) for i in range(200)], "store string, v string, n int")
    df.repartition(4).write.parquet(f"{base}/landing/drop=1")
    ingest = lambda: stream_append_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/check", df.schema, sketched=["v"], by=["store"])
    commit = CommitLog.commit

    def die(*a, **k):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(CommitLog, "commit", die)
    try:
        ingest()
    except Exception:
        pass
    log = CommitLog(spark, f"{base}/table")
    sketches = DistinctSketches(log, ["v"], ["store"])
    assert sketches.counts().first().n_rows == 0
    monkeypatch.setattr(CommitLog, "commit", commit)
    ingest()
    ingest()
    assert tuple(sketches.counts().first()) == (200, 40) and log.read(df.schema).count() == 200
