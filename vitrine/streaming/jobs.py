"""Structured Streaming jobs (2.11): incremental ingest of landed files and keep-first dedup by key across
increments. Both run with ``trigger(availableNow=True)``, a checkpoint in the shared folder, and a ``foreachBatch``
sink whose writes become visible by one entry of the table's manifest (``sources.commits``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.landing import landed_cte, landed_products
from ..oracle.catalog import with_raw_ctes
from ..registry import query
from ..operators.dedup import dedup_keep_first
from ..session import materialize, tables_root
from ..sources.commits import CommitLog
from ..sources.sketches import DistinctSketches
from ..sources.tables import read_table
from .keyindex import KeyIndex


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables_root(spark)}/stream/{name}-{uuid.uuid4().hex}"


def land_in_batches(df: DataFrame, path: str, drop: F.Column) -> None:
    """Land ``df`` as one folder of files per value of ``drop``, in one pass over it."""
    df.withColumn("drop", drop).write.mode("append").partitionBy("drop").parquet(path)


#: What identifies a delivered file's rows, in whatever order and under whatever name: their number and two sums of hashes.
PRINT = ["n_rows", "print_a", "print_b"]


def file_prints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``PRINT`` of the rows of each ``_file``."""
    cells = [F.col(f"`{c}`") for c in columns]
    cells += [c.isNull() for c in cells]  # hashes pass over nulls
    total = lambda *more: F.sum(F.xxhash64(*cells, *more).cast("decimal(38,0)")).cast("string")
    return rows.groupBy("_file").agg(F.count("*").alias("n_rows"), total().alias("print_a"), total(F.lit(1)).alias("print_b"))


def stream_append_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, schema,
                         max_files: int = 256, sketched: list[str] = (), by: list[str] = ()) -> None:
    """New landed files -> append to the products table. A micro-batch (``max_files`` at most) becomes visible by one
    manifest entry, which also enters its files into the ledger. Files whose rows the ledger knows, under whatever
    name, are refused and noted; so a retried micro-batch that was committed changes nothing. The entry also makes visible
    the distinct sketches of the columns ``sketched`` in the batch's rows, by the columns ``by``."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{landing}/*")
    columns = src.columns

    def write_batch(batch: DataFrame, epoch: int) -> None:
        log = CommitLog(batch.sparkSession, table)
        ledger = KeyIndex(log, PRINT, "ledger", buckets=1)
        told = sorted(file_prints(batch, columns).collect(), key=lambda r: r["_file"])  # max_files rows
        if not told:
            return
        prints = log.spark.createDataFrame([tuple(r[c] for c in PRINT) for r in told], "n_rows long, print_a string, print_b string")
        known = ledger.held(prints)
        seen = {tuple(r) for r in known.select(*PRINT).collect()} if known is not None else set()
        taken, refused = [], []
        for r in told:
            mark = tuple(r[c] for c in PRINT)
            (refused if mark in seen else taken).append(r["_file"])
            seen.add(mark)
        if not taken:
            return
        folder = log.new_folder("data")
        batch.where(F.col("_file").isin(taken)).drop("_file").write.parquet(f"{log.root}/{folder}")
        new = prints.distinct() if known is None else prints.distinct().join(known, PRINT, "left_anti")
        written = [{"path": p, "kind": "data"} for p in log.files_under(folder)]
        sketches = DistinctSketches(log, sketched, by)
        rows = log.spark.read.schema(schema).parquet(f"{log.root}/{folder}")
        log.commit(written + ledger.write(new) + (sketches.write(rows) if sketched else []), refused=refused)
        ledger.compact()
        sketches.compact()

    named = src.withColumn("_file", F.col("_metadata.file_path"))
    q = (named.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """A file once more under another name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


@query("stream_append_ingest", with_raw_ctes(landed_cte() + "\nSELECT * FROM landed"))
def q_stream_append_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Landed products dropped in 5 increments, ingested by a streaming append, then a file of the first one delivered
    again under another name; equals the batch table."""
    landed = landed_products(spark, sf)
    base = _folder(spark, "ingest")
    split = F.pmod(F.xxhash64("product_id", "source_store"), F.lit(5))
    land_in_batches(landed, f"{base}/landing", split)
    stream_append_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/_checkpoint", landed.schema)
    again = sorted(spark.read.schema(landed.schema).parquet(f"{base}/landing/*").inputFiles())[:1]
    for source in again:
        copy_file(spark, source, f"{base}/landing/drop=again/delivered-again.parquet")
    stream_append_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/_checkpoint", landed.schema)
    return CommitLog(spark, f"{base}/table").read(landed.schema)


@query("kpis_by_sketches", with_raw_ctes(landed_cte() + """
SELECT CASE WHEN grouping(source_store) = 1 THEN 'all stores' ELSE source_store END AS source_store,
  count(*) AS n_rows, count(DISTINCT category) AS n_category, count(DISTINCT brand) AS n_brand,
  count(DISTINCT source_store) AS n_source_store FROM landed GROUP BY GROUPING SETS ((source_store), ())"""))
def q_kpis_by_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Products, categories, brands and stores of each store and of all, merged from the sketches that a streaming
    ingest in 5 increments stored; no product row is read for it. With so few distinct values sketches are exact."""
    landed = landed_products(spark, sf)
    base = _folder(spark, "sketched")
    land_in_batches(landed, f"{base}/landing", F.pmod(F.xxhash64("product_id", "source_store"), F.lit(5)))
    columns, by = ["category", "brand", "source_store"], ["source_store"]
    stream_append_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/_checkpoint", landed.schema, max_files=8, sketched=columns, by=by)
    stored = DistinctSketches(CommitLog(spark, f"{base}/table"), columns, by)
    return stored.counts(by).unionByName(stored.counts().withColumn("source_store", F.lit("all stores")))


EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value"]


def stream_dedup(spark: SparkSession, landing: str, table: str, checkpoint: str, schema, keys: list[str],
                 order_cols: list[str], buckets: int = 16) -> None:
    """Append the rows of new drops whose key the table does not hold yet; of several new rows of a key the
    first by ``order_cols`` of the earliest drop. What keys are held is asked of the table's key index, not of state
    that a watermark ends: a re-delivery with another event time is recognised, a late first delivery is kept, and
    a micro-batch reads only index files that may hold its keys. Rows and keys become visible by one manifest
    entry, so a retried micro-batch finds its keys held, or nothing of itself."""
    src = spark.readStream.schema(schema).parquet(f"{landing}/*").withColumn("_file", F.col("_metadata.file_path"))

    def write_batch(batch: DataFrame, epoch: int) -> None:
        log = CommitLog(batch.sparkSession, table)
        index = KeyIndex(log, keys, buckets=buckets)
        batch = batch.withColumn("_drop", F.regexp_extract("_file", "drop=([0-9]+)", 1).cast("int")).drop("_file")
        first = materialize(dedup_keep_first(batch, keys, ["_drop", *order_cols]).drop("_drop"), "stream-first")
        held = index.held(first)
        if held is not None:
            same = [F.col(f"n.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in keys]
            first = first.alias("n").join(held.alias("h"), same, "left_anti")
        folder = log.new_folder("data")
        first.write.parquet(f"{log.root}/{folder}")
        files = log.files_under(folder)
        fresh = log.spark.read.schema(schema).parquet(f"{log.root}/{folder}")
        added = index.write(fresh.select(*keys))
        if added:
            log.commit([{"path": p, "kind": "data"} for p in files] + added)
            index.compact()

    q = (src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


#: Deliveries of ``events``: thirds of the time span in order, one event in ten two drops late; one in seven
#: arrives first with its time an hour off; everything is delivered again in the next drop, five hours off.
N_DROPS = 5
_PART = "least(floor((epoch_s - lo) * 3 / (hi - lo + 1)), 2) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END"
_DELIVERIES_SQL = f"""WITH e AS (SELECT *, epoch(ts) AS epoch_s, min(epoch(ts)) OVER () AS lo, max(epoch(ts)) OVER () AS hi FROM events),
d AS (SELECT *, CAST({_PART} AS INT) AS part FROM e),
deliveries AS (
  SELECT part, event_id, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts, user_id, event_type, value FROM d
  UNION ALL SELECT part + 1, event_id, ts + INTERVAL 5 HOUR, user_id, event_type, value FROM d WHERE part + 1 < {N_DROPS})
SELECT {", ".join(EVENT_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part, ts) AS rn FROM deliveries) x WHERE rn = 1"""


def event_deliveries(events: DataFrame) -> DataFrame:
    """The deliveries with their drop number ``part``."""
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    lo, hi = events.select(F.min(sec)).scalar(), events.select(F.max(sec)).scalar()
    late = F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    part = (F.least(F.floor((sec - lo) * 3 / (hi - lo + 1)), F.lit(2)) + late).cast("int")
    numbered = events.select(*EVENT_COLS).withColumn("part", part)
    first = numbered.withColumn("ts", F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")))
    again = numbered.withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 HOUR")).withColumn("part", F.col("part") + 1)
    return first.unionByName(again.where(F.col("part") < N_DROPS))


@query("stream_dedup", _DELIVERIES_SQL)
def q_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events delivered in 5 drops, out of order, late and again with another time, each drop taken in by its
    own streaming run; every event is kept once, as it came first."""
    ev = read_table(spark, sf, "events").select(*EVENT_COLS)
    base = _folder(spark, "dedup")
    land_in_batches(event_deliveries(ev), f"{base}/staged", F.col("part"))
    staged = spark.read.parquet(f"{base}/staged")
    for i in range(N_DROPS):
        staged.where(F.col("drop") == i).drop("drop").write.mode("overwrite").parquet(f"{base}/landing/drop={i}")
        stream_dedup(spark, f"{base}/landing", f"{base}/table", f"{base}/_checkpoint", ev.schema, ["event_id"], ["ts"], buckets=4)
    return CommitLog(spark, f"{base}/table").read(ev.schema)
