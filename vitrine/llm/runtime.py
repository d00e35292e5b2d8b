"""Session preparation, shared-folder tables and size-derived partition counts for the llm operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import ensure_checkpoint_dir, ship_package, tables_root

#: Rows of a batch sent to a Python worker: texts average some kB, so a batch stays at some MB.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Make the session fit for the Arrow operators (idempotent)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: Spark's setting that removes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: the lineage ends here, so a
    lost executor costs a re-read. The shuffle files of the write are removed when it ends."""
    spark = df.sparkSession
    path = f"{tables_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the inputs of a plan (file sizes for scans) as the optimizer knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(df: DataFrame, bytes_per_bucket: int = 8 << 20, least: int = 16) -> int:
    """Number of hash buckets for packed postings: grows with the input, so a bucket stays the same
    size at every scale. Never under ``least`` nor under the session's shuffle partitions."""
    return max(least, parallelism(df.sparkSession), -(-input_bytes(df) // bytes_per_bucket))


def words_pattern() -> str:
    """A word: a run of anything but the six ASCII white-space characters."""
    return "[^\\x20\\x09-\\x0D]+"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) only, null texts as empty. Ids are whole numbers, or strings of them; other strings are an error."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a one-element array is transformed)."""
    return F.transform(F.array(value), body)[0]
