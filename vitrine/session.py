"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vitrine") -> SparkSession:
    """Local/test session. On a cluster the submitted session is used as is."""
    master = master or os.environ.get("VITRINE_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("VITRINE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VITRINE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session has none and runs in local mode (tests) a scratch folder is created here; on
    a cluster a machine-local folder would not be seen by the executors, so an unset one is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="vitrine-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that functions which run there
    import it wherever the executors were started."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="vitrine-pkg-"), "vitrine_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("vitrine", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


#: Spark's settings that remove an execution's shuffle files when it ends, and that bound the bytes a task reads.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPLIT = "spark.sql.files.maxPartitionBytes"


def materialize(df, name: str, split: str | None = None):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage at a layer boundary (later stages that run several actions over it, such as a
    scalar subquery plus the main query, read the files instead of recomputing the plan; a lost
    executor costs a re-read, not a recompute). The shuffle files of the write are removed when it ends.
    ``split`` cuts the tables it reads finer than the session would: a task of few rows sorts them in memory.
    """
    spark = df.sparkSession
    path = new_table(spark, name)
    during = {_CLEANUP: "true"} | ({_SPLIT: split} if split else {})
    before = {k: spark.conf.get(k, None) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.parquet(path)


def new_table(spark, name: str) -> str:
    """A folder of its own for a table of this application."""
    return f"{tables_root(spark)}/{name}-{uuid.uuid4().hex}"


def tables_root(spark) -> str:
    """Folder of this application's materialised tables (one per Spark application)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vitrine-tables/{spark.sparkContext.applicationId}"


def drop_tables(spark) -> bool:
    """Delete this application's materialised tables (call at the end of a run); clears layer reuse."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(tables_root(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    app = spark.sparkContext.applicationId
    for key in [k for k in _LAYERS if k[0] == app]:
        del _LAYERS[key]
    return bool(fs.delete(root, True)) if fs.exists(root) else False


_LAYERS: dict = {}


def _fs_version(spark, paths) -> tuple:
    """(path, length, modification time) of every input, through the Hadoop file system API."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        st = fs.getContentSummary(hp)
        out.append((p, st.getLength(), fs.getFileStatus(hp).getModificationTime()))
    return tuple(out)


def _exists(spark, path: str) -> bool:
    jvm = spark._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp)


def cached_layer(spark, name: str, inputs: list[str], params, build):
    """A written layer (or a fitted model) computed once per session and input version.

    ``build()`` returns the layer DataFrame (already materialised under the checkpoint folder); it
    is reused while the input files keep their length and modification time and the layer files
    exist, as a downstream step of the original reads the processed table its preprocessing wrote.
    """
    key = (spark.sparkContext.applicationId, name, _fs_version(spark, inputs), repr(params))
    hit = _LAYERS.get(key)
    if hit is not None and (not hasattr(hit, "inputFiles") or all(_exists(spark, p) for p in hit.inputFiles()[:1])):
        return hit
    df = build()
    _LAYERS[key] = df
    return df
