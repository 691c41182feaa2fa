"""Session helpers: a configured local session for tests and tools, and
lineage cutting through the cluster's shared checkpoint directory."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Session settings every job relies on.  Timestamps are compared as UTC,
# AQE re-plans joins and coalesces small shuffles at runtime, and Arrow
# batches into Python are bounded in bytes as well as rows so one batch of
# large source files cannot exhaust a Python worker.
SESSION_DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "riskfold") -> SparkSession:
    """A local session for tests, tools and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting a scratch one only when the
    session has none (local tests).  On a cluster ``spark.checkpoint.dir``
    names a shared folder and is used as-is."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: lineage is cut through it")
        configured = tempfile.mkdtemp(prefix="riskfold-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise ``df`` as a parquet table in the reliable checkpoint
    directory and continue from it.

    Later reads (several passes, a lost executor) see exactly the rows that
    were written instead of recomputing -- and possibly re-sampling or
    re-ordering -- the plan that produced them.  One write, one job (a
    reliable RDD checkpoint would compute its input twice); never local.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint directory, which ``drop_intermediate``
    clears with the tables of ``cut_lineage``."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


#: Paths that this process has taken through ``scratch_path``.
_WRITTEN: list[str] = []


def drop_intermediate(spark: SparkSession) -> int:
    """Delete the tables that ``cut_lineage`` has written so far; the number
    of tables.  Results are computed from them when they are read, so call
    this once a job's results are written."""
    jvm = spark.sparkContext._jvm
    gone = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        gone += bool(fs.delete(path, True))
    return gone


def ship_package(spark: SparkSession) -> None:
    """Make ``riskfold`` importable in Python workers (once per context).

    Functions handed to ``mapInArrow`` are pickled by reference, so workers
    import this package.  The sources are zipped and added with
    ``addPyFile`` -- Spark's own code-shipping path, the equivalent of
    ``--py-files`` -- so jobs work whatever the driver's working directory.
    """
    import zipfile

    import riskfold

    sc = spark.sparkContext
    if getattr(sc, "_riskfold_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(riskfold.__file__))
    root = os.path.dirname(pkg_dir)
    out = tempfile.mkdtemp(prefix="riskfold-pyfiles-")
    archive = os.path.join(out, "riskfold.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    sc._riskfold_shipped = True
