"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "equilens",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one with sane defaults.

    On a cluster the session already exists (spark-submit / notebook) and is
    returned unchanged; the builder only fills in what is unset.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    b = (SparkSession.builder
         .master(master or f"local[{cpus}]")
         .appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # Remove checkpoint files once the DataFrames that own them are gone.
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", os.environ.get("EQUILENS_DRIVER_MEMORY", "6g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    return spark.sparkContext.getCheckpointDir()


def own_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder, for a session whose driver and executors are one process.
    On a cluster it would be the driver's disk alone, so there it is an error."""
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None) -> str:
    """Use the configured checkpoint folder; set ``fallback`` (or, with a local
    master, a temporary folder) only when unset (tests, local benches)."""
    d = checkpoint_dir(spark)
    if not d:
        d = fallback or own_folder(spark, "equilens-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a table that several jobs read, by a reliable checkpoint
    in the folder the cluster names (a temporary folder only where none is
    set), which survives the loss of the executors that computed it."""
    ensure_checkpoint_dir(df.sparkSession, None)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per context), so
    that jobs with Python functions run wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_equilens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="equilens-ship-"), "equilens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._equilens_shipped = True
