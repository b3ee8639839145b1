"""Outputs that are replaced as a whole.

Overwriting a folder deletes the former output before the new one is written,
so a job that dies in between leaves neither.  :func:`publish` writes to a
folder of its own under ``path`` and then appends one line to a manifest that names
it; readers take the version that the manifest named last (:func:`current`).  The
line is a file that Spark's writer moves into place when its job commits, so a
reader sees the former version or the new one, never half of one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "number long, version string"


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_SCHEMA).json(f"{path}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the published versions, the latest first; one line a publication."""
    found = _manifest(spark, path)
    if found is None:
        return []
    # Of two writers that took one number the greater name counts, for every reader.
    return [f"{path}/{r['version']}" for r in found.orderBy(F.desc("number"), F.desc("version")).collect()]


def current(spark: SparkSession, path: str) -> str:
    """The folder to read: the latest version, or ``path`` itself if nothing was published there."""
    return next(iter(versions(spark, path)), path)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Calls ``write`` with a new folder and, when it has returned, names that folder
    in the manifest.  Returns the folder."""
    version = f"version-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    found = _manifest(spark, path)
    number = 0 if found is None else (found.agg(F.max("number")).first()[0] or 0)
    spark.createDataFrame([(number + 1, version)], _SCHEMA).coalesce(1).write.mode("append").json(f"{path}/_manifest")
    return f"{path}/{version}"


def clean(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes version folders beyond the ``keep`` latest and those that were never
    published; no writer may be at work.  Returns what was deleted."""
    kept = set(versions(spark, path)[:max(1, keep)])
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("version-") and f"{path}/{name}" not in kept:
            fs.delete(status.getPath(), True)
            gone.append(f"{path}/{name}")
    return gone
