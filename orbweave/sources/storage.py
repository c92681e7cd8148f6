"""Intermediate tables in the folder that driver and executors share.

What is stored is deleted as soon as nothing to come reads it (``discard``), and all the rest when the process ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orbweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of this process, deleted with it."""
    path = f"{shared_dir(spark)}/orbweave/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made[path] = None
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage there."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing to come will read."""
    for df in tables:
        _delete(df.sparkSession._jvm, df.stored_at)
        _made.pop(df.stored_at, None)


def _delete(jvm, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    running = SparkContext._active_spark_context
    conf = running._jsc.hadoopConfiguration() if running is not None else jvm.org.apache.hadoop.conf.Configuration()
    path.getFileSystem(conf).delete(path, True)


def _sweep() -> None:
    gateway = SparkContext._gateway
    for folder in list(_made) if gateway is not None else ():
        try:
            _delete(gateway.jvm, folder)
        except Exception:  # noqa: BLE001  the JVM is gone already: nothing left to ask
            return
