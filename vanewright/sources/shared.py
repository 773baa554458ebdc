"""A folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where none is set (a local session) below a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif spark.sparkContext.master.startswith("local"):
            local = tempfile.mkdtemp(prefix="vanewright-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            path = f"file://{local}"
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: what was computed once stays as it was, whichever executors
    are lost. It is deleted when the session's process ends."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already: nothing is left to talk to
        pass
