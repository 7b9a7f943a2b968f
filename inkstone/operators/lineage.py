"""Cutting the lineage of iterative operators by a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where Spark is one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def remove(uri: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        shutil.rmtree(parts.path, ignore_errors=True)
        return
    from pyarrow import fs

    try:
        store, path = fs.FileSystem.from_uri(uri)
        store.delete_dir(path)
    except OSError:  # not there, or gone with its store
        pass


def made(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing else uses; it goes when the driver ends, if nothing removes it before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    return path


def cut(df: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """``df`` written and read again: what comes after does not compute it a second time. ``after`` is an earlier cut that
    ``df`` alone read, which is deleted then."""
    path = made(df.sparkSession, "cut")
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.cut_at = path
    if after is not None:
        remove(after.cut_at)
    return again
