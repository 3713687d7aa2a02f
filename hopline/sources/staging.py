"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from hopline.errors import StoreError

_cleared: set[str] = set()

#: Hadoop's local file system sets permissions by a child process, twice for a file with a checksum file and once
#: for one without; each child shares the executor's memory until it runs.  Staged tables go without checksum files.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where everything runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not available(spark):
        raise StoreError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="hopline-")
    atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def available(spark: SparkSession) -> bool:
    """Whether there is a shared folder to stage in."""
    master = spark.sparkContext.master
    return spark.conf.get("spark.checkpoint.dir", None) is not None or master == "local" or master.startswith("local[")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/hopline-{spark.sparkContext.applicationId}"
    if path not in _cleared:
        _cleared.add(path)
        atexit.register(_quietly_clear, *_at(spark, path))  # looked up now, for the session may be stopped by then
    return path


def _at(spark: SparkSession, path: str):
    """The Hadoop file system and path of a name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def _quietly_clear(fs, at) -> None:
    try:
        fs.delete(at, True)
    except Exception:  # noqa: BLE001 - the gateway may be gone, and with it the application
        pass


def clear(spark: SparkSession) -> None:
    """Delete what this application has staged; no result that still reads it may be in use."""
    delete(spark, own_dir(spark))


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` and read it back: cuts lineage, survives lost executors.  ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{**PLAIN_FILES, **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hopline_path = path
    return out


def drop(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(staged, "_hopline_path", None)
    if path:
        delete(staged.sparkSession, path)
