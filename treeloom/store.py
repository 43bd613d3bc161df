"""Tables that cut lineage, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset in local mode (tests), else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + (own := tempfile.mkdtemp(prefix="treeloom-"))
        atexit.register(shutil.rmtree, own, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_folders: set[str] = set()


def _run_folder(spark: SparkSession) -> str:
    """The folder of this application's tables, which release() removes, at the end of the session if not before."""
    folder = f"{shared_folder(spark)}/treeloom-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_leave, spark, folder)
    return folder


def _leave(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can't remove anything
        discard(spark, folder)


def release(spark: SparkSession) -> None:
    """Removes all tables that operators have written in this application; results that are not stored elsewhere go with them."""
    discard(spark, _run_folder(spark))


def materialise(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: the plan above it starts from the files."""
    path = f"{_run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
