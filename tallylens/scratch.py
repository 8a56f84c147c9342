"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

class _Made(threading.local):
    """The folders that a thread has made and not dropped yet, in order."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all
    runs in one local JVM, a folder of our own that is then set as the session's checkpoint folder."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallylens-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    _made.paths.append(f"{shared_dir(spark)}/tallylens/{kind}-{uuid.uuid4().hex}")
    return _made.paths[-1]


def mark() -> int:
    """How many folders the thread has made and not dropped."""
    return len(_made.paths)


def materialize(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """Write df as Parquet (with the writer's options) in the shared folder and read it back: cuts the lineage without
    keeping blocks on executors, so a lost executor costs only the tasks that it was running."""
    spark = df.sparkSession
    path = fresh_dir(spark, kind)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_from(spark: SparkSession, first: int, keep: int = 0) -> None:
    """Deletes the folders that the thread made since mark() was `first`, but for the last `keep`: nothing may
    read them any more."""
    for path in _made.paths[first : mark() - keep]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _made.paths.remove(path)
