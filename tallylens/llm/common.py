"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_from, fresh_dir, mark, materialize, shared_dir  # noqa: F401

#: White space that separates words in the word contracts, as a character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that it needn't be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_tallylens_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tallylens-")) / "tallylens.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(target))
    sc._tallylens_shipped = True


def lean(run):
    """run, a function over Arrow batches, that gives memory back when its task ends: Python workers serve task
    after task and would keep what their largest one took."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return wrapped


def in_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Ready the session for functions over whole texts: the package is shipped, and what one Arrow batch
    can hold is bounded in rows and bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)


#: Rows of a small table that may be broadcast, and places that the rows of one key meet it in if it has more.
SMALL, SALTS = 100_000, 32


def join_spread(big: DataFrame, small: DataFrame, on: str, by: str, width: int = 1) -> DataFrame:
    """big with the columns of small's one row for its key. A small table, counted first (its rows are `width` of a
    broadcast's), is broadcast; else the key's rows are dealt by the column `by`, so that a hot key is spread."""
    if small.count() * width <= SMALL:
        return big.join(F.broadcast(small), on)
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.hash(by), F.lit(SALTS))).join(spread, [on, "_salt"]).drop("_salt")
