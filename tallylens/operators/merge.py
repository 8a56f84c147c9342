"""Upserts and repeatable loads on plain Parquet tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .meeting import quoted


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target after MERGE: rows with a key in changes are replaced, new keys are added; a null key is a key, so
    that the same changes twice change nothing more. Two changes of one key are an error, as which of them holds
    isn't known."""
    on = [quoted(k) for k in keys]
    same = F.count(F.lit(1)).over(Window.partitionBy(*on)) > 1
    once = F.when(same, F.raise_error(F.lit("two changes have the same key")))
    changes = changes.withColumn("_once", once).where("_once is null").drop("_once")
    new = changes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(on)])
    met = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(on)])
    columns = [quoted(c) for c in target.columns]
    return target.join(new, met, "left_anti").select(*columns).unionByName(changes.select(*columns))


def newer(rows: DataFrame, column: str, watermark) -> DataFrame:
    """Rows above the watermark; all if there is none."""
    return rows if watermark is None else rows.where(F.col(column) > F.lit(watermark))


def with_ingest_time(rows: DataFrame, name: str = "_ingest_ts") -> DataFrame:
    return rows.withColumn(name, F.current_timestamp())


def overwrite(rows: DataFrame, table: str, schema: str | None = None, location: str | None = None) -> None:
    """Replaces a table by rows with their load time. location: where a schema that is made new keeps its tables."""
    spark = rows.sparkSession
    if schema:
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema.replace('`', '``')}`{place}")
        table = f"{schema}.{table}"
    with_ingest_time(rows).write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)
