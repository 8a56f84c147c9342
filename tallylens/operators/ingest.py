"""Comparison tables to findings, samples and table summaries: two joins, whatever the number of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import COLUMN, MISSING_IN_SOURCE, MISSING_IN_TARGET, SAMPLE_CAP, SCHEMA

# Fixed value: names that look like a date or time column.
DATE_NAME = r"(?i)(date|dt|_ts|timestamp|time|day|month|year)"


def full_name(name: Column) -> Column:
    parts = F.filter(F.array(name["catalog"], name["schema"], name["table_name"]), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(parts, ".")


def short_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(name, "[.]"), -1), "`", ""))


def columns_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), F.trim), lambda x: x != "")


def date_column(names: Column) -> Column:
    return F.get(F.filter(names, lambda x: x.rlike(DATE_NAME)), F.lit(0))


def keys_of(row: Column) -> Column:
    """Entries of a mismatch map that are no comparison."""
    return F.map_filter(row, lambda k, v: ~k.rlike("(_base|_compare|_match)$"))


def tables(main: DataFrame, metrics: DataFrame, recon_id: str) -> DataFrame:
    """One row for each compared pair of a run, with its counts."""
    picked = main.where(F.col("recon_id") == F.lit(recon_id))
    m = F.col("recon_metrics")
    count = lambda c: F.coalesce(c.cast("string").try_cast("long"), F.lit(0))
    return picked.join(metrics, "recon_table_id", "left").select(
        "recon_table_id",
        "recon_id",
        full_name(F.col("source_table")).alias("source_table"),
        full_name(F.col("target_table")).alias("target_table"),
        count(m["source_record_count"]).alias("source_count"),
        count(m["target_record_count"]).alias("target_count"),
        count(m["row_comparison"]["missing_in_source"]).alias("missing_in_source"),
        count(m["row_comparison"]["missing_in_target"]).alias("missing_in_target"),
        count(m["column_comparison"]["absolute_mismatch"]).alias("absolute_mismatch"),
        columns_of(m["column_comparison"]["mismatch_columns"]).alias("mismatch_columns"),
        F.coalesce(m["schema_comparison"], F.lit(True)).alias("schema_ok"),
    )


def detail_rows(tables_: DataFrame, details: DataFrame) -> DataFrame:
    """Every detail map with its table and place."""
    met = details.join(tables_.select("recon_table_id", "mismatch_columns", "source_count"), "recon_table_id")
    return met.select("recon_table_id", "recon_type", "mismatch_columns", "source_count", F.posexplode_outer("data").alias("seq", "row"))


def column_samples(rows: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """recon_table_id, column, seq, keys, source_value, target_value of values that differ."""
    pairs = rows.where("recon_type = 'mismatch'").withColumn("column", F.explode("mismatch_columns"))
    name = lambda end: F.concat(F.col("column"), F.lit(end))
    row = F.col("row")
    base, other, match = (F.element_at(row, name(x)) for x in ("_base", "_compare", "_match"))
    has = F.map_contains_key(row, name("_base")) | F.map_contains_key(row, name("_compare"))
    differ = F.when(F.map_contains_key(row, name("_match")), F.lower(match) == "false").otherwise(~base.eqNullSafe(other))
    hit = pairs.where(has & differ)
    rank = F.row_number().over(Window.partitionBy("recon_table_id", "column").orderBy("seq"))
    hit = hit.withColumn("rank", rank).where(F.col("rank") <= cap)
    return hit.select("recon_table_id", "column", "seq", keys_of(row).alias("keys"), base.alias("source_value"), other.alias("target_value"))


def ingest(main: DataFrame, metrics: DataFrame, details: DataFrame, recon_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, samples, summaries) of one run."""
    pairs = tables(main, metrics, recon_id)
    rows = detail_rows(pairs, details)
    base = ["recon_table_id", "recon_id", "source_table", "target_table", "source_count"]
    samples = column_samples(rows)
    by = samples.groupBy("recon_table_id", "column").agg(F.count(F.lit(1)).alias("mismatch_count"))
    columns = by.join(pairs.select(*base), "recon_table_id").withColumn("recon_type", F.lit(COLUMN)).withColumn("total_count", F.col("source_count"))
    volume = pairs.select(*base, F.expr(f"stack(2, '{MISSING_IN_TARGET}', missing_in_target, '{MISSING_IN_SOURCE}', missing_in_source) as (recon_type, mismatch_count)")).where("mismatch_count > 0")
    volume = volume.withColumn("total_count", F.col("source_count")).withColumn("column", F.lit(None).cast("string"))
    bad = rows.where((F.col("recon_type") == "schema") & (F.lower(F.col("row")["is_valid"]) == "false"))
    schema = bad.groupBy("recon_table_id").agg(F.count(F.lit(1)).alias("mismatch_count")).join(pairs.select(*base), "recon_table_id")
    schema = schema.withColumn("recon_type", F.lit(SCHEMA)).withColumn("total_count", F.lit(0).cast("long")).withColumn("column", F.lit(None).cast("string"))
    findings = columns.unionByName(volume).unionByName(schema).drop("source_count")
    findings = findings.withColumn("finding_id", F.concat_ws("/", "recon_table_id", "recon_type", "column"))
    samples = samples.withColumn("finding_id", F.concat_ws("/", "recon_table_id", F.lit(COLUMN), "column"))
    first = rows.where("recon_type = 'mismatch' and row is not null").groupBy("recon_table_id").agg(F.min_by(F.map_keys(keys_of(F.col("row"))), "seq").alias("join_keys"))
    whole = rows.where("recon_type like 'missing%' and row is not null").groupBy("recon_table_id").agg(F.min_by(F.map_keys("row"), "seq").alias("row_keys"))
    none = F.array().cast("array<string>")
    summaries = pairs.join(first, "recon_table_id", "left").join(whole, "recon_table_id", "left")
    summaries = summaries.withColumn("join_keys", F.coalesce("join_keys", none))
    summaries = summaries.withColumn("date_column", date_column(F.concat(F.col("mismatch_columns"), F.col("join_keys"), F.coalesce("row_keys", none)))).drop("row_keys")
    return findings, samples, with_rates(summaries)


def with_rates(summaries: DataFrame) -> DataFrame:
    """Adds common and matched rows and the row match percentage."""
    common = F.greatest(F.col("source_count") - F.col("missing_in_target"), F.lit(0))
    out = summaries.withColumn("common_rows", common).withColumn("matched_rows", F.greatest(F.col("common_rows") - F.col("absolute_mismatch"), F.lit(0)))
    pct = F.when(F.col("source_count") > 0, F.round(100.0 * F.try_divide("matched_rows", "source_count"), 2)).otherwise(100.0)
    return out.withColumn("row_match_pct", pct)
