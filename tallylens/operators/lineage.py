"""Evidence from lineage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import COLUMN
from .classify import evidence, top
from .ingest import short_name


def upstreams(column_lineage: DataFrame, table_lineage: DataFrame | None, targets: DataFrame, *, today, lookback_days: int = 90) -> DataFrame:
    """target_table, column (null from table lineage), upstream: distinct, of the last lookback_days.

    targets(target_table). Table lineage serves only targets that column lineage doesn't know."""
    want = targets.select(F.lower("target_table").alias("t")).distinct()

    def recent(df: DataFrame) -> DataFrame:
        df = df.where(F.col("source_table_full_name").isNotNull() & (F.col("event_date") >= F.date_sub(F.lit(today).cast("date"), lookback_days)))
        return df.withColumn("t", F.lower("target_table_full_name")).join(want, "t")

    fine = recent(column_lineage).select("t", F.lower("target_column_name").alias("column"), F.col("source_table_full_name").alias("upstream")).distinct()
    if table_lineage is None:
        return fine
    left = recent(table_lineage).join(fine.select("t").distinct(), "t", "left_anti")
    return fine.unionByName(left.select("t", F.lit(None).cast("string").alias("column"), F.col("source_table_full_name").alias("upstream")).distinct())


def by_table(ups: DataFrame) -> DataFrame:
    return ups.groupBy("t").agg(F.sort_array(F.collect_set("upstream")).alias("upstream_tables"))


def by_column(ups: DataFrame) -> DataFrame:
    return ups.where("column is not null").groupBy("t", "column").agg(F.sort_array(F.collect_set("upstream")).alias("upstreams"))


def lineage_pass(findings: DataFrame, hypotheses: DataFrame, ups: DataFrame) -> DataFrame:
    """Adds lineage evidence to top hypotheses; says so when a column has one upstream table and it isn't
    the source that the comparison expects."""
    heads = top(hypotheses).select("finding_id", "seq").join(findings, "finding_id").withColumn("t", F.lower("target_table"))
    met = heads.withColumn("col", F.lower("column")).join(by_column(ups).withColumnRenamed("column", "col"), ["t", "col"], "left").join(by_table(ups), "t", "left")
    is_column = F.col("recon_type") == COLUMN
    wrong = is_column & (F.size("upstreams") == 1) & ~F.contains(F.lower(F.get("upstreams", F.lit(0))), short_name(F.col("source_table")))
    shown = F.when(is_column, F.col("upstreams")).when(F.col("recon_type").like("missing%"), F.col("upstream_tables"))
    text = F.concat(F.lit("Fed by "), F.array_join(shown, ", "), F.when(wrong, F.lit("; not the source it is compared with.")).otherwise(F.lit("")))
    notes = met.where(F.size(shown) > 0).select("finding_id", "seq", F.array(evidence("lineage", text)).alias("note"))
    out = hypotheses.join(notes, ["finding_id", "seq"], "left")
    return out.select(*[F.when(F.col("note").isNotNull(), F.concat("evidence", "note")).otherwise(F.col("evidence")).alias(c) if c == "evidence" else F.col(c) for c in hypotheses.columns])
