"""Signals to ranked hypotheses, and the freshness pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probes
from ..schemas import COLUMN, EVIDENCE, MISSING_IN_TARGET, SCHEMA

#: Categories that a migration causes, once the evidence is strong enough.
MIGRATION = ["type_precision", "timezone", "string_format", "transpilation", "volume_missing", "volume_extra", "null_boolean", "env_config"]
OWNER_GENUINE, OWNER_MIGRATION = "data owner / source team", "migration engineer"


def verdict(category: Column, strength: Column, provenance: Column) -> Column:
    return (
        F.when(provenance | (category == "upstream_drift"), "genuine_data")
        .when(category == "semi_structured", F.when(strength >= 0.8, "benign").otherwise("needs_review"))
        .when(category.isin(MIGRATION) & (strength >= 0.5), "migration_induced")
        .otherwise("needs_review")
    )


def owner(verdict_: Column) -> Column:
    return F.when(verdict_ == "genuine_data", OWNER_GENUINE).otherwise(OWNER_MIGRATION)


def evidence(label: str, detail: Column, query: Column | None = None, data: Column | None = None) -> Column:
    return F.struct(F.lit(label).alias("label"), detail.alias("detail"), (query if query is not None else F.lit(None)).cast("string").alias("query"), (data if data is not None else F.lit(None)).cast("map<string,string>").alias("data")).cast(EVIDENCE)


def sample_signals(samples: DataFrame) -> DataFrame:
    """finding_id, seq, place (of the signal in its sample), signal: one row for each that fired."""
    found = probes.with_signals(samples, "source_value", "target_value")
    return probes.each_signal(found, "finding_id", "seq")


def classify_columns(findings: DataFrame, samples: DataFrame, provenance_wide: bool = True) -> DataFrame:
    """Hypotheses of column findings: one for each category that fired, or an unknown one.

    provenance_wide: one sample that shows another origin makes every category of the finding genuine."""
    columns = findings.where(F.col("recon_type") == COLUMN).select("finding_id")
    fired = sample_signals(samples).join(columns, "finding_id", "left_semi")
    sizes = samples.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n_samples"))
    at = F.struct("seq", "place")
    origin = F.coalesce(F.try_element_at(F.col("signal.meta"), F.lit("provenance_candidate")) == "true", F.lit(False))
    by = fired.withColumn("at", at).withColumn("origin", origin).groupBy("finding_id", F.col("signal.category").alias("category"))
    by = by.agg(
        F.avg("signal.strength").alias("strength"),
        F.count(F.lit(1)).alias("n_signals"),
        F.min("at").alias("at"),
        F.min_by("signal.detail", "at").alias("rationale"),
        F.max("origin").alias("origin"),
        F.slice(F.array_sort(F.collect_list(F.struct("at", F.col("signal.detail").alias("detail"), F.map_entries("signal.meta").alias("meta")))), 1, 3).alias("first"),  # a sample has few signals, a finding few samples
    )
    over = Window.partitionBy("finding_id")
    provenance = F.max("origin").over(over) if provenance_wide else F.col("origin")
    rows = by.withColumn("provenance", provenance).join(sizes, "finding_id")
    raw = F.col("strength") * (0.5 + 0.5 * F.col("n_signals") / F.col("n_samples"))
    decided = verdict(F.col("category"), F.col("strength"), F.col("provenance"))
    # Findings without a signal stay in the left join and are unknown.
    rows = columns.join(rows, "finding_id", "left")
    none = F.array().cast(f"array<{EVIDENCE}>")
    return rows.select(
        "finding_id",
        F.coalesce("category", F.lit("unknown")).alias("category"),
        F.when(F.col("category").isNull(), "needs_review").otherwise(decided).alias("verdict"),
        F.coalesce(F.round(F.least(raw, F.lit(0.99)), 2), F.lit(0.2)).alias("confidence"),
        F.coalesce("rationale", F.lit("No probe explains the difference.")).alias("rationale"),
        F.coalesce(F.transform("first", lambda x: evidence("probe", x["detail"], data=F.map_from_entries(x["meta"]))), none).alias("evidence"),
        F.row_number().over(over.orderBy("at")).alias("seq"),
    )


def _fixed(rows: DataFrame, category: Column | str, verdict_: str, confidence: float, rationale: str) -> DataFrame:
    category = F.lit(category) if isinstance(category, str) else category
    none = F.array().cast(f"array<{EVIDENCE}>")
    return rows.select("finding_id", category.alias("category"), F.lit(verdict_).alias("verdict"), F.lit(confidence).alias("confidence"), F.lit(rationale).alias("rationale"), none.alias("evidence"), F.lit(1).alias("seq"))


def classify(findings: DataFrame, samples: DataFrame, remediation: DataFrame | None = None, **params) -> DataFrame:
    """Hypotheses of all findings: finding_id, category, verdict, confidence, rationale, evidence, seq, owner,
    remediation."""
    volume = findings.where(F.col("recon_type").like("missing%"))
    kind = F.when(F.col("recon_type") == MISSING_IN_TARGET, "volume_missing").otherwise("volume_extra")
    out = classify_columns(findings, samples, **params)
    out = out.unionByName(_fixed(volume, kind, "migration_induced", 0.6, "Row counts differ between the tables."))
    out = out.unionByName(_fixed(findings.where(F.col("recon_type") == SCHEMA), "type_precision", "migration_induced", 0.7, "Column names or types differ."))
    out = out.withColumn("owner", owner(F.col("verdict")))
    if remediation is None:
        return out.withColumn("remediation", F.lit(""))
    return out.join(F.broadcast(remediation), "category", "left").withColumn("remediation", F.coalesce("remediation", F.lit("")))  # a dozen rows


def top(hypotheses: DataFrame) -> DataFrame:
    """The hypothesis of each finding with the greatest confidence; ties go to the one that fired first."""
    order = Window.partitionBy("finding_id").orderBy(F.desc("confidence"), "seq")
    return hypotheses.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def freshness_pass(findings: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """In a table where a column's top hypothesis is upstream drift, unexplained partial differences of
    other columns are put down to the same drift."""
    heads = top(hypotheses).join(findings, "finding_id")
    stale = heads.where((F.col("recon_type") == COLUMN) & (F.col("category") == "upstream_drift")).select("target_table").distinct()
    partial = heads.where((F.col("recon_type") == COLUMN) & (F.col("category") == "unknown") & (F.col("mismatch_count") < F.col("total_count")))
    hit = partial.join(stale, "target_table", "left_semi").select("finding_id", F.lit(True).alias("stale"))
    out = hypotheses.join(hit, "finding_id", "left")
    put = lambda name, value: F.when(F.col("stale"), F.lit(value)).otherwise(F.col(name)).alias(name)
    new = {"category": "upstream_drift", "verdict": "genuine_data", "confidence": 0.55, "rationale": "Other columns of the table were taken at another moment.", "owner": OWNER_GENUINE}
    return out.select(*[put(c, new[c]) if c in new else F.col(c) for c in hypotheses.columns])


def verdict_counts(heads: DataFrame) -> DataFrame:
    """Findings per verdict, with zeros."""
    from ..schemas import VERDICTS

    spark = heads.sparkSession
    every = spark.createDataFrame([(v, i) for i, v in enumerate(VERDICTS)], "verdict string, place int")
    counted = heads.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "verdict", "left").select("verdict", "place", F.coalesce("n", F.lit(0)).alias("n"))
