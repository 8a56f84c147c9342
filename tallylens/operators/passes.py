"""Passes that weigh hypotheses against code, declared types and load filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COLUMN, MISSING_IN_TARGET
from .classify import evidence, top
from .ingest import short_name

OWNER_DECIDE = "migration engineer + data owner (decide)"
SCALE = r"\(\s*\d+\s*,\s*(\d+)\s*\)"
#: A zoned type: LTZ, or TZ that no N stands before.
ZONED = r"(?i)(LTZ|(?<!N)TZ)"


def scale_of(text: Column) -> Column:
    """The scale in a type or cast, such as NUMBER(18,4); null without one."""
    return F.regexp_extract(text, SCALE, 1).try_cast("int")


def raised(confidence: Column, by: float, most: float) -> Column:
    return F.round(F.least(F.lit(most), F.greatest(confidence, F.lit(0.6)) + by), 2)


def stem(path: Column) -> Column:
    """A file's name without folders, ending and leading number, in lower case: the table that it makes."""
    name = F.lower(F.element_at(F.split(path, r"[/\\\\]"), -1))
    return F.regexp_replace(F.regexp_replace(name, r"[.][a-z0-9]+$", ""), r"^[0-9]+[_-]", "")


def issue_match(tables: DataFrame, issues: DataFrame) -> DataFrame:
    """Transpiler issues of the files named after a table. Both sides are small dimension tables."""
    name = short_name(F.col("target_table"))
    return tables.join(F.broadcast(issues), stem(issues["path"]) == name)


def code_pass(findings: DataFrame, hypotheses: DataFrame, transforms: DataFrame, types: DataFrame | None = None, filters: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """Adjusts each finding's top hypothesis by what the code says.

    transforms: table, column, expr, functions, is_direct, references (attribute names in expr);
    types: table, column, source_type; filters: table, target_filter; issues: table, severity, kind,
    message. Table names are short and lower-case; all four are small. A passthrough speaks against a
    transpilation cause, a derivation for one; a column that its derivation doesn't refer to is generated
    by the code, and must be looked at; a declared scale above the cast's, or a zoned type, confirms; a
    load filter explains missing rows."""
    spark = findings.sparkSession
    heads = top(hypotheses).join(findings.select("finding_id", "recon_type", "column", "target_table"), "finding_id").withColumn("table", short_name(F.col("target_table")))
    heads = heads.withColumn("col", F.lower("column"))
    t = transforms.select("table", F.lower("column").alias("col"), "expr", "functions", "is_direct", "references")
    heads = heads.join(F.broadcast(t), ["table", "col"], "left")
    empty = lambda s: spark.createDataFrame([], s)
    types = types if types is not None else empty("table string, column string, source_type string")
    filters = filters if filters is not None else empty("table string, target_filter string")
    heads = heads.join(F.broadcast(types.select("table", F.lower("column").alias("col"), "source_type")), ["table", "col"], "left")
    heads = heads.join(F.broadcast(filters), "table", "left")
    if issues is not None:
        said = issues.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("severity", "kind", "message"))).alias("issues"))
        heads = heads.join(F.broadcast(said), "table", "left")
    else:
        heads = heads.withColumn("issues", F.lit(None).cast("array<struct<severity:string,kind:string,message:string>>"))
    is_column = F.col("recon_type") == COLUMN
    direct = is_column & F.coalesce(F.col("is_direct"), F.lit(False))
    derived = is_column & ~F.coalesce(F.col("is_direct"), F.lit(True))
    generated = derived & ~F.exists("references", lambda r: F.lower(r) == F.col("col"))
    numeric = F.col("category").isin("type_precision", "transpilation")
    loses = is_column & numeric & F.coalesce(scale_of(F.col("source_type")) > scale_of(F.col("expr")), F.lit(False))
    zoned = is_column & (F.col("category") == "timezone") & F.coalesce(F.col("source_type").rlike(ZONED), F.lit(False))
    loads = (F.col("recon_type") == MISSING_IN_TARGET) & (F.coalesce("target_filter", F.lit("")) != "")
    c = F.col("confidence")
    c = F.when(direct & (F.col("category") == "transpilation"), F.round(c * 0.6, 2)).when(derived, raised(c, 0.1, 0.99)).otherwise(c)
    c = F.when(loses, raised(c, 0.1, 0.99)).when(zoned, raised(c, 0.05, 0.99)).otherwise(c)
    c = F.when(loads, raised(c, 0.2, 0.95)).otherwise(c)
    note = lambda cond, text: F.when(cond, F.array(evidence("code", text)))
    none = F.array().cast(hypotheses.schema["evidence"].dataType)
    before = F.coalesce(note(derived, F.concat(F.lit("Target derivation: "), F.col("expr"))), note(loads, F.concat(F.lit("A load filter explains missing rows: "), F.col("target_filter"))), none)
    after = [
        F.coalesce(note(direct, F.lit("Direct passthrough: no translated code is involved.")), none),
        F.coalesce(note(generated, F.lit("The code generates this value; the source column isn't carried over.")), none),
        F.coalesce(note(loses, F.concat(F.lit("Declared "), F.col("source_type"), F.lit("; the cast keeps fewer digits."))), note(zoned, F.concat(F.lit("Declared "), F.col("source_type"), F.lit(", a zoned time."))), note(is_column & numeric & F.col("source_type").isNotNull(), F.concat(F.lit("Declared "), F.col("source_type"), F.lit("."))), none),
        F.when(is_column & F.col("issues").isNotNull(), F.transform("issues", lambda i: evidence("transpile", F.concat_ws(" ", i["severity"], i["kind"], i["message"])))).otherwise(none),
    ]
    fresh = heads.select(
        "finding_id",
        F.col("seq"),
        c.alias("new_confidence"),
        F.when(generated & (F.col("verdict") == "genuine_data"), "needs_review").otherwise(F.col("verdict")).alias("new_verdict"),
        F.when(generated, OWNER_DECIDE).otherwise(F.col("owner")).alias("new_owner"),
        F.when(generated, "Decide whether the column is meant to be derived (leave it out of the comparison) or must carry the source's value.").otherwise(F.col("remediation")).alias("new_remediation"),
        F.concat(before, F.col("evidence"), *after).alias("new_evidence"),
        generated.alias("is_generated"),
    )
    out = hypotheses.join(fresh, ["finding_id", "seq"], "left")
    names = ("confidence", "verdict", "owner", "remediation", "evidence")
    kept = [F.coalesce(f"new_{n}", n).alias(n) if n in names else F.col(n) for n in hypotheses.columns]
    return out.select(*kept, F.coalesce("is_generated", F.lit(False)).alias("code_generated"))
