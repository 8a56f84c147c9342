"""Data model: names, categories, verdicts and the schemas of the comparison tables."""

from __future__ import annotations

from pyspark.sql import types as T

COLUMN, MISSING_IN_TARGET, MISSING_IN_SOURCE, SCHEMA = "column_mismatch", "missing_in_target", "missing_in_source", "schema"
#: The order in which a table's findings are shown.
KINDS = (SCHEMA, MISSING_IN_TARGET, MISSING_IN_SOURCE, COLUMN)

# Root-cause categories.
CATEGORIES = (
    "type_precision",
    "timezone",
    "semi_structured",
    "string_format",
    "transpilation",
    "volume_missing",
    "volume_extra",
    "upstream_drift",
    "null_boolean",
    "env_config",
    "recon_config",
    "unknown",
)
# Verdicts, in the order of reports.
VERDICTS = ("migration_induced", "genuine_data", "benign", "needs_review")
#: Text that stands for NULL in detail rows.
NULL_TEXT = "_null_recon_"
#: Detail rows kept of each kind and column.
SAMPLE_CAP = 200

_name = T.StructType([T.StructField("catalog", T.StringType()), T.StructField("schema", T.StringType()), T.StructField("table_name", T.StringType())])
MAIN = T.StructType(
    [T.StructField("recon_table_id", T.LongType()), T.StructField("recon_id", T.StringType()), T.StructField("source_table", _name), T.StructField("target_table", _name)]
)
METRICS = T.StructType(
    [
        T.StructField("recon_table_id", T.LongType()),
        T.StructField(
            "recon_metrics",
            T.StructType(
                [
                    T.StructField("source_record_count", T.LongType()),
                    T.StructField("target_record_count", T.LongType()),
                    T.StructField("row_comparison", T.StructType([T.StructField("missing_in_source", T.LongType()), T.StructField("missing_in_target", T.LongType())])),
                    T.StructField("column_comparison", T.StructType([T.StructField("absolute_mismatch", T.LongType()), T.StructField("mismatch_columns", T.StringType())])),
                    T.StructField("schema_comparison", T.BooleanType()),
                ]
            ),
        ),
    ]
)
DETAILS = T.StructType(
    [
        T.StructField("recon_table_id", T.LongType()),
        T.StructField("recon_type", T.StringType()),
        T.StructField("data", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)
SIGNAL = "struct<category:string,strength:double,detail:string,meta:map<string,string>>"
EVIDENCE = "struct<label:string,detail:string,query:string,data:map<string,string>>"
