"""Dialect packs: type mappings, functions whose meaning differs, and remediation by category.

Fixed values in a pack: the names of source types, functions and categories. Functions that share a remark are
listed one by one, as a name is looked for in code by itself. Remarks and remedies are our own."""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import DataFrame, SparkSession


def load(dialect: str = "snowflake") -> dict:
    """The pack of a dialect; an empty one where there is none."""
    file = resources.files(__name__) / f"{dialect.lower()}.json"
    return json.loads(file.read_text()) if file.is_file() else {"type_mappings": [], "function_diffs": [], "remediation": {}}


def risky_functions(pack: dict) -> list[str]:
    return [f["function"] for f in pack["function_diffs"]]


def remediation(spark: SparkSession, pack: dict) -> DataFrame:
    return spark.createDataFrame(sorted(pack["remediation"].items()), "category string, remediation string")
