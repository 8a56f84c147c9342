"""Settings of a run, from JSON with defaults, and where its files go."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

from ..operators import merge


@dataclass
class Config:
    recon_catalog: str = ""
    recon_schema: str = ""
    dialect: str = "snowflake"
    output_dir: str = "recon_output"
    recon_config_path: str | None = None
    transpiled_output_dir: str | None = None
    source_scripts_dir: str | None = None
    transpile_error_file: str | None = None
    tables: list[dict] = field(default_factory=list)
    use_lineage: bool = False


def load(path: str | None) -> Config:
    """The settings in a file over the defaults."""
    if not path or not os.path.exists(path):
        return Config()
    with open(path) as f:
        return parse(f.read())


def parse(text: str) -> Config:
    """Settings in JSON over the defaults; null and names that aren't settings are ignored."""
    given = json.loads(text)
    known = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in given.items() if k in known and v is not None})


def output_dir(spark: SparkSession, name: str) -> str:
    """An absolute name as it is, another below the user's home, or below /tmp where that can't be written."""
    if os.path.isabs(name):
        return name
    user = re.sub(r"[^\w.@-]", "_", spark.sql("select current_user()").first()[0])
    for base in (os.path.expanduser("~"), f"/tmp/{user}"):
        if os.access(base, os.W_OK):
            return os.path.join(base, name)
    return os.path.join("/tmp", name)


def layers(spark: SparkSession, steps: list[tuple[str, str]]) -> None:
    """Runs (table, SQL) steps in order, each over the tables before it: bronze, silver, gold. A table can be
    replaced while nothing reads it, so a step may not read its own."""
    for table, sql in steps:
        merge.overwrite(spark.sql(sql), table)
