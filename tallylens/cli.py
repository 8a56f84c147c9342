"""Command line: analyses one comparison run and writes JSON and a notebook."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from . import reports
from .operators import lineage
from .plans.analyze import analyze
from .sources import artifacts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallylens", description=__doc__)
    # The names of the flags.
    p.add_argument("--recon-id", required=True)
    p.add_argument("--recon-catalog", default="")
    p.add_argument("--recon-schema", required=True)
    p.add_argument("--dialect", default="snowflake")
    p.add_argument("--output-path", default="recon_output")
    p.add_argument("--no-drilldown", action="store_true")
    for name in ("recon-config", "transpiled-output", "transpile-errors", "source-scripts", "table-manifest"):
        p.add_argument(f"--{name}")
    p.add_argument("--column-lineage", help="table with column lineage")
    p.add_argument("--table-lineage", help="table with table lineage")
    p.add_argument("--today", help="date from which lineage looks back; the current one by default")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tallylens").getOrCreate()
    prefix = ".".join(x for x in (a.recon_catalog, a.recon_schema) if x)
    entries = artifacts.manifest(spark, a.table_manifest) if a.table_manifest else None
    mapping = artifacts.build_mapping(spark, config=a.recon_config, translated_sql=a.transpiled_output, error_log=a.transpile_errors, source_scripts=a.source_scripts, manifest_entries=entries)
    tables = [spark.table(f"{prefix}.{n}") for n in ("main", "metrics", "details")]
    ups = None
    if a.column_lineage:
        from pyspark.sql import functions as F

        pairs = tables[0].where(F.col("recon_id") == a.recon_id)
        from .operators.ingest import full_name

        today = a.today or spark.sql("select current_date()").first()[0]
        ups = lineage.upstreams(spark.table(a.column_lineage), spark.table(a.table_lineage) if a.table_lineage else None, pairs.select(full_name(F.col("target_table")).alias("target_table")), today=today)
    result = analyze(spark, *tables, a.recon_id, dialect=a.dialect, table=None if a.no_drilldown else spark.table, mapping=mapping, upstreams=ups)
    os.makedirs(a.output_path, exist_ok=True)
    reports.write_json(result, f"{a.output_path}/{a.recon_id}.json")
    reports.write_notebook(result, f"{a.output_path}/{a.recon_id}.ipynb")
    print(reports.tldr(reports.findings(result)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
