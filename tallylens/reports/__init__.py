"""Reports of an analysis: tables as DataFrames, and Markdown, JSON and notebook files of its few findings."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import COLUMN, KINDS, VERDICTS

#: Characters of a rationale and of a fix in summaries.
RATIONALE, FIX = 110, 130


def tally(heads: DataFrame, by: str) -> DataFrame:
    """Findings per verdict of each value of a column, with zeros."""
    return heads.groupBy(by).pivot("verdict", list(VERDICTS)).agg(F.count(F.lit(1))).fillna(0, list(VERDICTS))


def overview(analysis) -> DataFrame:
    """For each table: findings per verdict, missing rows, and the columns that differ."""
    heads = analysis.top()
    columns = heads.where(F.col("recon_type") == COLUMN).groupBy("target_table").agg(F.sort_array(F.collect_list("column")).alias("columns"))
    rows = analysis.summaries.select("source_table", "target_table", "missing_in_target", "missing_in_source", "row_match_pct")
    out = rows.join(tally(heads, "target_table"), "target_table", "left").join(columns, "target_table", "left")
    return out.fillna(0, list(VERDICTS)).orderBy("target_table")


def match_rates(analysis) -> tuple[DataFrame, DataFrame]:
    """(tables by ascending row match, columns by descending share of differing rows)."""
    tables = analysis.summaries.select("source_table", "target_table", "source_count", "target_count", "matched_rows", "row_match_pct").orderBy("row_match_pct", "target_table")
    columns = analysis.findings.where(F.col("recon_type") == COLUMN)
    columns = columns.join(analysis.summaries.select("recon_table_id", "common_rows"), "recon_table_id")
    share = F.try_divide("mismatch_count", "common_rows")
    columns = columns.select("target_table", "column", "mismatch_count", "common_rows", F.round(100 * (1 - F.least(share, F.lit(1.0))), 2).alias("column_match_pct"))
    return tables, columns.orderBy("column_match_pct", "target_table", "column")


def findings(analysis) -> list[dict]:
    """Findings with all their hypotheses, best first: by verdict, then confidence. Few enough for the driver."""
    heads = {r["finding_id"]: r.asDict(True) for r in analysis.findings.collect()}
    for r in analysis.hypotheses.orderBy(F.desc("confidence"), "seq").collect():
        if r["finding_id"] in heads:
            heads[r["finding_id"]].setdefault("hypotheses", []).append(r.asDict(True))
    rows = [f | {"hypotheses": f.get("hypotheses", [])} for f in heads.values()]

    def rank(f: dict) -> tuple:
        top = f["hypotheses"][0] if f["hypotheses"] else {"verdict": VERDICTS[-1], "confidence": 0}
        return VERDICTS.index(top["verdict"]), -top["confidence"], f["finding_id"]

    return sorted(rows, key=rank)


def place(f: dict) -> str:
    return f["target_table"] + (f".{f['column']}" if f.get("column") else f" ({f['recon_type'].replace('_', ' ')})")


def confirmed(f: dict) -> bool:
    return any(e["label"] == "drilldown" and e["detail"].startswith("Confirmed") for h in f["hypotheses"][:1] for e in h["evidence"])


def cut(text: str, n: int) -> str:
    return text if len(text) <= n else text[: n - 3].rstrip() + "..."


def tldr(rows: list[dict]) -> str:
    """Verdict counts, then each table's findings in a line."""
    counts = {v: sum(bool(f["hypotheses"]) and f["hypotheses"][0]["verdict"] == v for f in rows) for v in VERDICTS}
    lines = ["## In short", "", ", ".join(f"{n} {v.replace('_', ' ')}" for v, n in counts.items()), ""]
    by = defaultdict(list)
    for f in rows:
        by[f["target_table"]].append(f)
    for table in sorted(by):
        lines.append(f"**{table}**")
        for f in by[table]:
            h = f["hypotheses"][0]
            lines.append(f"- {f.get('column') or f['recon_type']}: {h['category']} ({h['verdict']}, {h['confidence']:.2f}{', confirmed' if confirmed(f) else ''}) {cut(h['rationale'] or '', RATIONALE)}")
        lines.append("")
    return "\n".join(lines)


def conclusion(rows: list[dict]) -> str:
    """What each owner has to do."""
    by = defaultdict(list)
    for f in rows:
        if f["hypotheses"]:
            by[f["hypotheses"][0]["owner"]].append(f)
    lines = ["## Who does what", ""]
    for owner in sorted(by):
        lines += [f"### {owner}", "", *[f"- {place(f)}: {cut(f['hypotheses'][0]['remediation'] or 'look into it', FIX)}" for f in by[owner]], ""]
    return "\n".join(lines)


def provenance(h: dict) -> str:
    """Which inputs a hypothesis rests on."""
    names = {"probe": "sampled values", "drilldown": "whole tables", "code": "translated code", "transpile": "translation log", "lineage": "lineage"}
    return ", ".join(dict.fromkeys(names.get(e["label"], e["label"]) for e in h["evidence"])) or "counts"


def section(f: dict) -> str:
    total = f["total_count"] or "?"
    lines = [f"### {place(f)}", "", f"{f['mismatch_count']} of {total} rows.", ""]
    for h in f["hypotheses"]:
        lines += [f"**{h['category']}** - {h['verdict']}, confidence {h['confidence']:.2f}; from {provenance(h)}", "", h["rationale"] or "", *[f"- {e['label']}: {e['detail']}" for e in h["evidence"]], ""]
    return "\n".join(lines)


def to_dict(analysis) -> dict:
    rows = findings(analysis)
    counts = {v: 0 for v in VERDICTS}
    for f in rows:
        if f["hypotheses"]:
            counts[f["hypotheses"][0]["verdict"]] += 1
    return {"recon_id": analysis.recon_id, "verdicts": counts, "tables": [r.asDict(True) for r in analysis.summaries.orderBy("target_table").collect()], "findings": rows}


def write_json(analysis, path: str) -> None:
    with open(path, "w") as f:
        json.dump(to_dict(analysis), f, indent=1, default=str)


def check_cell(f: dict, keys: list[str]) -> str:
    """Code that shows a finding's rows once more."""
    on = ", ".join(repr(k) for k in keys)
    if f["recon_type"] == COLUMN and keys:
        c = f["column"]
        return f"s, t = spark.table({f['source_table']!r}), spark.table({f['target_table']!r})\nboth = s.select({on}, s[{c!r}].alias('s')).join(t.select({on}, t[{c!r}].alias('t')), [{on}])\nboth.where('not (s <=> t)').limit(20).show(truncate=False)"
    if f["recon_type"].startswith("missing") and keys:
        a, b = ("source_table", "target_table") if f["recon_type"] == "missing_in_target" else ("target_table", "source_table")
        return f"spark.table({f[a]!r}).join(spark.table({f[b]!r}), [{on}], 'left_anti').limit(20).show(truncate=False)"
    return f"spark.table({f['target_table']!r}).printSchema()"


def notebook(analysis) -> dict:
    """A notebook: summary, validation and, table by table, each finding with a cell to rerun."""
    rows = findings(analysis)
    md = lambda text: {"cell_type": "markdown", "metadata": {}, "source": text}
    code = lambda text: {"cell_type": "code", "metadata": {}, "execution_count": None, "outputs": [], "source": text}
    keys = {r["target_table"]: r["join_keys"] for r in analysis.summaries.select("target_table", "join_keys").collect()}
    names = [(r["source_table"], r["target_table"]) for r in analysis.summaries.select("source_table", "target_table").orderBy("target_table").collect()]
    cells = [md(f"# Comparison {analysis.recon_id}"), md(tldr(rows)), md("## Validation"), code("from functools import reduce\nfrom tallylens.operators.validate import validate_rows\nparts = []")]
    cells += [code(f"parts.append(validate_rows(spark.table({s!r}), spark.table({t!r}), {keys[t]!r}))") for s, t in names]
    cells.append(code("reduce(lambda a, b: a.unionByName(b), parts).show()"))
    order = {k: i for i, k in enumerate(KINDS)}
    for f in sorted(rows, key=lambda f: (f["target_table"], order[f["recon_type"]], -(f["hypotheses"][0]["confidence"] if f["hypotheses"] else 0))):
        cells += [md(section(f)), code(check_cell(f, keys.get(f["target_table"]) or []))]
    cells.append(md(conclusion(rows)))
    return {"cells": cells, "metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5}


def write_notebook(analysis, path: str) -> None:
    with open(path, "w") as f:
        json.dump(notebook(analysis), f, indent=1)
