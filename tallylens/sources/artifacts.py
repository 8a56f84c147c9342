"""Code artifacts of a migration: comparison config, translated SQL, source DDL, error log and manifest.

SQL is read with Spark's own parser through the session's Java handle; a statement that it doesn't take is
left out. Paths are read by Spark's readers, so they can be in any store it knows."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import DATE_NAME
from ..operators.passes import stem


@dataclass
class Transform:
    column: str
    expr: str
    functions: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    is_direct: bool = False


@dataclass
class TableMapping:
    """What is known of one target table."""

    target_table: str = ""
    source_table: str = ""
    keys: list[str] = field(default_factory=list)
    date_column: str | None = None
    column_map: dict[str, str] = field(default_factory=dict)
    source_filter: str = ""
    #: The filter under which the target is loaded, from code or config.
    target_filter: str = ""
    #: The filters (source, target) under which the tables are compared, from the config alone.
    compared: tuple[str, str] = ("", "")
    transforms: dict[str, Transform] = field(default_factory=dict)
    source_types: dict[str, str] = field(default_factory=dict)
    issues: list[dict] = field(default_factory=list)


def short(name: str) -> str:
    return name.split(".")[-1].replace("`", "").replace('"', "").lower()


def texts(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    """Whole files below a path, in the order of their names. Artifacts are few and small."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.text(path, wholetext=True).selectExpr("value", "_metadata.file_path as p")
    return [r[0] for r in sorted(df.collect(), key=lambda r: r[1])]


def split_statements(sql: str) -> list[str]:
    """Statements of a script: cut at semicolons outside quotes and comments; comment-only ones go."""
    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"])*\"|`[^`]*`|;|[^;]", re.S)
    out, text, real = [], [], False
    for m in token.finditer(sql):
        t = m[0]
        if t == ";":
            if real:
                out.append("".join(text).strip())
            text, real = [], False
        else:
            text.append(t)
            real |= not (t.startswith(("--", "/*")) or t.isspace())
    if real:
        out.append("".join(text).strip())
    return out


def recon_config(spark: SparkSession, path: str) -> dict[str, TableMapping]:
    """Tables of a comparison config in JSON."""
    out = {}
    for t in json.loads("".join(texts(spark, path)) or "{}").get("tables", []):
        source, target = t.get("source_name", ""), t.get("target_name", t.get("source_name", ""))
        keys, filters = list(t.get("join_columns") or []), t.get("filters") or {}
        renamed = {c["source_name"]: c.get("target_name") for c in t.get("column_mapping") or [] if c.get("source_name")}
        when = next((k for k in keys if re.search(DATE_NAME, k)), None)
        both = (filters.get("source") or "", filters.get("target") or "")
        out[short(target)] = TableMapping(target, source, keys, when, renamed, *both, both)
    return out


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _walk(node):
    yield node
    for child in _seq(node.children()):
        yield from _walk(child)


def _transform(expr) -> Transform | None:
    kind = _kind(expr)
    name, inner = None, expr
    if kind == "Alias":
        name, inner = expr.name(), expr.child()
    elif kind == "UnresolvedAlias":
        inner = expr.child()
    functions, references = set(), []
    for n in _walk(inner):
        k = _kind(n)
        if k == "UnresolvedFunction":
            functions.add(_seq(n.nameParts())[-1].upper())
        elif k == "Cast":
            functions.add("CAST")
        elif k == "CaseWhen":
            functions.add("CASE")
        elif k == "UnresolvedAttribute":
            references.append(_seq(n.nameParts())[-1])
    direct = _kind(inner) == "UnresolvedAttribute"
    name = name or (references[0] if direct else None)
    return Transform(name, inner.sql(), sorted(functions), references, direct) if name else None


def parse_sql(spark: SparkSession, sql: str) -> dict[str, TableMapping]:
    """Target tables of INSERT and CREATE ... AS statements with their columns' derivations. Of a union only
    the first branch counts, of several filters the first."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    out: dict[str, TableMapping] = {}
    for statement in split_statements(sql):
        try:
            plan = parser.parsePlan(statement)
            kind = _kind(plan)
            if kind == "InsertIntoStatement":
                name = ".".join(_seq(plan.table().multipartIdentifier()))
            elif kind in ("ReplaceTableAsSelect", "CreateTableAsSelect"):
                name = ".".join(_seq(plan.name().nameParts()))
            else:
                continue
            found = out.setdefault(short(name), TableMapping(target_table=name))
            node, chosen = plan.query(), None
            while node is not None:
                k = _kind(node)
                if k in ("Project", "Aggregate") and chosen is None:
                    chosen = _seq(node.projectList() if k == "Project" else node.aggregateExpressions())
                if k == "Filter" and not found.target_filter:
                    found.target_filter = node.condition().sql()
                if k == "UnresolvedRelation":
                    found.source_table = found.source_table or ".".join(_seq(node.multipartIdentifier()))
                below = _seq(node.children())
                node = below[0] if below else None
            for t in filter(None, map(_transform, chosen or [])):
                found.transforms[t.column] = t
        except Exception:  # noqa: BLE001  a statement in a dialect that the parser doesn't know
            continue
    return out


def merged(into: dict[str, TableMapping], more: dict[str, TableMapping]) -> dict[str, TableMapping]:
    """Derivations of `more` replace earlier ones; names and filters stay once they are known."""
    for k, m in more.items():
        have = into.setdefault(k, TableMapping(target_table=m.target_table))
        have.transforms |= m.transforms
        have.source_types |= m.source_types
        have.compared = have.compared if any(have.compared) else m.compared
        have.column_map = m.column_map | have.column_map
        for f in ("source_table", "target_filter", "source_filter", "date_column"):
            setattr(have, f, getattr(have, f) or getattr(m, f))
        have.keys = have.keys or m.keys
        have.issues += m.issues
    return into


def translated(spark: SparkSession, path: str) -> dict[str, TableMapping]:
    out: dict[str, TableMapping] = {}
    for text in texts(spark, path, "*.sql"):
        merged(out, parse_sql(spark, text))
    return out


_TABLE = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:transient\s+|temporary\s+|temp\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`$]+)\s*\(", re.I)
_CONSTRAINT = re.compile(r"^(constraint|primary|foreign|unique|check|key|index)\b", re.I)
_TYPE = re.compile(r"^[\"`]?([\w$]+)[\"`]?\s+([A-Za-z_]\w*(?:\s+(?:precision|varying))?(?:\s*\([^)]*\))?)")


def parse_ddl(sql: str) -> dict[str, dict[str, str]]:
    """Table -> column -> declared type, of CREATE TABLE statements. NUMBER is shown as DECIMAL."""
    out: dict[str, dict[str, str]] = {}
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    for m in _TABLE.finditer(plain):
        depth, item, items = 1, [], []
        for c in plain[m.end() :]:
            depth += (c == "(") - (c == ")")
            if depth == 0 or (c == "," and depth == 1):
                items.append("".join(item).strip())
                item = []
            else:
                item.append(c)
            if depth == 0:
                break
        types = {}
        for x in items:
            t = _TYPE.match(x)
            if t and not _CONSTRAINT.match(x):
                types[t[1].lower()] = re.sub(r"^NUMBER\b", "DECIMAL", re.sub(r"\s+", "", t[2]).upper())
        if types:
            out[short(m[1])] = types
    return out


def declared(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for text in texts(spark, path, "*.sql"):
        for k, v in parse_ddl(text).items():
            out.setdefault(k, {}).update(v)
    return out


def parse_errors(lines: DataFrame) -> DataFrame:
    """Translation issues: code, kind, severity, path, message of each line that has them all. A message runs
    to the last quote of its line."""
    line = F.col("value")
    forms = {"code": r"\bcode=([^,]*),", "kind": r"\bkind=(\w+)", "severity": r"\bseverity=(\w+)", "path": r"\bpath='([^']*)'", "message": r"\bmessage='(.*)'\)?\s*$"}
    has_all = reduce(and_, [line.rlike(f) for f in forms.values()])
    return lines.where(has_all).select(*[F.trim(F.regexp_extract(line, f, 1)).alias(k) for k, f in forms.items()])


def errors(spark: SparkSession, path: str) -> DataFrame:
    return parse_errors(spark.read.text(path))


def manifest(spark: SparkSession, path: str) -> list[dict]:
    """Table entries of a manifest in JSON, or in YAML where a parser is installed."""
    text = "\n".join(texts(spark, path))
    try:
        return json.loads(text).get("tables", [])
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("a YAML manifest needs the yaml module") from e
        return (yaml.safe_load(text) or {}).get("tables", [])


def only(found: dict):
    """The one thing that a script named in a manifest defines, whatever its name."""
    return next(iter(found.values())) if len(found) == 1 else None


def apply_manifest(spark: SparkSession, mapping: dict[str, TableMapping], entries: list[dict]) -> dict[str, TableMapping]:
    """Lays a manifest's entries over a mapping: what it names for a table goes before what was found."""
    for e in entries:
        if not e.get("target"):
            continue
        k = short(e["target"])
        have = mapping.setdefault(k, TableMapping(target_table=e["target"]))
        have.source_table = e.get("source") or have.source_table
        have.keys = list(e.get("join_keys") or []) or have.keys
        have.date_column = e.get("date_column") or have.date_column
        if e.get("target_script"):
            found = {}
            for text in texts(spark, e["target_script"]):
                merged(found, parse_sql(spark, text))
            own = found.get(k) or only(found)
            if own:
                merged(mapping, {k: own})
        if e.get("source_script"):
            found = {}
            for text in texts(spark, e["source_script"]):
                found |= parse_ddl(text)
            have.source_types |= found.get(short(have.source_table or k)) or found.get(k) or only(found) or {}
    return mapping


def build_mapping(spark: SparkSession, *, config: str | None = None, translated_sql: str | None = None, error_log: str | None = None, source_scripts: str | None = None, manifest_entries: list[dict] | None = None) -> dict[str, TableMapping]:
    """Config, then translated SQL, source types, manifest and issues."""
    mapping = recon_config(spark, config) if config else {}
    if translated_sql:
        merged(mapping, translated(spark, translated_sql))
    if source_scripts:
        types = declared(spark, source_scripts)
        for k, m in mapping.items():
            m.source_types |= types.get(short(m.source_table or k)) or types.get(k) or {}
    if manifest_entries:
        apply_manifest(spark, mapping, manifest_entries)
    if error_log:
        for r in errors(spark, error_log).withColumn("stem", stem(F.col("path"))).collect():
            if r["stem"] in mapping:
                mapping[r["stem"]].issues.append({k: r[k] for k in ("code", "kind", "severity", "path", "message")})
    return mapping


def frames(spark: SparkSession, mapping: dict[str, TableMapping]) -> dict[str, DataFrame]:
    """A mapping as the small tables that the code pass joins."""
    t = [(k, x.column, x.expr, x.functions, x.is_direct, x.references) for k, m in mapping.items() for x in m.transforms.values()]
    types = [(k, c, v) for k, m in mapping.items() for c, v in m.source_types.items()]
    filters = [(k, m.target_filter) for k, m in mapping.items() if m.target_filter]
    issues = [(k, i["severity"], i["kind"], i["message"]) for k, m in mapping.items() for i in m.issues]
    return {
        "transforms": spark.createDataFrame(t, "table string, column string, expr string, functions array<string>, is_direct boolean, references array<string>"),
        "types": spark.createDataFrame(types, "table string, column string, source_type string"),
        "filters": spark.createDataFrame(filters, "table string, target_filter string"),
        "issues": spark.createDataFrame(issues, "table string, severity string, kind string, message string"),
    }
