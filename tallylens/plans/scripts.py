"""Runs SQL scripts statement by statement on the session's catalog.

Plain Parquet tables have neither atomic replacement nor key constraints, so: CREATE OR REPLACE TABLE ... AS
builds the new table beside the old one and then takes its name; a key and a clustering clause of a CREATE
TABLE are kept as table properties, and key_violations() looks whether the rows keep to them. NOT NULL and
COMMENT are the catalog's own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.artifacts import split_statements

#: Texts, quoted names and comments, which a statement is taken apart by.
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)
_PART = r"(?:`(?:[^`]|``)+`|\w+)"
_CREATE = re.compile(rf"^\s*create\s+(or\s+replace\s+)?table\s+(if\s+not\s+exists\s+)?({_PART}(?:\s*\.\s*{_PART})*)\s*(.*)$", re.I | re.S)
_KEY = re.compile(r",\s*(?:constraint\s+\w+\s+)?primary\s+key\s*\(([^)]*)\)(?:\s+(?:not\s+enforced|rely|norely))*", re.I)
_CLUSTER = re.compile(r"\bcluster\s+by\s*\(([^)]*)\)", re.I)
KEY, CLUSTER = "tallylens.primary_key", "tallylens.cluster_by"


def _names(text: str) -> str:
    return ",".join(x.strip().strip("`") for x in text.split(","))


def uncommented(sql: str) -> str:
    """sql with a space for each comment; texts and quoted names stay as they are."""
    return _QUOTED.sub(lambda m: " " if m[0].startswith(("--", "/*")) else m[0], sql)


def without_catalog(sql: str, catalog: str) -> str:
    """sql in which names of three parts that begin with the catalog lose it; texts and comments stay as they are."""
    name = rf"(?:`{re.escape(catalog.replace('`', '``'))}`|{re.escape(catalog)})"
    own = re.compile(rf"{name}\s*\.", re.I)

    def put(m: re.Match) -> str:
        return "" if own.fullmatch(m[0]) else m[0]

    # A quoted catalog is a quoted name as well, so it is looked for first.
    first = re.compile(rf"(?<![\w.`]){name}\s*\.(?=\s*{_PART}\s*\.\s*{_PART})|{_QUOTED.pattern}", re.I | re.S)
    return first.sub(put, sql)


def _beside(name: str, what: str) -> str:
    """The name of a table beside a table: its last part, longer."""
    return f"{name[:-1]}__{what}`" if name.endswith("`") else f"{name}__{what}"


def _replace(spark: SparkSession, built: str, name: str) -> None:
    """Gives a built table its name. The old one steps aside and goes only when the new one has taken its place."""
    old = _beside(name, "old")
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    aside = spark.catalog.tableExists(name)
    if aside:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {built} RENAME TO {name}")
    except Exception:
        if aside:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def create(spark: SparkSession, statement: str) -> bool:
    """Runs a CREATE TABLE statement; False if it is none."""
    m = _CREATE.match(uncommented(statement))
    if not m:
        return False
    replace, if_absent, name, rest = m.groups()
    if if_absent and spark.catalog.tableExists(name):
        return True
    # The clauses of our own stand in the column list, before any query.
    columns, query = _parted(rest)
    key, cluster = _KEY.search(columns), _CLUSTER.search(columns)
    columns = _CLUSTER.sub("", _KEY.sub("", columns))
    built = _beside(name, "new") if replace else name
    spark.sql(f"DROP TABLE IF EXISTS {built}") if replace else None
    if query:
        spark.sql(f"CREATE TABLE {built} USING parquet AS {query}")
    else:
        spark.sql(f"CREATE TABLE {built} {columns if re.search(r'\busing\b', columns, re.I) else _with_format(columns)}")
    properties = {k: _names(x[1]) for k, x in ((KEY, key), (CLUSTER, cluster)) if x}
    if properties:
        spark.sql(f"ALTER TABLE {built} SET TBLPROPERTIES ({', '.join(f"'{k}' = '{v}'" for k, v in properties.items())})")
    if replace:
        _replace(spark, built, name)
    return True


def _parted(rest: str) -> tuple[str, str]:
    """What stands before AS, and the query behind it; no query if there is no AS outside quotes and brackets."""
    depth = 0
    for m in re.finditer(rf"{_QUOTED.pattern}|[()]|\bas\b", rest, re.I | re.S):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0].lower() == "as" and not depth:
            return rest[: m.start()], rest[m.end() :].strip()
    return rest, ""


def _with_format(columns: str) -> str:
    """A column list with the format behind its closing bracket."""
    depth = 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == ")" and not depth:
            return columns[: k + 1] + " USING parquet" + columns[k + 1 :]
    raise ValueError(f"no column list in {columns[:60]!r}")


def run_script(spark: SparkSession, sql: str, *, catalog: str | None = None, dry_run: bool = False) -> list[tuple[int, str, str]]:
    """(number, first line, state) of each statement. The first that fails ends the run with its number.
    catalog: a catalog name that is left out of names of three parts, as the session has one of its own."""
    out = []
    for number, statement in enumerate(split_statements(sql), 1):
        if catalog:
            statement = without_catalog(statement, catalog)
        head = uncommented(statement).strip().split("\n")[0]
        if not dry_run:
            try:
                create(spark, statement) or spark.sql(statement)
            except Exception as e:
                raise RuntimeError(f"statement {number} failed ({head}): {e}") from e
        out.append((number, head, "planned" if dry_run else "done"))
    return out


def key_violations(spark: SparkSession, table: str) -> DataFrame:
    """The key values that several rows of a table have, and how many, by its declared key; none without one."""
    properties = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    keys = properties[KEY].split(",") if KEY in properties else spark.table(table).columns
    rows = spark.table(table).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows if KEY in properties else rows.limit(0)
