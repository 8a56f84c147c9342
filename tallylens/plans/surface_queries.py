"""Registered queries for what lies around the comparison: duplicate and null keys, artifacts, scripts, loads,
lineage, reports, streaming and the acceptance scenarios."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import reports, streaming
from ..functions import probes
from ..operators import checksums, classify, compare, drilldown, ingest, layout, lineage, meeting, merge, passes, patterns
from ..scratch import fresh_dir
from ..sources import artifacts
from . import config, scenarios, scripts
from .analyze import analyze, known
from .queries import _classified, _compared, pair, query, views

# --- duplicate and null keys -------------------------------------------------------------------------------
#: Keys of four rows each, a tenth of them null; the target lacks some rows, has others twice or changed.
_S = "SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 4 END AS k, o_orderstatus AS status FROM orders"
_T = """SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 4 END AS k, CASE WHEN o_orderkey % 10 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 50 <> 7
UNION ALL SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 4 END, o_orderstatus FROM orders WHERE o_orderkey % 13 = 0"""
#: Equal rows of a key are matched first; of the rest as many pairs differ as the shorter side has.
_RESTS = f"""WITH s AS ({_S}), t AS ({_T}), rows_ AS (
  SELECT k, status, count(*) FILTER (WHERE side = 's') AS a, count(*) FILTER (WHERE side = 't') AS b
  FROM (SELECT 's' AS side, * FROM s UNION ALL SELECT 't', * FROM t) GROUP BY k, status
), rests AS (SELECT k, sum(a) AS a, sum(b) AS b, sum(a - least(a, b)) AS ra, sum(b - least(a, b)) AS rb FROM rows_ GROUP BY k)
"""


def _copies(spark, sf_dir):
    views(spark, sf_dir)
    return spark.sql(_S), spark.sql(_T)


@query(_RESTS + "SELECT CAST(sum(a) AS BIGINT) AS source_rows, CAST(sum(b) AS BIGINT) AS target_rows, CAST(sum(rb - least(ra, rb)) AS BIGINT) AS missing_in_source, CAST(sum(ra - least(ra, rb)) AS BIGINT) AS missing_in_target, CAST(sum(least(ra, rb)) AS BIGINT) AS absolute_mismatch, CAST(sum(least(ra, rb)) AS BIGINT) AS n_status FROM rests")
def q_compare_duplicate_and_null_keys(spark, sf_dir):
    s, t = _copies(spark, sf_dir)
    return compare.Difference.of(s, t, compare.Pair(keys=["k"])).counts()


@query(_RESTS + "SELECT CAST(sum(least(ra, rb)) AS BIGINT) AS n, CAST((SELECT count(*) FROM s) AS BIGINT) AS src_total FROM rests")
def q_drill_duplicate_and_null_keys(spark, sf_dir):
    s, t = _copies(spark, sf_dir)
    m = F.col("measures")
    return drilldown.confirm_columns(s, t, ["k"], {"status": "upstream_drift"}).select(m["n"].cast("long").alias("n"), m["src_total"].cast("long").alias("src_total"))


@query(_RESTS + "SELECT CAST(sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS BIGINT) AS extra, CAST(sum(CASE WHEN a > 0 THEN greatest(b - a, 0) ELSE 0 END) AS BIGINT) AS duplicates FROM rests")
def q_surplus_duplicate_and_null_keys(spark, sf_dir):
    s, t = _copies(spark, sf_dir)
    return drilldown.confirm_extra(s, t, ["k"]).select("extra", "duplicates")


@query("SELECT CAST(0 AS BIGINT) AS missing_in_source, CAST(0 AS BIGINT) AS missing_in_target, CAST(0 AS BIGINT) AS absolute_mismatch, count(*) AS source_count FROM orders")
def q_compare_table_with_itself(spark, sf_dir):
    s, _ = _copies(spark, sf_dir)
    parts = compare.compare(s, s, compare.Pair(keys=["k"]), recon_id="r", table_id=1, source_name="a.s", target_name="a.t")
    return ingest.tables(*parts[:2], "r").select("missing_in_source", "missing_in_target", "absolute_mismatch", "source_count")


# --- probes on mixed pairs: the conditions are written out over the numbers that the pairs are made of ------
_K = "SELECT o_orderkey AS id, (o_orderkey * 7919 + o_custkey) % 100003 AS k FROM orders"


def _mixed(spark, sf_dir, numbers: str, source: str, target: str, probe: str) -> DataFrame:
    views(spark, sf_dir)
    rows = spark.sql(numbers).selectExpr("id", f"{source} AS s", f"{target} AS t")
    found = probes.each_signal(probes.with_signals(rows, "s", "t", names=[probe]), "id")
    return found.select("id", "signal.category", "signal.strength")


@query(
    f"""SELECT id, CASE WHEN (k // 10) % 10 = 0 THEN 'transpilation' ELSE 'type_precision' END AS category,
  CAST(CASE WHEN (k // 10) % 10 = 0 THEN 0.85 WHEN k % 10 < 5 OR (k % 10 = 5 AND (k // 10) % 2 = 0) THEN 0.9 ELSE 0.6 END AS DOUBLE) AS strength
FROM ({_K}) WHERE k % 10 > 0 AND ((k // 10) % 10 = 0 OR k % 10 < 5 OR (k % 10 = 5 AND (k // 10) % 2 = 0) OR (k % 10) / k < 0.001)"""
)
def q_probe_mixed_cut_digits(spark, sf_dir):
    """Hundredths against the same cut to tenths: equal, rounded down, rounded up to even, or just near."""
    shown = "concat({0} div {1}, '.', lpad({0} % {1}, {2}, '0'))"
    return _mixed(spark, sf_dir, _K, shown.format("k", 100, 2), shown.format("(k div 10)", 10, 1), "numeric")


@query(
    f"""SELECT id, CASE WHEN d >= 86400 THEN 'upstream_drift' ELSE 'timezone' END AS category, CAST(CASE WHEN d >= 86400 THEN 0.65 ELSE 0.9 END AS DOUBLE) AS strength
FROM (SELECT id, (k % 2000) * 150 AS d FROM ({_K})) WHERE (d > 0 AND d % 3600 = 0) OR d IN (1800, 12600, 16200, 19800) OR d >= 86400
UNION ALL SELECT id, 'timezone', 0.9 FROM (SELECT id, (k % 2000) * 150 AS d FROM ({_K})) WHERE d >= 86400 AND d IN (1800, 12600, 16200, 19800)"""
)
def q_probe_mixed_times(spark, sf_dir):
    """Times that lie any number of steps of two and a half minutes apart, up to three days."""
    return _mixed(spark, sf_dir, _K, "'2026-03-01 00:00:00'", "date_format(timestamp_ntz'2026-03-01 00:00:00' + make_dt_interval(0, 0, 0, (k % 2000) * 150), 'yyyy-MM-dd HH:mm:ss')", "temporal")


_LEFT, _RIGHT = "NULL, '', 'null', 'Y', 'no', '-1', 'x', 'TRUE'", "NULL, 'None', 'true', '0', 'n/a', 'X', 'x', 'Null'"


@query(
    f"""WITH p AS (SELECT id, [{_LEFT}][CAST(k % 8 + 1 AS INTEGER)] AS s, [{_RIGHT}][CAST(k // 8 % 8 + 1 AS INTEGER)] AS t FROM ({_K})),
q AS (SELECT *, s IS NULL OR s IN ('', 'null') AS ns, t IS NULL OR t = 'None' AS nt, lower(s) AS a, lower(t) AS b FROM p)
SELECT id, 'null_boolean' AS category, CAST(0.85 AS DOUBLE) AS strength FROM q WHERE ns AND nt AND coalesce(s, 'None') <> coalesce(t, 'None')
UNION ALL SELECT id, CASE WHEN coalesce(CASE WHEN ns THEN b ELSE a END IN ('-1', 'n/a', 'null'), false) THEN 'null_boolean' ELSE 'upstream_drift' END,
  CASE WHEN coalesce(CASE WHEN ns THEN b ELSE a END IN ('-1', 'n/a', 'null'), false) THEN 0.85 ELSE 0.8 END FROM q WHERE ns <> nt
UNION ALL SELECT id, 'null_boolean', 0.85 FROM q WHERE NOT ns AND NOT nt AND s <> t AND ((a IN ('y', 'true') AND b = 'true') OR (a = 'no' AND b = '0'))"""
)
def q_probe_mixed_nulls(spark, sf_dir):
    """Every pair of eight forms of no value, truth and text on either side."""
    pick = "get(array({}), cast(({}) % 8 as int))"
    return _mixed(spark, sf_dir, _K, pick.format(_LEFT, "k"), pick.format(_RIGHT, "k div 8"), "null_boolean")


# --- confirmations -----------------------------------------------------------------------------------------
def _confirm(spark, sf_dir, source: str, target: str, category: str) -> DataFrame:
    views(spark, sf_dir)
    rows = spark.table("orders")
    s, t = (rows.selectExpr("o_orderkey AS k", f"{x} AS v") for x in (source, target))
    return drilldown.confirm_columns(s, t, ["k"], {"v": category})


@query("SELECT count(*) FILTER (WHERE o_orderkey % 3 > 0) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS null_involved, true AS confirmed FROM orders")
def q_null_boolean_drill(spark, sf_dir):
    done = _confirm(spark, sf_dir, "if(o_orderkey % 3 = 1, null, 'Y')", "if(o_orderkey % 3 = 0, 'Y', 'true')", "null_boolean")
    m = F.col("measures")
    return done.select(m["n"].cast("long").alias("n"), m["null_involved"].cast("long").alias("null_involved"), "confirmed")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 8 < 6) AS same_content, count(*) = count(*) FILTER (WHERE o_orderkey % 8 < 6) AS confirmed FROM orders")
def q_json_drill(spark, sf_dir):
    done = _confirm(spark, sf_dir, """concat('{"a":', o_orderkey, ',"b":[1]}')""", """concat('{"b": [1], "a":', o_orderkey + if(o_orderkey % 8 < 6, 0, 1), '}')""", "semi_structured")
    m = F.col("measures")
    return done.select(m["n"].cast("long").alias("n"), m["same_content"].cast("long").alias("same_content"), "confirmed")


@query("SELECT count(*) AS n, count(DISTINCT -1) AS distinct_shifts, CAST(-1 AS BIGINT) AS shift_days, true AS confirmed FROM orders")
def q_week_start_drill(spark, sf_dir):
    done = _confirm(spark, sf_dir, "cast(date_trunc('week', o_orderdate) as date)", "date_sub(cast(date_trunc('week', o_orderdate) as date), 1)", "env_config")
    m = F.col("measures")
    return done.select(m["n"].cast("long").alias("n"), m["distinct_shifts"].cast("long").alias("distinct_shifts"), m["shift_days"].cast("long").alias("shift_days"), "confirmed")


# --- artifacts: a table for each nation --------------------------------------------------------------------
_T_NAME = "lower(replace(n_name, ' ', '_'))"


def _nations(spark, sf_dir) -> list:
    views(spark, sf_dir)
    return spark.table("nation").selectExpr("n_nationkey AS n", f"{_T_NAME} AS name", "n_regionkey AS r").orderBy("n").collect()


def _written(spark, text: str, name: str = "part") -> str:
    """A folder of the shared place that holds a text as one file."""
    path = fresh_dir(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def _file(spark, name: str, text: str) -> str:
    """A folder of the shared place with a file of the given name."""
    folder = fresh_dir(spark, "files")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(text.encode()))
    out.close()
    return folder


@query(f"SELECT 'tgt.' || {_T_NAME} AS target_table, 'src.' || {_T_NAME} AS source_table, CASE WHEN n_nationkey % 2 = 0 THEN 'id,load_dt' ELSE 'id' END AS keys, CASE WHEN n_nationkey % 2 = 0 THEN 'load_dt' ELSE '-' END AS date_column, 'r = ' || n_regionkey AS source_filter, 'new_' || n_nationkey AS renamed FROM nation")
def q_recon_config(spark, sf_dir):
    tables = [{"source_name": f"src.{x['name']}", "target_name": f"tgt.{x['name']}", "join_columns": ["id", "load_dt"][: 2 - x["n"] % 2], "filters": {"source": f"r = {x['r']}"}, "column_mapping": [{"source_name": "old", "target_name": f"new_{x['n']}"}]} for x in _nations(spark, sf_dir)]
    found = artifacts.recon_config(spark, _written(spark, json.dumps({"version": 1, "tables": tables}), "config"))
    rows = [(m.target_table, m.source_table, ",".join(m.keys), m.date_column or "-", m.source_filter, m.column_map["old"]) for m in found.values()]
    return spark.createDataFrame(rows, "target_table string, source_table string, keys string, date_column string, source_filter string, renamed string")


@query(f"SELECT {_T_NAME} AS \"table\", unnest(['id', 'amount', 'at']) AS \"column\", unnest(['DECIMAL(38,0)', 'DECIMAL(18,' || n_regionkey || ')', 'TIMESTAMP_LTZ(9)']) AS type FROM nation")
def q_source_ddl(spark, sf_dir):
    sql = "\n".join(f"-- made by hand; not {x['name']}\nCREATE OR REPLACE TABLE db.\"{x['name'].upper()}\" (id NUMBER(38, 0) NOT NULL, -- ; the key\n amount DECIMAL(18,{x['r']}) COMMENT 'a, b', at TIMESTAMP_LTZ(9), PRIMARY KEY (id));" for x in _nations(spark, sf_dir))
    rows = [(t, c, k) for t, cols in artifacts.parse_ddl(sql).items() for c, k in cols.items()]
    return spark.createDataFrame(rows, "table string, column string, type string")


@query(f"SELECT {_T_NAME} AS \"table\", 'src.' || n_nationkey AS source_table, 'key' || n_regionkey AS keys, CASE WHEN n_nationkey % 3 = 0 THEN 'at' ELSE '-' END AS date_column, CASE WHEN n_nationkey = 4 THEN 'UPPER' ELSE '-' END AS functions, CASE WHEN n_nationkey = 4 THEN 'NUMBER(9,2)' ELSE '-' END AS source_type FROM nation")
def q_manifest(spark, sf_dir):
    entries = [{"target": f"tgt.{x['name']}", "source": f"src.{x['n']}", "join_keys": [f"key{x['r']}"]} | ({"date_column": "at"} if x["n"] % 3 == 0 else {}) for x in _nations(spark, sf_dir)]
    # Scripts of one table each, whose names are other ones.
    entries[4] |= {"target_script": _written(spark, "CREATE TABLE staging.other AS SELECT upper(v) AS v FROM raw.t", "script"), "source_script": _written(spark, "CREATE TABLE old.other (v NUMBER(9,2));", "script")}
    entries = artifacts.manifest(spark, _written(spark, json.dumps({"tables": entries}), "manifest"))
    rows = []
    for t, m in artifacts.apply_manifest(spark, {}, entries).items():
        rows.append((t, m.source_table, ",".join(m.keys), m.date_column or "-", ",".join(m.transforms["v"].functions) if m.transforms else "-", m.source_types.get("v", "-").replace("DECIMAL", "NUMBER")))
    return spark.createDataFrame(rows, "table string, source_table string, keys string, date_column string, functions string, source_type string")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS number, 'SELECT ''' || n_name || ';''' AS head FROM nation")
def q_split_script(spark, sf_dir):
    views(spark, sf_dir)
    names = [r[0] for r in spark.table("nation").orderBy("n_nationkey").select("n_name").collect()]
    sql = "/* all; of them */\n" + "\n-- next;\n".join(f"SELECT '{n};' /* ; */;" for n in names) + "\n-- the end;"
    done = scripts.run_script(spark, sql, dry_run=True)
    return spark.createDataFrame([(k, head) for k, head, _ in done], "number long, head string")


@query("SELECT 'orders_' || r_regionkey AS recon_schema, 'snowflake' AS dialect, r_regionkey % 2 = 0 AS use_lineage, '/reports/' || r_regionkey AS output_dir FROM region")
def q_run_settings(spark, sf_dir):
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect():
        given = {"recon_schema": f"orders_{r[0]}", "use_lineage": r[0] % 2 == 0, "output_dir": f"/reports/{r[0]}", "dialect": None, "unheard_of": 1}
        c = config.parse(json.dumps(given))
        rows.append((c.recon_schema, c.dialect, c.use_lineage, config.output_dir(spark, c.output_dir)))
    return spark.createDataFrame(rows, "recon_schema string, dialect string, use_lineage boolean, output_dir string")


# --- scripts and loads -------------------------------------------------------------------------------------
def _schema(spark, name: str) -> str:
    """A schema of the session that is emptied and lies in the shared place."""
    spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{fresh_dir(spark, name)}'")
    return name


_SCRIPT = """
CREATE SCHEMA IF NOT EXISTS {s};
-- the core table; with its key
CREATE OR REPLACE TABLE main_catalog.{s}.core (
  k BIGINT NOT NULL COMMENT 'order', status STRING, price DECIMAL(18,2),
  CONSTRAINT core_key PRIMARY KEY (k) RELY
) COMMENT 'orders; as loaded' CLUSTER BY (k);
INSERT INTO {s}.core SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 2 = 0;
INSERT INTO {s}.core SELECT o_orderkey, lower(o_orderstatus), CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 2 = 1;
CREATE OR REPLACE TABLE {s}.by_status AS SELECT status, count(*) AS n, sum(price) AS price FROM {s}.core GROUP BY status;
CREATE OR REPLACE TABLE {s}.by_status AS SELECT status, n, CAST(price AS DECIMAL(18,2)) AS price FROM {s}.by_status WHERE n > 0;
INSERT INTO {s}.core SELECT k, status, price FROM {s}.core WHERE k % 100 = 0;
"""


@query(
    """SELECT status, count(*) AS n, CAST(sum(p) AS DECIMAL(18,2)) AS price, (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0) AS key_violations
FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE lower(o_orderstatus) END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders) GROUP BY 1"""
)
def q_script_tables(spark, sf_dir):
    views(spark, sf_dir)
    s = _schema(spark, "tallylens_script")
    scripts.run_script(spark, _SCRIPT.format(s=s), catalog="main_catalog")
    broken = scripts.key_violations(spark, f"{s}.core").agg(F.count(F.lit(1)).alias("key_violations"))
    return spark.table(f"{s}.by_status").crossJoin(broken)  # a single row


@query("SELECT count(*) AS n, count(*) AS with_time, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 3 = 0")
def q_overwrite_load(spark, sf_dir):
    views(spark, sf_dir)
    place = fresh_dir(spark, "load")
    spark.sql("DROP SCHEMA IF EXISTS tallylens_load CASCADE")
    for part in (spark.table("orders").select("o_orderkey"), spark.table("orders").select("o_orderkey").where("o_orderkey % 3 = 0")):
        merge.overwrite(part, "loaded", "tallylens_load", place)
    return spark.table("tallylens_load.loaded").agg(F.count(F.lit(1)).alias("n"), F.count("_ingest_ts").alias("with_time"), F.sum("o_orderkey").alias("keys"))


@query("SELECT status, count(*) AS n FROM (SELECT upper(o_orderstatus) AS status FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def q_layers(spark, sf_dir):
    views(spark, sf_dir)
    s = _schema(spark, "tallylens_layers")
    steps = [(f"{s}.bronze", "SELECT o_orderkey, o_orderstatus FROM orders"), (f"{s}.silver", f"SELECT upper(o_orderstatus) AS status FROM {s}.bronze WHERE o_orderkey % 2 = 0"), (f"{s}.gold", f"SELECT status, count(*) AS n FROM {s}.silver GROUP BY status")]
    config.layers(spark, steps)
    return spark.table(f"{s}.gold").select("status", "n")


# --- schema, lineage, mapping ------------------------------------------------------------------------------
@query("SELECT * FROM (VALUES ('k', 'bigint', 'bigint', true), ('price', 'decimal(18,4)', 'double', false), ('priority', 'string', '_null_recon_', false), ('prio', '_null_recon_', 'string', false)) v(\"column\", source_type, target_type, valid)")
def q_schema_compare(spark, sf_dir):
    s, t = (x.select("k", "price", "priority") for x in pair(spark, sf_dir))
    t = t.withColumn("price", F.col("price").cast("double")).withColumnRenamed("priority", "prio")
    rows = spark.createDataFrame([(r,) for r in compare.schema_rows(s, t, compare.Pair(keys=["k"]))], "x map<string,string>")
    x = F.col("x")
    name = F.when(x["source_column"] == "_null_recon_", x["databricks_column"]).otherwise(x["source_column"])
    return rows.select(name.alias("column"), x["source_datatype"].alias("source_type"), x["databricks_datatype"].alias("target_type"), (x["is_valid"] == "true").alias("valid"))


@query(
    """SELECT 'tgt.t' || (c_custkey % 4) AS t, 'src.n' || c_nationkey AS upstream FROM customer WHERE c_custkey % 4 < 2 AND c_nationkey % 3 > 0 GROUP BY ALL
UNION ALL SELECT 'tgt.t' || (c_custkey % 4), 'src.whole' || (c_nationkey % 5) FROM customer WHERE c_custkey % 4 >= 2 GROUP BY ALL"""
)
def q_lineage_table_fallback(spark, sf_dir):
    """Column lineage where there is some, else table lineage; only of the last ninety days."""
    views(spark, sf_dir)
    rows = spark.table("customer").withColumn("t", F.format_string("Tgt.T%d", F.col("c_custkey") % 4))
    recent = lambda late: F.when(late, F.lit("2026-01-20")).otherwise(F.lit("2025-06-01")).cast("date")
    fine = rows.where("c_custkey % 4 < 2").select(F.format_string("src.n%d", "c_nationkey").alias("source_table_full_name"), F.lit("c").alias("target_column_name"), F.col("t").alias("target_table_full_name"), recent(F.col("c_nationkey") % 3 > 0).alias("event_date"))
    whole = rows.select(F.format_string("src.whole%d", F.col("c_nationkey") % 5).alias("source_table_full_name"), F.col("t").alias("target_table_full_name"), recent(F.lit(True)).alias("event_date"))
    ups = lineage.upstreams(fine, whole, rows.select(F.col("t").alias("target_table")).distinct(), today="2026-02-01")
    return ups.select("t", "upstream")


@query(f"SELECT 'tgt.' || {_T_NAME} AS target_table, CASE WHEN n_nationkey % 2 = 0 THEN 'mapped' || n_nationkey ELSE 'guess' END AS join_keys, CASE WHEN n_nationkey % 4 = 0 THEN 'loaded_at' ELSE 'guessed_ts' END AS date_column FROM nation")
def q_mapping_over_guesses(spark, sf_dir):
    mapping = {x["name"]: artifacts.TableMapping(keys=[f"mapped{x['n']}"], date_column="loaded_at" if x["n"] % 4 == 0 else None) for x in _nations(spark, sf_dir) if x["n"] % 2 == 0}
    guessed = spark.table("nation").selectExpr(f"concat('tgt.', {_T_NAME}) AS target_table", "array('guess') AS join_keys", "'guessed_ts' AS date_column")
    return known(spark, guessed, mapping).withColumn("join_keys", F.array_join("join_keys", ","))


# --- reports -----------------------------------------------------------------------------------------------
class _Run:
    """An analysis without confirmation, as the reports read it."""

    def __init__(self, spark, sf_dir):
        _, _, (main, metrics, details) = _compared(spark, sf_dir)
        self.recon_id = "r1"
        self.findings, self.samples, self.hypotheses = _classified(spark, sf_dir)
        self.summaries = ingest.ingest(main, metrics, details, "r1")[2].persist()
        self.top = lambda: classify.top(self.hypotheses).join(self.findings, "finding_id")


@query(
    """SELECT 'tgt.orders' AS target_table, count(*) FILTER (WHERE o_orderkey % 50 = 7) AS missing_in_target, count(*) FILTER (WHERE o_orderkey % 97 = 3) AS missing_in_source,
  CAST(0 AS DOUBLE) AS row_match_pct, CAST(5 AS BIGINT) AS migration_induced, CAST(1 AS BIGINT) AS genuine_data, CAST(0 AS BIGINT) AS benign, CAST(0 AS BIGINT) AS needs_review, 'custkey,price,status,ts' AS columns FROM orders"""
)
def q_report_overview(spark, sf_dir):
    return reports.overview(_Run(spark, sf_dir)).drop("source_table").withColumn("columns", F.array_join("columns", ","))


_CAPPED = """SELECT c AS "column", n AS mismatch_count, common_rows, round(100 * (1 - least(n / common_rows, 1)), 2) AS column_match_pct
FROM (SELECT unnest(['custkey', 'price', 'status', 'ts']) AS c, unnest([least(200, count(*) FILTER (WHERE o_orderkey % 20 = 0)), least(200, count(*)), least(200, count(*) FILTER (WHERE o_orderkey % 10 = 0)), least(200, count(*))]) AS n, count(*) AS common_rows FROM orders WHERE o_orderkey % 50 <> 7)"""


@query(_CAPPED)
def q_report_column_rates(spark, sf_dir):
    return reports.match_rates(_Run(spark, sf_dir))[1].select("column", "mismatch_count", "common_rows", "column_match_pct")


@query("SELECT 'src.orders' AS source_table, 'tgt.orders' AS target_table, count(*) AS source_count, count(*) - count(*) FILTER (WHERE o_orderkey % 50 = 7) + count(*) FILTER (WHERE o_orderkey % 97 = 3) AS target_count, CAST(0 AS BIGINT) AS matched_rows, CAST(0 AS DOUBLE) AS row_match_pct FROM orders")
def q_report_table_rates(spark, sf_dir):
    return reports.match_rates(_Run(spark, sf_dir))[0]


@query("SELECT CAST(row_number() OVER (ORDER BY rank, confidence DESC, id) AS BIGINT) AS place, id FROM (VALUES (0, 0.9, '1/column_mismatch/price'), (0, 0.9, '1/column_mismatch/ts'), (0, 0.8, '1/column_mismatch/status'), (0, 0.6, '1/missing_in_source'), (0, 0.6, '1/missing_in_target'), (1, 0.8, '1/column_mismatch/custkey')) v(rank, confidence, id)")
def q_report_order(spark, sf_dir):
    rows = reports.findings(_Run(spark, sf_dir))
    return spark.createDataFrame([(k, f["finding_id"]) for k, f in enumerate(rows, 1)], "place long, id string")


@query("SELECT * FROM (VALUES ('markdown', CAST(10 AS BIGINT)), ('code', CAST(9 AS BIGINT))) v(kind, n)")
def q_report_notebook(spark, sf_dir):
    cells = reports.notebook(_Run(spark, sf_dir))["cells"]
    return spark.createDataFrame([(c["cell_type"],) for c in cells], "kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- streaming ---------------------------------------------------------------------------------------------
@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'timezone' ELSE 'string_format' END AS category FROM events WHERE event_id % 3 < 2")
def q_stream_signals(spark, sf_dir):
    """Detail rows read as a stream, a file at a time, probed batch by batch."""
    views(spark, sf_dir)
    kind = F.col("event_id") % 3
    base = F.when(kind == 0, "2026-01-01 00:00:00").otherwise("Abc")
    other = F.when(kind == 0, "2026-01-01 02:00:00").when(kind == 1, "ABC").otherwise("Abc")
    row = F.create_map(F.lit("k"), F.col("event_id").cast("string"), F.lit("c_base"), base, F.lit("c_compare"), other)
    rows = spark.table("events").select(F.col("event_id").cast("long").alias("recon_table_id"), F.lit("mismatch").alias("recon_type"), F.array(F.lit("c")).alias("mismatch_columns"), F.lit(1).alias("source_count"), F.lit(0).alias("seq"), row.alias("row"))
    arrived, found, at = (fresh_dir(spark, f"stream-{x}") for x in ("in", "out", "at"))
    rows.repartition(3).write.parquet(arrived)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    # A batch that runs again replaces what it wrote.
    started = streaming.on_new_runs(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{found}/batch={n}")).option("checkpointLocation", at).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(found).select(F.col("recon_table_id").alias("event_id"), F.col("signal.category").alias("category"))


#: A key space of orders; source rows of keys 1 mod 6 and target rows of keys 2 mod 7 come, values of 3 mod 10 differ.
_ARRIVED = "SELECT o_orderkey AS k, o_orderkey % 6 <> 1 AS s, o_orderkey % 7 <> 2 AS t, o_orderkey % 10 = 3 AS d FROM orders"


@query(f"SELECT k, CASE WHEN NOT s THEN 'missing_in_source' WHEN NOT t THEN 'missing_in_target' ELSE 'mismatch' END AS kind FROM ({_ARRIVED}) WHERE (s OR t) AND NOT (s AND t AND NOT d)")
def q_stream_findings(spark, sf_dir):
    """Both tables as streams, the target's even keys a day late: first taken for missing, then put right."""
    views(spark, sf_dir)
    rows = spark.sql(_ARRIVED)
    shown = F.when(F.col("d"), "other").otherwise("same")
    early, later = F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-02").cast("timestamp")
    source = rows.where("s").select("k", F.lit("same").alias("v"), early.alias("at"))
    target = rows.where("t").select("k", shown.alias("v"), F.when(F.col("k") % 2 == 0, later).otherwise(early).alias("at"))
    tick = spark.range(2).select((-1 - F.col("id")).alias("k"), F.lit("same").alias("v"), (later + F.make_dt_interval(F.col("id") * 2 - 1)).alias("at"))
    ins, out, at = [fresh_dir(spark, f"stream-{x}") for x in "st"], fresh_dir(spark, "stream-out"), fresh_dir(spark, "stream-at")
    # Rows on time, a row that moves the clock on, the late rows, and another.
    steps = [(source, target.where("k % 2 = 1")), (tick.where("k = -1"),) * 2, (source.limit(0), target.where("k % 2 = 0")), (tick.where("k = -2"),) * 2]
    for n, sides in enumerate(steps):
        for df, path in zip(sides, ins, strict=True):
            df.write.mode("append").parquet(path)
        streams = [spark.readStream.schema(source.schema).parquet(p) for p in ins]
        found = streaming.findings(*streams, ["k"], "at", late="1 hour", wait="1 hour", keep="30 days")
        sink = lambda df, i, n=n: df.write.mode("overwrite").parquet(f"{out}/run={n}/batch={i}")
        found.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy(F.col("key")["k"].cast("long").alias("k")).agg(F.max_by("kind", "revision").alias("kind"))
    return last.where("kind <> 'equal' AND k >= 0")


# --- narrowed comparison, laid-out tables, patterns ----------------------------------------------------------
#: Orders against a copy in which one stretch of keys has other prices, a few rows are gone and one in 5000 is new.
_STRETCH = "o_orderkey BETWEEN 2000 AND 2400"
_FEW = f"""SELECT o_orderkey AS k, o_custkey AS custkey, o_totalprice AS price, o_orderpriority AS priority FROM orders"""
_COPY = f"""SELECT o_orderkey AS k, o_custkey AS custkey, CASE WHEN {_STRETCH} THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey NOT BETWEEN 3001 AND 3010
UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 5000 = 1"""
_FEW_SQL = f"""SELECT count(*) AS source_rows, (SELECT count(*) FROM ({_COPY})) AS target_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 5000 = 1) AS missing_in_source, count(*) FILTER (WHERE o_orderkey BETWEEN 3001 AND 3010) AS missing_in_target,
  count(*) FILTER (WHERE {_STRETCH}) AS absolute_mismatch, CAST(0 AS BIGINT) AS n_custkey, count(*) FILTER (WHERE {_STRETCH}) AS n_price, CAST(0 AS BIGINT) AS n_priority FROM orders"""


def _few(spark, sf_dir):
    views(spark, sf_dir)
    return spark.sql(_FEW), spark.sql(_COPY)


@query(_FEW_SQL)
def q_narrowed_compare(spark, sf_dir):
    """Only the key ranges whose digests differ are joined."""
    return compare.Difference.of(*_few(spark, sf_dir), compare.Pair(keys=["k"]), narrowed=True).counts()


@query(f"""WITH s AS ({_FEW}), t AS ({_COPY}), ends AS (SELECT min(k) AS lo, max(k) AS hi FROM (SELECT k FROM s UNION ALL SELECT k FROM t)),
w AS (SELECT lo, CASE WHEN hi - lo + 1 <= 16 THEN 1 WHEN hi - lo + 1 <= 256 THEN 16 WHEN hi - lo + 1 <= 4096 THEN 256 ELSE CAST(ceil((hi - lo + 1) / 65536.0) AS BIGINT) * 4096 END AS w FROM ends),
a AS (SELECT (k - lo) // w AS range, count(*) AS n FROM s, w GROUP BY 1), b AS (SELECT (k - lo) // w AS range, count(*) AS n FROM t, w GROUP BY 1),
d AS (SELECT DISTINCT (k - lo) // w AS range FROM w, ((SELECT * FROM s EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM s)))
SELECT range, coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows, d.range IS NOT NULL AS differs FROM a FULL JOIN b USING (range) LEFT JOIN d USING (range)""")
def q_range_checksums(spark, sf_dir):
    laid = meeting.laid_out(*_few(spark, sf_dir), compare.Pair(keys=["k"]))
    return checksums.tree(laid, fan=16).levels[0].select("range", "source_rows", "target_rows", "differs")


@query(_FEW_SQL)
def q_laid_out_compare(spark, sf_dir):
    """Both tables written by key once and read without an exchange."""
    return compare.Difference(layout.co_locate(*_few(spark, sf_dir), compare.Pair(keys=["k"])).sides).counts()


@query("SELECT count(*) AS source_rows, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS n_map, count(*) FILTER (WHERE o_orderkey % 9 = 2) AS n_variant, count(*) FILTER (WHERE o_orderkey % 6 = 3) AS n_dotted FROM orders")
def q_compare_any_types(spark, sf_dir):
    """Maps, variants, and columns with dots in their names and names that the comparison might use."""
    views(spark, sf_dir)
    made = "SELECT o_orderkey AS _row, map({}) AS alone, parse_json(concat('{{\"a\": ', {}, ', \"b\": [1, 2]}}')) AS w, {} AS `s0.x` FROM orders"
    s = spark.sql(made.format("'p', 1, 'q', o_custkey", "o_custkey", "o_custkey"))
    t = spark.sql(made.format("'q', if(o_orderkey % 4 = 1, -1, o_custkey), 'p', 1", "if(o_orderkey % 9 = 2, -1, o_custkey)", "if(o_orderkey % 6 = 3, -1, o_custkey)"))
    n = compare.Difference.of(s, t, compare.Pair(keys=["_row"])).counts()
    return n.select("source_rows", F.col("n_alone").alias("n_map"), F.col("n_w").alias("n_variant"), F.col("`n_s0.x`").alias("n_dotted"))


@query("""WITH gone AS (SELECT o_orderpriority AS v FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey % 40 = 0), n AS (SELECT v, count(*) AS n FROM gone GROUP BY 1)
SELECT 'missing_in_target' AS recon_type, 'priority' AS dimension, CAST(sum(n) AS BIGINT) AS total, max_by(v, n) AS mode, max(n) AS top, round(max(n) / sum(n), 6) AS share, max(n) >= 0.6 * sum(n) AS clustered,
  (SELECT round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 6) FROM orders) AS usual FROM n""")
def q_row_patterns(spark, sf_dir):
    """Which column's value the rows of a finding share."""
    s, _ = _few(spark, sf_dir)
    found = compare.Difference.of(s, s.where("NOT (priority = '1-URGENT' OR k % 40 = 0)"), compare.Pair(keys=["k"]))
    shown = patterns.concentration(found, ["priority"])
    return shown.select("recon_type", "dimension", "total", "mode", "top", "share", "clustered", "usual")


# --- scenarios ---------------------------------------------------------------------------------------------
def _expected() -> str:
    rows = ", ".join(f"('{i}', '{t}', '{c}', '{v}', true)" for i, t, _, _, c, v in scenarios.SCENARIOS)
    return f'SELECT * FROM (VALUES {rows}) v(id, "table", got_category, got_verdict, passed)'


@query(_expected())
def q_scenarios(spark, sf_dir):
    return scenarios.validate(spark).select("id", "table", "got_category", "got_verdict", "passed")


@query("SELECT count(*) FILTER (WHERE n_nationkey % 3 <> 1) AS passed, count(*) FILTER (WHERE n_nationkey % 3 = 1) AS failed, count(*) AS scenarios FROM nation")
def q_scenario_totals(spark, sf_dir):
    """A scenario for each nation: a third found as it must be, a third found otherwise, a third not to be found."""
    views(spark, sf_dir)
    n = spark.table("nation").withColumn("t", F.format_string("t%d", "n_nationkey"))
    kind = F.col("n_nationkey") % 3
    asked = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("t").alias("table"), F.lit(None).cast("string").alias("column"), F.when(kind == 2, "none").otherwise("schema").alias("recon_type"), F.when(kind == 2, "none").otherwise("type_precision").alias("category"), F.when(kind == 2, "none").otherwise("migration_induced").alias("verdict"))
    found = n.where(kind < 2).select(F.col("t").alias("finding_id"), F.concat(F.lit("x."), F.upper("t")).alias("target_table"), F.lit("schema").alias("recon_type"), F.lit(None).cast("string").alias("column"))
    said = n.where(kind < 2).select(F.col("t").alias("finding_id"), F.lit("type_precision").alias("category"), F.when(kind == 0, "migration_induced").otherwise("needs_review").alias("verdict"), F.lit(0.7).alias("confidence"), F.lit(1).alias("seq"))
    return scenarios.totals(scenarios.matched(asked, found, said))


# --- passes and reports over one finding for each nation -----------------------------------------------------
_EVIDENCE = "array<struct<label:string,detail:string,query:string,data:map<string,string>>>"


def _findings(spark, sf_dir, recon_type: str, column: str = "'c'", category: str = "'upstream_drift'", verdict: str = "'genuine_data'", confidence: str = "0.8") -> tuple[DataFrame, DataFrame]:
    """(findings, hypotheses), by expressions over nation."""
    views(spark, sf_dir)
    n = spark.table("nation")
    f = n.selectExpr("cast(n_nationkey as string) AS finding_id", "cast(n_nationkey as bigint) AS recon_table_id", f"{recon_type} AS recon_type", f"{column} AS column", f"concat('src.', {_T_NAME}) AS source_table", f"concat('tgt.', {_T_NAME}) AS target_table", "cast(n_nationkey + 1 as bigint) AS mismatch_count", "cast(100 as bigint) AS total_count")
    h = n.selectExpr("cast(n_nationkey as string) AS finding_id", f"{category} AS category", f"{verdict} AS verdict", f"cast({confidence} as double) AS confidence", "repeat('r', cast(n_nationkey * 10 as int)) AS rationale", f"cast(array() as {_EVIDENCE}) AS evidence", "1 AS seq", "concat('owner', n_regionkey) AS owner", "repeat('f', cast(n_nationkey * 10 as int)) AS remediation")
    return f, h


_KIND = "case n_nationkey % 3 when 0 then 'schema' when 1 then 'missing_in_target' else 'missing_in_source' end"


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'type_precision' WHEN 1 THEN 'volume_missing' ELSE 'volume_extra' END AS category, 'migration_induced' AS verdict, CAST(CASE n_nationkey % 3 WHEN 0 THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence, 'migration engineer' AS owner FROM nation")
def q_row_and_schema_findings(spark, sf_dir):
    f, _ = _findings(spark, sf_dir, _KIND)
    none = spark.createDataFrame([], "finding_id string, seq int, source_value string, target_value string")
    done = classify.classify(f, none)
    return done.select(F.col("finding_id").cast("int").alias("n_nationkey"), "category", "verdict", "confidence", "owner")


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'needs_review' ELSE 'genuine_data' END AS verdict, n_nationkey % 2 = 0 AS code_generated,
  CASE WHEN n_nationkey % 2 = 0 THEN 'migration engineer + data owner (decide)' ELSE 'owner' || n_regionkey END AS owner, CAST(0.9 AS DOUBLE) AS confidence,
  CASE WHEN n_nationkey % 5 = 0 THEN 'error parse line ' || n_nationkey ELSE '-' END AS issue FROM nation"""
)
def q_generated_columns_and_issues(spark, sf_dir):
    """A derivation that doesn't name its column makes it up; translation issues come with the column's findings."""
    f, h = _findings(spark, sf_dir, "'column_mismatch'")
    n = spark.table("nation")
    made = F.col("n_nationkey") % 2 == 0
    t = n.select(F.expr(_T_NAME).alias("table"), F.lit("c").alias("column"), F.when(made, "upper('x')").otherwise("upper(c)").alias("expr"), F.array(F.lit("UPPER")).alias("functions"), F.lit(False).alias("is_direct"), F.when(made, F.array().cast("array<string>")).otherwise(F.array(F.lit("C"))).alias("references"))
    issues = n.where("n_nationkey % 5 = 0").select(F.expr(_T_NAME).alias("table"), F.lit("error").alias("severity"), F.lit("parse").alias("kind"), F.format_string("line %d", "n_nationkey").alias("message"))
    done = passes.code_pass(f, h, t, issues=issues)
    said = F.filter("evidence", lambda e: e["label"] == "transpile")
    return done.select(F.col("finding_id").cast("int").alias("n_nationkey"), "verdict", "code_generated", "owner", "confidence", F.coalesce(F.get(said, F.lit(0))["detail"], F.lit("-")).alias("issue"))


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN '-' WHEN n_nationkey % 4 = 2 THEN 'Fed by raw.a, raw.b' WHEN n_nationkey % 4 = 1 THEN 'Fed by raw.other; not the source it is compared with.' ELSE 'Fed by raw.' || {_T_NAME} END AS detail FROM nation")
def q_lineage_evidence(spark, sf_dir):
    """A column's one upstream that isn't its source is said so; several are listed; some have none."""
    f, h = _findings(spark, sf_dir, "'column_mismatch'")
    k = F.col("n_nationkey") % 4
    fed = F.when(k == 0, F.array(F.concat(F.lit("raw."), F.expr(_T_NAME)))).when(k == 1, F.array(F.lit("raw.other"))).when(k == 2, F.array(F.lit("raw.b"), F.lit("raw.a")))
    ups = spark.table("nation").select(F.concat(F.lit("tgt."), F.expr(_T_NAME)).alias("t"), F.lit("c").alias("column"), F.explode(fed).alias("upstream"))
    done = lineage.lineage_pass(f, h, ups)
    return done.select(F.col("finding_id").cast("int").alias("n_nationkey"), F.coalesce(F.get("evidence", F.lit(0))["detail"], F.lit("-")).alias("detail"))


class _Made:
    """An analysis of given findings and hypotheses."""

    def __init__(self, f: DataFrame, h: DataFrame):
        self.recon_id, self.findings, self.hypotheses = "r1", f, h
        self.summaries = f.selectExpr("recon_table_id", "source_table", "target_table", "array('id') AS join_keys").distinct()


def _shortened(column: str, most: int) -> str:
    return f"CASE WHEN n_nationkey * 10 <= {most} THEN repeat('{column}', n_nationkey * 10) ELSE repeat('{column}', {most - 3}) || '...' END"


_VERDICT = "case n_nationkey % 4 when 0 then 'migration_induced' when 1 then 'genuine_data' when 2 then 'benign' else 'needs_review' end"


@query(
    f"""SELECT '**tgt.' || {_T_NAME} || '**' AS line FROM nation UNION ALL
SELECT '- c: timezone (' || {_VERDICT} || ', 0.' || CAST(50 + n_nationkey AS VARCHAR) || ')' || rtrim(' ' || {_shortened('r', 110)}) FROM nation UNION ALL SELECT '## In short' UNION ALL
SELECT count(*) FILTER (WHERE n_nationkey % 4 = 0) || ' migration induced, ' || count(*) FILTER (WHERE n_nationkey % 4 = 1) || ' genuine data, ' || count(*) FILTER (WHERE n_nationkey % 4 = 2) || ' benign, ' || count(*) FILTER (WHERE n_nationkey % 4 = 3) || ' needs review' FROM nation"""
)
def q_report_short(spark, sf_dir):
    made = _Made(*_findings(spark, sf_dir, "'column_mismatch'", category="'timezone'", verdict=_VERDICT, confidence="0.5 + n_nationkey / 100"))
    return spark.createDataFrame([(x.strip(),) for x in reports.tldr(reports.findings(made)).split("\n") if x], "line string")


@query(f"SELECT '### owner' || n_regionkey AS line FROM nation GROUP BY n_regionkey UNION ALL SELECT '- tgt.' || {_T_NAME} || '.c: ' || CASE WHEN n_nationkey = 0 THEN 'look into it' ELSE {_shortened('f', 130)} END FROM nation UNION ALL SELECT '## Who does what'")
def q_report_conclusion(spark, sf_dir):
    made = _Made(*_findings(spark, sf_dir, "'column_mismatch'"))
    return spark.createDataFrame([(x,) for x in reports.conclusion(reports.findings(made)).split("\n") if x], "line string")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey, place) AS BIGINT) AS place, what FROM nation, (VALUES (1, 'schema'), (2, 'missing in target'), (3, 'missing in source'), (4, 'c')) v(place, what)")
def q_notebook_order(spark, sf_dir):
    """Table by table: schema, missing rows, surplus rows, columns; each section with a cell to run."""
    parts = [_findings(spark, sf_dir, f"'{k}'", "'c'" if k == "column_mismatch" else "cast(null as string)") for k in ("column_mismatch", "missing_in_source", "schema", "missing_in_target")]
    number = lambda df, k: df.withColumns({"finding_id": F.concat("finding_id", F.lit(f"/{k}"))} | ({"target_table": F.format_string("tgt.n%02d", "recon_table_id")} if "target_table" in df.columns else {}))
    f, h = (reduce(DataFrame.unionByName, [number(p[i], k) for k, p in enumerate(parts)]) for i in (0, 1))
    cells = reports.notebook(_Made(f, h))["cells"]
    titles = [c["source"].split("\n")[0] for c in cells if c["source"].startswith("### tgt.n")]
    what = [t[len("### tgt.n00") :].strip(" .()") for t in titles]
    return spark.createDataFrame(list(enumerate(what, 1)), "place long, what string")


@query(f"SELECT n_nationkey, count(*) FILTER (WHERE o_orderkey % 20 = 0 AND o_orderkey % 50 <> 7) AS column_rows, count(*) FILTER (WHERE o_orderkey % 50 = 7) AS missing, count(*) FILTER (WHERE o_orderkey % 97 = 3) AS extra FROM orders, nation WHERE n_nationkey = 0 GROUP BY 1")
def q_rerun_evidence(spark, sf_dir):
    """The SQL that evidence carries gives the findings' rows again."""
    s, t = pair(spark, sf_dir)
    s.createOrReplaceTempView("rerun_s"), t.createOrReplaceTempView("rerun_t")
    p = compare.Pair(keys=["k"])
    n = [spark.sql(drilldown.rerun(p, "rerun_s", "rerun_t", kind, c)).count() for kind, c in (("column_mismatch", "custkey"), ("missing_in_target", None), ("missing_in_source", None))]
    return spark.createDataFrame([(0, *n)], "n_nationkey int, column_rows long, missing long, extra long")


@query(f"SELECT {_T_NAME} AS \"table\", 'key' AS keys, CASE WHEN n_nationkey % 2 = 0 THEN 'ROUND' ELSE '-' END AS functions, 'DECIMAL(18,' || n_regionkey || ')' AS source_type, CASE WHEN n_nationkey % 3 = 0 THEN 'found ' || n_nationkey ELSE '-' END AS issue, CASE WHEN n_nationkey % 2 = 0 THEN 'v > ' || n_nationkey ELSE '-' END AS target_filter FROM nation")
def q_build_mapping(spark, sf_dir):
    """Config, translated SQL, source types, manifest and error log laid over one another."""
    every = _nations(spark, sf_dir)
    code = "\n".join(f"INSERT INTO tgt.{x['name']} SELECT id, round(v, 2) AS v FROM src.{x['name']} WHERE v > {x['n']};" for x in every if x["n"] % 2 == 0)
    scripts_ = _file(spark, "load.sql", code)
    ddl = _file(spark, "tables.sql", "\n".join(f"CREATE TABLE src.{x['name']} (id NUMBER(38,0), v NUMBER(18,{x['r']}));" for x in every))
    config_ = _written(spark, json.dumps({"tables": [{"source_name": f"src.{x['name']}", "target_name": f"tgt.{x['name']}", "join_columns": ["guess"]} for x in every]}), "config")
    log = _written(spark, "\n".join(f"code=7, kind=k, severity=error, path='/x/{x['name']}.sql', message='found {x['n']}'" for x in every if x["n"] % 3 == 0), "log")
    found = artifacts.build_mapping(spark, config=config_, translated_sql=scripts_, source_scripts=ddl, error_log=log, manifest_entries=[{"target": f"tgt.{x['name']}", "join_keys": ["key"]} for x in every])
    rows = [(k, ",".join(m.keys), ",".join(m.transforms["v"].functions) if m.transforms else "-", m.source_types["v"], m.issues[0]["message"] if m.issues else "-", (m.target_filter or "-").strip("()")) for k, m in found.items()]
    return spark.createDataFrame(rows, "table string, keys string, functions string, source_type string, issue string, target_filter string")


@query(f"SELECT 'tgt.' || {_T_NAME} AS target_table, n_nationkey + 1 AS mismatch_count, 'timezone' AS category FROM nation")
def q_report_json(spark, sf_dir):
    made = _Made(*_findings(spark, sf_dir, "'column_mismatch'", category="'timezone'"))
    rows = json.loads(json.dumps(reports.to_dict(made), default=str))["findings"]
    return spark.createDataFrame([(f["target_table"], f["mismatch_count"], f["hypotheses"][0]["category"]) for f in rows], "target_table string, mismatch_count long, category string")


@query("SELECT n_nationkey, n_name || chr(233) AS shown, 'cafe' || chr(769) AS made, true AS has_user FROM nation")
def q_string_codes(spark, sf_dir):
    views(spark, sf_dir)
    return spark.table("nation").select("n_nationkey", F.decode(F.unhex(F.concat(F.hex("n_name"), F.lit("C3A9"))), "UTF-8").alias("shown"), F.expr("concat('caf', 'e', decode(unhex('CC81'), 'UTF-8'))").alias("made"), (F.length(F.current_user()) > 0).alias("has_user"))
