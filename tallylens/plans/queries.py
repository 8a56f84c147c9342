"""The registered queries: each operator over the test tables, with the SQL that must give the same rows.

Source and target are derived from `orders` by deterministic expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import knowledge
from ..functions import probes
from ..operators import classify, compare, drilldown, ingest, lineage, merge, passes, patterns, validate
from ..sources import artifacts
from .analyze import analyze

_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(0.0034 AS DECIMAL(5,4)) AS DECIMAL(18,4))"
_PRICE_CUT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(0.0030 AS DECIMAL(5,4)) AS DECIMAL(18,4))"
_LATER = "o_orderdate + INTERVAL '5' HOUR + INTERVAL '30' MINUTE"
SOURCE = f"SELECT o_orderkey AS k, o_custkey AS custkey, o_orderstatus AS status, {_PRICE} AS price, o_orderdate AS ts, o_orderpriority AS priority FROM orders"
TARGET = f"""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_custkey END AS custkey,
  CASE WHEN o_orderkey % 10 = 0 THEN lower(o_orderstatus) || '  ' ELSE o_orderstatus END AS status,
  {_PRICE_CUT} AS price, {_LATER} AS ts, o_orderpriority AS priority FROM orders WHERE o_orderkey % 50 <> 7
UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, {_PRICE_CUT}, {_LATER}, o_orderpriority FROM orders WHERE o_orderkey % 97 = 3"""
#: DuckDB's side of every query over the pair.
_WITH = f"WITH s AS ({SOURCE}), t AS ({TARGET})"
NAMES = ("orders", "customer", "lineitem", "events", "nation", "part")


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views(spark, sf_dir, ("orders",))
    return spark.sql(SOURCE), spark.sql(TARGET)


# --- value pairs, one for each branch of the probes: source text, target text, expected rows --------------
_K = "CAST(o_orderkey AS STRING)"
_K1 = "CAST(o_orderkey + 1 AS STRING)"
#: name: (source, target, condition that a signal fires, category, strength)
PAIRS = {
    "numeric_wrap32": ("CAST(3000000000 + o_orderkey AS STRING)", "CAST(3000000000 + o_orderkey - 4294967296 AS STRING)", "true", "type_precision", "0.92"),
    "numeric_wrap64": ("CAST(CAST('18446744073709551616' AS DECIMAL(38,0)) + o_orderkey AS STRING)", _K, "true", "type_precision", "0.92"),
    "numeric_scale": (f"{_K} || '.1234'", f"{_K} || '.12'", "true", "type_precision", "0.9"),
    "numeric_whole": (f"{_K} || '.25'", _K, "true", "transpilation", "0.85"),
    "numeric_cut": (f"{_K} || '.5'", _K1, "o_orderkey % 2 = 1 OR o_orderkey >= 10", "transpilation", "CASE WHEN o_orderkey % 2 = 1 THEN 0.85 ELSE 0.72 END"),
    "numeric_tiny": (f"{_K1} || '.0000000001'", f"{_K1} || '.0000000002'", "true", "type_precision", "0.7"),
    "numeric_small": ("CAST(o_orderkey + 1000 AS STRING) || '.5'", "CAST(o_orderkey + 1000 AS STRING) || '.9'", "true", "type_precision", "0.6"),
    "numeric_factor": ("CAST((o_orderkey + 1) * 100 AS STRING)", _K1, "true", "transpilation", "0.6"),
    "temporal_offset": ("'2026-01-01 00:00:00'", "'2026-01-01 0' || CAST(o_orderkey % 9 AS STRING) || ':00:00'", "o_orderkey % 9 > 0", "timezone", "0.9"),
    "temporal_dates": ("'2026-01-1' || CAST(o_orderkey % 5 AS STRING)", "'2026-01-1' || CAST(o_orderkey % 5 + 1 AS STRING)", "true", "env_config", "0.75"),
    "temporal_fraction": ("'2026-01-01 00:00:00.1'", "'2026-01-01T00:00:00.25'", "true", "type_precision", "0.7"),
    "temporal_drift": ("'2026-01-01 00:00:00'", "'2026-01-' || CAST(10 + o_orderkey % 9 AS STRING) || ' 01:00:00'", "true", "upstream_drift", "0.65"),
    "string_spaces": (f"o_orderstatus || {_K}", f"'  ' || o_orderstatus || {_K} || ' '", "true", "string_format", "0.9"),
    "string_case": (f"'Abc' || {_K}", f"'aBC' || {_K}", "true", "string_format", "0.85"),
    "string_form": (f"'Café' || {_K}", f"'CAFÉ' || {_K} || ' '", "true", "string_format", "0.8"),
    "null_forms": ("CAST(NULL AS STRING)", "''", "true", "null_boolean", "0.85"),
    "null_sentinel": ("CAST(NULL AS STRING)", "'-1'", "true", "null_boolean", "0.85"),
    "null_one_side": (f"'x' || {_K}", "CAST(NULL AS STRING)", "true", "upstream_drift", "0.8"),
    "boolean_words": ("CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'no' END", "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '0' END", "true", "null_boolean", "0.85"),
    "json_order": (f"'{{\"a\":' || {_K} || ',\"b\":1}}'", f"'{{\"b\":1,\"a\":' || {_K} || '}}'", "true", "semi_structured", "0.9"),
    "json_values": (f"'{{\"a\":' || {_K} || '}}'", f"'{{\"a\":' || {_K1} || '}}'", "true", "semi_structured", "0.6"),
}


def _probe_query(name: str):
    source, target = PAIRS[name][:2]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        rows = spark.sql(f"SELECT o_orderkey AS id, {source} AS s, {target} AS t FROM orders")
        found = probes.each_signal(probes.with_signals(rows, "s", "t"), "id")
        return found.select("id", "signal.category", "signal.strength")

    return run


def _probe_sql(name: str) -> str:
    _, _, fires, category, strength = PAIRS[name]
    return f"SELECT o_orderkey AS id, '{category}' AS category, CAST({strength} AS DOUBLE) AS strength FROM orders WHERE {fires}"


# --- relational queries over the pair ----------------------------------------------------------------------
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _compared(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    p = compare.Pair(keys=["k"])
    return s, t, compare.compare(s, t, p, recon_id="r1", table_id=1, source_name="src.orders", target_name="tgt.orders")


@query(f"{_WITH} SELECT count(*) AS n FROM s JOIN t USING (k) WHERE s.price <> t.price")
def q_inner_compare_orders(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    return s.join(t, "k").where(s["price"] != t["price"]).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH} SELECT count(*) AS n, count(*) FILTER (WHERE s.custkey IS NULL OR t.custkey IS NULL) AS null_involved FROM s JOIN t USING (k) WHERE s.custkey IS DISTINCT FROM t.custkey")
def q_nullsafe_diff(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    both = s.join(t, "k").where(~s["custkey"].eqNullSafe(t["custkey"]))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(s["custkey"].isNull() | t["custkey"].isNull()).alias("null_involved"))


@query(f"{_WITH} SELECT k, status FROM s ANTI JOIN t USING (k)")
def q_missing_in_target(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    return s.join(t, "k", "left_anti").select("k", "status")


@query(f"{_WITH} SELECT k, status FROM t ANTI JOIN s USING (k)")
def q_extra_in_target(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    return t.join(s, "k", "left_anti").select("k", "status")


@query(
    f"""{_WITH}, b AS (SELECT s.k AS a, t.k AS b, s.custkey IS DISTINCT FROM t.custkey AS c1, s.status IS DISTINCT FROM t.status AS c2, s.price IS DISTINCT FROM t.price AS c3,
  s.ts IS DISTINCT FROM t.ts AS c4, s.priority IS DISTINCT FROM t.priority AS c5 FROM s FULL JOIN t ON s.k = t.k)
SELECT count(a) AS source_rows, count(b) AS target_rows, count(*) FILTER (WHERE a IS NULL) AS missing_in_source, count(*) FILTER (WHERE b IS NULL) AS missing_in_target,
  count(*) FILTER (WHERE a = b AND (c1 OR c2 OR c3 OR c4 OR c5)) AS absolute_mismatch, count(*) FILTER (WHERE a = b AND c1) AS n_custkey, count(*) FILTER (WHERE a = b AND c2) AS n_status,
  count(*) FILTER (WHERE a = b AND c3) AS n_price, count(*) FILTER (WHERE a = b AND c4) AS n_ts, count(*) FILTER (WHERE a = b AND c5) AS n_priority FROM b"""
)
def q_full_outer_compare(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    return compare.Difference.of(s, t, compare.Pair(keys=["k"])).counts()


@query(
    """SELECT 'custkey,status,price,ts' AS mismatch_columns, count(*) AS source_count, count(*) FILTER (WHERE o_orderkey % 50 = 7) AS missing_in_target,
  count(*) FILTER (WHERE o_orderkey % 97 = 3) AS missing_in_source, count(*) FILTER (WHERE o_orderkey % 50 <> 7) AS absolute_mismatch, true AS schema_ok FROM orders"""
)
def q_compare_ingest_tables(spark, sf_dir):
    _, _, (main, metrics, _) = _compared(spark, sf_dir)
    return ingest.tables(main, metrics, "r1").select("mismatch_columns", "source_count", "missing_in_target", "missing_in_source", "absolute_mismatch", "schema_ok").withColumn("mismatch_columns", F.array_join("mismatch_columns", ","))


@query(
    """SELECT source_count, common_rows, matched_rows, round(100.0 * matched_rows / source_count, 2) AS row_match_pct
FROM (SELECT count(*) AS source_count, count(*) FILTER (WHERE o_orderkey % 50 <> 7) AS common_rows, count(*) FILTER (WHERE o_orderkey % 50 <> 7 AND o_orderkey % 10 <> 0) AS matched_rows FROM orders)"""
)
def q_row_match_pct(spark, sf_dir):
    s, t = (x.select("k", "status") for x in pair(spark, sf_dir))
    main, metrics, _ = compare.compare(s, t, compare.Pair(keys=["k"]), recon_id="r1", table_id=1, source_name="a.s", target_name="a.t")
    return ingest.with_rates(ingest.tables(main, metrics, "r1")).select("source_count", "common_rows", "matched_rows", "row_match_pct")


_DRILL = ["custkey", "status", "price", "ts"]


def _confirmed(spark, sf_dir, categories):
    s, t = pair(spark, sf_dir)
    return drilldown.confirm_columns(s, t, ["k"], categories)


@query(f"{_WITH} SELECT CAST(count(DISTINCT epoch(t.ts) - epoch(s.ts)) AS DOUBLE) AS distinct_offsets, max(epoch(t.ts) - epoch(s.ts)) / 3600.0 AS offset_hours, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT epoch(t.ts) - epoch(s.ts)) = 1 AS confirmed FROM s JOIN t USING (k) WHERE s.ts IS DISTINCT FROM t.ts")
def q_tz_offset_drill(spark, sf_dir):
    m = F.col("measures")
    return _confirmed(spark, sf_dir, {"ts": "timezone"}).select(*[m[c].alias(c) for c in ("distinct_offsets", "offset_hours", "n")], "confirmed")


@query("SELECT CAST(count(DISTINCT 1 + o_orderkey % 5) AS DOUBLE) AS distinct_offsets, count(DISTINCT 1 + o_orderkey % 5) = 1 AS confirmed FROM orders")
def q_tz_varying(spark, sf_dir):
    s, _ = pair(spark, sf_dir)
    t = s.withColumn("ts", F.expr("ts + make_dt_interval(0, 1 + k % 5)"))
    done = drilldown.confirm_columns(s, t, ["k"], {"ts": "timezone"})
    return done.select(F.col("measures")["distinct_offsets"].alias("distinct_offsets"), "confirmed")


@query(f"{_WITH} SELECT CAST(count(*) AS DOUBLE) AS n, round(avg(abs(CAST(s.price AS DOUBLE) - CAST(t.price AS DOUBLE))), 6) AS avg_abs_diff, CAST(count(*) FILTER (WHERE round(CAST(s.price AS DOUBLE), 2) = CAST(t.price AS DOUBLE)) AS DOUBLE) AS eq_at_2dp FROM s JOIN t USING (k) WHERE s.price IS DISTINCT FROM t.price")
def q_precision_drill(spark, sf_dir):
    m = F.col("measures")
    return _confirmed(spark, sf_dir, {"price": "type_precision"}).select(m["n"].alias("n"), F.round(m["avg_abs_diff"], 6).alias("avg_abs_diff"), m["eq_at_2dp"].alias("eq_at_2dp"))


@query(f"{_WITH} SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE lower(trim(s.status)) = lower(trim(t.status))) AS DOUBLE) AS cosmetic, true AS confirmed FROM s JOIN t USING (k) WHERE s.status IS DISTINCT FROM t.status")
def q_string_drill(spark, sf_dir):
    m = F.col("measures")
    return _confirmed(spark, sf_dir, {"status": "string_format"}).select(m["n"].alias("n"), m["cosmetic"].alias("cosmetic"), "confirmed")


@query(f"{_WITH} SELECT CAST((SELECT count(*) FROM s) AS DOUBLE) AS src_total, CAST((SELECT count(*) FROM s WHERE custkey IS NULL) AS DOUBLE) AS src_nulls, CAST(count(*) AS DOUBLE) AS n FROM s JOIN t USING (k) WHERE s.custkey IS DISTINCT FROM t.custkey")
def q_provenance(spark, sf_dir):
    m = F.col("measures")
    return _confirmed(spark, sf_dir, {"custkey": "upstream_drift"}).select(*[m[c].alias(c) for c in ("src_total", "src_nulls", "n")])


@query(
    f"""{_WITH}, b AS (SELECT s.custkey AS c1, t.custkey AS d1, s.status AS c2, t.status AS d2, s.price AS c3, t.price AS d3, s.ts AS c4, t.ts AS d4 FROM s JOIN t USING (k))
SELECT 'custkey' AS "column", count(*) FILTER (WHERE c1 IS DISTINCT FROM d1) AS n, true AS confirmed FROM b UNION ALL SELECT 'status', count(*) FILTER (WHERE c2 IS DISTINCT FROM d2), true FROM b
UNION ALL SELECT 'price', count(*) FILTER (WHERE c3 IS DISTINCT FROM d3), true FROM b UNION ALL SELECT 'ts', count(*) FILTER (WHERE c4 IS DISTINCT FROM d4), true FROM b"""
)
def q_fused_drill(spark, sf_dir):
    done = _confirmed(spark, sf_dir, {"custkey": "upstream_drift", "status": "string_format", "price": "type_precision", "ts": "timezone"})
    return done.select("column", F.col("measures")["n"].cast("long").alias("n"), "confirmed")


@query("SELECT max(o_orderkey) AS src_max, max(o_orderkey) FILTER (WHERE o_orderkey < 900) AS tgt_max, true AS watermark FROM orders")
def q_watermark(spark, sf_dir):
    s, _ = pair(spark, sf_dir)
    return drilldown.confirm_missing(s, s.where("k < 900"), ["k"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_duplicate_keys(spark, sf_dir):
    views(spark, sf_dir)
    return spark.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 97 = 3) AS extra, count(*) FILTER (WHERE o_orderkey % 10 = 1) AS duplicates, true AS confirmed FROM orders")
def q_extra_and_duplicates(spark, sf_dir):
    s, _ = pair(spark, sf_dir)
    t = s.union(s.where("k % 10 = 1")).union(s.where("k % 97 = 3").withColumn("k", F.col("k") + 100000000))
    return drilldown.confirm_extra(s, t, ["k"])


@query("SELECT o_custkey % 5 AS store, CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, count(*) AS orders FROM orders GROUP BY 1, 2")
def q_daily_agg(spark, sf_dir):
    views(spark, sf_dir)
    return spark.table("orders").groupBy((F.col("o_custkey") % 5).alias("store"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"), F.count(F.lit(1)).alias("orders"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS BIGINT) AS revenue FROM orders GROUP BY 1")
def q_daily_agg_round(spark, sf_dir):
    views(spark, sf_dir)
    return spark.table("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 0).cast("long").alias("revenue"))


@query("SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(weekofyear(o_orderdate) AS INTEGER) AS week_id, count(*) AS orders FROM orders GROUP BY 1, 2")
def q_weekly_agg(spark, sf_dir):
    views(spark, sf_dir)
    return spark.table("orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week_start"), F.weekofyear("o_orderdate").alias("week_id")).agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT week_start, CASE WHEN d < 7 THEN 'env_config' ELSE 'upstream_drift' END AS category, CAST(d AS BIGINT) AS days FROM (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, 1 + dayofyear(CAST(date_trunc('week', o_orderdate) AS DATE)) % 9 AS d FROM orders)")
def q_weekly_agg_shift(spark, sf_dir):
    weeks = q_weekly_agg(spark, sf_dir).select("week_start").distinct()
    shifted = F.date_sub("week_start", 1 + F.dayofyear("week_start") % 9).cast("string")
    found = weeks.select("week_start", F.explode(probes.temporal(F.col("week_start").cast("string"), shifted)).alias("x"))
    return found.select("week_start", "x.category", F.col("x.meta")["days"].cast("long").alias("days"))


@query(f"{_WITH} SELECT s.status AS source_value, t.status AS target_value, count(*) AS n FROM s JOIN t USING (k) WHERE s.status IS DISTINCT FROM t.status GROUP BY 1, 2")
def q_valuepair_hist(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    both = s.select("k", F.col("status").alias("a")).join(t.select("k", F.col("status").alias("b")), "k").where("not (a <=> b)")
    return patterns.value_pairs(both, "a", "b")


@query(f"{_WITH} SELECT DISTINCT CAST(epoch(t.ts) - epoch(s.ts) AS BIGINT) AS offset_seconds FROM s JOIN t USING (k)")
def q_distinct_offsets(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    gap = F.floor((probes.wall_micros(t["ts"]) - probes.wall_micros(s["ts"])) / 1_000_000)
    return s.join(t, "k").select(gap.cast("long").alias("offset_seconds")).distinct()


@query(f"{_WITH} SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows, count(*) AS matched_keys, round(100.0 * count(*) / (SELECT count(*) FROM s), 2) AS row_match_pct FROM s SEMI JOIN t USING (k)")
def q_validate_rows(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    return validate.validate_rows(s, t, ["k"])


@query(f"{_WITH} SELECT 'status' AS \"column\", count(*) AS compared, count(*) FILTER (WHERE s.status IS NOT DISTINCT FROM t.status) AS equal, round(100.0 * count(*) FILTER (WHERE s.status IS NOT DISTINCT FROM t.status) / count(*), 2) AS column_match_pct FROM s JOIN t USING (k)")
def q_validate_column(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    return validate.validate_column(s, t, ["k"], "status")


@query(f"{_WITH}, a AS (SELECT * FROM s WHERE CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'), b AS (SELECT * FROM t WHERE CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') SELECT 'custkey' AS \"column\", count(*) AS compared, count(*) FILTER (WHERE a.custkey IS NOT DISTINCT FROM b.custkey) AS equal, round(100.0 * count(*) FILTER (WHERE a.custkey IS NOT DISTINCT FROM b.custkey) / nullif(count(*), 0), 2) AS column_match_pct FROM a JOIN b USING (k)")
def q_validate_window(spark, sf_dir):
    import datetime

    s, t = pair(spark, sf_dir)
    return validate.validate_column(s, t, ["k"], "custkey", "ts", datetime.date(1995, 1, 1), datetime.date(1996, 12, 31))


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 3) AS n")
def q_union_all_fanout(spark, sf_dir):
    s, _ = pair(spark, sf_dir)
    return s.union(s.where("k % 97 = 3")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH} SELECT 's' AS side, k, status FROM s UNION ALL BY NAME SELECT status, 't' AS side, k FROM t")
def q_union_by_name(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    return s.select(F.lit("s").alias("side"), "k", "status").unionByName(t.select("status", F.lit("t").alias("side"), "k"))


@query("SELECT o_orderkey, unnest([0, 1, 2]) AS item FROM orders")
def q_explode_items(spark, sf_dir):
    views(spark, sf_dir)
    return spark.table("orders").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("item"))


@query("SELECT o_orderkey, ['gold', 'silver', 'bronze'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS tier FROM orders")
def q_element_at(spark, sf_dir):
    views(spark, sf_dir)
    return spark.table("orders").select("o_orderkey", F.element_at(F.array(F.lit("gold"), F.lit("silver"), F.lit("bronze")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("tier"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_get_json(spark, sf_dir):
    views(spark, sf_dir)
    return spark.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, event_id % 3 = 0 AS same FROM events")
def q_json_canonical(spark, sf_dir):
    views(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_id") % 3
    a = F.format_string('{"k":%d,"a":[1,2]}', k)
    b = F.when(kind == 0, F.format_string('{"a": [1, 2], "k": %d}', k)).when(kind == 1, F.format_string('{"a":[2,1],"k":%d}', k)).otherwise(F.format_string('{"k":%d,"a":[1,2]}', k + 1))
    return spark.table("events").select("event_id", (probes.canonical_json(a) == probes.canonical_json(b)).alias("same"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'k' END, CASE WHEN event_id % 3 = 0 THEN 'm' END], lambda x: x IS NOT NULL), ',') AS changed FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def q_json_changed(spark, sf_dir):
    views(spark, sf_dir)
    k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    a = F.format_string('{"k":%d,"m":"x","n":null}', k)
    b = F.format_string('{"n": null, "m":"%s","k":%d}', F.when(i % 3 == 0, "y").otherwise("x"), k + F.when(i % 2 == 0, 1).otherwise(0))
    found = spark.table("events").select("event_id", F.explode(probes.semi_structured(a, b)).alias("x")).where("x.strength < 0.8")
    return found.select("event_id", F.col("x.meta")["changed_keys"].alias("changed"))


_TOP = """SELECT * FROM (VALUES ('custkey', 'upstream_drift', 'genuine_data', 0.8), ('price', 'type_precision', 'migration_induced', 0.9), ('status', 'string_format', 'migration_induced', 0.8),
  ('ts', 'timezone', 'migration_induced', 0.9)) v("column", category, verdict, confidence)"""


def _classified(spark, sf_dir):
    _, _, (main, metrics, details) = _compared(spark, sf_dir)
    findings, samples, _ = ingest.ingest(main, metrics, details.persist(), "r1")
    findings, samples = findings.persist(), samples.persist()
    pack = knowledge.load("snowflake")
    return findings, samples, classify.classify(findings, samples, knowledge.remediation(spark, pack)).persist()


@query(_TOP.replace("0.8)", "CAST(0.8 AS DOUBLE))").replace("0.9)", "CAST(0.9 AS DOUBLE))"))
def q_classify_columns(spark, sf_dir):
    findings, _, hypotheses = _classified(spark, sf_dir)
    return classify.top(hypotheses).join(findings.where("column is not null"), "finding_id").select("column", "category", "verdict", "confidence")


@query("SELECT f AS finding_id, seq, confidence FROM (SELECT c_custkey % 100 AS f, c_custkey AS seq, (c_custkey // 100) % 7 / 10.0 AS confidence FROM customer) QUALIFY row_number() OVER (PARTITION BY f ORDER BY confidence DESC, seq) = 1")
def q_top_hypothesis(spark, sf_dir):
    views(spark, sf_dir)
    return classify.top(spark.table("customer").selectExpr("c_custkey % 100 AS finding_id", "c_custkey AS seq", "cast((c_custkey div 100) % 7 / 10 as double) AS confidence"))


@query("SELECT v.verdict, count(c_custkey) AS n FROM (VALUES ('migration_induced', 0), ('genuine_data', 1), ('benign', 2), ('needs_review', 9)) v(verdict, k) LEFT JOIN customer ON c_custkey % 5 = k OR (k = 0 AND c_custkey % 5 > 2) GROUP BY 1")
def q_verdict_counts(spark, sf_dir):
    views(spark, sf_dir)
    k = F.col("c_custkey") % 5
    return classify.verdict_counts(spark.table("customer").select(F.when(k == 1, "genuine_data").when(k == 2, "benign").otherwise("migration_induced").alias("verdict"))).select("verdict", "n")


@query("SELECT 'n' || c_nationkey AS \"table\", count(*) FILTER (WHERE c_custkey % 5 IN (0, 3, 4)) AS migration_induced, count(*) FILTER (WHERE c_custkey % 5 = 1) AS genuine_data, count(*) FILTER (WHERE c_custkey % 5 = 2) AS benign, CAST(0 AS BIGINT) AS needs_review FROM customer GROUP BY 1")
def q_verdict_rollup(spark, sf_dir):
    from ..reports import tally

    views(spark, sf_dir)
    k = F.col("c_custkey") % 5
    heads = spark.table("customer").select(F.format_string("Db.s.`N%d`", "c_nationkey").alias("target_table"), F.when(k == 1, "genuine_data").when(k == 2, "benign").otherwise("migration_induced").alias("verdict"))
    return tally(heads.withColumn("table", ingest.short_name(F.col("target_table"))), "table")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 50 <> 7) > 0 AS any_rows, 'upstream_drift' AS category, CAST(0.55 AS DOUBLE) AS confidence")
def q_freshness_pass(spark, sf_dir):
    s, t = pair(spark, sf_dir)
    t = t.withColumn("priority", F.when(F.col("k") % 20 == 0, F.concat(F.lit("zz"), F.col("k").cast("string"))).otherwise(F.col("priority")))
    parts = compare.compare(s, t, compare.Pair(keys=["k"]), recon_id="r1", table_id=1, source_name="src.orders", target_name="tgt.orders")
    main, metrics, details = parts
    findings, samples, _ = ingest.ingest(main, metrics, details.persist(), "r1")
    findings, samples = findings.persist(), samples.persist()
    done = classify.freshness_pass(findings, classify.classify(findings, samples).persist())
    heads = classify.top(done).join(findings.where("column = 'priority'"), "finding_id")
    return heads.select((F.col("total_count") > 0).alias("any_rows"), "category", "confidence")


@query("SELECT count(*) AS total, min(s) FILTER (WHERE n = m) AS mode, round(max(n) / count(*), 6) AS share, max(n) / count(*) >= 0.6 AS clustered FROM (SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'late' ELSE o_orderstatus END AS s FROM orders) JOIN (SELECT s, n, max(n) OVER () AS m FROM (SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'late' ELSE o_orderstatus END AS s, count(*) AS n FROM orders GROUP BY 1)) USING (s)")
def q_rowpattern_buckets(spark, sf_dir):
    views(spark, sf_dir)
    rows = spark.table("orders").select(F.when(F.col("o_orderkey") % 10 < 7, "late").otherwise(F.col("o_orderstatus")).alias("s"))
    return patterns.buckets(rows, "s")


@query("SELECT o_orderkey, (o_orderkey % 3) * 1800 AS gap, (o_orderkey % 3) * 1800 >= 3600 AS skewed FROM orders")
def q_freshness_gap(spark, sf_dir):
    views(spark, sf_dir)
    late = F.expr("o_orderdate + make_dt_interval(0, 0, (o_orderkey % 3) * 30)")
    gap, flag = patterns.skewed(F.col("o_orderdate"), late)
    return spark.table("orders").select("o_orderkey", gap.alias("gap"), flag.alias("skewed"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'DATE_TRUNC,ROUND' ELSE '' END AS risky FROM nation")
def q_risky_functions(spark, sf_dir):
    views(spark, sf_dir)
    code = spark.table("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "select date_trunc('week', d), round (x, 0)").otherwise("select rounded, x from t").alias("sql"))
    found = patterns.risky(code, "sql", knowledge.risky_functions(knowledge.load("snowflake")))
    return found.select("n_nationkey", F.array_join("risky", ",").alias("risky"))


@query("SELECT p_partkey, CAST(p_partkey % 7 AS INTEGER) AS scale, p_partkey % 7 > 2 AS loses FROM part")
def q_scale_loss(spark, sf_dir):
    views(spark, sf_dir)
    declared = F.format_string("NUMBER(18, %d)", F.col("p_partkey") % 7)
    scale = passes.scale_of(declared)
    return spark.table("part").select("p_partkey", scale.alias("scale"), (scale > passes.scale_of(F.lit("CAST(x AS DECIMAL(18,2))"))).alias("loses"))


@query("SELECT 'tgt.' || n_name AS target_table, '/out/' || CASE WHEN n_nationkey % 2 = 0 THEN '2' || CAST(n_nationkey AS VARCHAR) || '_' ELSE '' END || lower(n_name) || '.sql' AS path FROM nation")
def q_issue_match(spark, sf_dir):
    views(spark, sf_dir)
    n = spark.table("nation")
    number = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("2"), F.col("n_nationkey").cast("string"), F.lit("_"))).otherwise("")
    issues = n.select(F.concat(F.lit("/out/"), number, F.lower("n_name"), F.lit(".sql")).alias("path"))
    issues = issues.union(n.select(F.concat(F.lit("/oman/x"), F.lower("n_name"), F.lit(".sql"))))  # tables of other names
    return passes.issue_match(n.select(F.concat(F.lit("tgt."), F.col("n_name")).alias("target_table")), issues)


@query("SELECT 'tgt.t' || (c_custkey % 3) AS t, string_agg(DISTINCT 'src.n' || c_nationkey, ',' ORDER BY 'src.n' || c_nationkey) AS upstream FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1")
def q_lineage_upstreams(spark, sf_dir):
    views(spark, sf_dir)
    rows = spark.table("customer").where("c_custkey % 4 <> 0")
    line = rows.select(F.format_string("src.n%d", "c_nationkey").alias("source_table_full_name"), F.lit("c").alias("target_column_name"), F.format_string("TGT.t%d", F.col("c_custkey") % 3).alias("target_table_full_name"), F.lit("2026-01-01").cast("date").alias("event_date"))
    targets = line.select(F.col("target_table_full_name").alias("target_table")).distinct()
    ups = lineage.upstreams(line, None, targets, today="2026-02-01")
    return lineage.by_table(ups).select("t", F.array_join("upstream_tables", ",").alias("upstream"))


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS r FROM lineitem) WHERE r <= 200")
def q_sample_cap(spark, sf_dir):
    views(spark, sf_dir)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return patterns.first_rows(spark.table("lineitem"), "l_returnflag", order, 200).select("l_returnflag", *order[:4])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'changed' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT o_orderkey + 100000000, 'changed' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 8 = 0")
def q_merge_upsert(spark, sf_dir):
    views(spark, sf_dir)
    rows = spark.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    hit = rows.where("o_orderkey % 4 = 0").withColumn("status", F.lit("changed"))
    new = rows.where("o_orderkey % 8 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("changed").alias("status"))
    return merge.upsert(rows, hit.union(new), ["o_orderkey"])


@query("SELECT o_orderkey, CAST(((o_orderkey * 1000003 + 2147483648) % 4294967296) - 2147483648 AS BIGINT) AS wrapped FROM orders")
def q_int_wrap(spark, sf_dir):
    views(spark, sf_dir)
    return spark.table("orders").select("o_orderkey", (F.pmod(F.col("o_orderkey") * 1000003 + 2147483648, F.lit(4294967296)) - 2147483648).alias("wrapped"))


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS customers, round(sum(CAST(c_acctbal AS DECIMAL(18,2))) / nullif(count(*), 0), 4) AS balance FROM customer GROUP BY 1")
def q_ratio_nullif(spark, sf_dir):
    views(spark, sf_dir)
    total = F.sum(F.col("c_acctbal").cast("decimal(18,2)"))
    return spark.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.round(total.cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("balance"))


@query("SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey > 500")
def q_high_key_slice(spark, sf_dir):
    views(spark, sf_dir)
    return merge.newer(spark.table("orders"), "o_orderkey", 500).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))


@query(
    f"""{_WITH} SELECT 'custkey' AS "column", count(*) FILTER (WHERE s.custkey IS DISTINCT FROM t.custkey) AS mismatch_count, 'genuine_data' AS verdict, CAST(0.95 AS DOUBLE) AS confidence FROM s JOIN t USING (k)
UNION ALL SELECT 'status', count(*) FILTER (WHERE s.status IS DISTINCT FROM t.status), 'migration_induced', 0.95 FROM s JOIN t USING (k)
UNION ALL SELECT 'price', count(*) FILTER (WHERE s.price IS DISTINCT FROM t.price), 'migration_induced', 0.98 FROM s JOIN t USING (k)
UNION ALL SELECT 'ts', count(*) FILTER (WHERE s.ts IS DISTINCT FROM t.ts), 'migration_induced', 0.98 FROM s JOIN t USING (k)"""
)
def q_analyze_orders(spark, sf_dir):
    s, t, parts = _compared(spark, sf_dir)
    tables = {"src.orders": s, "tgt.orders": t}
    done = analyze(spark, *parts, "r1", table=tables.__getitem__)
    return done.top().where("column is not null").select("column", "mismatch_count", "verdict", "confidence")


_CODE = "INSERT INTO tgt.orders SELECT k, custkey, upper(status) AS status, CAST(round(price, 2) AS DECIMAL(18,2)) AS price, 'x' AS priority FROM src.orders WHERE k % 50 <> 7"


@query("SELECT * FROM (VALUES ('k', true, '', 'k'), ('custkey', true, '', 'custkey'), ('status', false, 'UPPER', 'status'), ('price', false, 'CAST,ROUND', 'price'), ('priority', false, '', '')) v(\"column\", is_direct, functions, refs)")
def q_code_transforms(spark, sf_dir):
    frames = artifacts.frames(spark, artifacts.parse_sql(spark, _CODE))
    return frames["transforms"].select("column", "is_direct", F.array_join("functions", ",").alias("functions"), F.array_join("references", ",").alias("refs"))


@query("SELECT * FROM (VALUES ('price', 0.99, 'migration_induced'), ('status', 0.9, 'migration_induced'), ('custkey', 0.8, 'genuine_data'), ('missing_in_target', 0.8, 'migration_induced')) v(what, confidence, verdict)".replace("0.99,", "CAST(0.99 AS DOUBLE),").replace("0.9,", "CAST(0.9 AS DOUBLE),").replace("0.8,", "CAST(0.8 AS DOUBLE),"))
def q_code_pass(spark, sf_dir):
    findings, _, hypotheses = _classified(spark, sf_dir)
    mapping = artifacts.parse_sql(spark, _CODE)
    mapping["orders"].source_types = {"price": "NUMBER(18,4)"}
    done = passes.code_pass(findings, hypotheses, **artifacts.frames(spark, mapping))
    heads = classify.top(done).join(findings, "finding_id").select(F.coalesce("column", "recon_type").alias("what"), "confidence", "verdict")
    return heads.where("what in ('price', 'status', 'custkey', 'missing_in_target')")


@query("SELECT range AS id, 'SKU-' || lpad(CAST(range AS VARCHAR), 4, '0') AS sku, CAST(range * 1.5 AS DOUBLE) AS price FROM range(1, 31)")
def q_row_generator(spark, sf_dir):
    return spark.sql("SELECT id, concat('SKU-', lpad(cast(id AS string), 4, '0')) AS sku, cast(id * 1.5 AS double) AS price FROM range(1, 31) AS t(id)")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'N' ELSE 'Y' END AS source_flag, CASE WHEN c_custkey % 7 = 0 THEN 'false' ELSE 'true' END AS target_flag, 'null_boolean' AS category FROM customer")
def q_flag_encoding(spark, sf_dir):
    views(spark, sf_dir)
    no = F.col("c_custkey") % 7 == 0
    rows = spark.table("customer").select("c_custkey", F.when(no, "N").otherwise("Y").alias("source_flag"), F.when(no, "false").otherwise("true").alias("target_flag"))
    found = rows.withColumn("x", F.explode(probes.null_boolean(F.col("source_flag"), F.col("target_flag"))))
    return found.select("c_custkey", "source_flag", "target_flag", F.col("x.category").alias("category"))


@query("SELECT p_partkey, lower(p_brand) AS short, CASE WHEN p_partkey % 4 = 0 THEN 'sale_month' WHEN p_partkey % 4 = 1 THEN 'Updated_TS' WHEN p_partkey % 4 = 2 THEN 'weekday' ELSE '-' END AS date_column FROM part")
def q_names(spark, sf_dir):
    views(spark, sf_dir)
    full = F.concat(F.lit("cat.`s`.`"), F.col("p_brand"), F.lit("`"))
    return spark.table("part").select("p_partkey", ingest.short_name(full).alias("short"), F.coalesce(ingest.date_column(F.array(F.lit("qty"), F.get(F.array(*map(F.lit, ("sale_month", "Updated_TS", "weekday", "amount"))), F.col("p_partkey") % 4), F.lit("k"))), F.lit("-")).alias("date_column"))


@query("SELECT o_orderkey, 'k' AS keys FROM orders WHERE o_orderkey % 3 = 0")
def q_detail_predicate(spark, sf_dir):
    views(spark, sf_dir)
    third = F.col("o_orderkey") % 3 == 0
    row = F.create_map(F.lit("k"), F.col("o_orderkey").cast("string"), F.lit("c_base"), F.lit("a"), F.lit("c_compare"), F.when(third, "b").otherwise("a"))
    rows = spark.table("orders").select(F.col("o_orderkey").alias("recon_table_id"), F.lit("mismatch").alias("recon_type"), F.array(F.lit("c")).alias("mismatch_columns"), F.lit(1).alias("source_count"), F.lit(0).alias("seq"), row.alias("row"))
    return ingest.column_samples(rows).select(F.col("recon_table_id").alias("o_orderkey"), F.array_join(F.map_keys("keys"), ",").alias("keys"))


@query("SELECT o_custkey, count(*) AS orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def q_semi_join(spark, sf_dir):
    views(spark, sf_dir)
    poor = spark.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return spark.table("orders").join(poor, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT n_nationkey, 'T' || CAST(n_regionkey AS VARCHAR) AS kind, '/o/' || n_name || '.sql' AS path, 'can''t parse ''' || n_name || ''', line 3' AS message FROM nation WHERE n_nationkey % 5 <> 0")
def q_error_log(spark, sf_dir):
    views(spark, sf_dir)
    line = F.when(F.col("n_nationkey") % 5 == 0, "noise").otherwise(F.format_string("code=%d, kind=T%d, severity=warning, path='/o/%s.sql', message='can't parse '%s', line 3'%s", "n_nationkey", "n_regionkey", "n_name", "n_name", F.when(F.col("n_nationkey") % 2 == 0, ")").otherwise("")))
    parsed = artifacts.parse_errors(spark.table("nation").select(line.alias("value")))
    return parsed.select(F.col("code").cast("int").alias("n_nationkey"), "kind", "path", "message")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'genuine_data' WHEN c_custkey % 4 = 1 THEN 'benign' WHEN c_custkey % 4 = 2 THEN 'migration_induced' ELSE 'needs_review' END AS verdict FROM customer")
def q_verdict_rules(spark, sf_dir):
    views(spark, sf_dir)
    k = F.col("c_custkey") % 4
    category = F.when(k == 0, "upstream_drift").when(k == 1, "semi_structured").when(k == 2, "timezone").otherwise("env_config")
    strength = F.when(k == 3, 0.4).otherwise(0.9)
    return spark.table("customer").select("c_custkey", classify.verdict(category, strength, F.lit(False)).alias("verdict"))


def queries() -> dict:
    from . import surface_queries  # noqa: F401  it adds its own

    return {f"q_probe_{n}": _probe_query(n) for n in PAIRS} | QUERIES


def oracle_sql() -> dict[str, str]:
    from . import surface_queries  # noqa: F401

    return {f"q_probe_{n}": _probe_sql(n) for n in PAIRS} | SQL
