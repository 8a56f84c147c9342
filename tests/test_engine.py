"""From two tables to a report, on a small pair with one defect of each kind."""

import json
import os
import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallylens import knowledge, reports, scratch
from tallylens.operators import classify, compare, drilldown, ingest, lineage, meeting, merge, patterns, validate
from tallylens.plans import scripts
from tallylens.plans.analyze import analyze
from tallylens.sources import artifacts

N = 60


@pytest.fixture(scope="module")
def tables(spark):
    s = spark.range(N).select(
        F.col("id"),
        F.format_string("%d.1234", "id").cast("decimal(18,4)").alias("amount"),
        F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("ts"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.lit("x")).alias("tier"),
        F.lit("A").alias("name"),
        F.lit(1).alias("only_source"),
    )
    t = s.drop("only_source").select(
        "id",
        F.col("amount").cast("decimal(18,2)").cast("decimal(18,4)").alias("amount"),
        F.expr("ts + make_dt_interval(0, cast(1 + id % 4 as int))").alias("ts"),
        F.coalesce("tier", F.lit("gold")).alias("tier"),
        F.lit("A ").alias("name"),
    )
    t = t.where(f"id < {N - 6}")
    return s, t.union(t.where("id < 3")).union(t.where("id = 0").withColumn("id", F.lit(1000).cast("long")))


@pytest.fixture(scope="module")
def result(spark, tables):
    s, t = tables
    parts = compare.compare(s, t, compare.Pair(keys=["id"]), recon_id="r", table_id=7, source_name="cat.src.facts", target_name="cat.tgt.facts")
    code = artifacts.parse_sql(spark, "CREATE OR REPLACE TABLE tgt.facts AS SELECT id, CAST(round(amount, 2) AS DECIMAL(18,2)) AS amount, element_at(array('gold'), 1) AS tier, name FROM src.facts WHERE id < 54")
    code["facts"].source_types = {"amount": "NUMBER(18,4)", "ts": "TIMESTAMP_NTZ(9)"}
    return analyze(spark, *parts, "r", table={"cat.src.facts": s, "cat.tgt.facts": t}.__getitem__, mapping=code)


@pytest.fixture(scope="module")
def tops(result):
    return {r["column"] or r["recon_type"]: r.asDict(True) for r in result.top().collect()}


def test_counts_see_surplus_copies(result):
    r = result.summaries.first()
    assert (r["source_count"], r["target_count"], r["missing_in_target"], r["missing_in_source"]) == (N, N - 6 + 4, 6, 4)
    assert r["row_match_pct"] == 0.0 and not r["schema_ok"] and r["join_keys"] == ["id"]


def test_each_defect_is_found(tops):
    got = {k: v["category"] for k, v in tops.items()}
    assert got == {"amount": "type_precision", "ts": "timezone", "tier": "upstream_drift", "name": "string_format", "missing_in_target": "volume_missing", "missing_in_source": "volume_extra", "schema": "type_precision"}


def test_varying_offsets_go_to_review(tops):
    assert tops["ts"]["verdict"] == "needs_review"


def test_generated_column_is_not_called_genuine(tops):
    assert tops["tier"]["verdict"] == "needs_review" and tops["tier"]["code_generated"] and "decide" in tops["tier"]["owner"]


def test_confirmed_and_exact(tops):
    # Of the copies of a key only as many as the source has meet its rows.
    assert tops["amount"]["mismatch_count"] == N - 6 and tops["amount"]["confidence"] == pytest.approx(0.98)
    assert tops["amount"]["evidence"][0]["label"] == "drilldown"
    assert tops["missing_in_source"]["evidence"][0]["data"]["duplicates"] == "3"
    assert any("load filter" in e["detail"] for e in tops["missing_in_target"]["evidence"])


def test_reports(result, tmp_path):
    reports.write_json(result, str(tmp_path / "r.json"))
    reports.write_notebook(result, str(tmp_path / "r.ipynb"))
    data, nb = json.loads((tmp_path / "r.json").read_text()), json.loads((tmp_path / "r.ipynb").read_text())
    assert sum(data["verdicts"].values()) == 7 and set(data["verdicts"]) == {"migration_induced", "genuine_data", "benign", "needs_review"}
    assert nb["nbformat"] == 4 and any("validate_rows" in c["source"] for c in nb["cells"])
    rows = reports.findings(result)
    assert "amount" in reports.tldr(rows) and "migration engineer" in reports.conclusion(rows)
    assert reports.overview(result).first()["columns"] == ["amount", "name", "tier", "ts"]
    tables, columns = reports.match_rates(result)
    assert tables.count() == 1 and columns.count() == 4


def test_verdict_counts_have_zeros(spark):
    h = spark.createDataFrame([("f", "benign")], "finding_id string, verdict string")
    assert {r["verdict"]: r["n"] for r in classify.verdict_counts(h).collect()} == {"migration_induced": 0, "genuine_data": 0, "benign": 1, "needs_review": 0}


def test_ingest_reads_maps_without_match_entries(spark):
    rows = spark.createDataFrame([(1, "mismatch", ["c"], 5, 0, {"k": "1", "c_base": "a", "c_compare": "b"}), (1, "mismatch", ["c"], 5, 1, {"k": "2", "c_base": "a", "c_compare": "a"}), (1, "mismatch", ["c"], 5, 2, {"k": "3"})], "recon_table_id long, recon_type string, mismatch_columns array<string>, source_count long, seq int, row map<string,string>")
    assert [(r["seq"], r["keys"]) for r in ingest.column_samples(rows).collect()] == [(0, {"k": "1"})]


def test_equal_tables_give_no_findings(spark, tables):
    s, _ = tables
    parts = compare.compare(s, s, compare.Pair(keys=["id"]), recon_id="r", table_id=1, source_name="a.s", target_name="a.t")
    findings, _, summaries = ingest.ingest(*parts, "r")
    assert findings.count() == 0 and summaries.first()["row_match_pct"] == 100.0


def test_renamed_columns_and_filters(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    t = spark.createDataFrame([(1, "a"), (2, "x")], "k int, w string")
    found = compare.Difference.of(s, t, compare.Pair(keys=["k"], column_map={"v": "w"}, source_filter="k < 3", unique_keys=True))
    assert found.sides.common == ["w"] and found.counts().first()["n_w"] == 1


def test_freshness_pass_marks_unexplained_columns(spark):
    findings = spark.createDataFrame([("a", "column_mismatch", "t", 5, 10), ("b", "column_mismatch", "t", 4, 10), ("c", "column_mismatch", "u", 4, 10)], "finding_id string, recon_type string, target_table string, mismatch_count long, total_count long")
    base = "finding_id string, category string, verdict string, confidence double, rationale string, evidence array<string>, seq int, owner string, remediation string"
    h = spark.createDataFrame([("a", "upstream_drift", "genuine_data", 0.8, "", [], 1, "", ""), ("b", "unknown", "needs_review", 0.2, "", [], 1, "", ""), ("c", "unknown", "needs_review", 0.2, "", [], 1, "", "")], base)
    assert {r["finding_id"]: r["category"] for r in classify.freshness_pass(findings, h).collect()} == {"a": "upstream_drift", "b": "upstream_drift", "c": "unknown"}


def test_lineage_says_when_the_source_is_another(spark):
    line = spark.createDataFrame([("cat.s.other", "c", "CAT.T.Facts", "2026-01-01"), ("cat.s.old", "c", "cat.t.facts", "2020-01-01")], "source_table_full_name string, target_column_name string, target_table_full_name string, event_date string").withColumn("event_date", F.to_date("event_date"))
    tables_ = spark.createDataFrame([("cat.s.x", "cat.s.y", "2026-01-01")], "source_table_full_name string, target_table_full_name string, event_date string").withColumn("event_date", F.to_date("event_date"))
    ups = lineage.upstreams(line, tables_, spark.createDataFrame([("cat.t.facts",), ("cat.s.y",)], "target_table string"), today="2026-02-01")
    assert {(r["t"], r["column"], r["upstream"]) for r in ups.collect()} == {("cat.t.facts", "c", "cat.s.other"), ("cat.s.y", None, "cat.s.x")}
    f = spark.createDataFrame([("f", "column_mismatch", "c", "cat.s.facts", "cat.t.facts")], "finding_id string, recon_type string, column string, source_table string, target_table string")
    h = spark.createDataFrame([("f", 0.5, 1)], "finding_id string, confidence double, seq int").withColumn("evidence", F.array().cast("array<struct<label:string,detail:string,query:string,data:map<string,string>>>"))
    assert "not the source" in lineage.lineage_pass(f, h, ups).first()["evidence"][0]["detail"]


def test_rows_meet_in_one_join(tables):
    s, t = tables
    for unique, aggregates in ((True, 0), (None, 2)):
        laid = meeting.laid_out(s, t, meeting.Pair(keys=["id"], unique_keys=unique), ["amount", "ts"])
        plan = meeting.meet(laid, "inner")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == plan.count("Join Inner") == 1 and plan.count("Aggregate ") == aggregates


def test_validation(spark, tables):
    s, t = tables
    r = validate.validate_rows(s, t, ["id"]).first()
    assert r["matched_keys"] == N - 6 and r["row_match_pct"] == 90.0
    assert validate.validate_rows(s, t, []).first()["row_match_pct"] is None
    assert validate.validate_column(s, t, [], "name").first()["column_match_pct"] is None


def test_merge_is_repeatable(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "z"), (3, "n")], "k int, v string")
    once = merge.upsert(t, c, ["k"])
    assert sorted(map(tuple, merge.upsert(once, c, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "z"), (3, "n")]


def test_patterns(spark):
    rows = spark.createDataFrame([("a",)] * 7 + [("b",)] * 3 + [(None,)], "b string")
    assert patterns.buckets(rows, "b").first().asDict() == {"total": 10, "mode": "a", "share": 0.7, "clustered": True}
    pack = knowledge.load("snowflake")
    code = spark.createDataFrame([("select Round(x), date_trunc ('w', d)",), ("select background(x)",)], "sql string")
    assert [sorted(r["risky"]) for r in patterns.risky(code, "sql", knowledge.risky_functions(pack)).collect()] == [["DATE_TRUNC", "ROUND"], []]
    assert knowledge.load("none")["function_diffs"] == []


def test_artifacts(spark, tmp_path):
    assert artifacts.split_statements("-- c\nselect ';'; /* x; */ ; select 2 -- y;\n") == ["-- c\nselect ';'", "select 2 -- y;"]
    ddl = artifacts.parse_ddl('CREATE OR REPLACE TABLE "DB".s.T1 (id NUMBER(38,0) NOT NULL, ts TIMESTAMP_LTZ(9), -- c\n v VARCHAR, PRIMARY KEY (id))')
    assert ddl == {"t1": {"id": "DECIMAL(38,0)", "ts": "TIMESTAMP_LTZ(9)", "v": "VARCHAR"}}
    (tmp_path / "c.json").write_text(json.dumps({"tables": [{"source_name": "s.t1", "target_name": "x.t1", "join_columns": ["id", "load_date"], "filters": {"target": "id > 1"}}]}))
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "a.sql").write_text("INSERT INTO x.t1 SELECT id, upper(v) AS v FROM s.t1; SELECT FROM broken;")
    (tmp_path / "log").write_text("code=1, kind=parse, severity=warning, path='/out/t1.sql', message='odd, really'\nnoise\n")
    got = artifacts.build_mapping(spark, config=str(tmp_path / "c.json"), translated_sql=str(tmp_path / "sql"), error_log=str(tmp_path / "log"), manifest_entries=[{"target": "x.t1", "join_keys": ["id"]}])["t1"]
    assert got.keys == ["id"] and got.date_column == "load_date" and got.target_filter == "id > 1"
    assert got.transforms["v"].functions == ["UPPER"] and got.transforms["id"].is_direct and not got.transforms["v"].is_direct
    assert got.issues[0]["message"] == "odd, really"


def brute_compare(source, target):
    """(missing in source, missing in target, differing) of (key, value) rows: equal rows of a key meet first."""
    out = [0, 0, 0]
    for k in {k for k, _ in source + target}:
        a, b = (Counter(v for key, v in side if key == k) for side in (source, target))
        rest_a, rest_b = sum((a - b).values()), sum((b - a).values())
        out[0] += max(0, rest_b - rest_a)
        out[1] += max(0, rest_a - rest_b)
        out[2] += min(rest_a, rest_b)
    return tuple(out)


@pytest.mark.parametrize("seed", range(4))
def test_duplicate_and_null_keys_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [[(rng.choice([None, 1, 2, 3, 4]), rng.choice(["x", "y", "z", None])) for _ in range(rng.randrange(0, 14))] for _ in range(2)]
    s, t = (spark.createDataFrame(r, "k int, v string") for r in rows)
    got = compare.Difference.of(s, t, compare.Pair(keys=["k"])).counts().first()
    assert (got["source_rows"], got["target_rows"]) == tuple(map(len, rows))
    assert (got["missing_in_source"], got["missing_in_target"], got["absolute_mismatch"]) == brute_compare(*rows)
    main, metrics, details = compare.compare(s, t, compare.Pair(keys=["k"]), recon_id="r", table_id=1, source_name="a.s", target_name="a.t")
    shown = {r["recon_type"]: len(r["data"]) for r in details.collect()}
    assert tuple(shown.get(k, 0) for k in ("missing_in_source", "missing_in_target", "mismatch")) == brute_compare(*rows)
    m = drilldown.confirm_columns(s, t, ["k"], {"v": "string_format"}).first()["measures"]
    assert m["n"] == brute_compare(*rows)[2]


def test_the_verdicts_cases_of_copies(spark):
    s = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    t = spark.createDataFrame([(1, "y")], "k int, v string")
    got = compare.Difference.of(s, t, compare.Pair(keys=["k"])).counts().first()
    assert (got["absolute_mismatch"], got["missing_in_target"]) == (0, 1)
    many = spark.range(300).selectExpr("1 AS k", "cast(id as string) AS v")
    other = many.selectExpr("k", "concat(v, '!') AS v")
    assert drilldown.confirm_columns(many, other, ["k"], {"v": "string_format"}).first()["measures"]["n"] == 300


def test_drill_follows_renamed_columns_and_filters(spark):
    s = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], "k int, v string, part int")
    t = spark.createDataFrame([(1, "A"), (2, "b"), (9, "z")], "k int, w string")
    pair = compare.Pair(keys=["k"], column_map={"v": "w"}, source_filter="part = 1", target_filter="k < 9")
    heads = [{"finding_id": "f", "recon_type": "column_mismatch", "column": "w", "category": "string_format"}, {"finding_id": "g", "recon_type": "schema", "column": None, "category": "type_precision"}]
    got = [r for df in drilldown.drill(s, t, pair, heads, "db.src", "db.tgt") for r in df.collect()]
    assert got[0]["exact_n"] == 1 and got[0]["confirmed"] and "part: int -> none" in got[1]["detail"]
    s.createOrReplaceTempView("drill_src"), t.createOrReplaceTempView("drill_tgt")
    for kind, column, want in (("column_mismatch", "w", 1), ("missing_in_target", None, 0), ("missing_in_source", None, 0)):
        assert spark.sql(drilldown.rerun(pair, "drill_src", "drill_tgt", kind, column)).count() == want


def test_two_changes_of_one_key_are_an_error(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="two changes"):
        merge.upsert(t, spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), ["k"]).collect()


def test_scripts_say_which_statement_failed(spark):
    assert [s for _, _, s in scripts.run_script(spark, "select 1; -- no\nselect nothing", dry_run=True)] == ["planned", "planned"]
    with pytest.raises(RuntimeError, match="statement 2 failed"):
        scripts.run_script(spark, "select 1; select nothing from nowhere; select 3")


def test_issues_go_to_the_file_of_their_table(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"tables": [{"source_name": "s.oman", "target_name": "x.oman", "join_columns": ["id"]}, {"source_name": "s.romania", "target_name": "x.romania", "join_columns": ["id"]}]}))
    (tmp_path / "log").write_text("code=1, kind=parse, severity=warning, path='/out/21_ROMANIA.sql', message='can't parse it')\n")
    got = artifacts.build_mapping(spark, config=str(tmp_path / "c.json"), error_log=str(tmp_path / "log"))
    assert not got["oman"].issues and [i["message"] for i in got["romania"].issues] == ["can't parse it"]


def test_settings_come_from_a_file_over_defaults(tmp_path):
    from tallylens.plans import config

    (tmp_path / "c.json").write_text('{"recon_schema": "r", "dialect": null, "tables": [{"target": "t"}], "odd": 1}')
    got = config.load(str(tmp_path / "c.json"))
    assert (got.recon_schema, got.dialect, got.tables, got.use_lineage) == ("r", "snowflake", [{"target": "t"}], False)
    assert config.load(None) == config.load(str(tmp_path / "none.json")) == config.Config()


def test_scratch_folders_are_dropped(spark):
    first = scratch.mark()
    kept = [scratch.materialize(spark.range(k), "test") for k in (1, 2, 3)]
    scratch.drop_from(spark, first, keep=1)
    assert scratch.mark() == first + 1 and kept[2].count() == 3
    with pytest.raises(Exception):
        kept[0].count()
    scratch.drop_from(spark, first)


def test_all_else_works_without_the_training_data_folders(tmp_path):
    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "corpus_pipeline.py") or (n == "llm" and Path(folder).name in ("tallylens", "tests"))])
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.split()[1:] == ["False", "False", "True"] and int(done.stdout.split()[0]) > 100
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert collected.returncode == 0, collected.stdout
