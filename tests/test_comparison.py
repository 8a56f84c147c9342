"""How tables meet and are compared: any names and types, copies, digests of ranges, laid-out tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallylens.operators import checksums, compare, drilldown, layout, meeting, merge, patterns, validate
from tallylens.plans import scripts
from tallylens.plans.analyze import analyze
from tallylens.sources import artifacts


def plan_of(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def shown(parts):
    return {r["recon_type"]: r["data"] for r in parts[2].collect()}


def test_columns_of_any_name_and_type(spark):
    s = spark.sql("""SELECT id AS `_row`, map('b', id, 'a', 1L) AS m, id AS `a.b`, 'x' AS `_here`, parse_json('{"p": 1, "q": [1, 2]}') AS v,
      named_struct('m', map('k', id), 'w', parse_json('[1]')) AS st, array(map(1, 'one')) AS am, id AS `s0`, 'y' AS `tick``ed`, 1 AS alone, 2 AS w FROM range(20)""")
    t = spark.sql("""SELECT id AS `_row`, map('a', 1L, 'b', if(id = 3, 0L, id)) AS m, if(id = 4, 0L, id) AS `a.b`, 'x' AS `_here`, if(id = 5, parse_json('{"q": [2, 1], "p": 1}'), parse_json('{"q": [1, 2], "p": 1}')) AS v,
      named_struct('m', map('k', if(id = 6, 0L, id)), 'w', parse_json('[1]')) AS st, array(map(1, if(id = 7, 'two', 'one'))) AS am, id AS `s0`, if(id = 8, 'z', 'y') AS `tick``ed`, 1 AS alone, 2 AS w FROM range(20)""")
    found = compare.Difference.of(s, t, compare.Pair(keys=["_row"])).counts().first()
    for c in ("m", "a.b", "v", "st", "am", "tick`ed"):
        assert found[f"n_{c}"] == 1, c
    assert found["absolute_mismatch"] == 6 and found["n_s0"] == found["n__here"] == 0
    parts = compare.compare(s, t, compare.Pair(keys=["_row"]), recon_id="r", table_id=1, source_name="a.s", target_name="a.t")
    rows = {r["_row"]: r for r in shown(parts)["mismatch"]}
    assert set(rows) == set("345678") and rows["4"]["a.b_base"] == "4" and rows["4"]["a.b_compare"] == "0" and rows["3"]["m_match"] == "false"
    done = drilldown.confirm_columns(s, t, ["_row"], {"a.b": "type_precision", "tick`ed": "string_format"}).collect()
    assert {r["column"]: r["measures"]["n"] for r in done} == {"a.b": 1, "tick`ed": 1}
    assert validate.validate_column(s, t, ["_row"], "a.b").first()["equal"] == 19


def test_keys_of_any_type(spark):
    s = spark.sql("SELECT named_struct('x', if(id = 1, null, id)) AS k, to_date('2026-01-01') + cast(id AS int) AS d, id AS v FROM range(6)")
    t = s.withColumn("v", F.when(F.col("v") == 1, -1).otherwise(F.col("v"))).where("v <> 2")
    for keys in (["k"], ["k", "d"], ["d"]):
        got = compare.Difference.of(s, t, compare.Pair(keys=keys)).counts().first()
        assert (got["missing_in_target"], got["n_v"]) == (1, 1)
    wide = s.withColumn("d", F.col("d").cast("string"))
    assert compare.Difference.of(s, wide, compare.Pair(keys=["v"])).counts().first()["n_d"] == 0


def test_tables_without_rows_or_keys(spark):
    s = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    none = s.limit(0)
    got = compare.Difference.of(s, none, compare.Pair(keys=["k"])).counts().first()
    assert (got["source_rows"], got["target_rows"], got["missing_in_target"]) == (3, 0, 3)
    assert compare.Difference.of(none, none, compare.Pair(keys=["k"])).counts().first()["source_rows"] == 0
    got = compare.Difference.of(s, s.union(s.limit(1)), compare.Pair(keys=[])).counts().first()
    assert (got["missing_in_source"], got["missing_in_target"], got["absolute_mismatch"]) == (1, 0, 0)


def brute(source, target):
    out = [0, 0, 0]
    for k in {r[0] for r in source + target}:
        a, b = (Counter(r[1:] for r in side if r[0] == k) for side in (source, target))
        rest_a, rest_b = sum((a - b).values()), sum((b - a).values())
        out[0] += max(0, rest_b - rest_a)
        out[1] += max(0, rest_a - rest_b)
        out[2] += min(rest_a, rest_b)
    return tuple(out)


def test_copies_of_one_key_are_spread_and_equal_brute_force(spark):
    """A third of all rows has one key: neither its rows nor its numbers come together in one task."""
    n = 6000
    s = spark.range(n).select(F.when(F.col("id") < n // 3, 7).otherwise(F.col("id") + 100).alias("k"), (F.col("id") % 900).cast("string").alias("v"), F.lit(None).cast("string").alias("u"))
    t = spark.range(n).select(F.when(F.col("id") < n // 3 + 50, 7).otherwise(F.col("id") + 100).alias("k"), (F.col("id") % 800).cast("string").alias("v"), F.lit(None).cast("string").alias("u"))
    rows = [list(map(tuple, df.collect())) for df in (s, t)]
    got = compare.Difference.of(s, t, compare.Pair(keys=["k"])).counts().first()
    assert (got["missing_in_source"], got["missing_in_target"], got["absolute_mismatch"]) == brute(*rows)
    hot = spark.range(100_000).select((F.col("id") % 1 + 7).alias("j0"), (F.col("id") < 0).alias("z0"), *[F.xxhash64(F.lit(k), "id").alias(f"h{k}") for k in (0, 1)], (1 + F.col("id") % 3).alias("d"))
    numbered = meeting._numbered(hot.repartition(4, "h0"), ["j0", "z0"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    each = numbered.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = sum(r["n"] for r in each)
    assert total == numbered.select("copy").distinct().count() == numbered.agg(F.max("copy")).first()[0] == 199_999
    assert len(each) > 1 and max(r["n"] for r in each) < 0.6 * total


def test_few_rows_of_many_copies_are_spread_whichever_side_is_smaller(spark):
    """Once the rows were the first side to be ready, their join broadcast them, and all copies stood in one task."""
    hot = spark.range(1000).select(F.lit(7).alias("j0"), F.lit(False).alias("z0"), *[F.xxhash64(F.lit(k), "id").alias(f"h{k}") for k in (0, 1)], (1 + F.col("id") % 300).alias("d"))
    numbered = meeting._numbered(hot, ["j0", "z0"])
    assert "Broadcast" not in numbered._jdf.queryExecution().executedPlan().toString()
    total = sum(1 + k % 300 for k in range(1000))
    assert numbered.agg(F.count(F.lit(1)), F.count_distinct("copy"), F.min("copy"), F.max("copy")).first() == (total, total, 1, total)


def test_nulls_in_different_columns_are_different_rows(spark):
    s = spark.createDataFrame([(1, None, "x"), (1, "y", None)], "k int, a string, b string")
    t = spark.createDataFrame([(1, "x", None), (1, "y", None)], "k int, a string, b string")
    assert compare.Difference.of(s, t, compare.Pair(keys=["k"])).counts().first()["absolute_mismatch"] == 1


@pytest.fixture(scope="module")
def long_pair(spark):
    s = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") % 97).alias("a"), F.format_string("v%d", "id").alias("b"))
    t = s.where("k <> 31000").withColumn("b", F.when(F.col("k").between(20_000, 20_010), "other").otherwise(F.col("b")))
    return s, t.union(spark.createDataFrame([(60_000, 1, "new"), (None, 1, "null")], "k long, a long, b string"))


def test_only_ranges_that_differ_are_joined(spark, long_pair):
    s, t = long_pair
    laid = meeting.laid_out(s, t, meeting.Pair(keys=["k"]))
    tree = checksums.tree(laid, fan=16, small=20)
    assert (tree.source_rows, tree.target_rows) == (50_000, 50_001)
    first = tree.levels[0].collect()
    assert sum(r["source_rows"] for r in first) == 50_000 and len(first) <= 16
    assert tree.open.source.count() < 200 and len(tree.levels) >= 3
    open_ = {r["j0"] for r in tree.open.source.select("j0").collect()}
    assert {*range(20_000, 20_011), 31_000} <= open_
    got = compare.Difference(tree.open, (tree.source_rows, tree.target_rows)).counts().first()
    want = compare.Difference.of(s, t, compare.Pair(keys=["k"])).counts().first()
    assert got == want and (got["n_b"], got["missing_in_target"], got["missing_in_source"], got["source_rows"]) == (11, 1, 2, 50_000)
    # The digests above say the same as those below, added up.
    below = tree.levels[1].groupBy((F.col("lo") / F.lit(first[0]["hi"] - first[0]["lo"] + 1)).cast("long").alias("range")).agg(F.sum("source_rows").alias("n")).collect()
    above = {r["range"]: r["source_rows"] for r in first if r["differs"]}
    assert {r["range"]: r["n"] for r in below} == above


@pytest.mark.parametrize("seed", range(3))
def test_narrowed_comparisons_equal_whole_ones(spark, seed):
    rng = random.Random(seed)
    made = [(rng.choice([None, f"key{rng.randrange(400)}"]) if i % 40 == 0 else f"key{i}", rng.choice("xyz"), rng.choice([None, 1, 2])) for i in range(1500)]
    other = [(k, "w", v) if rng.random() < 0.01 else (k, x, v) for k, x, v in made if rng.random() > 0.005] + [made[3]] * 2
    s, t = (spark.createDataFrame(r, "k string, x string, v int") for r in (made, other))
    got, want = (compare.Difference.of(s, t, compare.Pair(keys=["k"]), narrowed=n).counts().first() for n in (True, False))
    assert got == want and (got["missing_in_source"], got["missing_in_target"], got["absolute_mismatch"]) == brute(made, other)


def test_equal_tables_leave_no_range_open(spark, long_pair):
    laid = meeting.laid_out(long_pair[0], long_pair[0].repartition(3), meeting.Pair(keys=["k"]))
    tree = checksums.tree(laid)
    assert tree.open.source.count() == tree.open.target.count() == 0 and len(tree.levels) == 1
    none = meeting.laid_out(long_pair[0].limit(0), long_pair[0].limit(0), meeting.Pair(keys=["k"]))
    assert checksums.tree(none).source_rows == 0


def test_spans_are_joined_across_the_smallest_gaps():
    spans = [(0, 1), (2, 3), (10, 12), (50, 51), (53, 53)]
    assert checksums._merged(spans, 64) == [(0, 3), (10, 12), (50, 51), (53, 53)]
    assert checksums._merged(spans, 2) == [(0, 12), (50, 53)]


def test_laid_out_tables_meet_without_an_exchange(spark, long_pair):
    s, t = long_pair
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        laid = layout.co_locate(s, t, meeting.Pair(keys=["k"]), buckets=4)
        for unique in (None, True):
            import dataclasses

            sides = dataclasses.replace(laid.sides, unique=unique)
            for how in ("inner", "full_outer"):
                assert "Exchange" not in plan_of(meeting.meet(sides, how))
        # The total alone is an exchange, of one row a task, above the join.
        checked = plan_of(validate.validate_laid_out(laid.sides))
        assert checked.count("Exchange") == checked.count("Exchange SinglePartition") <= 1
        got = compare.Difference(laid.sides).counts().first()
        assert got == compare.Difference.of(s, t, compare.Pair(keys=["k"])).counts().first()
        assert validate.validate_laid_out(laid.sides).first() == validate.validate_rows(s, t, ["k"]).first()
        assert drilldown.confirm_laid_out(laid.sides, {"b": "string_format"}).first()["measures"]["n"] == 11
        n = {kind: spark.sql(laid.rerun(kind, column)).count() for kind, column in (("column_mismatch", "b"), ("missing_in_target", None), ("missing_in_source", None))}
        assert n == {"column_mismatch": 11, "missing_in_target": 1, "missing_in_source": 2}
        assert "Exchange" not in plan_of(spark.sql(laid.rerun("column_mismatch", "b")))
        laid.drop(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_validation_takes_null_keys_as_keys_and_filters_the_column_itself(spark, tmp_path):
    import datetime

    s = spark.createDataFrame([(None, 1), (None, 1), (1, 2), (2, 3)], "k int, v int")
    assert validate.validate_rows(s, s, ["k"]).first()["row_match_pct"] == 100.0
    assert tuple(validate.validate_column(s, s, ["k"], "v").first()) == ("v", 4, 4, 100.0)
    spark.range(100).selectExpr("id AS k", "timestamp_ntz'2026-01-01 12:00:00' + make_dt_interval(cast(id as int)) AS ts").write.parquet(str(tmp_path / "t"))
    df = validate._window(spark.read.parquet(str(tmp_path / "t")), "ts", datetime.date(2026, 1, 3), datetime.date(2026, 1, 5))
    assert df.count() == 3 and "GreaterThanOrEqual(ts" in plan_of(df)


def test_upserts_with_null_keys_are_repeatable(spark):
    t = spark.createDataFrame([(1, None, "a"), (None, 2, "b")], "k int, `l.l` int, v string")
    c = spark.createDataFrame([(1, None, "z"), (None, None, "n")], "k int, `l.l` int, v string")
    once = merge.upsert(t, c, ["k", "l.l"])
    assert Counter(map(tuple, once.collect())) == Counter(map(tuple, merge.upsert(once, c, ["k", "l.l"]).collect())) == Counter([(1, None, "z"), (None, 2, "b"), (None, None, "n")])


def test_scripts_keep_texts_and_quoted_names(spark):
    name = "script_db"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")
    script = f"""-- cat.x.y stays in a comment
    CREATE OR REPLACE TABLE `cat`.{name}.`odd_name` AS SELECT 'see cat.a.b -- not; a comment' AS v, /* cat.c.d */ "as (cat.e.f)" AS w;
    CREATE OR REPLACE TABLE cat.{name}.`odd_name` AS SELECT concat(v, '!') AS v, w FROM cat.{name}.`odd_name`;
    CREATE TABLE IF NOT EXISTS cat.{name}.plain (id INT, v STRING COMMENT 'primary key (x), as is', PRIMARY KEY (id)) CLUSTER BY (id)"""
    scripts.run_script(spark, script, catalog="cat")
    assert tuple(spark.table(f"{name}.`odd_name`").first()) == ("see cat.a.b -- not; a comment!", "as (cat.e.f)")
    assert spark.sql(f"DESCRIBE {name}.plain").where("col_name = 'v'").first()["comment"] == "primary key (x), as is"
    assert {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {name}").collect()} == {"odd_name", "plain"}
    # A statement that fails leaves the old table.
    with pytest.raises(RuntimeError, match="statement 1"):
        scripts.run_script(spark, f"CREATE OR REPLACE TABLE {name}.`odd_name` AS SELECT raise_error('no') AS v")
    assert spark.table(f"{name}.`odd_name`").count() == 1
    assert scripts.without_catalog("a.cat.b.c, cat.t.u, CAT.s.t, 'cat.s.t', \"cat.s.t\", mycat.s.t, cat.t", "cat") == "a.cat.b.c, cat.t.u, s.t, 'cat.s.t', \"cat.s.t\", mycat.s.t, cat.t".replace("cat.t.u", "t.u")
    spark.sql(f"DROP SCHEMA {name} CASCADE")


@pytest.mark.parametrize("many", [10_000, 1])
def test_patterns_say_where_rows_lie(spark, many):
    """By grouping sets, and by sketches where values are many."""
    s = spark.range(1000).selectExpr("id AS k", "concat('r', id % 4) AS region", "date_add(date'2026-01-01', cast(id % 50 AS int)) AS day", "id % 2 = 0 AS even", "cast(id AS string) AS name", "1 AS v")
    t = s.where("NOT (region = 'r2' AND k < 400)").withColumn("v", F.when((F.col("day") == F.lit("2026-01-05").cast("date")) | (F.col("k") < 8), 2).otherwise(F.col("v")))
    found = compare.Difference.of(s, t, compare.Pair(keys=["k"]))
    got = {(r["recon_type"], r["column"], r["dimension"]): r for r in patterns.concentration(found, many=many).collect()}
    missing = got["missing_in_target", None, "region"]
    assert (missing["mode"], missing["total"], missing["share"], missing["clustered"]) == ("r2", 100, 1.0, True) and missing["usual"] == 0.25
    day = got["column_mismatch", "v", "day"]
    rows = [d for d in ((k % 50, k) for k in range(1000) if not (k % 4 == 2 and k < 400)) if d[0] == 4 or d[1] < 8]
    assert day["total"] == len(rows) and (day["mode"], day["top"]) == ("2026-01-05", sum(d == 4 for d, _ in rows))
    assert not got["missing_in_target", None, "name"]["clustered"] and not got["missing_in_target", None, "day"]["clustered"]
    assert patterns.concentration(compare.Difference.of(s, s, compare.Pair(keys=["k"]))).count() == 0


def test_analysis_says_where_findings_lie(spark):
    s = spark.range(200).selectExpr("id AS k", "concat('r', id % 4) AS region", "'a' AS v")
    t = s.where("region <> 'r1'")
    parts = compare.compare(s, t, compare.Pair(keys=["k"]), recon_id="r", table_id=1, source_name="a.s", target_name="a.t")
    done = analyze(spark, *parts, "r", table={"a.s": s, "a.t": t}.__getitem__, mapping={"t": artifacts.TableMapping("a.t", "a.s", ["k"])}, locate=True)
    said = [e for r in done.hypotheses.collect() for e in r["evidence"] if e["label"] == "pattern"]
    assert said and said[0]["data"] == {"dimension": "region", "mode": "r1", "share": "1.0"}


def test_pairs_of_one_shape_are_confirmed_in_one_plan(spark, monkeypatch):
    """Other names, copies in some pairs, an empty one: the same as one by one."""
    pairs, want = {}, {}
    for tag in range(5):
        s = spark.range(40 if tag < 4 else 0).selectExpr(f"id AS key{tag}", f"concat('a', id % {tag + 2}) AS word{tag}", f"cast(id + 0.125 AS decimal(10,3)) AS price{tag}")
        t = s.withColumn(f"word{tag}", F.when(F.col(f"key{tag}") % (tag + 2) == 1, F.upper(f"word{tag}")).otherwise(F.col(f"word{tag}"))).withColumn(f"price{tag}", F.col(f"price{tag}").cast("decimal(10,2)").cast("decimal(10,3)"))
        t = t.union(t.limit(3)) if tag == 2 else t
        kinds = {f"price{tag}": "type_precision", f"word{tag}": "string_format"}
        pairs[tag] = (meeting.laid_out(s, t, meeting.Pair(keys=[f"key{tag}"])), kinds)
        want |= {(tag, r["column"]): (r["category"], r["measures"], r["confirmed"]) for r in drilldown.confirm_columns(s, t, [f"key{tag}"], kinds).collect()}
    plans = []
    real = drilldown.confirm_laid_out
    monkeypatch.setattr(drilldown, "confirm_laid_out", lambda *x: plans.append(x) or real(*x))
    got = {(r["tag"], r["column"]): (r["category"], r["measures"], r["confirmed"]) for r in drilldown.confirm_pairs(pairs).collect()}
    assert len(plans) == 1 and got == {k: v for k, v in want.items() if k[0] < 4} and len(got) == 8
