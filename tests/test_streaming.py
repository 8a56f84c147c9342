"""Rows that stream in from both sides: findings, their corrections, and what state is given up."""

import functools

from pyspark.sql import functions as F

from tallylens import streaming

SCHEMA = "k long, v string, w int, at timestamp"


def run(spark, tmp_path, batches):
    """batches: (source rows, target rows) of each micro-batch -> all findings, in order."""
    at = {}
    for side in "st":
        at[side] = str(tmp_path / side)
        spark.createDataFrame([], SCHEMA).write.parquet(at[side])
    check, out = str(tmp_path / "check"), []
    for n, sides in enumerate(batches):
        for side, rows in zip("st", sides, strict=True):
            if rows:
                df = spark.createDataFrame([(k, v, w, f"2026-01-01 {t}") for k, v, w, t in rows], "k long, v string, w int, at string")
                df.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(at[side])
        streams = [spark.readStream.schema(SCHEMA).parquet(at[x]) for x in "st"]
        found = streaming.findings(*streams, ["k"], "at", late="10 seconds", wait="1 minute", keep="30 minutes")
        started = found.writeStream.outputMode("update").foreachBatch(lambda df, i, n=n: out.extend((n, r) for r in df.collect())).option("checkpointLocation", check).trigger(availableNow=True).start()
        started.awaitTermination()
    return [(n, r["key"].get("k"), r["kind"], r["columns"], r["corrects"], r["revision"]) for n, r in out]


def test_findings_wait_for_the_other_side_and_are_corrected(spark, tmp_path):
    got = run(
        spark,
        tmp_path,
        [
            ([(1, "a", 1, "10:00:00"), (2, "b", 1, "10:00:00"), (3, "c", 1, "10:00:00")], [(1, "a", 1, "10:00:01")]),
            # Key 2 comes within the wait and differs; 3 waits on.
            ([], [(2, "B", 2, "10:00:30")]),
            # The watermark passes 3's wait: it is missing. 9 pushes the time on.
            ([(9, "z", 1, "10:05:00")], [(9, "z", 1, "10:05:00")]),
            # The late row of 3 corrects that; 2 is corrected by its source's new row.
            ([(2, "B", 2, "10:05:10")], [(3, "c", 1, "10:05:10"), (None, "n", 1, "10:05:10")]),
            ([(9, "z", 1, "10:09:00")], [(9, "y", 1, "10:09:00")]),
        ],
    )
    by = {}
    for n, k, *rest in got:
        by.setdefault(k, []).append((n, *rest))
    assert by["2"] == [(1, "mismatch", ["v", "w"], None, 1), (3, "equal", [], "mismatch", 2)]
    assert by["3"] == [(2, "missing_in_target", [], None, 1), (3, "equal", [], "missing_in_target", 2)]
    assert by["9"] == [(4, "mismatch", ["v"], "equal", 1)] and "1" not in by
    assert by[None] == [(4, "missing_in_source", [], None, 1)]


def test_keys_of_one_group_wait_and_go_by_themselves(spark, tmp_path, monkeypatch):
    """All keys in one group: some have new rows while the time of others passes."""
    monkeypatch.setattr(streaming, "findings", functools.partial(streaming.findings, groups=1))
    test_findings_wait_for_the_other_side_and_are_corrected(spark, tmp_path)


def test_many_keys_share_the_calls_of_python(spark, tmp_path):
    """Each key was a call of Python's and a state of its own, at a millisecond or more."""
    n, paths, out = 12_000, [str(tmp_path / x) for x in "st"], []
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("w"), F.lit("2026-01-01").cast("timestamp").alias("at"))
    rows.coalesce(2).write.parquet(paths[0])
    rows.withColumn("v", F.when(F.col("k") % 10 == 3, "b").otherwise("a")).coalesce(2).write.parquet(paths[1])
    found = streaming.findings(*[spark.readStream.schema(SCHEMA).parquet(p) for p in paths], ["k"], "at")
    started = found.writeStream.outputMode("update").foreachBatch(lambda df, i: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    started.awaitTermination()
    assert sorted(int(r["key"]["k"]) for r in out) == list(range(3, n, 10)) and {(r["kind"], *r["columns"]) for r in out} == {("mismatch", "v")}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in started.recentProgress) <= 4096
