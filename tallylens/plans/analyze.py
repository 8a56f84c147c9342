"""The whole analysis: comparison tables in, ranked and confirmed hypotheses out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import knowledge
from ..operators import classify, compare, drilldown, ingest, lineage, meeting, passes, patterns
from ..schemas import COLUMN
from ..scratch import drop_from, mark, materialize
from ..sources import artifacts


@dataclass
class Analysis:
    recon_id: str
    findings: DataFrame
    samples: DataFrame
    hypotheses: DataFrame
    summaries: DataFrame

    def top(self) -> DataFrame:
        return classify.top(self.hypotheses).join(self.findings, "finding_id")

    def verdict_counts(self) -> DataFrame:
        return classify.verdict_counts(classify.top(self.hypotheses))


def analyze(
    spark: SparkSession,
    main: DataFrame,
    metrics: DataFrame,
    details: DataFrame,
    recon_id: str,
    *,
    dialect: str = "snowflake",
    table: Callable[[str], DataFrame] | None = None,
    mapping: dict[str, artifacts.TableMapping] | None = None,
    upstreams: DataFrame | None = None,
    drills: int = 4,
    locate: bool = False,
) -> Analysis:
    """table: gives a compared table by its full name; without it nothing is confirmed on whole tables.
    mapping: code artifacts; their keys, renamed columns and load filters hold for the confirmation too.
    upstreams: as from lineage.upstreams. drills: pairs confirmed at a time. locate: also say which value of which
    column a finding's rows share, which compares the pair's tables once more."""
    first = mark()
    # Details are at most SAMPLE_CAP rows for each column of each pair. Each step's frames are written once.
    findings, samples, summaries = ingest.ingest(main, metrics, materialize(details, "details"), recon_id)
    if mapping:
        summaries = known(spark, summaries, mapping)
    findings, samples, summaries = (materialize(x, "analysis") for x in (findings, samples, summaries))
    pack = knowledge.load(dialect)
    hypotheses = materialize(classify.classify(findings, samples, knowledge.remediation(spark, pack)), "analysis")
    hypotheses = classify.freshness_pass(findings, hypotheses)
    if mapping:
        hypotheses = passes.code_pass(findings, hypotheses, **artifacts.frames(spark, mapping))
    if table is not None or upstreams is not None:
        hypotheses = materialize(hypotheses, "analysis")
    if table is not None:
        drilled = drill_all(spark, findings, hypotheses, summaries, table, mapping or {}, drills)
        findings, hypotheses = drilldown.finalise(findings, hypotheses, drilled)
        if locate:
            hypotheses = patterns.pattern_pass(hypotheses, located(spark, findings, summaries, table, mapping or {}))
    if upstreams is not None:
        hypotheses = lineage.lineage_pass(findings, hypotheses, upstreams)
    out = Analysis(recon_id, *(materialize(x, "analysis") for x in (findings, samples, hypotheses, summaries)))
    drop_from(spark, first, keep=4)  # what it wrote on its way
    return out


def _pair(r, mapping: dict) -> compare.Pair:
    m = mapping.get(artifacts.short(r["target_table"]))
    return compare.Pair(keys=list(r["join_keys"] or []), column_map=dict(m.column_map) if m else {}, source_filter=m.compared[0] if m else "", target_filter=m.compared[1] if m else "")


def located(spark: SparkSession, findings: DataFrame, summaries: DataFrame, table: Callable[[str], DataFrame], mapping: dict) -> DataFrame:
    """finding_id and the columns of patterns.concentration, for the pairs that have findings."""
    known = findings.select("finding_id", "recon_table_id", "recon_type", "column")
    rows = summaries.join(known.select("recon_table_id").distinct(), "recon_table_id", "left_semi")
    out = []
    for r in rows.select("recon_table_id", "source_table", "target_table", "join_keys").collect():  # a row for each pair
        found = compare.Difference.of(table(r["source_table"]), table(r["target_table"]), _pair(r, mapping))
        out.append(patterns.concentration(found).withColumn("recon_table_id", F.lit(r["recon_table_id"])))
    if not out:
        return spark.createDataFrame([], "finding_id string, dimension string, total long, mode string, top long, share double, clustered boolean, usual double")
    each = materialize(reduce(lambda a, b: a.unionByName(b), out), "patterns")
    met = each.join(known, (each["recon_table_id"] == known["recon_table_id"]) & (each["recon_type"] == known["recon_type"]) & each["column"].eqNullSafe(known["column"]))
    return met.select("finding_id", *[each[c] for c in ("dimension", "total", "mode", "top", "share", "clustered", "usual")])


def known(spark: SparkSession, summaries: DataFrame, mapping: dict[str, artifacts.TableMapping]) -> DataFrame:
    """Summaries with the join keys and date column that the artifacts name in place of the guessed ones."""
    rows = [(k, m.keys or None, m.date_column or None) for k, m in mapping.items()]
    given = spark.createDataFrame(rows, "_t string, _keys array<string>, _date string")
    met = summaries.join(F.broadcast(given), ingest.short_name(F.col("target_table")) == F.col("_t"), "left")  # a row for each mapped table
    new = {"join_keys": F.coalesce("_keys", "join_keys"), "date_column": F.coalesce("_date", "date_column")}
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in summaries.columns])


def drill_all(spark: SparkSession, findings: DataFrame, hypotheses: DataFrame, summaries: DataFrame, table: Callable[[str], DataFrame], mapping: dict, drills: int) -> DataFrame:
    """The confirmations of all pairs. Findings and confirmations are a row each, so the driver holds them: one job
    reads the findings; columns of pairs of the same types are confirmed in one plan; what concerns whole rows and
    schemas has a small plan for each pair, some of them at a time."""
    by = defaultdict(list)
    heads = classify.top(hypotheses).join(findings.select("finding_id", "recon_table_id", "recon_type", "column"), "finding_id")
    for r in heads.select("finding_id", "recon_table_id", "recon_type", "column", "category").collect():
        by[r["recon_table_id"]].append(r)
    pairs = [r for r in summaries.select("recon_table_id", "source_table", "target_table", "join_keys").collect() if r["recon_table_id"] in by]
    laid, ids = {}, []
    for r in pairs:
        tag, pair = r["recon_table_id"], _pair(r, mapping)
        s, t = drilldown.sides(table(r["source_table"]), table(r["target_table"]), pair)
        columns = drilldown.column_heads(s, t, pair.keys, by[tag])
        if columns:
            laid[tag] = (meeting.laid_out(s, t, meeting.Pair(keys=pair.keys), list(columns)), {c: k for c, (_, k) in columns.items()})
            ids += [(tag, c, i, drilldown.rerun(pair, r["source_table"], r["target_table"], COLUMN, c)) for c, (i, _) in columns.items()]
    rows = []
    if laid:
        known = spark.createDataFrame(ids, "tag long, column string, finding_id string, query string")
        done = drilldown.confirm_pairs(laid).join(F.broadcast(known), ["tag", "column"])  # a row for each finding
        rows = drilldown.said_of_columns(done).collect()

    def one(r) -> list:
        todo = drilldown.drill(table(r["source_table"]), table(r["target_table"]), _pair(r, mapping), by[r["recon_table_id"]], r["source_table"], r["target_table"], with_columns=False)
        return [x for df in todo for x in df.collect()]

    with ThreadPoolExecutor(drills) as pool:
        rows += [x for done in pool.map(one, pairs) for x in done]
    return spark.createDataFrame(rows, drilldown.DRILLED)
