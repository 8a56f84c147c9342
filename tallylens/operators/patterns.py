"""Row patterns, extract freshness and risky functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.probes import wall_micros
from ..schemas import COLUMN, MISSING_IN_SOURCE, MISSING_IN_TARGET
from ..scratch import materialize
from . import compare
from .classify import evidence


def buckets(rows: DataFrame, bucket: str, threshold: float = 0.6) -> DataFrame:
    """total, mode, share, clustered: whether one bucket holds at least threshold of the rows.
    Ties go to the smaller bucket; null buckets don't count."""
    counts = rows.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").alias("total"), F.max_by(F.struct(F.col(bucket).alias("mode"), "n"), F.struct("n", -F.xxhash64(bucket))).alias("unused"), F.max("n").alias("top"))
    mode = counts.join(one.select("top"), counts["n"] == F.col("top")).agg(F.min(bucket).alias("mode"))
    out = one.select("total", "top").crossJoin(mode)  # two single rows
    share = F.round(F.try_divide("top", "total"), 6)
    return out.select(F.coalesce("total", F.lit(0)).alias("total"), "mode", share.alias("share"), F.coalesce(share >= threshold, F.lit(False)).alias("clustered"))


def skewed(source_ts: Column, target_ts: Column, threshold_seconds: int = 3600) -> tuple[Column, Column]:
    """(gap in seconds, whether it is at least the threshold); null times are not skewed."""
    gap = F.floor(F.abs(wall_micros(target_ts) - wall_micros(source_ts)) / 1_000_000)
    return gap, F.coalesce(gap >= threshold_seconds, F.lit(False))


def risky(code: DataFrame, text: str, functions: list[str]) -> DataFrame:
    """Adds `risky`: those of the functions that the text calls or names, as whole words before a bracket."""
    hits = [F.when(F.col(text).rlike(r"(?i)\b" + re.escape(f) + r"\s*\("), F.lit(f)) for f in functions]
    return code.withColumn("risky", F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>"))


def value_pairs(both: DataFrame, source: str, target: str) -> DataFrame:
    """How often each pair of values meets."""
    return both.groupBy(F.col(source).alias("source_value"), F.col(target).alias("target_value")).agg(F.count(F.lit(1)).alias("n"))


def first_rows(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """At most n rows of each `by`, first in order; the limit applies before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


#: Distinct values from which on a column's values are counted by a sketch first, and items that it keeps.
MANY, KEPT = 10_000, 1024


def _dimensions(found: compare.Difference) -> dict[str, tuple[Column, Column]]:
    """The columns that may say where a finding's rows lie, as texts of either side: words, truth, dates, days of times."""
    sides, out = found.sides, {}
    for c in [*sides.keys, *sides.common]:
        texts = []
        for side, kind in zip("st", sides.types(c), strict=True):
            x = getattr(sides, side)(c)
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                x = x.cast("date")
            texts.append(x.cast("string") if isinstance(kind, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) else None)
        if all(x is not None for x in texts):
            out[c] = tuple(texts)
    return out


def concentration(found: compare.Difference, dimensions: list[str] | None = None, threshold: float = 0.6, many: int = MANY) -> DataFrame:
    """For each finding (recon_type, column) of the rows that differ and each dimension: total (rows with a value
    there), mode, top (its rows), share, clustered (whether one value has at least `threshold` of them), and for
    those that are, usual: the value's share of all rows of the side that the finding is about.

    One aggregate over grouping sets counts the values of all dimensions with few of them. Where a dimension has
    `many` or more, a frequent-items sketch names the only value that can hold the threshold (which must be above
    1 / KEPT) and a second aggregate counts that one exactly; a mode that holds less is then null, and so is its
    share. Null values don't count; ties go to the least value."""
    known = _dimensions(found)
    names = [c for c in (dimensions if dimensions is not None else known) if c in known]
    common = found.sides.common
    kinds = F.when(F.col("tn").isNull(), F.array(F.lit(-1))).when(F.col("sn").isNull(), F.array(F.lit(-2))).otherwise(F.array_compact(F.array(*[F.when(found.flag(c), F.lit(k)) for k, c in enumerate(common)])) if common else F.array().cast("array<int>"))
    values = [F.coalesce(*known[c]).alias(f"v{k}") for k, c in enumerate(names)]
    rows = found.rows.select(F.explode(kinds).alias("what"), *values)
    empty = rows.select("what", F.lit(0).alias("dimension"), F.lit("").alias("mode"), F.lit(1).cast("long").alias("top"), F.lit(1).cast("long").alias("total")).limit(0)
    if not names:
        return _shown(empty, names, common, threshold).withColumn("usual", F.lit(None).cast("double"))
    sizes = rows.agg(*[F.approx_count_distinct(f"v{k}") for k in range(len(names))]).first()
    few, wide = ([k for k, n in enumerate(sizes) if (n < many) == x] for x in (True, False))
    out = empty
    if few:
        columns = [F.col(f"v{k}") for k in few]
        sets = [[F.col("what"), c] for c in columns]
        at = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(k)) for k, c in zip(few, columns, strict=True)]).alias("dimension")
        counts = rows.groupingSets(sets, F.col("what"), *columns).agg(at, F.coalesce(*columns).alias("mode"), F.count(F.lit(1)).alias("n")).where("mode is not null")
        by = counts.groupBy("what", "dimension").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
        least = counts.join(by, ["what", "dimension"]).where("n = top").groupBy("what", "dimension").agg(F.min("mode").alias("mode"), F.first("top").alias("top"), F.first("total").alias("total"))
        out = out.unionByName(least.select(*out.columns))
    if wide:
        picked = rows.groupBy("what").agg(*[F.expr(f"approx_top_k(v{k}, 2, {KEPT})").alias(f"c{k}") for k in wide])
        first = picked.select("what", *[F.expr(f"get(filter(c{k}, x -> x.item is not null), 0).item").alias(f"c{k}") for k in wide])
        met = rows.join(F.broadcast(first), "what")  # a row for each finding
        sums = met.groupBy("what").agg(*[x for k in wide for x in (F.first(f"c{k}").alias(f"c{k}"), F.count_if(F.col(f"v{k}") == F.col(f"c{k}")).alias(f"n{k}"), F.count(f"v{k}").alias(f"t{k}"))])
        each = [F.struct(F.lit(k).alias("dimension"), F.col(f"c{k}").alias("mode"), F.col(f"n{k}").alias("top"), F.col(f"t{k}").alias("total")) for k in wide]
        sums = sums.select("what", F.explode(F.array(*each)).alias("e")).select("what", "e.*").where("total > 0")
        enough = F.col("top") >= threshold * F.col("total")
        out = out.unionByName(sums.withColumns({c: F.when(enough, F.col(c)) for c in ("mode", "top")}))
    return _with_usual(materialize(_shown(out, names, common, threshold), "patterns"), found, known)


def _with_usual(shown: DataFrame, found: compare.Difference, known: dict) -> DataFrame:
    values = [tuple(r) for r in shown.where("clustered").select("dimension", "mode").distinct().collect()]  # at most one for each finding and dimension
    rows = []
    for side, df in enumerate((found.sides.source, found.sides.target)):
        for a in range(0, len(values), 100):
            part = values[a : a + 100]
            counts = df.agg(*[x for c, v in part for x in (F.count_if(known[c][side] == F.lit(v)), F.count(known[c][side]))]).first()
            rows += [(c, v, side == 1, counts[2 * k] / max(1, counts[2 * k + 1])) for k, (c, v) in enumerate(part)]
    usual = shown.sparkSession.createDataFrame(rows, "dimension string, mode string, _target boolean, usual double")
    met = shown.withColumn("_target", F.col("recon_type") == MISSING_IN_SOURCE).join(F.broadcast(usual), ["dimension", "mode", "_target"], "left")  # as few rows
    return met.select(*shown.columns, F.round(F.when(F.col("clustered"), F.col("usual")), 6).alias("usual"))


def _shown(rows: DataFrame, names: list[str], common: list[str], threshold: float) -> DataFrame:
    kind = F.when(F.col("what") == -1, MISSING_IN_TARGET).when(F.col("what") == -2, MISSING_IN_SOURCE).otherwise(COLUMN)
    pick = lambda x, at: F.get(F.array(*[F.lit(c) for c in x]).cast("array<string>"), at)
    share = F.round(F.try_divide("top", "total"), 6)
    return rows.select(
        kind.alias("recon_type"),
        F.when(F.col("what") >= 0, pick(common, F.col("what"))).alias("column"),
        pick(names, F.col("dimension")).alias("dimension"),
        "total",
        "mode",
        "top",
        share.alias("share"),
        F.coalesce(F.col("top") >= threshold * F.col("total"), F.lit(False)).alias("clustered"),
    )


def pattern_pass(hypotheses: DataFrame, patterns: DataFrame) -> DataFrame:
    """Hypotheses with evidence of where their finding's rows lie; patterns: finding_id and concentration()'s columns.
    A finding's clearest pattern counts: the value whose share is farthest above its usual one, and by half at least."""
    gain = F.struct(F.col("share") - F.col("usual"), F.col("dimension"))
    clear = patterns.where("clustered AND share >= 1.5 * usual").groupBy("finding_id").agg(F.max_by(F.struct("dimension", "mode", "share", "usual"), gain).alias("p"))
    detail = F.format_string("%.0f%% of the rows have %s = %s, of all rows %.0f%%: a bounded filter, a lagging load or one bad batch.", F.col("p.share") * 100, F.col("p.dimension"), F.col("p.mode"), F.col("p.usual") * 100)
    data = F.create_map(F.lit("dimension"), F.col("p.dimension"), F.lit("mode"), F.col("p.mode"), F.lit("share"), F.col("p.share").cast("string"))
    said = clear.select("finding_id", evidence("pattern", detail, data=data).alias("_said"))
    out = hypotheses.join(said, "finding_id", "left")
    new = F.when(F.col("_said").isNotNull(), F.concat(F.col("evidence"), F.array("_said"))).otherwise(F.col("evidence"))
    return out.select(*[new.alias(c) if c == "evidence" else F.col(c) for c in hypotheses.columns])
