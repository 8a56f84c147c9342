"""Validation helpers that a report's reader can run again."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import drilldown, meeting


def _window(df: DataFrame, date_column: str | None, start, end) -> DataFrame:
    """Rows whose date lies between start and end; said of the column itself, so that the scan can use it."""
    if not date_column or start is None:
        return df
    x = F.col(meeting.quoted(date_column))
    if isinstance(df.schema[date_column].dataType, (T.TimestampType, T.TimestampNTZType)) and not isinstance(end, datetime.datetime):
        return df.where((x >= F.lit(start)) & (x < F.lit(end + datetime.timedelta(days=1))))
    return df.where(x.between(F.lit(start), F.lit(end)))


def validate_rows(source: DataFrame, target: DataFrame, keys: list[str], date_column: str | None = None, start=None, end=None) -> DataFrame:
    """source_rows, target_rows, matched_keys, row_match_pct: distinct keys of the source found in the target, a null
    key being a key. Without keys the percentage is null."""
    source, target = (_window(x, date_column, start, end) for x in (source, target))
    return validate_laid_out(meeting.laid_out(source, target, meeting.Pair(keys=keys), []))


def validate_laid_out(sides: meeting.Sides) -> DataFrame:
    """validate_rows of sides in the common layout: one row for each key and side, one join."""
    s, t = (df.groupBy(*sides.on).agg(F.count(F.lit(1)).alias(n)) for df, n in ((sides.source, "s"), (sides.target, "t")))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(f"{'source' if x == 's' else 'target'}_rows")
    here = F.col("s").isNotNull()
    one = s.join(t, sides.on, "full_outer").agg(total("s"), total("t"), F.count_if(here & F.col("t").isNotNull()).alias("matched"), F.count_if(here).alias("keys"))
    matched = F.when(F.lit(bool(sides.keys)), F.col("matched")).alias("matched_keys")
    pct = F.when(F.lit(bool(sides.keys)), F.round(100.0 * F.try_divide("matched", "keys"), 2)).alias("row_match_pct")
    return one.select("source_rows", "target_rows", matched, pct)


def validate_column(source: DataFrame, target: DataFrame, keys: list[str], column: str, date_column: str | None = None, start=None, end=None) -> DataFrame:
    """compared, equal, column_match_pct over rows that share a key and meet as in the comparison; null without keys."""
    source, target = (_window(x, date_column, start, end) for x in (source, target))
    if not keys:
        return source.sparkSession.createDataFrame([(column, None, None, None)], "column string, compared long, equal long, column_match_pct double")
    sides = meeting.laid_out(source, target, meeting.Pair(keys=keys), [column])
    both = F.col("alone") & F.col("sn").isNotNull() & F.col("tn").isNotNull()
    values = {"here": F.when(both, F.col("w")), "same": F.when(both & ~sides.differs(column), F.col("w"))}
    total = lambda x: (F.coalesce(F.sum(x), F.lit(0)), F.sum)
    one = drilldown.fold(sides, "inner", values, {"compared": total("here"), "equal": total("same")})
    return one.select(F.lit(column).alias("column"), "compared", "equal", F.round(100.0 * F.try_divide("equal", "compared"), 2).alias("column_match_pct"))
