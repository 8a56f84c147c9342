"""Digests of key ranges: only the ranges of two tables that differ are joined.

A row's place is its key, if that is one whole number, date or time on both sides, else a hash of its keys. Places
are cut into ranges of equal width, each of them into FAN ranges of the level below, and so on. A range's digest
holds its rows and four sums of 31 bits each of two 64-bit hashes of every row (keys and common columns), so
digests don't depend on order, tasks add them up before the shuffle, and digests of neighbours add up to that of
the range above. Level by level, only ranges whose digests differ are looked into further, with a filter on the
key that the scan can use.

Two different sets of rows with equal digests would be taken as equal: for other than crafted data the chance is
about 2^-120 for each range. Sums are exact up to 2^32 rows in a range.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize
from . import meeting

#: Ranges that a range is cut into, levels at most, ranges that may be open at a level, rows of a range that is
#: small enough, and intervals that a filter on the key names.
FAN, LEVELS, OPEN, SMALL, INTERVALS = 256, 4, 4096, 10_000, 64
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _whole(x: Column, t: T.DataType) -> Column:
    if isinstance(t, T.DateType):
        return F.unix_date(x).cast("long")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(x.cast("timestamp"))
    return x.cast("long")


@dataclasses.dataclass
class Tree:
    """The digests of two tables. levels: of each level level, range, lo, hi (its first and last place), source_rows,
    target_rows, differs; those of the first level cover all rows."""

    sides: meeting.Sides
    levels: list[DataFrame]
    #: The sides' rows in ranges that differ at the last level.
    open: meeting.Sides
    source_rows: int
    target_rows: int

    def ranges(self) -> DataFrame:
        out = self.levels[0]
        for df in self.levels[1:]:
            out = out.unionByName(df)
        return out


def _places(sides: meeting.Sides) -> tuple[list[DataFrame], int, int, bool]:
    """Both sides with `place` from 0 on; how many places there are, the first key's number, and whether places are keys."""
    kinds = [t[k] for k in sides.keys for t in (sides.source_types, sides.target_types)]
    if len(sides.keys) == 1 and kinds[0] == kinds[1] and isinstance(kinds[0], _WHOLE):
        key = _whole(F.col("j0"), kinds[0])
        ends = sides.source.select("j0").union(sides.target.select("j0")).agg(F.min(key), F.max(key)).first()
        low, high = ends[0] or 0, ends[1] or 0
        if high - low < 1 << 62:
            return [df.withColumn("place", key - F.lit(low)) for df in (sides.source, sides.target)], high - low + 1, low, True
    hashed = F.shiftrightunsigned(F.xxhash64(*sides.on), 1)
    return [df.withColumn("place", hashed) for df in (sides.source, sides.target)], 1 << 63, 0, False


def _digest(sides: meeting.Sides, placed: list[DataFrame], width: int, level: int) -> DataFrame:
    """The digest of each range of `width` places."""
    both = None
    for df, side in zip(placed, "st", strict=True):
        lanes = [lane for h in meeting.row_hashes(sides, side) for lane in (F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit((1 << 31) - 1)))]
        one = df.select((F.expr(f"place div {width}L")).alias("range"), *[F.lit(int(side == x)).cast("long").alias(f"n{x}") for x in "st"], *[(lane if side == x else F.lit(0).cast("long")).alias(f"{x}{k}") for x in "st" for k, lane in enumerate(lanes)])
        both = one if both is None else both.unionByName(one)
    sums = both.groupBy("range").agg(*[F.sum(c).alias(c) for c in both.columns if c != "range"])
    differs = meeting.any_of([F.col("ns") != F.col("nt"), *[F.col(f"s{k}") != F.col(f"t{k}") for k in range(4)]])
    at = F.col("range") * F.lit(width)
    last = F.lit(width - 1)
    return sums.select(F.lit(level).alias("level"), "range", at.alias("lo"), (at + last).alias("hi"), F.col("ns").alias("source_rows"), F.col("nt").alias("target_rows"), differs.alias("differs"))


def _within(df: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    return df.withColumn("range", F.expr(f"place div {width}L")).join(F.broadcast(ranges), "range", "left_semi").drop("range")  # at most OPEN rows, counted


def _filtered(df: DataFrame, column: Column, kind: T.DataType, low: int, spans: list[tuple[int, int]]) -> DataFrame:
    """Rows whose key lies in the spans of places, said of the column itself so that scans can skip files."""
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df
    inside = meeting.any_of([column.between(low + a, low + b) for a, b in spans])
    return df.where(inside | column.isNull())


def _merged(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Spans that cover these, at most `most`: neighbours are joined, those with the smallest gaps first."""
    spans = sorted(spans)
    gaps = sorted((b[0] - a[1] for a, b in zip(spans, spans[1:], strict=False)), reverse=True)
    least = max(2, gaps[most - 1] + 1) if len(gaps) >= most else 2
    out = spans[:1]
    for a, b in spans[1:]:
        if a - out[-1][1] < least:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def tree(sides: meeting.Sides, fan: int = FAN, levels: int = LEVELS, small: int = SMALL) -> Tree:
    """Digests from all rows down to ranges of about `small` rows that differ."""
    placed, span, low, keyed = _places(sides)
    # Widths are powers of fan apart, so that ranges lie within those above.
    levels = next(k for k in range(1, levels + 1) if k == levels or fan**k >= span)
    width, found, totals = -(-span // fan**levels) * fan**levels, [], None
    for level in range(1, levels + 1):
        width //= fan
        digests = materialize(_digest(sides, placed, width, level), "digests")
        found.append(digests)
        sums = digests.agg(F.sum("source_rows"), F.sum("target_rows"), F.count_if("differs"), F.sum(F.when(F.col("differs"), F.col("source_rows") + F.col("target_rows")))).first()
        totals = totals or (sums[0] or 0, sums[1] or 0)
        n_open, rows = sums[2] or 0, sums[3] or 0
        if n_open > OPEN:
            break  # nearly all differs: what is looked into further stays as it was
        ranges = digests.where("differs").select("range")
        if keyed:
            spans = _merged([(r[0], r[1]) for r in digests.where("differs").select("lo", "hi").collect()], INTERVALS)  # at most OPEN rows
            kinds = (sides.source_types, sides.target_types)
            placed = [_filtered(df, getattr(sides, x)(sides.keys[0]), t[sides.keys[0]], low, spans) for df, x, t in zip(placed, "st", kinds, strict=True)]
        placed = [_within(df, ranges, width) for df in placed]
        if rows <= 2 * small * n_open:
            break
    rest = dataclasses.replace(sides, source=placed[0].drop("place"), target=placed[1].drop("place"))
    return Tree(sides, found, rest, *totals)
