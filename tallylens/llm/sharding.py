"""Sharding by sampled splitters.

Records are ordered by (hash of text, doc_id), so equal texts stand together. Where rows that tie in both are so
many that a boundary would miss its place, rows are numbered as well: they are written to the shared folder with
their numbers, which all further passes read, and any range of them can be cut anywhere. A sample that is drawn
with probability in proportion to size gives quantile boundaries; the exact bytes of each range are
then added up over all rows, ranges that came out overfull are sampled again on their own and
subdivided, and consecutive ranges are joined into shards whose sizes are near equal. A boundary moves
to the edge of a group of equal texts where that costs less than `slack` of a shard.

What reaches the driver is bounded: per_range samples for each of at most max_ranges ranges (16 x 65,536
keys), the splitters, and the sizes and counts of the ranges.

Defined cases: null text has size 1 and crc32 0; a null doc_id comes first among equal texts; repeated rows are
rows of their own; a row larger than
a shard fills one alone; an empty table gives an empty result; with fewer rows than shards some stay empty.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship


Key = tuple[int, int, int]


def _ranged(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    """Adds `range`: how many splitters (h, d, u) are at or below the row's."""
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    # Sorted keys, as three arrays: at most max_ranges, and the edges of their groups.
    shared = rows.sparkSession.sparkContext.broadcast(tuple(np.array(x, dtype="int64") for x in zip(*sorted(splitters), strict=True)))

    @F.pandas_udf("int")
    def place(h: pd.Series, d: pd.Series, u: pd.Series) -> pd.Series:
        hs, ds, us = shared.value
        at, end = (np.searchsorted(hs, h.to_numpy(), side=x) for x in ("left", "right"))
        # Where splitters have the row's h, a binary search among their (d, u).
        own = np.flatnonzero(at < end)
        lo, hi, key, number = at[own], end[own], d.to_numpy()[own], u.to_numpy()[own]
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(ds) - 1)
            below = (ds[mid] < key) | (ds[mid] == key) & (us[mid] <= number)
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        end[own] = lo
        return pd.Series(end.astype("int32"))

    return rows.withColumn("range", place("h", "d", "u"))


def _sample(rows: DataFrame, total: int, want: int, salt: int) -> list[Key]:
    """Keys drawn with probability want * size / total each (1 at most), in ascending order."""
    draw = F.shiftrightunsigned(F.xxhash64("h", "d", "u", F.lit(salt)), 11) / float(1 << 53)
    # A row above total / want is met several times over: it stands for as many quantiles.
    share = F.col("size") * (want / max(1, total))
    hits = F.floor(share) + F.when(draw < share - F.floor(share), 1).otherwise(0)
    drawn = rows.where(hits > 0).select("h", "d", "u", hits.alias("n"))
    return sorted(tuple(r)[:3] for r in drawn.collect() for _ in range(min(int(r[3]), want)))


def _quantiles(sample: list, parts: int) -> list:
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


LOWEST = -(1 << 63)


def _edge(h: int) -> Key:
    """Where the group of texts of one hash begins."""
    return h, LOWEST, LOWEST


def _heads(rows: DataFrame, cuts: list) -> list[tuple[int, int]]:
    """The exact (bytes, rows) of each range."""
    sums = {r[0]: (r[1], r[2]) for r in _ranged(rows, cuts).groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    return [sums.get(k, (0, 0)) for k in range(len(cuts) + 1)]


def _subdivided(rows: DataFrame, cuts: list, heads: list, parts: dict[int, int], per_range: int, salt: int) -> list:
    """cuts, and new ones that split each range k of parts into about parts[k] pieces of equal bytes."""
    inside = _ranged(rows, cuts).where(F.col("range").isin(list(parts)))
    found = _sample(inside, sum(heads[k][0] for k in parts), sum(parts.values()) * per_range, salt)
    by: dict[int, list] = {}
    for s in found:
        by.setdefault(bisect.bisect_right(cuts, s), []).append(s)
    extra = {c for k, inner in by.items() if k in parts for c in _quantiles(inner, parts[k])}
    return sorted(set(cuts) | extra | {_edge(c[0]) for c in extra})


def splitters(rows: DataFrame, total: int, ranges: int, shards: int, per_range: int = 16, rounds: int = 3) -> tuple[list, list]:
    """Splitters (h, d, u) and the exact (bytes, rows) of each range between them. rows: h, d, u, size.

    A splitter is the edge of a group of equal texts unless several samples share an h."""
    goal = total / ranges
    drawn = _quantiles(_sample(rows, total, ranges * per_range, 0), ranges)
    seen: dict = {}
    for h, *_ in drawn:
        seen[h] = seen.get(h, 0) + 1
    cuts = sorted({_edge(h) for h in seen} | {c for c in drawn if seen[c[0]] > 1})
    heads = _heads(rows, cuts)
    for again in range(rounds):
        full = {k: math.ceil(b / goal) for k, (b, n) in enumerate(heads) if b > 2 * goal and n > 1}
        if not full:
            break
        cuts = _subdivided(rows, cuts, heads, full, per_range, again + 1)
        heads = _heads(rows, cuts)
    # The ranges in which the shards' boundaries fall are cut finer.
    ends = np.cumsum([b for b, _ in heads])
    fine = {int(np.searchsorted(ends, total * k / shards)): 64 for k in range(1, shards)} if total else {}
    fine = {k: n for k, n in fine.items() if k < len(heads) and heads[k][1] > 1}
    if fine:
        cuts = _subdivided(rows, cuts, heads, fine, per_range, rounds + 1)
        heads = _heads(rows, cuts)
    return cuts, heads


def shard_of_ranges(cuts: list, heads: list, shards: int, slack: float) -> list[int]:
    """The shard of each range: consecutive ranges, cut where the running size is nearest to k / shards;
    at the edge of a group of equal texts if one is within slack of a shard."""
    total, run, ends = sum(b for b, _ in heads), 0, []
    for b, _ in heads:
        run += b
        ends.append(run)
    edges = [k for k in range(len(cuts)) if cuts[k][1] == LOWEST]
    chosen, last = [], -1
    for k in range(1, shards):
        want = total * k / shards
        at = min(range(len(cuts)), key=lambda i: abs(ends[i] - want), default=None)
        if at is None:
            break
        edge = min(edges, key=lambda i: abs(ends[i] - want), default=at)
        if abs(ends[edge] - want) - abs(ends[at] - want) <= slack * total / shards:
            at = edge
        last = max(last, at)
        chosen.append(last)
    out, shard = [], 0
    for k in range(len(heads)):
        while shard < len(chosen) and k > chosen[shard]:
            shard += 1
        out.append(shard)
    return out


def _keyed(docs: DataFrame, *more, numbered: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, and the order's h (hash of text), d (doc_id, the null one first) and u (a number of
    the row's own, or 0)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("d"),
        (F.monotonically_increasing_id() if numbered else F.lit(0).cast("long")).alias("u"),
        *more,
    )


def _cut(rows: DataFrame, shards: int, rows_per_range: int, max_ranges: int, slack: float) -> tuple[list, list, list[int], bool]:
    """Splitters, (bytes, rows) and shard of each range, and whether every boundary is near its place: within 2 * slack
    of a shard and the largest row."""
    thin = rows.select("h", "d", "u", "size")
    n, total, largest = thin.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ranges = int(min(max_ranges, max(64 * shards, n // rows_per_range)))
    cuts, heads = splitters(thin, total, ranges, shards)
    where = shard_of_ranges(cuts, heads, shards, slack)
    sizes = np.bincount(where, [b for b, _ in heads], shards)
    off = np.abs(np.cumsum(sizes) - total * np.arange(1, shards + 1) / shards).max()
    return cuts, heads, where, bool(off <= 2 * slack * total / shards + largest)


def _placed(docs: DataFrame, shards: int, *more, rows_per_range: int = 1 << 16, max_ranges: int = 1 << 16, slack: float = 0.01) -> DataFrame:
    """Keyed rows of docs, with shard and slot; more columns are carried along in the one shuffle by range."""
    spark = docs.sparkSession
    ship(spark)
    stored = materialize(_keyed(docs), "shard-sizes")
    cuts, heads, where, near = _cut(stored, shards, rows_per_range, max_ranges, slack)
    if not near:
        stored = materialize(_keyed(docs, *more, numbered=True), "shard-rows")
        cuts, heads, where, _ = _cut(stored, shards, rows_per_range, max_ranges, slack)
    elif more:
        stored = _keyed(docs, *more)
    offsets, used = [], {}
    for (_, rows), s in zip(heads, where, strict=True):
        offsets.append(used.get(s, 0))
        used[s] = offsets[-1] + rows
    table = spark.createDataFrame(list(zip(range(len(where)), where, offsets, strict=True)), "range int, shard int, first long")
    placed = _ranged(stored, cuts)
    order = Window.partitionBy("range").orderBy("h", "d", "u")
    placed = placed.withColumn("within", F.row_number().over(order) - 1).join(F.broadcast(table), "range")  # at most max_ranges rows
    return placed.withColumn("slot", F.col("first") + F.col("within"))


def shard(docs: DataFrame, shards: int = 16, **params) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; law is `bytes`.
    Further columns of docs are ignored."""
    return _placed(docs, shards, **params).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(docs: DataFrame, shards: int = 16, **params) -> DataFrame:
    """The rows of docs with shard and slot; other columns stay as they are, whatever their names, but a
    column named shard or slot gives way. Whole rows move once, to their range, and are written before only if they
    must be numbered."""
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = _placed(docs, shards, F.struct(*[F.col(c) for c in keep]).alias("row"), **params)
    return placed.select("row.*", "shard", "slot")
