"""Mixing sources to target weights by a low-discrepancy schedule. Built-in SQL functions only.

Each source's documents are put in a hash-shuffled order and laid end to end as one sequence of words,
which is cut into blocks of nearly equal word counts. A golden-ratio sequence u_i = frac(i * phi) is
mapped through the cumulative weights of the sources; the slots that fall to a source are ranked, and
rank r takes block r of the source's (repeated) sequence: the schedule decides at which slot a document
comes, and any prefix of the slots holds every source near its share. The last slot of a source is trimmed,
so that each source gives its target exactly, to the rounding of one word.

Sources are few: a table of one row for each is worked on in one task. No product of two sizes is taken, so
a source may have as many words as a bigint counts.

Defined cases: null text has size 0; documents of size 0 are never taken; the null source is a source
of its own and comes last; repeated rows count as rows of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: Rows that a window over one bucket of a source's shuffled order should hold.
BUCKET_ROWS = 2048
#: Consecutive slots ranked together.
CHUNK = 1 << 16


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """rows(source, size) -> idx, source, source_size, weight, target.

    Targets share all sizes by weight; none may be above cap times its source's size. Water-filling: in
    ascending order of limit/weight, the first source that its fair share fits sets the level.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("idx", F.row_number().over(order) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("idx") % len(weights) + 1))
    by = by.withColumn("limit", F.col("source_size") * cap).withColumn("ratio", F.col("limit") / F.col("weight"))
    rising = Window.orderBy("ratio", "idx")
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    by = by.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    by = by.withColumn("level", F.col("left") / F.sum("weight").over(rest))
    by = by.withColumn("place", F.row_number().over(rising))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"]
    by = by.withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return by.select("idx", "source", "source_size", "weight", "target")


def _sequence(rows: DataFrame, sources: DataFrame, seed: int, n_rows: int) -> DataFrame:
    """Adds idx, source_size, target, nb and each row's start in its source's shuffled word sequence.

    The order is by hash; its leading bits make buckets, so that no window holds a whole source."""
    bits = max(1, min(30, math.ceil(math.log2(max(2, n_rows / BUCKET_ROWS)))))
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed)))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    inner = Window.partitionBy("idx", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(inner) - F.col("size"))
    totals = rows.groupBy("idx", "bucket").agg(F.sum("size").alias("bucket_size"))
    over = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("idx", "bucket", F.coalesce(F.sum("bucket_size").over(over), F.lit(0)).alias("bucket_start"))
    rows = rows.join(totals, ["idx", "bucket"])
    return rows.withColumn("start", F.col("bucket_start") + F.col("within")).drop("h", "bucket", "within", "bucket_start")


def golden(i):
    """frac(i * phi) for a bigint column, in two parts so that the product stays exact enough."""
    phi = (math.sqrt(5) - 1) / 2
    big = (1 << 24) * phi % 1
    x = F.shiftright(i, 24) * F.lit(big) + i.bitwiseAND(F.lit((1 << 24) - 1)) * F.lit(phi)
    return x - F.floor(x)


def _slots(sources: DataFrame, n_points: int, n_sources: int, sequence=golden) -> DataFrame:
    """slot, idx, rank: points of the sequence through the cumulative weights, ranked per source.

    There are as many points as slots. The golden-ratio points in an interval differ from their share by at
    most 3 + (1 / ln phi + 1 / ln 2) ln n: points above a source's need are passed over, and what it lacks
    comes last."""
    spark = sources.sparkSession
    cells = 4096
    up_to = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    some = sources.where("need > 0")
    parts = some.withColumn("hi", F.sum("need").over(up_to)).withColumn("lo", F.col("hi") - F.col("need"))
    parts = parts.select("idx", "need", "nb", "source_size", "goal", (F.col("lo") / n_points).alias("lo"), (F.col("hi") / n_points).alias("hi"))
    # A range join as an equi-join on grid cells: a source meets only the points of the cells it touches.
    parts = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    points = spark.range(n_points).select(F.col("id").alias("slot"), sequence(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    met = points.join(parts, "cell").where("u >= lo and u < hi")
    met = met.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    inner = Window.partitionBy("idx", "chunk").orderBy("slot")
    met = met.withColumn("r", F.row_number().over(inner) - 1)
    counts = met.groupBy("idx", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("idx", "chunk", F.coalesce(earlier, F.lit(0)).alias("earlier"), "n")
    columns = ["slot", "idx", "rank", "need", "nb", "source_size", "goal"]
    last = some.join(counts.groupBy("idx").agg(F.sum("n").alias("n")), "idx", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need")
    last = last.withColumn("rank", F.explode(F.expr("sequence(n, need - 1)"))).withColumn("slot", F.expr(f"{n_points} + (rank - n) * {n_sources} + idx"))
    met = met.join(counts.drop("n"), ["idx", "chunk"]).withColumn("rank", F.col("r") + F.col("earlier")).where("rank < need")
    met = met.select(columns).union(last.select(columns))
    met = met.withColumn("epoch", F.expr("rank div nb")).withColumn("block", F.expr("rank % nb"))
    met = met.withColumn("block_lo", F.expr(_begin("block"))).withColumn("block_hi", F.expr(_begin("(block + 1)")))
    met = met.withColumn("take", F.expr("least(block_hi - block_lo, goal - epoch * source_size - block_lo)"))
    return met.where("take > 0").select("slot", "idx", "rank", "epoch", "block", "block_lo", "take")


def _begin(block: str) -> str:
    """First word of a block: the first source_size % nb blocks have a word more than the others."""
    return f"({block} * (source_size div nb) + least({block}, source_size % nb))"


def _block_of(word: str) -> str:
    """The block of a word; there are at most as many blocks as words."""
    wide = "(source_size div nb + 1)"
    return f"CASE WHEN {word} < source_size % nb * {wide} THEN {word} div {wide} ELSE source_size % nb + ({word} - source_size % nb * {wide}) div (source_size div nb) END"


def plan(rows: DataFrame, *, slots: int = 1 << 16, block_limit: int = 1 << 20, weights=(1, 2, 3), cap: int = 3, seed: int = 20, sequence=golden):
    """rows(doc_id, source, size) -> (rows with idx, source_size, target, start; mix).

    mix(slot, idx, epoch, block, doc_id, start, words): what each slot takes, in the order of slots.
    slots: about how many blocks the whole mix has; block_limit: the most words in a block; sequence: the
    points in [0, 1) of a column of slot numbers."""
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    words = max(1, min(block_limit, total // slots))
    sources = source_targets(rows, weights, cap)
    sources = sources.withColumn("nb", F.expr(f"greatest(1, source_size div {words})"))
    sources = sources.withColumn("goal", F.round("target").cast("long"))
    sources = sources.withColumn("rest", F.expr("if(source_size > 0, goal % source_size, 0)"))
    need = F.expr(f"if(source_size > 0, goal div source_size * nb + if(rest > 0, {_block_of('(rest - 1)')} + 1, 0), 0)")
    sources = materialize(sources.withColumn("need", need).drop("rest"), "mix-sources")
    n_points, n_sources = sources.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count(F.lit(1))).first()
    placed = materialize(_sequence(rows, sources.select("idx", "source", "source_size", "target", "nb"), seed, n_rows), "mix-rows")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence({_block_of('start')}, {_block_of('(start + size - 1)')})")))
    met = _slots(sources, n_points, n_sources, sequence).join(pieces.select("idx", "block", "doc_id", "start", "size"), ["idx", "block"])
    met = met.withColumn("words", F.expr("least(start + size, block_lo + take) - greatest(start, block_lo)")).where("words > 0")
    return placed, met.select("slot", "idx", "epoch", "block", "doc_id", "start", "size", "words")


def mix(docs: DataFrame, **params) -> DataFrame:
    """Per row of docs(doc_id, text, source): doc_id, source, size, source_size, target, taken, first_slot
    (the first slot of the mix that takes some of its words; null if none does). Further columns of docs are
    ignored."""
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    placed, taken = plan(rows, **params)
    # A row with words is known by its source and start; rows without words are taken by no slot.
    taken = taken.groupBy("idx", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).withColumn("some", F.lit(True))
    placed = placed.withColumn("some", F.col("size") > 0)
    return placed.join(taken, ["idx", "start", "some"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs in the order of the schedule's slots, each as often as the mix takes it: taken / size,
    rounded; the n-th time at the slot that begins its n-th repetition. All columns stay, whatever their names.

    Rows that are equal in every column stand for each other: one of them carries the slots of all."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    hashed = [F.to_json(F.struct(c)) if t.startswith(("map", "variant")) else F.col(c) for c, t in docs.dtypes]
    who = F.struct(F.xxhash64(*hashed).alias("h"), F.crc32(F.to_json(F.struct("doc_id"))).alias("c")).alias("doc_id")
    rows = materialize(docs.select(who, "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    _, taken = plan(rows, **params)
    # A row has at most cap + 1 repetitions.
    each = taken.groupBy("idx", "start", "doc_id", "size", "epoch").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
    each = each.groupBy("idx", "start", "doc_id", "size").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list("slot")).alias("slots"))
    each = each.select("doc_id", F.explode(F.slice("slots", 1, F.round(F.col("words") / F.col("size")).cast("int"))).alias("slot"))
    # Equal rows meet before they move, and the join finds them where they are.
    whole = docs.select(who, row.alias("row")).groupBy("doc_id").agg(F.first("row").alias("row"))
    return whole.join(each, "doc_id").orderBy("slot").select("row.*")
