"""How the rows of a source and a target table meet.

Both sides are first laid out alike: keys as j0.. (never null) and z0.. (whether the key is null), and every
column under its place, s0.. and t0.., so that no column's name or type stands in the way. One full outer join
on the keys then meets a row of each side. Whether keys are unique needn't be known beforehand: each side is
grouped by key before the join, over the same partitioning, and carries how many rows a key has. A key with
several rows on a side is set apart; its rows meet as equal rows first, and the rest by number.

Those copies never come together in one task: equal rows are counted by key and hash; what one side has more of
is numbered by prefix sums, first over parts of a key's hashes, then within each part; and rows of either side
meet by key and number. Rows are told apart by two 64-bit hashes of their common columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize

#: Parts of a key's hashes that are numbered apart, and copies of one row that are written out at a time.
PARTS, RUN = 1024, 100_000


@dataclass
class Pair:
    """What to compare: keys, renamed columns (source name to target name) and filters on either side."""

    keys: list[str]
    column_map: dict[str, str] = field(default_factory=dict)
    source_filter: str = ""
    target_filter: str = ""
    #: Whether no key has two rows on a side; None: seen while rows meet.
    unique_keys: bool | None = None


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _holds(t: T.DataType, *kinds: type) -> bool:
    if isinstance(t, T.StructType):
        return any(_holds(f.dataType, *kinds) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _holds(t.elementType, *kinds)
    if isinstance(t, T.MapType):
        return T.MapType in kinds or _holds(t.keyType, *kinds) or _holds(t.valueType, *kinds)
    return isinstance(t, kinds)


def comparable(x: Column, t: T.DataType) -> Column:
    """x in a form that can be compared and hashed: maps as entries in order, variants as text in order of names."""
    if not _holds(t, T.MapType, T.VariantType):
        return x
    if isinstance(t, T.VariantType):
        return F.to_json(x)
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda e: comparable(e, t.elementType))
    if isinstance(t, T.MapType):
        return F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(comparable(e["key"], t.keyType).alias("key"), comparable(e["value"], t.valueType).alias("value"))))
    return F.when(x.isNotNull(), F.struct(*[comparable(x[f.name], f.dataType).alias(f"f{k}") for k, f in enumerate(t.fields)]))


def text(x: Column, t: T.DataType) -> Column:
    if isinstance(t, T.VariantType) or (isinstance(t, (T.StructType, T.ArrayType, T.MapType)) and _holds(t, T.VariantType)):
        return F.to_json(x)
    return x.cast("string")


def differs(s: Column, t: Column, types: tuple[T.DataType, T.DataType], as_numbers: bool = False) -> Column:
    """Null-safe inequality: of values where the types agree (or both are numbers, if so asked), else of their texts."""
    if types[0] == types[1] or (as_numbers and all(isinstance(x, T.NumericType) for x in types)):
        return ~comparable(s, types[0]).eqNullSafe(comparable(t, types[1]))
    return ~text(s, types[0]).eqNullSafe(text(t, types[1]))


#: What stands for a null key, by type; the flag beside it tells it from a key of that value.
_NO_KEY = {T.StringType: "", T.BooleanType: False, T.DateType: "1970-01-01", T.TimestampType: "1970-01-01 00:00:00", T.TimestampNTZType: "1970-01-01 00:00:00"}


def _key(x: Column, own: T.DataType, shared: T.DataType) -> Column:
    if isinstance(shared, (T.StructType, T.ArrayType, T.MapType, T.VariantType, T.BinaryType)):
        return F.coalesce(F.to_json(F.struct(comparable(x, own).alias("k"))), F.lit(""))
    none = 0 if isinstance(shared, T.NumericType) else _NO_KEY.get(type(shared), "")
    return F.coalesce(x.cast(shared), F.lit(none).cast(shared))


@dataclass(frozen=True)
class Sides:
    """Both tables in the common layout, with the names and types of their columns (the source's as renamed)."""

    source: DataFrame
    target: DataFrame
    keys: list[str]
    source_types: dict[str, T.DataType]
    target_types: dict[str, T.DataType]
    unique: bool | None = None
    #: Whether rows of several pairs of tables stand together, told apart by the column `tag`.
    tagged: bool = False

    @property
    def on(self) -> list[str]:
        return ["tag"] * self.tagged + [f"{x}{k}" for k in range(max(1, len(self.keys))) for x in "jz"]

    @property
    def common(self) -> list[str]:
        return [c for c in self.source_types if c in self.target_types and c not in self.keys]

    def s(self, name: str) -> Column:
        return F.col(f"s{list(self.source_types).index(name)}")

    def t(self, name: str) -> Column:
        return F.col(f"t{list(self.target_types).index(name)}")

    def types(self, name: str) -> tuple[T.DataType, T.DataType]:
        return self.source_types[name], self.target_types[name]

    def differs(self, name: str, as_numbers: bool = False) -> Column:
        return differs(self.s(name), self.t(name), self.types(name), as_numbers)


def laid_out(source: DataFrame, target: DataFrame, pair: Pair, columns: list[str] | None = None) -> Sides:
    """Both sides as the pair compares them; columns: only these, besides the keys."""
    if pair.source_filter:
        source = source.where(pair.source_filter)
    if pair.target_filter:
        target = target.where(pair.target_filter)
    fields = [{pair.column_map.get(f.name, f.name): f for f in source.schema.fields}, {f.name: f for f in target.schema.fields}]
    frames, keys = [], list(pair.keys)
    pick = [{n: f for n, f in x.items() if columns is None or n in columns or n in keys} for x in fields]
    empty = [df.select(*[F.col(quoted(x[k].name)).alias(f"k{i}") for i, k in enumerate(keys)]).limit(0) for df, x in zip((source, target), fields, strict=True)]
    shared = [f.dataType for f in empty[0].union(empty[1]).schema.fields] if keys else []
    for df, x, p, side in zip((source, target), fields, pick, "st", strict=True):
        # Without keys, all rows are copies of one key.
        on = [] if keys else [F.lit(0).alias("j0"), F.lit(True).alias("z0")]
        for i, k in enumerate(keys):
            value = F.col(quoted(x[k].name))
            on += [_key(value, x[k].dataType, shared[i]).alias(f"j{i}"), value.isNull().alias(f"z{i}")]
        frames.append(df.select(*on, *[F.col(quoted(f.name)).alias(f"{side}{i}") for i, f in enumerate(p.values())]))
    return Sides(*frames, keys, *[{n: f.dataType for n, f in p.items()} for p in pick], unique=pair.unique_keys if keys else False)


def together(pairs: dict[int, tuple[Sides, list[str]]]) -> Sides:
    """Pairs of tables with equal types of keys and of the named columns, as one pair: each by its tag, with the
    columns in the given order as c0, c1, ..."""
    frames, types = [], []
    for side in "st":
        rows = []
        for tag, (sides, columns) in pairs.items():
            df = sides.source if side == "s" else sides.target
            own = [getattr(sides, side)(c).alias(f"{side}{k}") for k, c in enumerate(columns)]
            rows.append(df.select(F.lit(tag).cast("long").alias("tag"), *sides.on, *own))
        frames.append(reduce(lambda a, b: a.unionByName(b), rows))
        first, names = next(iter(pairs.values()))
        known = first.source_types if side == "s" else first.target_types
        types.append({f"c{k}": known[c] for k, c in enumerate(names)})
    return Sides(*frames, [f"k{i}" for i in range(len(first.keys))], *types, unique=all(x.unique for x, _ in pairs.values()), tagged=True)


def any_of(flags: list[Column]) -> Column:
    return reduce(or_, flags, F.lit(False))


#: Rows of meet(): the keys, sn and tn (rows of the key on either side, null if none), alone (whether the key has
#: at most one row on each side), copy (0, or a number among a key's copies), w (rows it stands for) and columns.
def meet(sides: Sides, how: str = "full_outer") -> DataFrame:
    """A row for each key, with a row of either side. Only those that are alone are pairs of rows."""
    each = []
    for df, side in ((sides.source, "s"), (sides.target, "t")):
        values = [c for c in df.columns if c not in sides.on]
        if sides.unique:
            each.append(df.withColumn(f"{side}n", F.lit(1).cast("long")))
        else:
            each.append(df.groupBy(*sides.on).agg(F.count(F.lit(1)).alias(f"{side}n"), *[F.first(c).alias(c) for c in values]))
    both = each[0].join(each[1], sides.on, how)
    alone = F.lit(True) if sides.unique else (F.coalesce("sn", F.lit(0)) <= 1) & (F.coalesce("tn", F.lit(0)) <= 1)
    return both.withColumns({"alone": alone, "copy": F.lit(0).cast("long"), "w": F.lit(1).cast("long")})


def _parts(sides: Sides, side: str) -> list[Column]:
    """The common columns of a row in a form that is alike on both sides."""
    out = []
    for c in sides.common:
        own, other = sides.types(c)[:: 1 if side == "s" else -1]
        x = getattr(sides, side)(c)
        out.append(comparable(x, own) if own == other else text(x, own))
    return out


def row_hashes(sides: Sides, side: str, with_keys: bool = True) -> list[Column]:
    """Two hashes of a row's common columns, and of its keys; a null counts by its place."""
    parts = _parts(sides, side)
    nulls = F.concat(*[F.when(x.isNull(), "1").otherwise("0") for x in parts]) if parts else F.lit("")
    return [F.xxhash64(F.lit(k), *(sides.on if with_keys else []), nulls, *parts) for k in (0, 1)]


def _numbered(rows: DataFrame, on: list[str]) -> DataFrame:
    """rows(on, h0, h1, d), d copies each, written out with copy = 1, 2, ... within their key."""
    rows = rows.withColumn("part", F.pmod(F.shiftrightunsigned("h0", 54), F.lit(PARTS)).cast("int"))
    # A key's parts are at most PARTS rows, and its rows spread over them.
    sums = rows.groupBy(*on, "part").agg(F.sum("d").alias("d"))
    before = Window.partitionBy(*on).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*on, "part", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*on, "part").orderBy("h0", "h1").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("d").over(within), F.lit(0)))
    # A join that broadcasts the rows would leave all of a key where its sums are, in one task.
    placed = rows.join(sums.hint("merge"), [*on, "part"]).withColumn("first", F.col("base") + F.col("before")).drop("part", "base", "before")
    runs = placed.withColumn("run", F.explode(F.expr(f"sequence(0L, (d - 1) div {RUN})")))
    size = f"least({RUN}, d - run * {RUN})"
    return runs.withColumn("copy", F.explode(F.expr(f"sequence(first + run * {RUN} + 1, first + run * {RUN} + {size})"))).drop("first", "run", "d", "h0", "h1")


def copies(sides: Sides, met: DataFrame) -> DataFrame:
    """The rows of keys that met() sets apart, in its form; equal rows are one row of weight w."""
    on = sides.on
    several = materialize(met.where("NOT alone").select(*on), "several")
    by = [*on, "h0", "h1"]
    each = []
    for df, side in ((sides.source, "s"), (sides.target, "t")):
        values = [c for c in df.columns if c not in on]
        hashes = [h.alias(f"h{k}") for k, h in enumerate(row_hashes(sides, side, with_keys=False))]
        rows = df.join(several, on, "left_semi").select(*on, *values, *hashes)
        each.append(rows.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{side}d"), *[F.first(c).alias(c) for c in values]))
    both = materialize(each[0].join(each[1], by, "full_outer").withColumn("least", F.least(F.coalesce("sd", F.lit(0)), F.coalesce("td", F.lit(0)))), "copies")
    here = {"alone": F.lit(True), "copy": F.lit(-1).cast("long"), "w": F.col("least"), "sn": F.lit(1).cast("long"), "tn": F.lit(1).cast("long")}
    equal = both.where("least > 0").withColumns(here).drop("h0", "h1", "sd", "td", "least")
    rest = []
    for df, side in ((sides.source, "s"), (sides.target, "t")):
        values = [c for c in df.columns if c not in on]
        left = both.where(f"{side}d > least").select(*by, (F.col(f"{side}d") - F.col("least")).alias("d"), *values)
        rest.append(_numbered(left, on).withColumn(f"{side}n", F.lit(1).cast("long")))
    unequal = rest[0].join(rest[1], [*on, "copy"], "full_outer").withColumns({"alone": F.lit(True), "w": F.lit(1).cast("long")})
    return equal.unionByName(unequal)
