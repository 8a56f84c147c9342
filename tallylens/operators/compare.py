"""Comparison of a source and a target table: rows, columns and schema, in the form that ingest reads.

Rows meet as in meeting.py. One job reads both tables, writes the rows that differ, with a flag for each column,
and observes the sizes on its way; counts and details then read what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..schemas import NULL_TEXT, SAMPLE_CAP
from ..scratch import materialize
from . import checksums, meeting
from .meeting import Pair, any_of, laid_out, meet, text  # noqa: F401


def _flags(sides: meeting.Sides) -> dict[str, Column]:
    """For each common column, whether it differs in a row of both sides."""
    here = F.col("sn").isNotNull() & F.col("tn").isNotNull()
    return {c: here & sides.differs(c) for c in sides.common}


class Difference:
    """The rows in which two tables differ: `rows`, written in the shared folder, with d0.. (whether a common column
    differs), and `sizes`: rows of either side and the greatest first key of each."""

    def __init__(self, sides: meeting.Sides, totals: tuple[int, int] | None = None):
        """totals: the tables' rows, where the sides are only those of ranges that differ."""
        self.sides = sides
        met = meet(self.sides)
        # Seen on the way to the result, so that a task that runs again counts once.
        seen = Observation()
        greatest = lambda n: F.max(F.when(F.col(n).isNotNull() & ~F.col("z0"), F.col("j0")))
        sums = {"source_rows": F.sum("sn"), "target_rows": F.sum("tn"), "several": F.count_if(~F.col("alone")), "source_max": greatest("sn"), "target_max": greatest("tn")}
        self.rows = materialize(self._differing(met.observe(seen, *[v.alias(k) for k, v in sums.items()])), "differing")
        self.sizes = {k: v if k.endswith("max") else int(v or 0) for k, v in seen.get.items()}
        if totals is not None:
            self.sizes |= {"source_rows": totals[0], "target_rows": totals[1]}
        if self.sizes.pop("several"):
            self.rows = self.rows.unionByName(materialize(self._differing(meeting.copies(self.sides, met)), "differing-copies"))

    @classmethod
    def of(cls, source: DataFrame, target: DataFrame, pair: Pair, narrowed: bool = False) -> Difference:
        """narrowed: by digests first, so that only ranges that differ are joined; worth two scans where most is equal."""
        sides = laid_out(source, target, pair)
        if not narrowed:
            return cls(sides)
        tree = checksums.tree(sides)
        return cls(tree.open, (tree.source_rows, tree.target_rows))

    def _differing(self, rows: DataFrame) -> DataFrame:
        flags = [f.alias(f"d{k}") for k, f in enumerate(_flags(self.sides).values())]
        rows = rows.where("alone").select("*", *flags)
        return rows.where(any_of([F.col("sn").isNull(), F.col("tn").isNull(), *[F.col(f"d{k}") for k in range(len(flags))]]))

    def flag(self, column: str) -> Column:
        return F.col(f"d{self.sides.common.index(column)}")

    def counts(self) -> DataFrame:
        """One row: rows of either side, rows missing, rows that differ, and n_ and the name for each common column."""
        flags = {c: self.flag(c) for c in self.sides.common}
        return self.rows.agg(
            *[F.lit(self.sizes[k]).cast("long").alias(k) for k in ("source_rows", "target_rows")],
            F.count_if(F.col("sn").isNull()).alias("missing_in_source"),
            F.count_if(F.col("tn").isNull()).alias("missing_in_target"),
            F.count_if(any_of(list(flags.values()))).alias("absolute_mismatch"),
            *[F.count_if(f).alias(f"n_{c}") for c, f in flags.items()],
        )


def schema_rows(source: DataFrame, target: DataFrame, pair: Pair) -> list[dict[str, str]]:
    """One map for each column of either side; is_valid is false where name or type differs."""
    types_s = {pair.column_map.get(n, n): t for n, t in source.dtypes}
    types_t = dict(target.dtypes)
    names = list(dict.fromkeys([*types_s, *types_t]))
    return [
        {
            "source_column": n if n in types_s else NULL_TEXT,
            "source_datatype": types_s.get(n, NULL_TEXT),
            "databricks_column": n if n in types_t else NULL_TEXT,
            "databricks_datatype": types_t.get(n, NULL_TEXT),
            "is_valid": str(types_s.get(n) == types_t.get(n)).lower(),
        }
        for n in names
    ]


def detail_rows(found: Difference, cap: int = SAMPLE_CAP) -> DataFrame:
    """recon_type, key, copy, row (a map): of each kind and column the first `cap` rows by key.

    The least keys are picked from keys and flags alone, in each task before the shuffle, and then fetch their
    values: at most `cap` rows for each kind and column."""
    sides, on = found.sides, found.sides.on
    names = F.array_compact(F.array(*[F.when(found.flag(c), F.lit(k)) for k, c in enumerate(sides.common)])) if sides.common else F.array().cast("array<int>")
    kinds = F.when(F.col("tn").isNull(), F.array(F.lit(-1))).when(F.col("sn").isNull(), F.array(F.lit(-2))).otherwise(names)
    order = Window.partitionBy("what").orderBy(*on, "copy")
    picked = found.rows.select(*on, "copy", F.explode(kinds).alias("what"))
    picked = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select(*on, "copy").distinct()
    rows = found.rows.join(F.broadcast(picked), [*on, "copy"], "left_semi")  # bounded by cap, kinds and columns

    def shown(x: Column, t) -> Column:
        return F.coalesce(text(x, t), F.lit(NULL_TEXT))

    parts = [x for c in sides.keys for x in (F.lit(c), shown(sides.s(c), sides.source_types[c]))]
    for c in sides.common:
        s, t = (shown(getattr(sides, side)(c), kind) for side, kind in zip("st", sides.types(c), strict=True))
        parts += [F.lit(f"{c}_base"), s, F.lit(f"{c}_compare"), t, F.lit(f"{c}_match"), (~found.flag(c)).cast("string")]
    whole = {side: F.create_map(*[x for c, t in kinds_.items() for x in (F.lit(c), shown(getattr(sides, side)(c), t))]) for side, kinds_ in (("s", sides.source_types), ("t", sides.target_types))}
    kind = F.when(F.col("tn").isNull(), "missing_in_target").when(F.col("sn").isNull(), "missing_in_source").otherwise("mismatch")
    row = F.when(F.col("tn").isNull(), whole["s"]).when(F.col("sn").isNull(), whole["t"]).otherwise(F.create_map(*parts) if parts else F.expr("map()").cast("map<string,string>"))
    # A key's place among nulls and values: null first.
    key = F.struct(*[x for k in range(len(sides.keys)) for x in ((~F.col(f"z{k}")).alias(f"z{k}"), F.col(f"j{k}"))], F.col("copy"))
    return rows.select(kind.alias("recon_type"), key.alias("key"), row.alias("row"))


def compare(
    source: DataFrame, target: DataFrame, pair: Pair, *, recon_id: str, table_id: int, source_name: str, target_name: str, narrowed: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(main, metrics, details) of one pair of tables. Columns may have any name and type. narrowed: see Difference.of."""
    spark = source.sparkSession
    found = Difference.of(source, target, pair, narrowed)
    common = found.sides.common
    invalid = [r for r in schema_rows(source, target, pair) if r["is_valid"] == "false"]
    n = [F.col(meeting.quoted(f"n_{c}")) for c in common]
    listed = F.array_join(F.array_compact(F.array(*[F.when(x > 0, F.lit(c)) for c, x in zip(common, n, strict=True)])), ",") if common else F.lit("")
    metrics = found.counts().select(
        F.lit(table_id).cast("long").alias("recon_table_id"),
        F.struct(
            F.col("source_rows").alias("source_record_count"),
            F.col("target_rows").alias("target_record_count"),
            F.struct("missing_in_source", "missing_in_target").alias("row_comparison"),
            F.struct("absolute_mismatch", listed.alias("mismatch_columns")).alias("column_comparison"),
            F.lit(not invalid).alias("schema_comparison"),
        ).alias("recon_metrics"),
    )

    def named(name: str) -> Column:
        parts = ([None, None] + name.split("."))[-3:]
        return F.struct(*[F.lit(p).cast("string").alias(n) for p, n in zip(parts, ("catalog", "schema", "table_name"), strict=True)])

    main = spark.range(1).select(F.lit(table_id).cast("long").alias("recon_table_id"), F.lit(recon_id).alias("recon_id"), named(source_name).alias("source_table"), named(target_name).alias("target_table"))
    # At most SAMPLE_CAP rows for each column and kind.
    grouped = detail_rows(found).groupBy("recon_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", F.map_entries("row").alias("row")))), lambda x: F.map_from_entries(x["row"])).alias("data"))
    details = grouped.select(F.lit(table_id).cast("long").alias("recon_table_id"), "recon_type", "data")
    if invalid:
        bad = spark.createDataFrame([(table_id, "schema", invalid)], "recon_table_id long, recon_type string, data array<map<string,string>>")
        details = details.unionByName(bad)
    return main, metrics, details
