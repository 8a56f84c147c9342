"""Two tables laid out by key once, for all that reads them.

Both sides are written as tables in the common layout (see meeting.py), bucketed and sorted by key into equally
many buckets, a file each. What groups or joins them by key then needs no exchange: comparison, confirmation,
validation and the evidence's queries.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schemas import MISSING_IN_SOURCE, MISSING_IN_TARGET
from ..scratch import fresh_dir
from . import meeting


@dataclasses.dataclass(frozen=True)
class Layout:
    """The names of the written tables, and the sides as read from them."""

    source_table: str
    target_table: str
    sides: meeting.Sides

    def rerun(self, kind: str, column: str | None = None) -> str:
        """SQL that shows a finding's rows once more, on the written tables and under the columns' own names."""
        sides, on = self.sides, f"USING ({', '.join(self.sides.on)})"

        def own(side: str, names) -> str:
            return ", ".join(f"{x}.{side}{k} AS {meeting.quoted(n)}" for x in side for k, n in enumerate(names))

        if kind == MISSING_IN_TARGET:
            return f"SELECT {own('s', sides.source_types)} FROM {self.source_table} s LEFT ANTI JOIN {self.target_table} t {on}"
        if kind == MISSING_IN_SOURCE:
            return f"SELECT {own('t', sides.target_types)} FROM {self.target_table} t LEFT ANTI JOIN {self.source_table} s {on}"
        names = list(sides.target_types)
        keys = ", ".join(f"t.t{names.index(k)} AS {meeting.quoted(k)}" for k in sides.keys)
        s, t = f"s.s{list(sides.source_types).index(column)}", f"t.t{names.index(column)}"
        return f"SELECT {keys}, {s} AS source_value, {t} AS target_value FROM {self.source_table} s JOIN {self.target_table} t {on} WHERE NOT {s} <=> {t}"

    def drop(self, spark: SparkSession) -> None:
        for name in (self.source_table, self.target_table):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def co_locate(source: DataFrame, target: DataFrame, pair: meeting.Pair, buckets: int | None = None, name: str | None = None) -> Layout:
    """Writes both sides of a pair. buckets: as many as the session shuffles into, unless given."""
    spark = source.sparkSession
    laid = meeting.laid_out(source, target, pair)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"laid_{uuid.uuid4().hex}"
    tables = []
    for df, side in ((laid.source, "s"), (laid.target, "t")):
        # Dealt by the buckets' own hash, so that each task writes one file.
        dealt = df.repartition(buckets, *laid.on)
        tables.append(f"{name}_{side}")
        dealt.write.format("parquet").bucketBy(buckets, *laid.on).sortBy(*laid.on).option("path", fresh_dir(spark, tables[-1])).mode("overwrite").saveAsTable(tables[-1])
    return Layout(*tables, dataclasses.replace(laid, source=spark.table(tables[0]), target=spark.table(tables[1])))
