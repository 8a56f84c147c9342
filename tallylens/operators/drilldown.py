"""Confirmation on the whole tables: one join for each pair of tables, whatever the number of findings.

All measures of all columns are aggregates over the same rows, which meet as in the comparison: null-safe, equal
copies of a key first, and nothing fans out. Every measure is made of sums, least and greatest values and sketches,
so that the rows of keys with copies, if there are any, are added to those of the others."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.probes import canonical_json, folded, wall_micros
from ..schemas import COLUMN, MISSING_IN_SOURCE, MISSING_IN_TARGET, SCHEMA
from . import compare, meeting
from .classify import evidence, top
from .passes import raised


def _seconds(x: Column) -> Column:
    return F.floor(wall_micros(x.try_cast("timestamp_ntz")) / 1_000_000)


#: How the parts of a measure are put together.
_ADD, _MOST, _LEAST, _SKETCH = F.sum, F.max, F.min, F.hll_union_agg


def _spread(what: str, value: Column) -> dict[str, tuple[Column, Callable]]:
    return {f"{what}_least": (F.min(value), _LEAST), f"{what}_most": (F.max(value), _MOST), f"{what}_sketch": (F.hll_sketch_agg(value), _SKETCH)}


def column_values(category: str, differ: Column, s: Column, t: Column) -> dict[str, Column]:
    """What a joined row says of one column's category; measures add these up, so that each is computed once."""
    when = lambda x: F.when(differ, x)
    out = {"n": differ, "null_involved": differ & (s.isNull() | t.isNull())}
    if category == "timezone":
        out |= {"offset": when(_seconds(t) - _seconds(s)).cast("long")}
    if category in ("type_precision", "transpilation"):
        a, b = s.try_cast("double"), t.try_cast("double")
        out |= {"gap": when(F.abs(a - b)), "eq_at_2dp": when(F.round(a, 2) == b)}
    if category == "semi_structured":
        out |= {"same_content": when(canonical_json(s.cast("string")) == canonical_json(t.cast("string")))}
    if category == "env_config":
        out |= {"shift": when(F.date_diff(t.try_cast("date"), s.try_cast("date"))).cast("long")}
    if category == "string_format":
        out |= {"cosmetic": when(folded(F.trim(s.cast("string"))) == folded(F.trim(t.cast("string"))))}
    return out


def column_measures(names: list[str], v: Callable[[str], Column]) -> dict[str, tuple[Column, Callable]]:
    """The aggregates of a column's values v(name), and what puts two of each together."""
    out: dict[str, tuple[Column, Callable]] = {}
    for n in names:
        if n in ("offset", "shift"):
            out |= _spread(n, v(n))
        elif n == "gap":
            out |= {"gap_sum": (F.sum(v(n)), _ADD), "gap_n": (F.count(v(n)), _ADD), "max_abs_diff": (F.max(v(n)), _MOST)}
        else:
            out[n] = (F.count_if(v(n)), _ADD)
    return out


def _final(category: str, m: Callable[[str], Column]) -> dict[str, Column]:
    """The measures of a column, from the added-up parts m(name)."""

    def shifts(what: str) -> Column:
        # One value if the least is the greatest, exactly; how many others there are, from the sketch.
        least, most = m(f"{what}_least"), m(f"{what}_most")
        return F.when(least.isNull(), 0).when(least == most, 1).otherwise(F.greatest(F.lit(2).cast("long"), F.hll_sketch_estimate(m(f"{what}_sketch"))))

    out = {"n": m("n"), "null_involved": m("null_involved")}
    if category == "timezone":
        out |= {"distinct_offsets": shifts("offset"), "offset_hours": m("offset_most") / 3600.0}
    if category in ("type_precision", "transpilation"):
        out |= {"avg_abs_diff": F.try_divide(m("gap_sum"), m("gap_n")), "max_abs_diff": m("max_abs_diff"), "eq_at_2dp": m("eq_at_2dp")}
    if category == "semi_structured":
        out |= {"same_content": m("same_content")}
    if category == "env_config":
        out |= {"distinct_shifts": shifts("shift"), "shift_days": m("shift_most")}
    if category == "string_format":
        out |= {"cosmetic": m("cosmetic")}
    if category == "upstream_drift":
        out |= {"src_total": m("src_total"), "src_nulls": m("src_nulls")}
    return out


def fold(sides: meeting.Sides, how: str, values: dict[str, Column], parts: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """One row of aggregates over the values of the rows of both sides (a row for each tag that has some): first
    over keys that are alone, and where there are others, over their copies too. The values must leave out rows
    that aren't alone."""
    met = meeting.meet(sides, how)
    spark, by = met.sparkSession, ["tag"] * sides.tagged
    columns = [v.alias(k) for k, (v, _) in parts.items()]
    seen = lambda rows: rows.select(*by, "alone", "sn", "copy", *[v.alias(k) for k, v in values.items()]).groupBy(*by)
    one = seen(met).agg(*columns, F.count_if(~F.col("alone")).alias("several"))
    rows = one.collect()  # a single row, or one for each pair
    done = spark.createDataFrame([tuple(r)[:-1] for r in rows], T.StructType(one.schema.fields[:-1]))
    if any(r["several"] for r in rows):
        both = done.unionByName(seen(meeting.copies(sides, met)).agg(*columns))
        done = both.groupBy(*by).agg(*[merge(k).alias(k) for k, (_, merge) in parts.items()])
    return done


def sides(source: DataFrame, target: DataFrame, pair: compare.Pair) -> tuple[DataFrame, DataFrame]:
    """Both tables as the pair compares them: filtered, and the source's columns under the target's names."""
    if pair.source_filter:
        source = source.where(pair.source_filter)
    if pair.target_filter:
        target = target.where(pair.target_filter)
    return source.withColumnsRenamed(pair.column_map), target


def confirm_columns(source: DataFrame, target: DataFrame, keys: list[str], categories: dict[str, str], unique_keys: bool | None = None) -> DataFrame:
    """column, category, measures (map), confirmed; one join and one scan for all columns."""
    laid = meeting.laid_out(source, target, meeting.Pair(keys=keys, unique_keys=unique_keys), list(categories))
    return confirm_laid_out(laid, categories)


#: Pairs of tables that are confirmed in one plan.
TOGETHER = 64


def confirm_pairs(pairs: dict[int, tuple[meeting.Sides, dict[str, str]]]) -> DataFrame:
    """tag, column, category, measures, confirmed of many pairs: by tag their sides and the categories of columns.

    Pairs whose keys, columns and categories are of the same types are confirmed in one plan, whatever the names."""
    alike: dict[tuple, dict] = {}
    for tag, (sides, categories) in pairs.items():
        columns = sorted(categories, key=lambda c: (categories[c], *(t.simpleString() for t in sides.types(c)), c))
        kinds = tuple(sides.source.schema[c].dataType.simpleString() for c in sides.on)
        shape = (kinds, bool(sides.unique), *[(categories[c], *(t.simpleString() for t in sides.types(c))) for c in columns])
        alike.setdefault(shape, {})[tag] = (sides, columns)
    out = []
    for shape, group in alike.items():
        tags = list(group)
        for a in range(0, len(tags), TOGETHER):
            some = {t: group[t] for t in tags[a : a + TOGETHER]}
            done = confirm_laid_out(meeting.together(some), {f"c{k}": x[0] for k, x in enumerate(shape[2:])})
            named = [(t, f"c{k}", c) for t, (_, columns) in some.items() for k, c in enumerate(columns)]
            names = done.sparkSession.createDataFrame(named, "tag long, column string, name string")
            out.append(done.join(F.broadcast(names), ["tag", "column"]).withColumn("column", F.col("name")).drop("name"))  # a row for each finding
    return reduce(lambda a, b: a.unionByName(b), out)


def confirm_laid_out(laid: meeting.Sides, categories: dict[str, str]) -> DataFrame:
    drift = [c for c, k in categories.items() if k == "upstream_drift"]
    alone = F.col("alone")
    both = alone & F.col("sn").isNotNull() & F.col("tn").isNotNull()
    values: dict[str, Column] = {}
    parts: dict[str, tuple[Column, Callable]] = {}
    for i, (c, category) in enumerate(categories.items()):
        own = column_values(category, both & laid.differs(c, as_numbers=True), laid.s(c), laid.t(c))
        values |= {f"v{i}_{k}": v for k, v in own.items()}
        parts |= {f"c{i}_{k}": v for k, v in column_measures(list(own), lambda k, i=i: F.col(f"v{i}_{k}")).items()}
        if category == "upstream_drift":
            values[f"v{i}_nulls"] = F.when(alone & F.col("sn").isNotNull() & laid.s(c).isNull(), F.col("w"))
            parts |= {f"c{i}_src_total": (F.sum(F.when(F.col("copy") == 0, F.coalesce("sn", F.lit(0)))), _ADD), f"c{i}_src_nulls": (F.coalesce(F.sum(f"v{i}_nulls"), F.lit(0)), _ADD)}
    one = fold(laid, "full_outer" if drift else "inner", values, parts)
    rows = []
    for i, (c, category) in enumerate(categories.items()):
        final = _final(category, lambda k, i=i: F.col(f"c{i}_{k}"))
        pairs = [x for k, v in final.items() for x in (F.lit(k), v.cast("double"))]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(category).alias("category"), F.create_map(*pairs).alias("measures")))
    out = one.select(*["tag"] * laid.tagged, F.explode(F.array(*rows)).alias("r")).select(*["tag"] * laid.tagged, "r.*")
    m = F.col("measures")
    return out.withColumn(
        "confirmed",
        F.when(F.col("category") == "timezone", m["distinct_offsets"] == 1)
        .when(F.col("category") == "string_format", (m["n"] > 0) & (m["cosmetic"] == m["n"]))
        .when(F.col("category") == "semi_structured", (m["n"] > 0) & (m["same_content"] == m["n"]))
        .when(F.col("category") == "env_config", (m["distinct_shifts"] == 1) & (m["shift_days"] != 0))
        .when(F.col("category") == "upstream_drift", F.lit(True))
        .when(F.col("category").isin("type_precision", "transpilation", "null_boolean"), m["n"] > 0)
        .otherwise(False),
    )


def confirm_missing(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest first key of either side and whether the target simply lags behind. Keys keep their type."""
    k = meeting.quoted(keys[0])
    return source.agg(F.max(k).alias("src_max")).crossJoin(target.agg(F.max(k).alias("tgt_max"))).withColumn("watermark", F.col("tgt_max") < F.col("src_max"))  # two single rows


def confirm_extra(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose whole key the source lacks, and surplus copies of keys that it has: one aggregate over
    both sides' keys, in which null keys are keys."""
    laid = meeting.laid_out(source, target, meeting.Pair(keys=keys), [])
    side = lambda df, s, t: df.select(*laid.on, F.lit(s).alias("_m"), F.lit(t).alias("_n"))
    both = side(laid.source, 1, 0).union(side(laid.target, 0, 1)).groupBy(*laid.on).agg(F.sum("_m").alias("m"), F.sum("_n").alias("n"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    one = both.agg(total(F.when(F.col("m") == 0, F.col("n"))).alias("extra"), total(F.when(F.col("m") > 0, F.greatest(F.col("n") - F.col("m"), F.lit(0)))).alias("duplicates"))
    return one.withColumn("confirmed", (F.col("extra") > 0) | (F.col("duplicates") > 0))


#: One confirmation.
DRILLED = "finding_id string, detail string, data map<string,string>, confirmed boolean, exact_n long, query string"


def _name(*parts: str) -> str:
    return ".".join(f"`{x.replace('`', '')}`" for p in parts for x in p.split("."))


def rerun(pair: compare.Pair, source: str, target: str, kind: str, column: str | None = None) -> str:
    """SQL that shows a finding's rows once more on the named tables."""
    names = {new: old for old, new in pair.column_map.items()}
    own = lambda c: _name(names.get(c, c))
    s, t = (f"(SELECT * FROM {_name(n)}{f' WHERE {c}' if c else ''})" for n, c in ((source, pair.source_filter), (target, pair.target_filter)))
    on = " AND ".join(f"s.{own(k)} <=> t.{_name(k)}" for k in pair.keys)
    if kind == MISSING_IN_TARGET:
        return f"SELECT s.* FROM {s} s LEFT ANTI JOIN {t} t ON {on}"
    if kind == MISSING_IN_SOURCE:
        return f"SELECT t.* FROM {t} t LEFT ANTI JOIN {s} s ON {on}"
    if kind == SCHEMA:
        return f"DESCRIBE {_name(target)}"
    return f"SELECT {', '.join(f't.{_name(k)}' for k in pair.keys)}, s.{own(column)} AS source_value, t.{_name(column)} AS target_value FROM {s} s JOIN {t} t ON {on} WHERE NOT s.{own(column)} <=> t.{_name(column)}"


def column_heads(s: DataFrame, t: DataFrame, keys: list[str], heads: list) -> dict[str, tuple[str, str]]:
    """(finding_id, category) of each column that can be confirmed."""
    both = set(s.columns) & set(t.columns) - set(keys)
    found = {r["column"]: (r["finding_id"], r["category"]) for r in heads if r["recon_type"] == COLUMN and r["column"] in both and r["category"] != "unknown"}
    return found if keys else {}


def said_of_columns(done: DataFrame) -> DataFrame:
    """DRILLED of confirmed columns with their finding_id and query."""
    text = F.concat_ws(", ", F.transform(F.map_entries("measures"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.6g", e["value"]))))
    return done.select("finding_id", F.concat(F.when(F.col("confirmed"), "Confirmed: ").otherwise("Not confirmed: "), text).alias("detail"), F.transform_values("measures", lambda k, v: v.cast("string")).alias("data"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.col("measures")["n"].cast("long").alias("exact_n"), "query")


def drill(source: DataFrame, target: DataFrame, pair: compare.Pair, heads: list, source_name: str, target_name: str, with_columns: bool = True) -> list[DataFrame]:
    """The confirmations, as in DRILLED, of the findings of one pair of tables.

    heads: finding_id, recon_type, column and category of the findings' top hypotheses. with_columns: False leaves out
    the columns' findings, where confirm_pairs takes them."""
    s, t = sides(source, target, pair)
    keys, out = pair.keys, []
    spark = source.sparkSession
    query = lambda kind, column=None: rerun(pair, source_name, target_name, kind, column)
    columns = column_heads(s, t, keys, heads)
    if columns and with_columns:
        ids = spark.createDataFrame([(c, i, query(COLUMN, c)) for c, (i, _) in columns.items()], "column string, finding_id string, query string")
        done = confirm_columns(s, t, keys, {c: k for c, (_, k) in columns.items()}, pair.unique_keys)
        out.append(said_of_columns(done.join(F.broadcast(ids), "column")))  # a row for each column
    for kind, check, flag in ((MISSING_IN_TARGET, confirm_missing, "watermark"), (MISSING_IN_SOURCE, confirm_extra, "confirmed")):
        for r in heads:
            if r["recon_type"] == kind and keys:
                one = check(s, t, keys)
                names = [c for c in one.columns if c != flag]
                data = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])
                detail = F.concat(F.when(F.col(flag), "Confirmed: ").otherwise("Not confirmed: "), F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in names]))
                out.append(one.select(F.lit(r["finding_id"]).alias("finding_id"), detail.alias("detail"), data.alias("data"), F.coalesce(F.col(flag), F.lit(False)).alias("confirmed"), F.lit(None).cast("long").alias("exact_n"), F.lit(query(kind)).alias("query")))
    for r in heads:
        if r["recon_type"] == SCHEMA:
            types = [dict(x.dtypes) for x in (s, t)]
            differ = {c: f"{types[0].get(c, 'none')} -> {types[1].get(c, 'none')}" for c in sorted({*types[0], *types[1]}) if types[0].get(c) != types[1].get(c)}
            said = ", ".join(f"{c}: {x}" for c, x in differ.items())
            out.append(spark.createDataFrame([(r["finding_id"], f"Confirmed: {said}" if differ else "Not confirmed: the types agree", differ, bool(differ), None, query(SCHEMA))], DRILLED))
    return out


def finalise(findings: DataFrame, hypotheses: DataFrame, drilled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with exact counts, and hypotheses with the confirmation first in their evidence.

    A confirmed top hypothesis gains confidence; one that waited for review is decided, unless its column is
    generated by the code. Time offsets that vary are put back to review."""
    exact = findings.join(drilled.select("finding_id", "exact_n"), "finding_id", "left")
    exact = exact.withColumn("mismatch_count", F.when(F.col("exact_n") > 0, F.col("exact_n")).otherwise(F.col("mismatch_count"))).drop("exact_n")
    heads = top(hypotheses).select("finding_id", "seq").join(drilled.select("finding_id", "detail", "data", "confirmed", "query"), "finding_id")
    out = hypotheses.join(heads, ["finding_id", "seq"], "left")
    hit = F.coalesce(F.col("confirmed"), F.lit(False))
    generated = F.col("code_generated") if "code_generated" in hypotheses.columns else F.lit(False)
    varies = F.coalesce((F.col("category") == "timezone") & (F.try_element_at("data", F.lit("distinct_offsets")).cast("double") > 1), F.lit(False))
    promoted = F.when(F.col("category") == "upstream_drift", "genuine_data").otherwise("migration_induced")
    new = {
        "confidence": F.when(hit, raised(F.col("confidence"), 0.15, 0.98)).otherwise(F.col("confidence")),
        "verdict": F.when(varies, "needs_review").when(hit & (F.col("verdict") == "needs_review") & ~generated, promoted).otherwise(F.col("verdict")),
        "evidence": F.when(F.col("detail").isNotNull(), F.concat(F.array(evidence("drilldown", F.col("detail"), F.col("query"), F.col("data"))), F.col("evidence"))).otherwise(F.col("evidence")),
    }
    return exact, out.select(*[new[c].alias(c) if c in new else F.col(c) for c in hypotheses.columns])
