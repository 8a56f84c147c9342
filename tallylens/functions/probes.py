"""Value-difference probes: Column functions of a (source, target) pair of texts.

Each gives array<struct<category, strength, detail, meta>>; `signals` joins them in registry order. A probe
that works in steps can also lay its steps over a table as columns (`with_signals`), each computed once and
within generated code; that is the way for many rows. A probe never raises: whatever doesn't parse is NULL and
fires nothing. Numbers are DECIMAL(38,18) where that holds them, else two limbs of up to 38 digits before and 37
behind the point; larger ones fire no numeric probe.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import NULL_TEXT, SIGNAL

Probe = Callable[[Column, Column], Column]

# Texts that stand for NULL, sentinels, and booleans.
NULLISH = ["", "null", "NULL", "None", NULL_TEXT]
SENTINELS = ["-1", "-9999", "9999", "n/a", "na", "unknown", "none", "null", "?", "tbd", "0000-00-00", "1900-01-01", "1970-01-01"]
TRUE_WORDS = ["y", "yes", "t", "true", "1"]
FALSE_WORDS = ["n", "no", "f", "false", "0"]
# Constant factors that a unit change leaves, and half-hour offsets of time zones.
FACTORS = ["10", "100", "1000", "0.1", "0.01"]
HALF_HOURS = [1800, 12600, 16200, 19800]
# Accepted forms of dates and times.
DATE_FORM = r"^\d{4}-\d{1,2}-\d{1,2}$"
TIME_FORM = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$"
ZONE_FORM = r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}|T\d{1,2}:\d{1,2}:\d{1,2})(Z|[+-]\d{2}:?\d{2})$"


#: All white space, as Unicode has it.
_BLANK = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(_BLANK))


def signal(when: Column, category: str, strength: float, detail: str | Column, **meta: Column) -> Column:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    bag = F.create_map(*pairs) if pairs else F.lit(None)
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(when, F.struct(F.lit(category).alias("category"), F.lit(strength).alias("strength"), text.alias("detail"), bag.cast("map<string,string>").alias("meta")))


def fired(*signals: Column) -> Column:
    """Those that fired, in order."""
    return F.filter(F.array(*signals), lambda x: x.isNotNull())


def bind(body: Callable[[Column], Column], **values: Column) -> Column:
    """body of a struct of values, each computed once however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


class Steps:
    """A probe in steps. A step gives new values by name from those before it: `source` and `target`, and these
    stripped, `ss` and `st`, first; `final` gives the signals."""

    def __init__(self, *steps: Callable, final: Callable):
        self.steps, self.final = steps, final

    def __call__(self, source: Column, target: Column) -> Column:
        def go(p, names: list[str], steps: tuple) -> Column:
            if not steps:
                return fired(*self.final(p))
            new = steps[0](p)
            kept = {n: p[n] for n in names} | new
            return bind(lambda q: go(q, list(kept), steps[1:]), **kept)

        first = {"source": source, "target": target, "ss": strip(source), "st": strip(target)}
        return bind(lambda p: go(p, list(first), self.steps), **first)

    def laid(self, df: DataFrame, first: dict[str, Column], prefix: str) -> tuple[DataFrame, list[Column]]:
        """df with a column for each value, and the signals, null where they didn't fire."""
        p = dict(first)
        for step in self.steps:
            new = step(p)
            df = df.withColumns({prefix + n: c for n, c in new.items()})
            p |= {n: F.col(prefix + n) for n in new}
        return df, self.final(p)


#: How a number begins; other texts aren't tried as one.
NUMBER_FORM = r"^[-+]?[0-9.]"


def decimal(stripped: Column) -> Column:
    return F.when(stripped.rlike(NUMBER_FORM), stripped.try_cast("decimal(38,18)"))


def scale(x: Column) -> Column:
    """Digits after the point without trailing zeros, of a decimal with a scale."""
    return F.length(F.rtrim(F.substring_index(x.cast("string"), ".", -1), F.lit("0")))


def _power(digits: Column, factor: int) -> Column:
    """factor * 10^-digits, from a constant table; digits from 0 to 18."""
    return F.get(F.array(*[F.lit(f"{Decimal(factor).scaleb(-k):f}").cast("decimal(38,18)") for k in range(19)]), digits)


def rounded_equal(fine: Column, coarse: Column, digits: Column) -> Column:
    """Whether fine, rounded half-even to the digits of coarse, is coarse: it is less than half a unit away, or
    half a unit from an even digit. A digit less makes room for an exact difference; from 1e19 on numbers go the
    wide way."""
    fine, coarse = (x.try_cast("decimal(37,18)") for x in (fine, coarse))
    gap, half = F.abs(fine - coarse), _power(digits + 1, 5)
    tie = (gap == half) & (F.abs(coarse) % _power(digits, 2) == 0)
    return F.coalesce((digits < 18) & ((gap < half) | tie), F.lit(False))


def _tried(p) -> dict[str, Column]:
    return {"s0": decimal(p["ss"]), "t0": decimal(p["st"])}


def _decimals(p) -> dict[str, Column]:
    return {x: F.when(~p["wide"], p[f"{x}0"]) for x in "st"}


def _scales(p) -> dict[str, Column]:
    differ = p["s"].isNotNull() & p["t"].isNotNull() & (p["s"] != p["t"])
    return {"differ": differ, "scale_s": F.when(differ, scale(p["s"])), "scale_t": F.when(differ, scale(p["t"]))}


def _numeric(p) -> dict[str, Column]:
    s, t, scale_s, scale_t, differ = (p[n] for n in ("s", "t", "scale_s", "scale_t", "differ"))
    whole_s, whole_t = scale_s == 0, scale_t == 0
    wide = s.cast("decimal(38,0)")

    def wraps(bits: int) -> Column:
        half, full = (F.lit(str(1 << n)).cast("decimal(38,0)") for n in (bits - 1, bits))
        return F.pmod(wide + half, full) - half == t

    digits = F.least(scale_s, scale_t)
    gap = F.try_divide(F.abs(s.cast("double") - t.cast("double")), F.greatest(F.abs(s.cast("double")), F.abs(t.cast("double"))))
    # A narrow literal keeps the product's scale at 15 digits; the ratio tells smaller numbers apart.
    ratio = F.try_divide(s.cast("double"), t.cast("double"))
    near = lambda f: F.abs(ratio / float(f) - 1) < 1e-9
    factor = F.coalesce(*[F.when(near(f) & (s == F.try_multiply(t, F.lit(f).cast("decimal(3,2)" if "." in f else "decimal(4,0)"))), F.lit(f)) for f in FACTORS])
    equal = F.when(scale_s > scale_t, rounded_equal(s, t, scale_t)).when(scale_t > scale_s, rounded_equal(t, s, scale_s)).otherwise(False)
    return {
        "digits": digits,
        "to_whole": (digits == 0) & (scale_s > 0),
        "bits": F.when(differ & whole_s & whole_t, F.when(wraps(32), 32).when(wraps(64), 64)),
        "equal": F.when(differ, equal).otherwise(False),
        "gap": gap,
        "cut": whole_t & ~whole_s & (gap < 0.05),
        "factor": F.when(differ & (t != 0), factor),
    }


def _numeric_signals(p) -> list[Column]:
    wrapped, equal, to_whole, gap, cut = p["bits"].isNotNull(), p["equal"], p["to_whole"], p["gap"], p["cut"]
    rest = F.coalesce(p["differ"], F.lit(False)) & ~wrapped
    return [
        signal(wrapped, "type_precision", 0.92, "Target is the source wrapped around a narrower integer.", bits=p["bits"]),
        signal(rest & equal & to_whole, "transpilation", 0.85, "Equal once the source is rounded to whole units: a rounding step differs.", scale=p["digits"]),
        signal(rest & equal & ~to_whole, "type_precision", 0.9, F.concat(F.lit("Equal at scale "), p["digits"].cast("string"), F.lit(": digits were lost.")), scale=p["digits"]),
        signal(rest & ~equal & cut, "transpilation", 0.72, "Target is whole and near a fractional source: a rounding step differs.", relative=gap),
        signal(rest & ~equal & ~cut & (gap < 1e-6), "type_precision", 0.7, "Differs by less than a millionth: binary floating point or order of addition.", relative=gap),
        signal(rest & ~equal & ~cut & (gap >= 1e-6) & (gap < 1e-3), "type_precision", 0.6, "Differs by less than a thousandth: rounding or lost digits.", relative=gap),
        signal(rest & p["factor"].isNotNull(), "transpilation", 0.6, F.concat(F.lit("Source is target times "), p["factor"], F.lit(": a unit or scale differs.")), factor=p["factor"]),
    ]


# --- numbers that DECIMAL(38,18) doesn't hold ----------------------------------------------------------------
#: A number of two limbs: up to 38 digits before the point and FRACTION behind it, with or without an exponent.
WIDE_FORM = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]{1,3})?$"
FRACTION = 37
#: From here on DECIMAL(38,18) has no room to tell whether numbers are equal once rounded.
WIDE_FROM = "10000000000000000000"
#: Fixed value: significant digits that a rounded number may have.
SIGNIFICANT = 28


def _big(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _is_wide(p) -> dict[str, Column]:
    """Whether both are numbers and one of them is too large, or too finely written, for the plain way."""
    large = lambda x, text: F.coalesce(F.abs(x) >= F.lit(WIDE_FROM).cast("decimal(38,18)"), F.lit(True)) | (F.length(text) > 20)
    begun = p["ss"].rlike(NUMBER_FORM) & p["st"].rlike(NUMBER_FORM)
    formed = F.when(begun, F.when(p["ss"].rlike(WIDE_FORM), p["st"].rlike(WIDE_FORM)))
    return {"wide": F.coalesce(F.when(large(p["s0"], p["ss"]) | large(p["t0"], p["st"]), formed), F.lit(False))}


def _point(p) -> dict[str, Column]:
    """Of each text the digits, and where among them the point stands."""
    out = {}
    for side, text in (("s", p["ss"]), ("t", p["st"])):
        x = F.when(p["wide"], F.lower(F.ltrim(text, F.lit("+-"))))
        mantissa = F.substring_index(x, "e", 1)
        whole = F.substring_index(mantissa, ".", 1)
        exponent = F.when(x.contains("e"), F.substring_index(x, "e", -1).cast("int")).otherwise(0)
        out |= {f"d{side}": F.replace(mantissa, F.lit("."), F.lit("")), f"p{side}": F.length(whole) + exponent, f"m{side}": text.startswith("-")}
    return out


def _limb_texts(p) -> dict[str, Column]:
    """The digits before and behind the point, without zeros at the ends."""
    out = {}
    for side in "st":
        d, at = p[f"d{side}"], p[f"p{side}"]
        n = F.length(d)
        room = F.when(at.between(-FRACTION, 80), at)
        whole = F.when(room <= 0, "").otherwise(F.rpad(F.substr(d, F.lit(1), F.least(room, n)), room, F.lit("0")))
        rest = F.when(room >= n, "").when(room <= 0, F.concat(F.repeat(F.lit("0"), -room), d)).otherwise(F.substr(d, room + 1))
        out |= {f"w{side}": F.ltrim(whole, F.lit("0")), f"f{side}": F.rtrim(rest, F.lit("0"))}
    return out


def _limbs(p) -> dict[str, Column]:
    """Both limbs as whole numbers: the fraction's counts units of 10^-FRACTION."""
    fit = F.lit(True)
    for side in "st":
        fit = fit & (F.length(p[f"w{side}"]) <= 38) & (F.length(p[f"f{side}"]) <= FRACTION)
    out = {}
    for side in "st":
        out |= {
            f"big{side}": F.when(fit, _big(F.concat(F.lit("0"), p[f"w{side}"]).try_cast("decimal(38,0)"))),
            f"unit{side}": F.when(fit, F.rpad(p[f"f{side}"], FRACTION, "0").try_cast("decimal(38,0)")),
            f"n{side}": F.length(p[f"f{side}"]),
            f"z{side}": p[f"m{side}"] & (F.length(F.concat(p[f"w{side}"], p[f"f{side}"])) > 0),
        }
    return out


def _rounds_to(p, fine: str, coarse: str, digits: Column) -> Column:
    """Whether the fine side, rounded half-even to digits behind the point, is the coarse one."""
    unit = F.get(F.array(*[_big(F.lit(str(10**k))) for k in range(FRACTION + 1)]), FRACTION - digits)
    whole, fraction = p[f"big{fine}"], p[f"unit{fine}"]
    rest = fraction % unit
    kept = fraction - rest
    odd = F.when(digits == 0, whole % 2 == 1).otherwise(kept % (unit * 2) == unit)
    up = (rest * 2 > unit) | ((rest * 2 == unit) & odd)
    last = _big(F.lit(str(10**FRACTION)))
    new = F.when(up, kept + unit).otherwise(kept)
    carried = new == last
    same = (F.when(carried, F.try_add(whole, F.lit(1))).otherwise(whole) == p[f"big{coarse}"]) & (F.when(carried, 0).otherwise(new) == p[f"unit{coarse}"])
    nought = (p[f"big{coarse}"] == 0) & (p[f"unit{coarse}"] == 0)
    long = F.length(p[f"w{fine}"]) + digits
    return same & ((p["zs"] == p["zt"]) | nought) & (long <= SIGNIFICANT)


def _wide_numeric(p) -> dict[str, Column]:
    """What _numeric gives of limbs."""
    alike = p["zs"] == p["zt"]
    same = alike & (p["bigs"] == p["bigt"]) & (p["units"] == p["unitt"])
    differ = F.coalesce(~same, F.lit(False))
    digits = F.least(p["ns"], p["nt"])
    equal = F.when(p["ns"] > p["nt"], _rounds_to(p, "s", "t", digits)).when(p["nt"] > p["ns"], _rounds_to(p, "t", "s", digits)).otherwise(False)
    whole_s, whole_t = p["ns"] == 0, p["nt"] == 0
    signed = {x: F.when(p[f"z{x}"], -p[f"big{x}"]).otherwise(p[f"big{x}"]) for x in "st"}

    def wraps(bits: int) -> Column:
        full, half = (_big(F.lit(str(1 << n))) for n in (bits, bits - 1))
        low = F.pmod(signed["s"], full)
        return F.when(low >= half, low - full).otherwise(low) == signed["t"]

    # The limbs' differences first, so that nearly equal numbers keep the digits in which they differ.
    value = {x: p[f"big{x}"].cast("double") + p[f"unit{x}"].cast("double") / float(10**FRACTION) for x in "st"}
    near = F.abs(F.try_subtract(p["bigs"], p["bigt"]).cast("double") + (p["units"] - p["unitt"]).cast("double") / float(10**FRACTION))
    gap = F.try_divide(F.when(alike, near).otherwise(value["s"] + value["t"]), F.greatest(value["s"], value["t"]))
    # The same digits with the point elsewhere.
    digit = {x: F.rtrim(F.ltrim(F.concat(p[f"w{x}"], p[f"f{x}"]), F.lit("0")), F.lit("0")) for x in "st"}
    zeros = {x: F.when(p[f"w{x}"] != "", F.length(p[f"w{x}"])).otherwise(F.length(F.ltrim(p[f"f{x}"], F.lit("0"))) - p[f"n{x}"]) for x in "st"}
    moved = F.when(alike & (digit["s"] == digit["t"]) & (digit["t"] != ""), zeros["s"] - zeros["t"])
    factor = F.coalesce(*[F.when(moved == Decimal(f).adjusted(), F.lit(f)) for f in FACTORS])
    found = {
        "differ": differ,
        "digits": digits,
        "to_whole": (digits == 0) & (p["ns"] > 0),
        "bits": F.when(differ & whole_s & whole_t, F.when(wraps(32), 32).when(wraps(64), 64)),
        "equal": F.when(differ, F.coalesce(equal, F.lit(False))).otherwise(False),
        "gap": gap,
        "cut": whole_t & ~whole_s & (gap < 0.05),
        "factor": F.when(differ, factor),
    }
    return {f"wide_{k}": v for k, v in found.items()}


def _all_numeric(p) -> list[Column]:
    names = ("differ", "digits", "to_whole", "bits", "equal", "gap", "cut", "factor")
    return _numeric_signals(p) + _numeric_signals({n: p[f"wide_{n}"] for n in names})


def timestamp(x: Column) -> Column:
    """Wall-clock time of a stripped text in an accepted form; an offset is left out."""
    plain = F.regexp_replace(x, r"(Z|[+-]\d{2}:?\d{2})$", "")
    # A year with a hyphen behind it begins every form.
    dated = F.substring(x, 5, 1) == "-"
    return F.when(dated, F.when(x.rlike(DATE_FORM) | x.rlike(TIME_FORM), x.try_cast("timestamp_ntz")).when(x.rlike(ZONE_FORM), plain.try_cast("timestamp_ntz")))


def wall_micros(x: Column) -> Column:
    """Microseconds of the wall clock since 1970, whatever the session's time zone and its clock changes."""
    day = F.date_diff(x.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    minute = F.hour(x) * 60 + F.minute(x)
    return (day * 1440 + minute) * 60_000_000 + (F.date_part(F.lit("SECOND"), x) * 1_000_000).cast("long")


def _times(p) -> dict[str, Column]:
    return {"s": timestamp(p["ss"]), "t": timestamp(p["st"]), "dated": ~p["source"].contains(":") & ~p["target"].contains(":")}


def _gap(p) -> dict[str, Column]:
    return {"micros": F.when(p["s"] != p["t"], F.abs(wall_micros(p["t"]) - wall_micros(p["s"])))}


def _temporal(p) -> list[Column]:
    micros = p["micros"]
    differ = micros > 0
    day, seconds = 86_400_000_000, micros / 1_000_000
    dates = p["dated"] & (micros % day == 0) & (micros <= 6 * day)
    hours = (micros % 3_600_000_000 == 0) & (micros < day)
    halves = micros.isin([x * 1_000_000 for x in HALF_HOURS])
    rest = differ & ~dates
    return [
        signal(differ & dates, "env_config", 0.75, "Dates are a few whole days apart: another start of the week or bucket.", days=(micros / day).cast("int")),
        signal(rest & (hours | halves), "timezone", 0.9, "Times are an offset of time zones apart.", offset_seconds=seconds.cast("long")),
        signal(rest & (micros < 1_000_000), "type_precision", 0.7, "Times differ below a second: another precision.", offset_seconds=seconds),
        signal(rest & (micros >= day), "upstream_drift", 0.65, "Times are a day or more apart: taken at another moment.", days=(micros / day).cast("int"), provenance_candidate=F.lit(True)),
    ]


def folded(x: Column) -> Column:
    """x in a form that two texts share where full case folding makes them equal: ß and ss, ligatures, final sigma.

    Lower and then upper case, with special casing, part characters as folding does but for the dotless i, which
    stands aside meanwhile."""
    full = F.upper(F.translate(F.lower(x), "\u0131", "\uf8f0"))
    return F.when(F.octet_length(x) == F.char_length(x), F.upper(x)).otherwise(full)


#: Letters that collations take for two others though no normal form does, and what stands for them.
_LIKE_TWO, _STAND_IN = "\u013f\u0e33\u0eb3\u0f77\u0f79", "\uf8f1\uf8f2\uf8f3\uf8f4\uf8f5"
#: Control and format characters, which collations pass over.
_IGNORED = r"[^\p{Cc}\p{Cf}]"


def _stripped(p) -> dict[str, Column]:
    return {"spaces": p["ss"] == p["st"], "case": folded(p["source"]) == folded(p["target"])}


def _string(p) -> list[Column]:
    differ, spaces, case = p["source"] != p["target"], p["spaces"], p["case"]
    # UNICODE compares composed and decomposed forms as equal, and tells all else apart but what it ignores.
    form = lambda x: F.collate(F.translate(folded(x), _LIKE_TWO, _STAND_IN), "UNICODE")
    alike = form(p["ss"]) == form(p["st"])
    both = alike & (F.regexp_replace(p["ss"], _IGNORED, "") == F.regexp_replace(p["st"], _IGNORED, ""))
    return [
        signal(differ & spaces, "string_format", 0.9, "Equal without white space at the ends."),
        signal(differ & ~spaces & case, "string_format", 0.85, "Equal but for case."),
        signal(F.when(differ & ~spaces & ~case, both), "string_format", 0.8, "Equal once normalised: Unicode form, case and white space."),
    ]


def _words(p) -> dict[str, Column]:
    def nullish(x: Column) -> Column:
        return x.isNull() | F.coalesce(x.isin(NULLISH), F.lit(False))

    return {"ns": nullish(p["source"]), "nt": nullish(p["target"]), "ws": F.lower(p["ss"]), "wt": F.lower(p["st"])}


def _null_boolean(p) -> list[Column]:
    source, target, ns, nt = (p[n] for n in ("source", "target", "ns", "nt"))

    def truth(word: Column) -> Column:
        return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)

    both, one = ns & nt, ns != nt
    other = F.when(ns, target).otherwise(source)
    sentinel = F.coalesce(F.when(ns, p["wt"]).otherwise(p["ws"]).isin(SENTINELS), F.lit(False))
    shown = [F.coalesce(x, F.lit("None")) for x in (source, target)]
    return [
        signal(both & (shown[0] != shown[1]), "null_boolean", 0.85, "Both are forms of no value."),
        signal(one & sentinel, "null_boolean", 0.85, "A sentinel stands for no value.", sentinel=other),
        signal(one & ~sentinel, "upstream_drift", 0.8, "Only one side has a value.", populated_side=F.when(ns, "target").otherwise("source"), provenance_candidate=F.lit(True)),
        signal(~both & ~one & (source != target) & (truth(p["ws"]) == truth(p["wt"])), "null_boolean", 0.85, "The same truth value in another form."),
    ]


def canonical_json(text: Column) -> Column:
    """Text of a JSON object or array with sorted keys; NULL for anything else."""
    return _canonical_of(strip(text))


def _canonical_of(stripped: Column) -> Column:
    return F.when(_bracketed(stripped) & F.substring(stripped, -1, 1).isin("]", "}"), F.to_json(F.try_parse_json(stripped)))


def _bracketed(stripped: Column) -> Column:
    return F.substring(stripped, 1, 1).isin("[", "{")


def _canonical(p) -> dict[str, Column]:
    both = _bracketed(p["ss"]) & _bracketed(p["st"])
    return {"s": F.when(both, _canonical_of(p["ss"])), "t": F.when(both, _canonical_of(p["st"]))}


def _semi_structured(p) -> list[Column]:
    source, target, s, t = p["source"], p["target"], p["s"], p["t"]
    keys_s, keys_t = (F.array_sort(F.json_object_keys(x)) for x in (s, t))
    objects = s.startswith("{") & t.startswith("{")
    values = lambda x: F.from_json(x, "map<string,string>")
    changed = F.filter(keys_s, lambda k: ~F.element_at(values(s), k).eqNullSafe(F.element_at(values(t), k)))
    return [
        signal((source != target) & (s == t), "semi_structured", 0.9, "The same content in another order or spacing.", semantically_equal=F.lit(True)),
        signal((s != t) & objects & (keys_s == keys_t), "semi_structured", 0.6, "The same keys with other values.", semantically_equal=F.lit(False), changed_keys=F.array_join(changed, ",")),
    ]


numeric = Steps(_tried, _is_wide, _decimals, _scales, _numeric, _point, _limb_texts, _limbs, _wide_numeric, final=_all_numeric)
temporal = Steps(_times, _gap, final=_temporal)
string = Steps(_stripped, final=_string)
null_boolean = Steps(_words, final=_null_boolean)
semi_structured = Steps(_canonical, final=_semi_structured)

#: Probes in the order that decides ties.
REGISTRY: dict[str, Probe] = {"numeric": numeric, "temporal": temporal, "string": string, "null_boolean": null_boolean, "semi_structured": semi_structured}


def register(name: str, probe: Probe) -> None:
    """Adds a probe after those known."""
    REGISTRY[name] = probe


def signals(source: Column, target: Column, names: list[str] | None = None) -> Column:
    """All signals of a pair, in registry order."""
    none = F.array().cast(f"array<{SIGNAL}>")
    return F.flatten(F.array(*[F.coalesce(REGISTRY[n](source, target), none) for n in names or REGISTRY]))


def held(x: Column) -> Column:
    """x, which the optimizer doesn't take for a constant even if it is one."""
    return F.when(F.spark_partition_id() >= 0, x)


def with_signals(df: DataFrame, source: str, target: str, out: str = "found", names: list[str] | None = None) -> DataFrame:
    """df with the signals of two of its columns, in the order of signals(), and nulls among them: to filter
    an array takes a lambda, which no code is generated for. each_signal() leaves them out. Probes in steps are
    laid out as columns; others are called on the two columns.

    The target is held: of two constant columns the optimizer would write each step's expression out in all that
    name it, step upon step, before it works any of them out. A constant source alone is worked out once."""
    kept, picked, none = df.columns, [], F.array().cast(f"array<{SIGNAL}>")
    df = df.withColumn("_probe_target", held(F.col(target)))
    first = {"source": F.col(source), "target": F.col("_probe_target")}
    df = df.withColumns({"_probe_ss": strip(first["source"]), "_probe_st": strip(first["target"])})
    first |= {"ss": F.col("_probe_ss"), "st": F.col("_probe_st")}
    for n in names or REGISTRY:
        probe = REGISTRY[n]
        if isinstance(probe, Steps):
            df, found = probe.laid(df, first, f"_probe_{n}_")
            picked.append(F.array(*found))
        else:
            picked.append(F.coalesce(probe(F.col(source), F.col(target)), none))
    return df.select(*kept, F.concat(*picked).alias(out))


def each_signal(df: DataFrame, *columns: str, found: str = "found") -> DataFrame:
    """columns, place (in the row's signals) and signal, a row for each signal. A plain explode would infer a
    filter on the signals and push it below all steps, which writes every step out in it."""
    return df.select(*columns, F.posexplode_outer(found).alias("place", "signal")).where("signal is not null")
