"""The probes against plain Python: each branch with pairs about its limits, and many random pairs."""

import itertools
import random
import threading
from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation, localcontext

import pytest
from pyspark.sql import functions as F

from tallylens.functions import probes

SPACES = ["", " ", "\t", " ", "\xa0\n"]


def numeric_oracle(source, target):
    """Categories and strengths, in order, of two decimals of at most 18 digits after the point."""
    if source == target:
        return []
    scale = [max(0, -x.normalize().as_tuple().exponent) for x in (source, target)]
    whole = [n == 0 for n in scale]
    if all(whole):
        for bits in (32, 64):
            if (int(source) + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1) == target:
                return [("type_precision", 0.92)]
    digits = min(scale)
    at = [x.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN) for x in (source, target)]
    gap = abs(float(source) - float(target)) / max(abs(float(source)), abs(float(target)))
    out = []
    if at[0] == at[1]:
        out.append(("transpilation", 0.85) if digits == 0 and scale[0] > 0 else ("type_precision", 0.9))
    elif whole[1] and not whole[0] and gap < 0.05:
        out.append(("transpilation", 0.72))
    elif gap < 1e-3:
        out.append(("type_precision", 0.7 if gap < 1e-6 else 0.6))
    if target and source / target in [Decimal(f) for f in probes.FACTORS]:
        out.append(("transpilation", 0.6))
    return out


def numeric_pairs():
    rng = random.Random(4)
    for d in (0, 1, 3, 8, 16, 17):  # about the half of a unit, on even and odd digits
        unit = Decimal(1).scaleb(-d)
        for base, off in itertools.product((Decimal(rng.randrange(1, 10**6)), Decimal(7), Decimal(8), Decimal(-3)), (4, 5, 6)):
            coarse = base * unit
            fine = coarse + off * unit / 10
            yield fine, coarse
            yield coarse, fine
    for bits in (32, 64):  # at the edges of what wraps
        for k in (0, 1, 17, (1 << bits - 1) - 1):
            yield Decimal((1 << bits) + k), Decimal(k)
            yield Decimal((1 << bits) + k), Decimal(k + 1)
    for rel in ("0.00000099", "0.00000101", "0.00099", "0.00101", "0.049", "0.051"):  # at the limits of nearness
        yield Decimal("1000000.125"), (Decimal("1000000.125") * (1 + Decimal(rel))).quantize(Decimal("1e-9"))
        yield Decimal("10000.5"), (Decimal("10000.5") * (1 - Decimal(rel))).quantize(Decimal(1))
    for f in probes.FACTORS:
        yield Decimal(37) * Decimal(f), Decimal(37)
    for _ in range(300):
        s = Decimal(rng.randrange(-(10**9), 10**9)).scaleb(-rng.randrange(0, 10))
        yield s, rng.choice([s.quantize(Decimal(1).scaleb(-rng.randrange(0, 6)), ROUND_HALF_EVEN), s + Decimal(rng.randrange(1, 100)).scaleb(-rng.randrange(0, 12)), s])


NUMBERS = list(numeric_pairs())


def temporal_pairs():
    """(source, target, categories)"""
    day, at = "2031-05-%02d", "2031-05-%02d %02d:%02d:%02d"
    for n in (1, 6, 7, 8):  # whole days, up to six
        yield day % 10, day % (10 + n), ["env_config"] if n <= 6 else ["upstream_drift"]
    for minutes in (60, 30, 210, 270, 330, 90, 150, 1, 23 * 60):
        whole = minutes % 60 == 0 or minutes in (30, 210, 270, 330)
        yield at % (10, 0, 0, 0), at % (10, minutes // 60, minutes % 60, 0), ["timezone"] if whole else []
        yield (at % (10, 0, 0, 0)).replace(" ", "T"), (at % (10, minutes // 60, minutes % 60, 0)).replace(" ", "T") + "Z", ["timezone"] if whole else []
    yield at % (10, 0, 0, 0) + ".25", at % (10, 0, 0, 0) + ".5", ["type_precision"]
    yield at % (10, 0, 0, 0) + ".25", at % (10, 0, 0, 1) + ".25", []
    yield at % (10, 0, 0, 0), at % (11, 0, 0, 0), ["upstream_drift"]
    yield at % (10, 0, 0, 0), at % (10, 0, 0, 0), []
    for bad in ("2031-13-01", "2031-02-30", "31-05-2031", "2031/05/10", "yesterday"):
        yield day % 10, bad, []


def other_pairs():
    """(probe, source, target, categories and strengths)"""
    for a, b in itertools.product(SPACES, SPACES):
        yield "string", a + "Ort", "Ort" + b, [("string_format", 0.9)] if a or b else []
    yield "string", "Ort", "oRT", [("string_format", 0.85)]
    yield "string", "Ort", " oRT", [("string_format", 0.8)]
    yield "string", "Zoë", "Zoë", [("string_format", 0.8)]
    yield "string", "Ort", "Orte", []
    for a, b in itertools.product([None, *probes.NULLISH], repeat=2):
        yield "null_boolean", a, b, [("null_boolean", 0.85)] if (a or "None" if a is None else a) != ("None" if b is None else b) else []
    for x in probes.SENTINELS:
        if x not in probes.NULLISH:
            yield "null_boolean", None, x.upper(), [("null_boolean", 0.85)] if x.upper() not in probes.NULLISH else []
            yield "null_boolean", f" {x} ", "", [("null_boolean", 0.85)]
    yield "null_boolean", "7", None, [("upstream_drift", 0.8)]
    for a, b in itertools.product([*probes.TRUE_WORDS, *probes.FALSE_WORDS, "maybe"], repeat=2):
        same = any(a in w and b in w for w in (probes.TRUE_WORDS, probes.FALSE_WORDS))
        yield "null_boolean", a, b.upper(), [("null_boolean", 0.85)] if same and a != b.upper() else []
    yield "semi_structured", '{"p": 1, "q": [1, 2]}', '{"q":[1,2],"p":1}', [("semi_structured", 0.9)]
    yield "semi_structured", '{"p": 1, "q": 2}', '{"q":2,"p":3}', [("semi_structured", 0.6)]
    yield "semi_structured", '{"p": 1}', '{"q":1}', []
    yield "semi_structured", "[1,2]", "[1, 2]", [("semi_structured", 0.9)]
    yield "semi_structured", "[1,2]", "[2,1]", []
    yield "semi_structured", '{"p": 1', '{"p":1}', []
    yield "semi_structured", "1", " 1", []


def found(spark, rows, names, staged):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, s string, t string")
    df = probes.with_signals(df, "s", "t", "x", names) if staged else df.withColumn("x", probes.signals(F.col("s"), F.col("t"), names))
    return [[(x["category"], x["strength"]) for x in r["x"] if x] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("staged", [False, True])
def test_numeric(spark, staged):
    shown = [(f"{s:f}" + SPACES[k % 5], SPACES[k % 3] + f"{t:f}") for k, (s, t) in enumerate(NUMBERS)]
    for (s, t), got in zip(NUMBERS, found(spark, shown, ["numeric"], staged), strict=True):
        assert got == numeric_oracle(s, t), (s, t)


@pytest.mark.parametrize("staged", [False, True])
def test_temporal(spark, staged):
    pairs = list(temporal_pairs())
    for (s, t, want), got in zip(pairs, found(spark, [x[:2] for x in pairs], ["temporal"], staged), strict=True):
        assert [c for c, _ in got] == want, (s, t)


@pytest.mark.parametrize("staged", [False, True])
@pytest.mark.parametrize("name", ["string", "null_boolean", "semi_structured"])
def test_others(spark, name, staged):
    pairs = [x for x in other_pairs() if x[0] == name]
    for (_, s, t, want), got in zip(pairs, found(spark, [x[1:3] for x in pairs], [name], staged), strict=True):
        assert got == want, (s, t)


def test_four_tenths_are_less_than_a_millionth_from_400000_on(spark):
    """The pairs of q_probe_numeric_small about the key where the reference's rule changes."""
    pairs = [(f"{k + 1000}.5", f"{k + 1000}.9") for k in (0, 398_999, 399_000, 8_999_999)]
    want = [[("type_precision", x)] for x in (0.6, 0.6, 0.7, 0.7)]
    assert found(spark, pairs, ["numeric"], True) == want == [numeric_oracle(*map(Decimal, p)) for p in pairs]


def test_odd_texts_fire_no_numeric_or_temporal_probe(spark):
    odd = [("nan", "1"), ("1e400", "2"), ("9" * 30, "1"), ("-", "."), (None, "1"), ("", "1"), ("1,5", "1.5"), ("0x1", "1")]
    assert found(spark, odd, ["numeric", "temporal"], True) == [[]] * len(odd)


def test_staged_probes_are_in_generated_code(spark):
    df = spark.range(10).selectExpr("cast(id as string) AS s", "cast(id + 1 as string) AS t")
    plan = probes.each_signal(probes.with_signals(df, "s", "t", names=["numeric", "temporal", "string", "null_boolean"]), "s")
    lines = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "Project" in x or "Filter" in x]
    assert len(lines) > 5 and all(x.lstrip(" +-:").startswith("*(") for x in lines)


def test_constant_pairs_are_planned_step_by_step(spark):
    """Of two constants each step was written out in all that name it, 3 ** 14 times here: the driver's memory ran out."""
    first = lambda p: {"v": F.length(F.coalesce(p["source"], F.lit("ab"))) + F.length(p["target"])}
    step = lambda p: {"v": (p["v"] * p["v"] + p["v"]) % 1009}
    probes.register("deep", probes.Steps(first, *[step] * 14, final=lambda p: [probes.signal(p["v"] >= 0, "deep", 0.1, "", v=p["v"])]))
    try:
        constants = [F.lit(x).cast("string").alias(n) for n, x in (("s", None), ("t", "-1"))]
        rows = probes.each_signal(probes.with_signals(spark.range(3).select("id", *constants), "s", "t", names=["null_boolean", "deep"]), "id")
        got, v = [], 4
        thread = threading.Thread(target=lambda: got.extend((r["id"], r["signal"]["category"], r["signal"]["meta"]) for r in rows.collect()), daemon=True)
        thread.start()
        thread.join(60)
    finally:
        del probes.REGISTRY["deep"]
    for _ in range(14):
        v = (v * v + v) % 1009
    assert sorted(got, key=lambda x: x[:2]) == [(k, *x) for k in range(3) for x in (("deep", {"v": str(v)}), ("null_boolean", {"sentinel": "-1"}))]


def test_own_probe_can_be_added(spark):
    probes.register("length", lambda s, t: probes.fired(probes.signal(F.length(s) != F.length(t), "recon_config", 0.1, "lengths differ")))
    try:
        for staged in (False, True):
            assert found(spark, [("a", "zz"), ("a", "b")], ["length"], staged) == [[("recon_config", 0.1)], []]
    finally:
        del probes.REGISTRY["length"]


def test_case_folds_fully_as_python_does(spark):
    """All letters that change with case or normal form, alone and within a text."""
    import unicodedata

    pairs = [("STRASSE", "straße"), ("ﬁne", "FINE"), ("ŉ", "ʼN"), ("ΌΣΟΣ", "όσος"), ("ıx", "IX"), ("İx", "i̇x"), ("a\u200bb", "ab"), ("a\u200bB", "a\u200bb"), ("e\u0301", "É "), ("ª", "a")]
    for c in map(chr, (*range(0x80, 0x2200), *range(0xA640, 0xABC0), *range(0xFB00, 0xFB18), *range(0x10400, 0x10450))):
        if unicodedata.category(c) != "Cn":
            other = {c.upper(), c.lower(), c.casefold(), unicodedata.normalize("NFD", c), unicodedata.normalize("NFD", c).upper(), unicodedata.normalize("NFKC", c)} - {c}
            pairs += [p for d in sorted(other) for p in ((c, d), (f"a{c}b", f"A{d}B"))]

    def want(a, b):
        if a.strip() == b.strip() or a.casefold() == b.casefold():
            return 0.9 if a.strip() == b.strip() else 0.85
        a, b = (unicodedata.normalize("NFC", x).strip().casefold() for x in (a, b))
        return 0.8 if a == b else None

    found = probes.with_signals(spark.createDataFrame(pairs, "a string, b string"), "a", "b", names=["string"])
    got = found.select("a", "b", F.get(F.filter("found", lambda x: x.isNotNull()), F.lit(0))["strength"].alias("n")).collect()
    assert len(got) > 5000 and [(r["a"], r["b"], r["n"]) for r in got if r["a"] != r["b"] and r["n"] != want(r["a"], r["b"])] == []


def wide_pairs():
    rng = random.Random(9)

    def number(whole, rest):
        text = str(rng.randrange(10 ** (whole - 1), 10**whole)) if whole else "0"
        return rng.choice(["", "-"]) + text + ("." + "".join(rng.choice("0123456789") for _ in range(rest)) if rest else "")

    for _ in range(260):
        a = number(rng.randrange(0, 39), rng.choice([0, 0, 1, 2, 5, 18, 20, 30, 37]))
        d = Decimal(a)
        sign, digits, exponent = d.as_tuple()
        cut = rng.randrange(0, 1 + max(0, -exponent))
        scale = Decimal(1).scaleb(-cut)
        with localcontext(Context(prec=90)):
            b = rng.choice([d.quantize(scale, ROUND_HALF_EVEN), d + 1, d * 10, d / 100, d + scale, -d, d * Decimal("1.0000001"), d * Decimal("1.0005"), d])
        yield a, f"{b:f}"[:60]
    for bits in (32, 64):
        for k in (0, 5, (1 << bits - 1) - 1, 1 << bits - 1):
            yield str((1 << 100) + (7 << bits) + k), str((k + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1))
    half = "12345678901234567890123"
    for tail, other in ((".5", "4"), (".5", "3"), (".50", "3"), (".51", "4"), (".49", "3"), (".25", "3.2"), (".35", "3.4")):
        yield half + tail, half[:-1] + other
        yield "-" + half + tail, "-" + half[:-1] + other
    yield "1e30", "1000000000000000000000000000000"
    yield "1.5E+30", "1.5e29"
    yield "0.00000000000000000000000001234", "0.0000000000000000000000000123"
    yield "9" * 38 + ".9", "9" * 38
    yield "1" * 39, "1" * 38


def wide_expected(a, b):
    """The signals that plain decimals of 28 significant digits give."""
    s, t = Decimal(a), Decimal(b)
    if s == t or any(len(str(abs(int(x)))) > 38 or x.normalize(Context(prec=100)).as_tuple().exponent < -37 for x in (s, t)):
        return []  # equal, or beyond the limbs
    with localcontext(Context(prec=100)):
        scale = [max(0, -x.normalize().as_tuple().exponent) for x in (s, t)]
        if not any(scale):
            for bits in (32, 64):
                if (int(s) + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1) == int(t):
                    return [("type_precision", 0.92)]
        gap, factor = abs(s - t) / max(abs(s), abs(t)), t != 0 and s / t in [Decimal(f) for f in probes.FACTORS]
    digits, out, equal = min(scale), [], False
    try:
        unit = Decimal(1).scaleb(-digits)
        equal = s.quantize(unit) == t.quantize(unit)
    except InvalidOperation:
        pass
    if equal:
        out.append(("transpilation", 0.85) if digits == 0 and scale[0] > 0 else ("type_precision", 0.9))
    elif scale[1] == 0 < scale[0] and gap < Decimal("0.05"):
        out.append(("transpilation", 0.72))
    elif gap < Decimal("1e-3"):
        out.append(("type_precision", 0.7 if gap < Decimal("1e-6") else 0.6))
    return out + ([("transpilation", 0.6)] if factor else [])


@pytest.mark.parametrize("staged", [True, False])
def test_wide_numbers_equal_plain_decimals(spark, staged):
    pairs = sorted({p for p in wide_pairs() if max(len(x) for x in p) > 20})
    df = spark.createDataFrame(pairs, "a string, b string")
    out = probes.with_signals(df, "a", "b", names=["numeric"]) if staged else df.select("a", "b", probes.signals(F.col("a"), F.col("b"), ["numeric"]).alias("found"))
    got = {(r["a"], r["b"]): [(x["category"], x["strength"]) for x in r["found"] if x is not None] for r in out.collect()}
    assert len(got) > 150
    wrong = {p: (got[p], wide_expected(*p)) for p in pairs if p[1] != "hello" and got[p] != wide_expected(*p)}
    assert wrong == {}
