"""Source divergence, phrases and packing against brute force, on small tables with nulls, empty and very long
texts, ties, repeated rows and columns with clashing names; and on empty tables."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallylens.llm import common, divergence, packing, phrases, words
from tallylens.llm.segments import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, at int, piece string, m string, key string, part int, `p.q` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rng = np.random.default_rng(11)
    vocab = [*(f"w{chr(97 + i)}" for i in range(12)), "É", "漢字", "it's", "A\tb", "x  y"]
    out = []
    for i in range(150):
        made = " ".join(rng.choice(vocab, int(rng.integers(1, 30)), p=np.arange(17, 0, -1) / 153))
        text = re.sub(r" (wb|wd) ", lambda m: f"{'.,;:!?'[i % 6]} {m[1]}\n", made)
        out.append((i, text, [None, "en", "en", "de", ""][i % 5], ["a", "b", None, "c é", "", "a"][i % 6]))
    out += [(200, None, "en", "a"), (201, "", None, "b"), (202, " \t\n..", "xx", "lone"), (203, "123 !!", "yy", "p"), (204, "456", "yy", "q")]
    out += [(205, "wa wb " * 30_000, "en", "a"), (206, "wa WA wa wa. " * 200, "de", "b"), (None, out[7][1], "en", "b"), (None, "wc wd we", None, None)]
    out += [(7, *out[7][1:])] * 3  # repeated rows
    return [(*r, 1, "x", 2, "y", "z", "k", 3, 4) for r in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@given(st.lists(st.one_of(st.none(), st.text("aZé漢. \t\n1", max_size=12)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_of_batches(texts):
    got, row = words.tokens(pa.array(["zz", *texts], pa.string()).slice(1), words.LETTERS)
    want = [(w, i) for i, t in enumerate(texts) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))]
    assert list(zip(got.to_pylist(), row.tolist(), strict=True)) == want


def brute_audit(min_docs, top):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in ROWS:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)
        of = sorted(s for g, s in groups if g == lang)

        def share(c):
            below = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // below for t in kept}

        p = {s: share(counts[lang, s]) for s in of}
        q = share(sum((counts[lang, s] for s in of), Counter()))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in of:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in of if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out |= {(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(pairs, 1)} | {(lang, s, "term", t, v, k) for k, (v, t) in enumerate(terms, 1)}
    return out


def test_divergence_equals_brute_force(docs, monkeypatch):
    want = brute_audit(10, 10)
    assert {r[2] for r in want} == {"pair", "term"} and ("yy", "p", "pair", "q", 0, 1) in want and not any(r[0] == "xx" for r in want)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == sorted(want)
    monkeypatch.setattr(common, "SMALL", 0)  # the languages' sizes are joined, not broadcast
    assert sorted(map(tuple, divergence.audit(docs, min_docs=3, top=2).collect())) == sorted(brute_audit(3, 2))


def test_divergence_shares_are_exact_beyond_64_bit_products(spark):
    for n, of in ((3 * 10**12, 7 * 10**12 + 1), (8 * 10**15, 9 * 10**15), (1, 3), (5, 5)):
        got = spark.range(1).select(F.expr(divergence._share(f"{n}L", f"{of}L"))).first()[0]
        assert got == 1 + 10**9 * n // of


def test_divergence_counts_rows_that_hold_a_term(docs, none):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in divergence.term_counts(docs).collect()}
    want, held = Counter(), Counter()
    for _, text, lang, source, *_ in ROWS:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        want.update((lang or "", source or "", t) for t in terms)
        held.update((lang or "", source or "", t) for t in set(terms))
    assert got == {k: (n, held[k]) for k, n in want.items()}
    assert divergence.audit(none).count() == 0


def pieces_brute():
    for _, text, lang, *_ in ROWS:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            yield "und" if lang is None else lang, re.findall(r"[^\x20\x09]+", piece)


def brute_phrases(least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, w in pieces_brute():
        n[lang] += len(w)
        for k in range(1, 6):
            f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        kept = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in kept.items():
            if any(len(x) > len(g) and b >= a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, b in kept.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), " ".join(g), c[g[:k]], c[g[k:]]))
        out += [(lang, k, x[3], -x[1], x[4], x[5], n[lang], -x[0]) for k, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_phrases_equal_brute_force(docs, none, monkeypatch):
    for least, top in ((100, 2000), (12, 7)):
        want = brute_phrases(least, top)
        assert len(want) > 5
        assert sorted(map(tuple, phrases.collocations(docs, least, top).drop("cut").collect())) == want
    # A filter that lets all pass, few places at a time and joined sizes change nothing.
    monkeypatch.setattr(phrases, "BITS_MOST", 64)
    monkeypatch.setattr(phrases.Sieve, "has", lambda self, hashes: np.ones(len(hashes), dtype=bool))
    monkeypatch.setattr(phrases, "PLACES", 50)
    monkeypatch.setattr(common, "SMALL", 0)
    assert sorted(map(tuple, phrases.collocations(docs, 12, 7).drop("cut").collect())) == want
    assert phrases.collocations(none).count() == 0


def test_pieces_are_counted_once_with_their_multiplicity(docs):
    got = {(r["lang"], r["piece"]): r["m"] for r in phrases.pieces_of(docs).collect()}
    want = Counter()
    for _, text, lang, *_ in ROWS:
        want.update(("und" if lang is None else lang, p.strip(" \t")) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)) if p.strip(" \t"))
    assert got == want


def test_buckets_beyond_memory_are_added_up_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "MEMORY", "24MB")
    n, name = 400_000, "x" * 60

    def batches():
        for _ in range(3):
            for a in range(0, n, 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(["en"] * 50_000), pa.array([f"{name}{k}" for k in range(a, a + 50_000)]), pa.array([40] * 50_000)], schema=phrases._GRAM)

    monkeypatch.setattr(phrases.TaskContext, "get", staticmethod(lambda: type("T", (), {"taskAttemptId": lambda self: 1})()))
    out = list(phrases._bucket(str(tmp_path), 100, True)(batches()))
    assert sum(b.num_rows for b in out) == n + 1
    assert sum(pa.compute.sum(b["f"]).as_py() for b in out) == 2 * n * 120


def test_sieve_holds_all_its_phrases(spark):
    made = [("en" if i % 2 else "de", f"a{i} b{i % 7} c") for i in range(3000)]
    shared = phrases.sieve(spark.createDataFrame([(*r, 1) for r in made], "lang string, phrase string, f long"), len(made))
    known = phrases.Sieve(shared.value)
    inside, outside = (phrases._phrase_hashes(pa.array([r[0] for r in x]), pa.array([r[1] for r in x])) for x in (made, [("fr", p) for _, p in made]))
    assert known.has(inside).all() and known.has(outside).mean() < 0.1


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2), (1, 6)])
def test_hilbert_curve_visits_each_cell_and_moves_by_one(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = packing.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@given(st.lists(st.integers(1, 50), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_pieces_fill_sequences_without_padding(sizes):
    n = np.array(sizes)
    doc, start, length, seq, offset = packing.pieces_of(np.cumsum(n) - n, n, int(n.sum()), 16)
    assert (length > 0).all() and all(length[doc == d].sum() == n[d] for d in range(len(n)))
    for s in range(int(seq.max()) + 1):
        at = np.argsort(offset[seq == s])
        sizes = length[seq == s][at]
        assert (offset[seq == s][at] == np.cumsum(sizes) - sizes).all()
        assert sizes.sum() <= 16 and int(sizes.sum()).bit_count() == 1


def check_packed(got, made, length):
    """Every document's ids stand in its pieces, and every sequence is gapless and needs no padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter((r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in made)
    by = defaultdict(list)
    for r in got:
        ids = tuple(np.frombuffer(r["ids"], dtype="<u4").tolist())
        assert len(ids) == r["length"]
        by[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"], r["start"], r["doc_tokens"], ids))
    whole = Counter()
    row = [x for s in range(len(by)) for x in sorted(by[s])]
    for s in range(len(by)):
        at = 0
        for offset, n, *_ in sorted(by[s]):
            assert offset == at
            at += n
        assert at <= length and at.bit_count() == 1
    part = ()
    for _, _, doc, start, n, ids in row:  # a document's pieces follow each other
        assert start == len(part)
        part += ids
        if len(part) == n:
            whole[doc, part] += 1
            part = ()
    assert part == () and whole == want


def test_packing_keeps_every_id_in_one_piece(spark, docs, none):
    check_packed(packing.pack(docs).collect(), ROWS, 2048)
    check_packed(packing.pack(docs, length=64).collect(), ROWS, 64)
    assert packing.pack(none).count() == 0


def test_packing_spreads_equal_rows(spark):
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words again and again").alias("text")).repartition(4)
    parts = packing.laid_out(packing.encoded(same), ids_per_part=4000)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1200
    check_packed(packing.pieces(parts).collect(), [(None, "the same words again and again")] * 4000, 2048)


def test_neighbours_in_sequences_are_alike(spark):
    """Documents of eight vocabularies: neighbours share theirs far more often than by chance (1 in 8)."""
    rng = np.random.default_rng(5)
    made = [(i, " ".join(f"{chr(97 + i % 8)}{w}" for w in rng.integers(0, 30, 120))) for i in range(800)]
    got = packing.pack(spark.createDataFrame(made, "doc_id long, text string")).where("start = 0").orderBy("sequence_id", "offset").collect()
    kinds = [r["doc_id"] % 8 for r in got]
    assert sum(a == b for a, b in itertools.pairwise(kinds)) > 3 * len(kinds) / 8
