"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeated
rows and extra columns with clashing names; and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallylens.llm import chat, decontamination, langid, lmscore, mixing, neardup, neighbours, sharding, tokencounts, tokenfiles
from tallylens.llm.common import fresh_dir
from tallylens.llm.segments import cut_finely

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, bucket string, size double, key string, label string"


def rows():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)]
    base = " ".join(rng.choice(vocab, 60))
    out = []
    for i in range(60):
        kind = i % 6
        text = " ".join(rng.choice(vocab, int(rng.integers(1, 80))))
        if kind == 1:
            text = base
        elif kind == 2:
            words = base.split()
            words[int(rng.integers(60))] = "Changed"
            text = " ".join(words)
        out.append((i, text, "en" if i % 2 else "de", ["a", "b", "c", None][i % 4]))
    out += [(60, None, "en", "a"), (61, "", None, "b"), (62, " \t\n", "de", None), (63, "one two", "en", "a"), (64, "ONE two", "en", "c"), (65, "x " * 5000, "de", "a"), (66, "123 !!", None, "b"), (67, "é ü ﬁ 漢字", "de", "b")]
    out += [(5, out[5][1], *out[5][2:])] * 2  # repeated rows
    return [(*r, len(r[1] or ""), 1, "x", 0.5, "k", "l") for r in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_chat(spark):
    said = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "[INST] a\\b [\\/INST] <\\\\s></s>é"), (1, None, None, None), (2, 0, "assistant", ""), (None, 0, "assistant", "x<|endoftext|>"), (2, 0, "assistant", "")]
    said += [(3, 0, "assistant", "é word </s>\n" * 30_000), (3, 1, "tool </s>", " 漢字 \t\x00" * 9)]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    turns = turns.unionByName(chat.forged_conversation(spark), allowMissingColumns=True)
    got = {r["conv_id"]: r for r in chat.digest(chat.read_turns(chat.format_turns(turns))).collect()}
    groups = defaultdict(list)
    for c, t, r, x in [*said, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        g.sort()
        loss = "".join(x for _, r, x in g if r == "assistant")
        assert got[c]["n_turns"] == len(g)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in g).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(20 + len(x) for t in g for x in chat.escape(pa.array(t[1:])).to_pylist()) - 20 * len(g)
    assert chat.digest(chat.read_turns(chat.format_turns(turns.limit(0)))).count() == 0


@pytest.mark.parametrize("text", ["<s>", "<\\s>", "<\\\\s>x</s>", "<<s>", "[[INST]INST]", "[/INST][/INST]", "\\", "plain"])
def test_escapes_are_reversible_and_leave_no_mark(text):
    shown = chat.escape(pa.array([text, None, ""]))
    assert chat.unescape(shown).to_pylist() == [text, None, ""] and not any(c in shown[0].as_py() for c in chat.CONTROL)


def test_chat_refuses_vocabularies_that_reach_the_reserved_ids(spark, monkeypatch):
    monkeypatch.setattr(chat, "RESERVED", 50000)
    with pytest.raises(ValueError, match="reserved"):
        chat.format_turns(chat.forged_conversation(spark))


def test_shards(spark, docs, none):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(ROWS)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= {0, 1, 2, 3}
    assert sharding.shard(none).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 20).otherwise(F.repeat(F.col("id").cast("string"), 25)).alias("text"))
    sizes = [r[0] for r in sharding.shard(many).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 16 and max(sizes) < 1.05 * min(sizes)  # a third of the rows are copies of one text


def clashing(spark):
    """Rows whose columns have the names that the operators use inside; the first three are near copies, and
    one has no doc_id."""
    words = [f"w{k}" for k in range(60)]
    made = [(k, " ".join([*words[:59], "other"] if k == 1 else words)) for k in (0, 1, 2)] + [(k, f"text {k} of its own") for k in range(3, 40)] + [(None, "no id"), (None, None), (3, "text 3 of its own")]
    names = ("_size", "_crc", "_no", "_h", "_id", "_t", "_n", "_key", "h", "d", "t", "id", "row", "key", "range", "first", "within", "size", "kept", "head", "law", "text_crc32", "n_shingles", "bucket")
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("source", F.lit("a"))
    for k, n in enumerate(names):
        df = df.withColumn(n, F.concat(F.lit(f"{n}{k}"), F.coalesce("text", F.lit(""))))
    return df


def test_operators_on_documents_keep_clashing_columns(spark):
    docs = clashing(spark)
    every = Counter(map(str, docs.collect()))
    sharded = sharding.sharded_documents(docs.withColumn("shard", F.lit(9)), 4)
    assert sharded.columns == [*docs.columns, "shard", "slot"] and Counter(map(str, sharded.drop("shard", "slot").collect())) == every
    stays = Counter(str(r) for r in docs.collect() if r["doc_id"] not in (1, 2))
    stays = Counter(dict.fromkeys(stays, 1))  # of the repeated row one stays
    alone = neardup.deduplicated(docs)
    assert alone.columns == docs.columns and Counter(map(str, alone.collect())) == stays
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and set(map(str, mixed.collect())) <= set(every)
    spoken = langid.kept_documents(docs, langid.fit(docs.withColumn("lang", F.lit("en"))))
    assert Counter(map(str, spoken.collect())) == Counter(str(r) for r in docs.collect() if r["text"])
    bench = spark.createDataFrame([(1, "text 5 of its own")], "item_id long, text string")
    assert Counter(map(str, decontamination.clean_documents(docs, bench).collect())) == Counter(str(r) for r in docs.collect() if r["doc_id"] != 5)


def test_sharded_documents_keep_rows_and_columns(docs):
    got = sharding.sharded_documents(docs, 4)
    assert set(docs.columns) <= set(got.columns) and got.count() == len(ROWS)
    want = Counter((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs, 4).collect())
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got.collect()) == want


def test_shards_of_rows_without_doc_id_and_of_one_text(spark):
    rows = spark.createDataFrame([(None if k % 3 else k, "the same" if k % 2 else f"other {k}") for k in range(300)], "doc_id long, text string")
    for part in (rows, rows.where("text = 'the same'")):
        got = sharding.shard(part, 4, max_ranges=64).collect()
        assert len(got) == part.count() and sum(r["doc_id"] is None for r in got) == part.where("doc_id is null").count()
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_ranges_count_splitters(spark):
    rng = np.random.default_rng(2)
    cuts = sorted({(int(h), int(d), int(u)) for h, d, u in zip(rng.integers(-3, 4, 60), rng.integers(-2, 3, 60), rng.integers(0, 4, 60), strict=True)} | {(0, sharding.LOWEST, sharding.LOWEST)})
    rows = spark.createDataFrame([(h, d, u) for h in range(-4, 5) for d in range(-3, 4) for u in range(5)], "h long, d long, u long")
    assert all(r["range"] == sum(c <= (r["h"], r["d"], r["u"]) for c in cuts) for r in sharding._ranged(rows, cuts).collect())


@pytest.mark.parametrize("share", [1.0, 0.4])
def test_equal_rows_without_doc_id_are_cut_to_equal_shards(spark, share):
    """Rows that tie in text and doc_id: 16 shards within 1 % of each other, or a row."""
    n, same = 8000, int(8000 * share)
    rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < same, "the same text").otherwise(F.format_string("text %07d", "id")).alias("text")).repartition(5)
    got = sharding.shard(rows, 16).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == n and set(sizes) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(sizes.values()) / 16
    assert max(abs(x - mean) for x in sizes.values()) <= 0.02 * mean
    whole = sharding.sharded_documents(rows, 16)
    assert whole.columns == ["doc_id", "text", "shard", "slot"] and whole.select("shard", "slot").distinct().count() == n


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((600, 24)).astype("float32")
    v[100:300] = v[100]  # a third are equal
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    bad = [(900, None), (1000, [0.0] * 24), (1100, [float("nan")] * 24), (1200, [None] + [1.0] * 23), (1300, [1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("list", F.lit(0)).repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x, met = v.astype("float64"), 0
    assert set(got) == set(range(0, 600, 100))
    for q in got:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        met += len(set(want) & {i for i, _ in got[q]})
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-12 for i, s in got[q]) and got[q] == sorted(got[q], key=lambda r: (r[1], r[0]))
    assert met >= 0.9 * 60
    assert neighbours.search(df.where("vec_id in (0, 1, 2)"), F.col("id") == 0).count() == 2
    assert neighbours.search(df.where("vec_id >= 900"), F.col("id") >= 0).count() == 0


def recall(spark, x, per, **params):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("id") % per == 0, **params).collect():
        got[r["query_id"]].append(r["vec_id"])
    met = 0
    for q in range(0, len(x), per):
        d = ((x - x[q]) ** 2).sum(1)
        met += len(set(got[q]) & {int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q and d[i] <= np.sort(d)[10]})
    return met / (10 * len(range(0, len(x), per)))


def test_recall_of_the_registered_search_without_clusters(spark):
    x = np.random.default_rng(9).standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, 20) >= 0.94
    # More cells, blocks of a list and chunks of queries.
    assert recall(spark, x, 20, block=16, most_lists=30) >= 0.94


def test_clustered_vectors_need_few_lists():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 32)) * 6)[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 32))
    centre = neighbours.k_means(x, 63)
    own = neighbours.nearest(x, centre)
    size, spread = np.bincount(own, minlength=63), np.bincount(own, ((x - centre[own]) ** 2).sum(1), 63)
    far, d = neighbours.squared(x[:200], centre), neighbours.squared(x[:200], x)
    pick = neighbours.late_lists(far, size, spread / np.maximum(size, 1), np.sqrt(np.sort(d, axis=1)[:, 10]), 32, 0.08)
    near = d.argsort(1)[:, 1:11]
    assert np.mean([pick[q, own[near[q]]].mean() for q in range(200)]) > 0.95 and (pick * size).sum() < 0.15 * 200 * 4000


def test_the_bound_tightens_while_entries_are_scanned():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 48)) @ neighbours.rotation(48)
    best = np.full((5, 11), np.inf)
    i, j, part = neighbours.scan(x[:5], x, best, np.full(5, np.inf))
    d = neighbours.squared(x[:5], x)
    assert np.allclose(best, np.sort(d, axis=1)[:, :11], atol=1e-9) and len(i) < 5 * 14
    tight = np.sort(d, axis=1)[:, 3]
    i, j, part = neighbours.scan(x[:5], x, np.full((5, 11), np.inf), tight)
    assert np.bincount(i).tolist() == [4] * 5


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfiles.tokenizer_path())
    # The null doc_id comes first; the tokenizer's own call finds the special token.
    more = spark.createDataFrame([(None, "no id"), (70, "a <|endoftext|> b"), (71, "x<|endoftext|>")], "doc_id long, text string")
    parts = tokenfiles.write(docs.unionByName(more, allowMissingColumns=True), fresh_dir(spark, "test"), rows_per_part=20)
    assert parts.count() > 1
    got = tokenfiles.read_documents(parts).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, *sorted(r[0] for r in ROWS), 70, 71]
    texts = {r[0]: r[1] or "" for r in ROWS} | {r["doc_id"]: r["text"] for r in more.collect()}
    assert tok.encode(texts[70], add_special_tokens=False).ids == [64, 220, 50256, 275]
    start = 0
    for r in got:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfiles.write_and_read(none).count() == 0


def test_edited_counts(docs, none):
    from tallylens.llm.segments import Pieces

    tok = Pieces().tok
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = Counter((r["doc_id"], r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) for r in tokencounts.count_edited(docs).collect())
    lengths = F.length(F.coalesce("text", F.lit(""))).cast("long")
    given = {r[0]: r[1] for r in docs.select("doc_id", tokencounts.sampled_edits(F.col("doc_id"), lengths)).collect()}
    want = Counter()
    for i, t, *_ in ROWS:
        after = t or ""
        for e in given[i]:
            after = after[: e["start"]] + e["new"] + after[max(e["start"], e["end"]) :]
        want[(i, count(t or ""), count(after), len(after))] += 1
    assert got == want and tokencounts.count_edited(none).count() == 0


def test_stored_trees_take_edits_of_a_table_again_and_again(spark, docs, none):
    from tallylens.llm.segments import Pieces

    tok = Pieces().tok
    edits = [(1, 2, 0, 4, "first "), (1, 1, 5, 5, None), (5, 1, None, None, "x"), (60, 1, 3, 9, "of null"), (65, 1, 5000, 90000, " end"), (9999, 1, 0, 0, "no one"), (None, 1, 0, 1, "lost")]
    table = spark.createDataFrame(edits, "doc_id long, seq int, start long, end long, new string")
    stored = tokencounts.with_trees(docs)
    once = tokencounts.edited(tokencounts.with_edits(stored, table))
    twice = tokencounts.edited(tokencounts.with_edits(once, table)).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        t = t or ""
        for _ in range(2):
            for _, _, a, b, new in sorted((e for e in edits if e[0] == i), key=lambda e: e[1]):
                a = min(a or 0, len(t))
                t = t[:a] + (new or "") + t[max(a, b or 0) :]
        want[(i, t, len(tok.encode(t, add_special_tokens=False).ids))] += 1
    assert Counter((r["doc_id"], r["text"], r["n_tokens_edited"]) for r in twice) == want
    assert all(sum(r["leaf_tokens"]) == r["n_tokens_edited"] and sum(r["leaf_chars"]) == len(r["text"]) for r in twice)
    assert tokencounts.edited(tokencounts.with_edits(tokencounts.with_trees(none), table)).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("block_chars", [8 << 20, 40])
def test_decontamination(spark, docs, none, block_chars):
    texts = {r[0]: r[1] for r in ROWS}
    long = " ".join(texts[1].split()[10:30]).upper().replace(" ", ", ")
    items = [(1, long), (2, "one two"), (3, None), (4, "!!"), (5, "w1 w2 nowhere"), (10, long), (6, "x"), (2, "One, two"), (10, long), (None, "ü ﬁ"), (None, "123")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("b", F.lit(1))
    got = Counter(tuple(r) for r in decontamination.report(docs, bench, block_chars=block_chars).collect())
    windows, spots = defaultdict(set), defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(10, len(w))
        for q in range(len(w) - n + 1) if n else ():
            windows[tuple(w[q : q + n])].add("" if i is None else str(i))
            spots[tuple(w[q : q + n])].add(("" if i is None else str(i), q, tuple(w)))
    want = Counter()
    for i, t, *_ in ROWS:
        w, hit, ids, best = WORD.findall(low(t)), set(), set(), (0, None, None, None)
        for p in range(len(w)):
            for n in range(1, 11):
                if tuple(w[p : p + n]) in windows and p + n <= len(w):
                    hit |= set(range(p, p + n))
                    ids |= windows[tuple(w[p : p + n])]
                    for name, q, item in spots[tuple(w[p : p + n])]:
                        size = n
                        while p + size < len(w) and q + size < len(item) and w[p + size] == item[q + size]:
                            size += 1
                        found = (-size, p, name, q)
                        best = min(best, found, key=lambda x: (x[0], *(("",) if x[1] is None else x[1:])))
        want[(i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit), -best[0], *best[1:])] += 1
    assert got == want
    clean = decontamination.clean_documents(docs, bench, block_chars=block_chars)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[5])
    assert decontamination.report(none, bench).count() == 0 and decontamination.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_longest_match_is_found(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(30)))], "item_id long, text string")
    text = "no " + " ".join(f"b{i}" for i in range(3, 25)) + " no b0 b1 b2"
    r = decontamination.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert (r["longest"], r["longest_at"], r["n_hit"]) == (22, 1, 22)


def test_language(docs, none):
    model = langid.fit(docs, docs_per_language=20)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in ("en", "de", "und")
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert langid.fit(none)["langs"] == [] and langid.predict(docs, langid.fit(none)).where("lang_pred != 'und'").count() == 0
    assert langid.kept_documents(docs, model).columns == docs.columns


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    p = np.log(np.array([[0.3], [0.2], [0.2], [0.1], [0.1], [0.1]]))
    scorer = langid.Scorer(pieces, p)

    def brute(w):
        if not w:
            return 1.0
        return sum(math.exp(p[pieces.index(x)][0]) * brute(w[len(x) :]) for x in pieces if w.startswith(x)) + (0.1 * brute(w[1:]) if w[0] not in "ab" else 0)

    words = ["a", "abab", "aba", "xab", "abaabba" * 5]
    sums = [1.0]  # over the prefixes of the long word, which is too long for the brute force
    for e in range(1, 36):
        sums.append(sum(math.exp(p[pieces.index(x)][0]) * sums[e - len(x)] for x in pieces if words[4][:e].endswith(x)))
    assert np.allclose(scorer.words(words)[:, 0], [math.log(brute(w)) for w in words[:4]] + [math.log(sums[-1])])
    a = langid.forward(scorer.lattice.find(["abaabb"], 6), scorer.logp, True)
    assert np.allclose(a, langid.forward(scorer.lattice.find(["abaabb"], 6), scorer.logp, False))


def test_long_words_are_learned_from(monkeypatch):
    lattice = langid.Lattice(["▁", "a", "b", "ab", "ba"])
    counts = {"▁ab": 3, "▁" + "ab" * 12: 2, "▁" + "ba" * 20 + "z": 2, "▁" + "ab" * 900: 1}
    few = {w: n for w, n in counts.items() if len(w) <= langid.SHORT}
    got = langid.fit_language(lattice, counts)
    assert np.isfinite(got).all() and not np.allclose(got, langid.fit_language(lattice, few))
    some = {w: n for w, n in counts.items() if len(w) < 100}
    got = langid.fit_language(lattice, some)
    monkeypatch.setattr(langid, "SHORT", 100)  # all in plain numbers
    assert np.allclose(got, langid.fit_language(lattice, some))


def test_very_long_words_are_scored_in_stretches(monkeypatch):
    rng = np.random.default_rng(6)
    pieces = sorted({"".join(rng.choice(list("abc"), n)) for n in (1, 1, 1, 2, 2, 3, 4, 7, 16, 16)} | {"a" * 16})
    logp = np.log(rng.dirichlet(np.ones(len(pieces) + 1), 3).T)
    scorer = langid.Scorer(pieces, logp)
    monkeypatch.setattr(langid, "STRIP", 50)
    for n in (1, 2, 15, 16, 17, 49, 50, 51, 100, 257, 1000):
        word = "".join(rng.choice(list("abcx"), n)) + "a" * (n % 40)
        want = langid.forward(scorer.lattice.find([word], len(word)), scorer.logp, True)[0]
        assert np.allclose(langid.forward_long(scorer.lattice, word, scorer.logp), want)
    monkeypatch.undo()
    assert np.isfinite(scorer.words(["ab" * 150_000, "漢字かな" * 20_000])).all()


def segmentations(word, pieces):
    """All ways to write a word as pieces; a character that is no piece is the piece None."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            out += [[word[:n] if word[:n] in pieces else None, *rest] for rest in segmentations(word[n:], pieces)]
    return out


def test_fit_and_prediction_equal_brute_force(spark, monkeypatch):
    pieces = sorted(["▁", "a", "b", "ab", "▁a", "ba", "bab", "c"])
    monkeypatch.setattr(langid, "vocabulary", lambda path=None: pieces)
    rng = np.random.default_rng(8)
    made = [(i, " ".join("".join(rng.choice(list(["abb", "aab", "cabé"][i % 3]), int(rng.integers(1, 7)))) for _ in range(6)) + ["\n", " \t", ""][i % 3], ["x", "y", None][i % 3] if i % 7 else "z") for i in range(60)]
    made += [(60, None, "x"), (61, "", "y"), (62, "12 !", "z"), (None, "abba ab", "x"), (63, "ABBA\u2003Ab", None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    learned = [(t, g) for i, t, g in made if t is not None and g and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)]
    langs = sorted({g for _, g in learned})
    assert model["langs"] == langs
    names, logp = [*pieces, None], {}
    for g in langs:
        words = Counter("▁" + w for t, k in learned if k == g for w in t.lower().split())
        p = {x: 1 / len(names) for x in names}
        for _ in range(4):
            seen = dict.fromkeys(names, 0.05)
            for w, n in words.items():
                ways = segmentations(w, pieces)
                share = [math.prod(p[x] for x in way) for way in ways]
                for way, q in zip(ways, share, strict=True):
                    for x in way:
                        seen[x] += n * q / sum(share)
            p = {x: v / sum(seen.values()) for x, v in seen.items()}
        logp[g] = p
    assert np.allclose(np.exp(model["logp"]), [[logp[g][x] for g in langs] for x in names])
    shares = Counter(g for _, g in learned)
    got = {(r["doc_id"], r["held_out"]): (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    for i, t, _ in made:
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if not t or not any(map(str.isalpha, t)):
            assert got[i, held] == ("und", 0.0)
            continue
        odds = [math.log(shares[g] / len(learned)) + sum(math.log(sum(math.prod(logp[g][x] for x in way) for way in segmentations("▁" + w, pieces))) for w in t.lower().split()) for g in langs]
        odds = np.exp(np.array(odds) - max(odds))
        assert got[i, held][0] == langs[int(odds.argmax())] and got[i, held][1] == pytest.approx(odds.max() / odds.sum())


def test_equal_scores_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(i, "same words here", ["b", "é", "a", "Z"][i % 4]) for i in range(16) if zlib.crc32(str(i).encode()) % 4 != 2], "doc_id long, text string, lang string")
    docs = docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    got = {(r["lang_pred"], round(r["score"], 9)) for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got == {("Z", 0.25)}


def test_held_out_accuracy(spark):
    """Each language has its own words; the held-out documents' words are mixed anew."""
    rng = np.random.default_rng(5)
    vocab = {g: ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(3, 9)))) for _ in range(300)] for g in ("k", "l", "m")}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocab[g], 30)), g) for i, g in enumerate(np.tile(["k", "l", "m"], 80).tolist())], "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.fit(docs)).join(docs, "doc_id").where("held_out")
    assert got.count() > 30 and got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_language_without_spaces_is_learned(spark):
    texts = [("abcd" * 20, "x"), ("dcba" * 20, "y"), ("漢字仮名" * 50, "z"), ("名仮字漢" * 50, "w")]
    docs = spark.createDataFrame([(i, *texts[i % 4]) for i in range(80)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    asked = pa.array(["abcd" * 18, "dcba" * 18, "漢字仮名" * 900])
    lang, score = langid.decide(langid.scorer_of(model), model, asked)
    assert [model["langs"][k] for k in lang] == ["x", "y", "z"] and min(score[:2]) > 0.99


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(docs, none, order):
    texts = [(r[0], split(low(r[1]))) for r in ROWS]
    every = Counter(tuple(w[i : i + n]) for _, w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in texts)
    want = []
    for i, w in texts:
        own = Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
        rest, others, s = lambda g, own=own: every[g] - own[g], max(1, total - len(w)), 0.0
        for k in range(len(w)):
            f = 0.0
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if rest(g) > 0:
                    s += f + math.log(rest(g) / (rest(g[:-1]) if n > 1 else others))
                    break
                f += math.log(0.4)
            else:
                s += f - math.log(others)
        want.append((i, len(w), round(s, 6)))
    got = [(r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in lmscore.score_documents(docs, order=order, bucket_bytes=4000, batch_rows=7).collect()]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(sorted(got), sorted(want), strict=True))
    assert lmscore.score_documents(none).count() == 0


def test_registered_scores_use_trigrams(spark, tmp_path):
    """In the last text all word pairs were seen, but no three words in a row."""
    import __spark_entry__

    texts = ["a b c", "a b c", "b d", "x c d", "a b d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    name = next(n for n in __spark_entry__.queries() if n.startswith("op7_"))
    got = {r["doc_id"]: r for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
    want = math.log(2 / 11) + math.log(2 / 2) + math.log(0.4) + math.log(1 / 3)
    assert got[4]["log_score"] == pytest.approx(want, abs=1e-4) and got[4]["n_backed_off"] == 1


def test_batches_of_equal_words_are_scored_apart(spark):
    docs = spark.createDataFrame([(k, "p q r") for k in range(6)], "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["n_backed_off"]) for r in lmscore.score_documents(docs, batch_rows=2).collect()]
    assert sorted(got) == [(k, 0) for k in range(6)]


def brute_groups(texts):
    sets = []
    for t in texts:
        w = [low(x) for x in split(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if k == old else k for k in label]
    return sets, label


def test_near_duplicates(spark, docs, none, monkeypatch):
    unique = list({r[0]: r for r in ROWS}.values())
    ids = [r[0] for r in unique]
    sets, label = brute_groups([r[1] for r in unique])
    least = {k: min(i for i, x in zip(ids, label, strict=True) if x == k) for k in label}
    want = {i: (len(s), least[k]) for i, s, k in zip(ids, sets, label, strict=True)}
    got = neardup.groups(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, c in want.values()})
    assert neardup.groups(none).count() == 0


def test_near_copies_with_null_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "pq"]
    near = [t.replace(" p30 ", " new ").replace(" q30 ", " new ") for t in texts]
    rows = [(7, texts[0]), (None, texts[0]), (3, near[0]), (None, texts[1]), (9, near[1]), (None, near[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.groups(docs).collect()]
    assert Counter(got) == Counter([(7, 3, False), (None, 3, False), (3, 3, True), (None, 9, False), (9, 9, True), (None, 9, False)])
    assert sorted(r["doc_id"] for r in neardup.deduplicated(docs).collect()) == [3, 9]
    nameless = spark.createDataFrame([(None, texts[0]), (None, near[0])], docs.schema)
    assert neardup.deduplicated(nameless).count() == 1


@pytest.mark.parametrize("small", [2, 12, 1000])
def test_buckets_of_any_size_give_the_same_links(spark, monkeypatch, small):
    """Many near copies about the threshold of one base: all in tiles, both ways, all listed."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "TILE", 16)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 6))):
            w[k] = f"n{rng.integers(1000000)}"
        texts.append(" ".join(w))
    sets, label = brute_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 90


def test_bayes_bounds_rise():
    least = neardup.least_matches(1e-6)
    assert (np.diff(least) > 0).all() and least[0] >= 1 and least[-1] < 0.75 * 128


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len(split(r[1]))
    order = sorted((k for k in sizes if k is not None), key=lambda x: x.encode()) + [None]
    weight, total = {k: i % 3 + 1 for i, k in enumerate(order)}, sum(sizes.values())
    target, open_, left = {}, set(order), float(total)
    while open_:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
        open_ -= over
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[k] - target[k]) <= 1 for k in order)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(split(r[1]))) for r in ROWS)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(none).count() == 0


def test_mix_uses_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_sequence_decides_the_schedule(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "20 + id % 7 AS size")
    total = 400 * 20

    def schedule(**params):
        return [tuple(r) for r in mixing.plan(rows, slots=600, **params)[1].groupBy("slot", "idx").agg(F.sum("words")).orderBy("slot").collect()]

    golden = schedule()
    other = schedule(sequence=lambda i: F.pmod(i * 0.41421356 + 0.3, F.lit(1.0)))
    assert golden != other and sum(r[2] for r in golden) == sum(r[2] for r in other) >= total
    taken, all_of, done = Counter(), Counter(), 0
    for _, idx, words in golden:
        all_of[idx] += words
    whole = sum(all_of.values())
    block = max(r[2] for r in golden)
    for _, idx, words in golden:
        taken[idx] += words
        done += words
        assert all(abs(taken[k] - all_of[k] * done / whole) <= 6 * block for k in all_of)
    poor = schedule(sequence=lambda i: F.lit(0.01))
    assert sum(r[2] for r in poor) == whole and max(r[0] for r in golden) <= 600 + 4 * 30 < max(r[0] for r in poor)


def test_mix_of_very_large_sources(spark):
    rows = spark.createDataFrame([(0, "a", 8 * 10**12), (1, "a", 7), (2, "b", 3 * 10**12 + 1), (3, None, 0), (4, "c", 5)], "doc_id long, source string, size long")
    placed, taken = mixing.plan(rows, slots=300, block_limit=1 << 40)
    target = {r["source"]: r["target"] for r in placed.collect()}
    got = Counter()
    for r in taken.join(rows.drop("size"), "doc_id").collect():
        got[r["source"]] += r["words"]
    assert all(abs(got[k] - x) <= 1 for k, x in target.items()) and sum(got.values()) > 10**13


def test_mixed_documents_keep_columns_and_follow_the_slots(spark, docs):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and max(r["count"] for r in got.groupBy("doc_id").count().collect()) <= 9
    clash = spark.createDataFrame([(i, f"w{i} x y", "ab"[i % 2], 1, {"k": i}, i) for i in range(40)], "doc_id long, text string, source string, _n int, m map<string,int>, slot long").withColumn("row", F.lit(2)).withColumn("_key", F.lit("z"))
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and all(r["text"].startswith(f"w{r['slot']} ") and r["m"] == {"k": r["doc_id"]} and r["_n"] == 1 and r["row"] == 2 for r in mixed.collect())
    assert any(r["first_slot"] is not None for r in mixing.mix(clash).collect())
    order = [r["source"] for r in mixed.collect()]  # a and b weigh 1 and 2
    assert all(abs(order[:n].count("a") - n * order.count("a") / len(order)) <= 4 for n in range(len(order)))


def test_pipeline_stages_take_the_rows_of_the_one_before(spark, docs, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    keep = docs.select("doc_id", "text", "lang", "source", "n_chars")
    keep.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"shard", "slot", *keep.columns} == set(out.columns) and 0 < out.count()
    assert out.where("text is null or text = ''").count() == 0


def test_pipeline_rows_equal_brute_force(spark, tmp_path):
    """All stages, rows included. The sources' words are 1 : 2 : 3 after cleaning, as the mix's weights are,
    so each clean row stays exactly once."""
    import corpus_pipeline

    passage = [f"item{k}" for k in range(10)]
    made = [(i, " ".join(f"w{i}x{k}" for k in range(12)), ["en", "de"][i % 2], "a" if i < 5 else "b" if i < 15 else "c") for i in range(30)]
    made += [(30 + k, " ".join([*made[k][1].split()[:11], "other"]), "en", made[k][3]) for k in (0, 7, 20)]
    made += [made[3], (60, made[4][1], "de", "b"), (61, None, "en", "a"), (62, "", None, "b"), (63, "12 34 !!", "de", "c")]
    made += [(70 + k, " ".join(["left"] * k + passage + ["right"] * (9 * k)), "en", "b") for k in (0, 1)]
    rows = [(*r, len(r[1] or "")) for r in made]
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    known = sorted({r for r in rows if any(map(str.isalpha, r[1] or ""))})
    _, label = brute_groups([r[1] for r in known])
    heads = {}
    for r, k in zip(known, label, strict=True):
        heads.setdefault(k, r)
    clean = [r for r in heads.values() if not any(WORD.findall(low(r[1]))[k : k + 10] == passage for k in range(len(r[1])))]
    words = Counter()
    for r in clean:
        words[r[3]] += len(split(r[1]))
    assert words == {"a": 60, "b": 120, "c": 180}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in out) == Counter(clean)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) and 0 <= k < 16 for k, x in slots.items())


def test_mixed_documents_meet_targets_in_whole_rows(spark):
    made = [(i, " ".join(f"w{i}x{k}" for k in range(9)), "ab"[i % 2]) for i in range(60)]
    got = Counter(map(tuple, mixing.mixed_documents(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()))
    a, b = ([got[r] for r in made if r[2] == s] for s in "ab")
    assert set(got) <= set(made) and set(a) <= {0, 1} and set(b) <= {1, 2}
    assert abs(9 * sum(a) - 180) <= 9 and abs(9 * sum(b) - 360) <= 9


def test_languages_are_learned_without_and_with_repeated_doc_ids(spark):
    rng = np.random.default_rng(4)
    vocab = {"en": ["the", "house", "and", "would", "light"], "fr": ["maison", "avec", "lumière", "vous", "être"]}
    made = [(None, " ".join(rng.choice(vocab[k], 12)), k) for k in ("en", "fr") * 400]
    for rows in (made, [(8, *r[1:]) for r in made], made[:1] * 900 + made):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = langid.predict(docs.withColumn("want", F.col("lang")), langid.fit(docs, docs_per_language=100)).collect()
        right = sum(a["lang_pred"] == b[2] for a, b in zip(got, rows, strict=True))
        assert right >= 0.99 * len(rows) and min(r["score"] for r in got) > 0.5


def test_words_learned_from_are_bounded(spark):
    words = spark.createDataFrame([("en", f"w{k:05d}", k) for k in range(500)] + [("de", "x" * 900, 9), ("de", "kurz", 3)], "lang string, word string, n long")
    got = {tuple(r) for r in langid._bounded(words, 2, 200, 1200).collect()}
    assert got == {("en", f"w{k:05d}", k) for k in range(400, 500)} | set()
    assert {r["word"] for r in langid._bounded(words, 2, 200, 2400).where("lang = 'de'").collect()} == {"x" * 900, "kurz"}


def test_edits_of_unspaced_text_reencode_little():
    """Chinese clauses, and words set apart by signs alone: an edit re-encodes a few clauses."""
    encoder = tokencounts.shared(tokencounts.tokenizer_path())
    rng = np.random.default_rng(8)
    letters = [chr(c) for c in range(0x4E00, 0x4F00)]
    for text in ("，".join("".join(rng.choice(letters, 12)) for _ in range(1400)), "".join(f"abc{k},def;ghi." for k in range(1500))):
        (tree,) = tokencounts.trees([text], encoder)
        for _ in range(12):
            at = int(rng.integers(len(tree.text)))
            tree.edit(at, at + int(rng.integers(0, 9)), str(rng.choice(["", "新字", "，", "x'", "'s", "1", " "])), encoder)
            assert tree.n_tokens == len(encoder.whole([tree.text])[0]) and tree.n_chars == len(tree.text)
        assert tree.reencoded < 12 * 400


@given(st.text("ab'1,。漢é sS\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_fine_cuts_keep_the_ids(text):
    encoder = tokencounts.shared(tokencounts.tokenizer_path())
    pieces = cut_finely(text)
    assert "".join(pieces) == text
    each = encoder.whole(pieces) if pieces else []
    assert [i for x in each for i in x] == (encoder.whole([text])[0].tolist() if text else [])


def test_common_windows_are_searched_in_the_items_suffix_array(monkeypatch):
    import random
    import time

    rng = random.Random(0)
    for trial in range(120):
        vocab = "ab" if trial % 2 else "abc"
        items = [(f"i{k}", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for k in range(rng.randint(1, 12))]
        texts = [" ".join(rng.choice(vocab + "z" * (trial % 3 == 0)) for _ in range(rng.randint(0, 40))).encode() for _ in range(5)]
        block, found = decontamination.Block(items, 4), []
        for most in (10**9, 0):
            monkeypatch.setattr(decontamination, "PAIRS", most)
            found.append(decontamination.scan(block, texts))
        assert found[0] == found[1]
    monkeypatch.setattr(decontamination, "PAIRS", 2_000_000)
    for words in (1, 40):
        block = decontamination.Block([(k, "the " * words) for k in range(4000)], 10)
        began = time.time()
        (got,) = decontamination.scan(block, [b"the " * 3000])
        assert time.time() - began < 1 and len(got[2]) == 4000 and got[1] == [0, 3000] and got[3] == (-words, 0, "0", 0)
