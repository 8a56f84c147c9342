"""Phrases whose words stand together more often than chance would have it.

Texts are split into pieces; identical pieces of a language are counted once with their multiplicity. N-grams
are then counted order by order, weighted by multiplicity: tasks add up the n-grams of a batch of pieces and
shuffle them by a hash of (lang, phrase), and the task that a hash bucket goes to adds it up in duckdb, whose
aggregation works out of core beyond its memory limit. Only n-grams that occur `least` times are kept.

An n-gram that occurs so often consists of two n-grams of the order below that do, so an order is counted only
where a Bloom filter of the order below has both. The filter's size is bounded; beyond what it is made for, more
n-grams pass and are counted and dropped, and results stay the same.

The parts of a candidate, for its score and for what it makes superfluous, are looked up by requests: a row
for each part of each cut, shuffled to where the part's count is. Parts of one word, which very many candidates
may ask for, are spread over SALTS places.

Defined cases: null text has no pieces, null lang is `und`; rows are documents whatever their doc_id, so that
repeated rows count again; texts and pieces may be of any length; an empty table gives an empty result.
Further columns of docs are ignored.
"""

from __future__ import annotations

from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_from, fresh_dir, in_arrow_batches, join_spread, lean, mark, materialize
from .words import keeping, spans, strings, text_bytes

#: What pieces are made of, and words within them.
IN_PIECE = keeping(".,;:!?\n\v\f\r")
IN_WORD = keeping(" \t")
UNKNOWN = "und"
LONGEST = 5
#: N-grams that begin at so many places are added up at a time.
PLACES = 1 << 20
#: Bits of a filter for each of its n-grams, and at most in all (64 MB).
BITS_EACH, BITS_MOST = 16, 1 << 29
#: Memory of one bucket's aggregation; what is beyond it goes to disk.
MEMORY = "300MB"
SALTS = 16

_PIECE = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("m", pa.int64())])
_GRAM = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
_DDL = "lang string, phrase string, f long"


def _added(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, and the sum of its weights, in whole numbers."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, dtype="int64")
    return order[new], np.add.reduceat(weights[order], new) if len(keys) else weights


def _split(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct pieces of a batch of documents, without the spaces at their ends."""
    data, edges = text_bytes(batch.column("text"))
    word = IN_WORD[data]
    start, end = spans(IN_PIECE[data], edges)
    # From each piece's first word character to its last.
    at = np.flatnonzero(word)
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    has = lo < hi
    start, end = at[lo[has]], at[hi[has] - 1] + 1
    pieces = strings(data, start, end).dictionary_encode()
    langs = batch.column("lang").fill_null(UNKNOWN).dictionary_encode()
    of = langs.indices.to_numpy()[np.searchsorted(edges, start, side="right") - 1]
    key, m = np.unique(of.astype("int64") * max(1, len(pieces.dictionary)) + pieces.indices.to_numpy(), return_counts=True)
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(key // max(1, len(pieces.dictionary)))), pieces.dictionary.take(pa.array(key % max(1, len(pieces.dictionary)))).cast(pa.string()), pa.array(m)],
        schema=_PIECE,
    )


def pieces_of(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> lang, piece, m: distinct pieces with their multiplicities."""
    in_arrow_batches(docs.sparkSession, 4000)
    split = docs.select("lang", "text").mapInArrow(lean(lambda batches: map(_split, batches)), "lang string, piece string, m long")
    return split.groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _hash(texts: pa.Array) -> np.ndarray:
    return pd.util.hash_array(texts.to_numpy(zero_copy_only=False), categorize=False)


def _mix(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all its words but the last, and that of the last."""
    x = (code ^ (word >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return x ^ (x >> np.uint64(29))


class Sieve:
    """A Bloom filter of two places for each hash."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        shift = np.uint64(64 - (bits - 1).bit_length())
        return [(hashes * np.uint64(c)) >> shift for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for p in self.places(hashes, 64 * len(self.words)):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def _phrase_hashes(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """Of phrases of equally many words."""
    lists = pc.split_pattern(phrase, " ")
    words = lists.flatten()
    each = _hash(words).reshape(len(phrase), -1) if len(phrase) else np.zeros((0, 1), dtype="uint64")
    code = _hash(lang)
    for k in range(each.shape[1]):
        code = _mix(code, each[:, k])
    return code


def sieve(grams: DataFrame, n: int):
    """The broadcast filter of grams, n rows of one order. Tasks set bits; the driver gets the filter's words that
    are not 0, which its bound holds too."""
    bits = min(BITS_MOST, max(1 << 16, 1 << (n * BITS_EACH - 1).bit_length()))

    def run(batches):
        for b in batches:
            hashes = _phrase_hashes(b.column("lang"), b.column("phrase"))
            at = np.concatenate(Sieve.places(hashes, bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype("int64")), pa.array((np.uint64(1) << (at & np.uint64(63))).view("int64"))], names=["at", "bits"])

    found = grams.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype="uint64")
    words[found["at"].to_numpy()] = found["bits"].to_numpy().view("uint64")
    return grams.sparkSession.sparkContext.broadcast(words)


def _grams(batch: pa.RecordBatch, k: int, below: Sieve | None):
    """The weighted n-grams of order k of a batch of pieces: lang, phrase, f; those that the filter of the order below lets pass."""
    data, edges = text_bytes(batch.column("piece"))
    start, end = spans(IN_WORD[data], edges)
    words = strings(data, start, end).dictionary_encode()
    names, word = words.dictionary.cast(pa.string()), words.indices.to_numpy().astype("int64")
    piece = np.searchsorted(edges, start, side="right") - 1
    langs = batch.column("lang").dictionary_encode()
    lang, m = langs.indices.to_numpy()[piece].astype("int64"), batch.column("m").to_numpy()[piece]
    begin = np.arange(max(0, len(word) - k + 1))
    begin = begin[piece[begin] == piece[begin + k - 1]]
    if below is not None:
        hashes, of = _hash(names), _hash(langs.dictionary)
        # Both n-grams of the order below, of which the second begins a word later.
        code = of[lang]
        for j in range(k - 1):
            code[: len(word) - j] = _mix(code[: len(word) - j], hashes[word[j:]])
        passes = below.has(code)
        begin = begin[passes[begin] & passes[begin + 1]]
    width = max(1, len(names))
    for a in range(0, len(begin), PLACES):
        at = begin[a : a + PLACES]
        # Numbers of (lang, first words), then of those with a word more, so that keys stay within 64 bits.
        key = lang[at] * width + word[at]
        for j in range(1, k):
            key = np.unique(key, return_inverse=True)[1] * width + word[at + j]
        one, f = _added(key, m[at])
        one = at[one]
        phrase = names.take(pa.array(word[one]))
        for j in range(1, k):
            phrase = pc.binary_join_element_wise(phrase, names.take(pa.array(word[one + j])), " ")
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[one])), phrase, pa.array(f)], schema=_GRAM)


def _spill(spark: SparkSession) -> str | None:
    """Where buckets larger than memory go: a folder of the shared storage, if tasks see that as a file system."""
    uri = urlparse(fresh_dir(spark, "phrase-buckets"))
    return uri.path if uri.scheme in ("", "file") else None


def _bucket(spill: str | None, least: int, totals: bool):
    """A function that adds up the n-grams of a task's bucket in duckdb; keeps those that occur `least` times,
    and with totals, behind them, the sum of each language, with a null phrase."""

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
        if spill:
            con.execute(f"SET temp_directory = '{spill}/{TaskContext.get().taskAttemptId()}'")
        grams = pa.RecordBatchReader.from_batches(_GRAM, (pa.RecordBatch.from_arrays([b.column(c) for c in _GRAM.names], schema=_GRAM) for b in batches))  # noqa: F841
        con.execute("CREATE TEMP TABLE counted AS SELECT lang, phrase, CAST(sum(f) AS BIGINT) AS f FROM grams GROUP BY ALL" + ("" if totals else f" HAVING sum(f) >= {least}"))
        out = f"SELECT lang, phrase, f FROM counted WHERE f >= {least}"
        if totals:
            out += " UNION ALL SELECT lang, NULL, CAST(sum(f) AS BIGINT) FROM counted GROUP BY lang"
        for b in con.sql(out).to_arrow_reader(1 << 16):
            yield b.cast(_GRAM)
        con.close()

    return run


def count_grams(pieces: DataFrame, k: int, least: int, below=None) -> DataFrame:
    """lang, phrase, f of the n-grams of order k that occur at least `least` times; for k = 1 also a row with a
    null phrase for each bucket and language, with the bucket's share of its words."""
    spark = pieces.sparkSession
    in_arrow_batches(spark, 50_000)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        known = None if below is None else Sieve(below.value)
        for b in batches:
            yield from _grams(b, k, known)

    found = pieces.mapInArrow(lean(run), _DDL).repartition(buckets, "lang", "phrase")
    return materialize(found.mapInArrow(lean(_bucket(_spill(spark), least, k == 1)), _DDL), f"phrases-{k}")


def counted(docs: DataFrame, least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, k of all phrases of up to `longest` words that occur `least` times; lang, n of all words)."""
    pieces = materialize(pieces_of(docs), "phrase-pieces")
    first = count_grams(pieces, 1, least)
    sizes = first.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    orders = [first.where("phrase is not null")]
    for k in range(2, longest + 1):
        n = orders[-1].count()
        if not n:
            break
        filter_ = sieve(orders[-1], n)
        orders.append(count_grams(pieces, k, least, filter_))
        filter_.unpersist()
    out = orders[0].withColumn("k", F.lit(1))
    for k, rows in enumerate(orders[1:], 2):
        out = out.unionByName(rows.withColumn("k", F.lit(k)))
    return out, sizes


def _answered(grams: DataFrame) -> DataFrame:
    """A row for each part of each cut of each candidate: lang, phrase, a, k (words), cut, first (whether it is the
    first part), part, f (how often the part occurs)."""
    candidates = grams.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    front = F.expr("substring_index(phrase, ' ', cut)")
    parts = F.array(F.struct(F.lit(True).alias("first"), front.alias("part"), F.col("cut").alias("size")), F.struct(F.lit(False).alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("part"), (F.col("k") - F.col("cut")).alias("size")))
    asked = candidates.select("lang", "phrase", "a", "k", "cut", F.explode(parts).alias("p")).select("lang", "phrase", "a", "k", "cut", "p.*")
    asked = asked.withColumn("salt", F.when(F.col("size") == 1, F.pmod(F.hash("phrase"), F.lit(SALTS))).otherwise(0))
    salts = F.when(F.col("k") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = grams.select("lang", F.col("phrase").alias("part"), "f", F.explode(salts).alias("salt"))
    return asked.join(known, ["lang", "part", "salt"]).drop("salt")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, cut, l, r, n, score: each language's `top` phrases."""
    mine = mark()
    grams, sizes = counted(docs, least, longest)
    answered = materialize(_answered(grams), "phrase-parts")
    # What an n-gram one word longer says as often says it all: one longer still that does has one of these within.
    within = answered.where("size > 1 AND size = k - 1 AND f = a").select("lang", F.col("part").alias("phrase")).distinct()
    cuts = answered.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    cuts = join_spread(cuts, sizes, "lang", "phrase")
    wide = "CAST({} AS DECIMAL(19, 0))".format
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    left = best.join(within, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "b.cut", "b.l", "b.r", "n", "b.score")
    # First the best of each of SALTS parts of a language, so that no task ranks all of one.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    for by in (["lang", F.pmod(F.hash("phrase"), F.lit(SALTS))], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    done = materialize(left.select("lang", "rank", "phrase", "a", "cut", "l", "r", "n", "score"), "phrases")
    drop_from(docs.sparkSession, mine, keep=1)  # counts, pieces and requests
    return done
