"""How the sources of each language differ in their words: wide term vectors.

Every row's terms are counted by (lang, source, term), in Arrow batches and before the shuffle; a language's counts
of a term are then pivoted into one array with a place for each of the language's sources. From such a
vector alone, higher-order functions give the shares of all sources and what the term adds to the divergence
of every pair of sources; those contributions are added up per pair, again in each task first. All numbers
are whole and all arithmetic is exact.

The vectors of a language are as long as it has sources, and its result has a row for each ordered pair of
them, so sources are taken to be few; documents, terms and languages may be any number. What is known about
a language (its sources, their sizes) is broadcast to its terms if its measured size allows, and else joined so
that a language which holds most terms is spread.

Defined cases: null text, lang and source are empty; a row is a document, whatever its doc_id, so repeated
rows count again; a group without terms takes part with counts of 0; a language without kept terms has pairs
of value 0 and no term rows; a language of one source has no pairs; an empty table gives an empty result.
Counts may reach 9e15 (checked: Spark's ANSI arithmetic raises an error on overflow).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_from, in_arrow_batches, join_spread, lean, mark, materialize
from .words import LETTERS, tokens

SCALE = 1_000_000_000


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n (occurrences) and docs (rows that hold the term) of the rows of one batch."""
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    pairs = langs.indices.to_numpy().astype("int64") * len(sources.dictionary) + sources.indices.to_numpy()
    words, row = tokens(batch.column("text"), LETTERS)
    terms = words.dictionary_encode()
    names, width = terms.dictionary, len(terms.dictionary)
    # First the terms of each row, then those of each (lang, source).
    cell, n = np.unique(row * width + terms.indices.to_numpy(), return_counts=True)
    group, place = np.unique(pairs[cell // max(1, width)] * width + cell % max(1, width), return_inverse=True)
    pair = group // max(1, width)
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(pair // max(1, len(sources.dictionary)))),
            sources.dictionary.take(pa.array(pair % max(1, len(sources.dictionary)))),
            names.take(pa.array(group % max(1, width))),
            pa.array(np.bincount(place, n, len(group)).astype("int64")),
            pa.array(np.bincount(place, minlength=len(group))),
        ],
        schema=_COUNTS,
    )


def _named(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", *more)])


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text) -> lang, source, term, n (occurrences), docs (rows that hold it)."""
    in_arrow_batches(docs.sparkSession, 4000)
    found = _named(docs, "text").mapInArrow(lean(lambda batches: map(_count_batch, batches)), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups(docs: DataFrame) -> DataFrame:
    """The sources of each language, in order."""
    return _named(docs).distinct().groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))


def _join_lang(terms: DataFrame, langs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of terms with the columns of their language's one row."""
    most = groups.agg(F.max(F.size("sources") + 1)).first()[0] or 0
    return join_spread(terms, langs, "lang", "term", most)


def _share(n: str, of: str) -> str:
    """1 + floor(SCALE * n / of) for 0 <= n <= of, thousand by thousand, so that no product passes 64 bits."""
    first = f"(1000L * ({n}))"
    second = f"(1000L * ({first} % ({of})))"
    third = f"(1000L * ({second} % ({of})))"
    return f"1L + 1000000L * ({first} div ({of})) + 1000L * ({second} div ({of})) + {third} div ({of})"


def _divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def vectors(counts: DataFrame, groups: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, n (occurrences by the place of the source), total; terms in at least min_docs documents."""
    # As many parts as the session shuffles into, since what is done with a small vector is much.
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pivoted = counts.repartition(parts, "lang", "term").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by"))
    kept = pivoted.where(F.col("docs") >= min_docs)
    return _join_lang(kept, groups, groups).select("lang", "term", F.expr("transform(sources, s -> coalesce(try_element_at(by, s), 0L))").alias("n"), "total")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """docs(lang, source, text) -> lang, source, part, item, value, rank. Part `pair`: how far each other source
    of the language is; part `term`: the `top` terms that the source has more of than its language, by how much
    they add. Further columns of docs are ignored."""
    mine = mark()
    groups = materialize(_groups(docs), "divergence-groups")
    wide = materialize(vectors(term_counts(docs), groups, min_docs), "divergence-vectors")
    # Behind the sums of the sources: that of the language, and the number of its kept terms.
    sums = wide.select("lang", F.posexplode(F.concat("n", F.array("total", F.lit(1).cast("long")))).alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    sums = sums.groupBy("lang").agg(F.expr("transform(sort_array(collect_list(struct(at, n))), x -> x.n)").alias("sums"))
    sums = sums.select("lang", F.expr("transform(sums, x -> x + 2 * element_at(sums, -1))").alias("below"))
    shares = _join_lang(wide, groups.join(sums, "lang"), groups).select(
        "lang",
        "term",
        "sources",
        "n",
        F.expr(f"transform(n, (x, i) -> {_share('x + 2', 'below[i]')})").alias("p"),
        F.expr(_share("total + 2", "below[size(sources)]")).alias("q"),
    )
    shares = materialize(shares, "divergence-shares")
    done = materialize(_pairs(shares, groups).unionByName(_terms(shares, top)), "divergence")
    drop_from(docs.sparkSession, mine, keep=1)  # vectors and shares
    return done


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    # A term's contributions to all unordered pairs, in the order (0, 1), (0, 2), ..., (1, 2), ...
    each = f"transform(slice(p, i + 2, size(p)), y -> {_divergence('x', 'y')})"
    emitted = shares.select("lang", F.expr(f"flatten(transform(p, (x, i) -> {each}))").alias("f"))
    found = emitted.select("lang", F.posexplode("f").alias("at", "f")).groupBy("lang", "at").agg(F.sum("f").alias("f"))
    # All ordered pairs, those of languages without kept terms too.
    pairs = groups.select("lang", "sources", F.posexplode("sources").alias("a", "source")).select("lang", F.size("sources").alias("s"), "a", "source", F.posexplode("sources").alias("b", "item"))
    place = "least(a, b) * s - (least(a, b) * (least(a, b) + 1)) div 2 + greatest(a, b) - least(a, b) - 1"
    pairs = pairs.where("a <> b").withColumn("at", F.expr(place).cast("int"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        pairs.join(found, ["lang", "at"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).cast("long").alias("value"))
        .withColumn("rank", F.row_number().over(order))
    )


def _terms(shares: DataFrame, top: int) -> DataFrame:
    more = f"transform(p, (x, i) -> struct(sources[i] AS source, n[i] > 0 AND x > q AS more, {_divergence('x', 'q')} AS f))"
    each = shares.select("lang", F.col("term").alias("item"), F.explode(F.expr(f"filter({more}, x -> x.more)")).alias("e"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = each.select("lang", "e.source", F.lit("term").alias("part"), "item", F.col("e.f").alias("value")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top)
