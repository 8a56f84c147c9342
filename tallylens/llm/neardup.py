"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one class. Classes meet in the buckets of banded MinHash
signatures. In a first round every class of a bucket is compared with the bucket's hub alone; verified
links give components, and most buckets then lie in one component. Where they don't, a second round
compares the bucket's classes across components: those of a small bucket by listing the pairs, those of a
large one in tiles that hold the full sets, verify in place and give only the links that join components.
A comparison looks at signatures in batches and gives a pair up when the posterior probability that its similarity reaches the threshold falls below `miss`;
survivors are verified on their full sets, which are built from the texts of just these classes.
Components come from alternating large-star and small-star steps.

So no group is expanded into all its pairs, a group of copies is one class, and a bucket of any size is
shared out in tiles. Candidates are lost only with the chance that no band meets (5e-6 at the threshold,
less above it) or that a test gives up wrongly.

Defined cases: null text and text without words has an empty set and is linked with nothing; fewer
words than a shingle make one shingle; repeated rows are in one class; of rows with an equal doc_id and
text all are kept or none.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_from, in_arrow_batches, lean, mark, materialize

WORDS, THRESHOLD = 5, 0.75
BANDS, ROWS = 32, 4
BATCH = 16
#: Classes of a bucket whose pairs the second round lists, and of a larger one that half a tile holds.
SMALL, TILE = 32, 512
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(97)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype="uint32") | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype="uint32")[:, None]


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype="uint64")
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype="uint64")
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="uint64", count=len(words))
    n = len(w) - WORDS + 1
    h = w[:n].copy()
    for j in range(1, WORDS):
        h *= _MULTIPLY
        h += w[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    x = (h >> np.uint64(11)).astype("uint32")
    out = np.full(len(_A), 0xFFFFFFFF, dtype="uint32")
    for at in range(0, len(x), 2048):
        y = x[at : at + 2048] * _A
        y += _B
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        np.minimum(out, y.min(1), out=out)
    return out


def least_matches(miss: float) -> np.ndarray:
    """For n = BATCH, 2 BATCH, ... compared places: the fewest matches at which the posterior probability
    of similarity >= THRESHOLD, from a uniform prior, is still `miss`. Places match by chance with 1/256,
    as one byte of each is compared."""
    x = THRESHOLD + (1 - THRESHOLD) / 256
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def surviving(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs of signature rows are not given up."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype="int32")
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of text), n, key (of the shingle set), bands, sig (a byte of each place)."""
    in_arrow_batches(docs.sparkSession)
    base = np.uint64(0x9FB21C651E98DF25)

    def run(batches):
        for b in batches:
            n, keys, bands, sigs = [], [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                h = shingles(t)
                n.append(len(h))
                if not len(h):
                    keys.append(None), bands.append(None), sigs.append(None)
                    continue
                keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                s = signature(h)
                x = np.arange(BANDS, dtype="uint64")
                for j in range(ROWS):
                    x = (x ^ s[j::ROWS].astype("uint64")) * base
                    x ^= x >> np.uint64(31)
                bands.append(x.view("int64"))
                sigs.append((s >> np.uint32(7)).astype("uint8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("t"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "t", "n", "key", "bands", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, t long, n long, key binary, bands array<long>, sig binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="uint8").reshape(len(column), BANDS * ROWS)


def _sets(keys: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """key, set (sorted 64-bit hashes) of the given distinct keys, from one document's text of each."""
    who = keys.join(classes.select("key", "doc_id", "t"), "key")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    text = text.join(who, text["doc_id"].eqNullSafe(who["doc_id"]) & (text["t"] == who["t"])).select("key", "text")

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([shingles(t).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())], names=["key", "set"])

    return materialize(text.mapInArrow(lean(sets), "key binary, set binary").dropDuplicates(["key"]), "dup-sets")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs(a, b) of keys whose full sets reach the threshold."""
    have = _sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), classes, docs)
    both = pairs.join(have.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(have.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype="uint64"), np.frombuffer(y, dtype="uint64")
                if len(x) > len(y):
                    x, y = y, x
                met = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * met >= 75 * (len(x) + len(y) - met))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(lean(check), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> key, label: the least key of each key's component; keys without edges are left out."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    first = mark()
    edges = materialize(edges, "dup-edges")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u != v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = materialize(small, "dup-edges")
        # It is done when no key has two neighbours below it and no key is both below and above another.
        more = small.groupBy("u").count().where("count > 1").limit(1).count() or small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        edges = small
        drop_from(edges.sparkSession, first, keep=1)  # earlier rounds' edges
        if not more:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def _halves(column: pa.Array) -> np.ndarray:
    """16-byte values as pairs of numbers in their order."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").reshape(-1, 2)


def _listed(least: np.ndarray):
    """Of small buckets, whose rows come together: pairs of classes of different components that no test gives
    up. Pairs with the hub have been verified before. All buckets of a batch are worked on at once."""

    def survivors(t: pa.RecordBatch) -> pa.RecordBatch:
        bucket, n = t.column("bucket").to_numpy(), len(t)
        edge = np.flatnonzero(np.diff(bucket, append=bucket[-1:] + 1))
        later = np.repeat(edge, np.diff(edge, prepend=-1)) - np.arange(n)  # rows of the bucket after each row
        i = np.repeat(np.arange(n), later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        key, label, hub = (_halves(t.column(c)) for c in ("key", "label", "hub"))
        free = (key != hub).any(1)
        keep = free[i] & free[j] & (label[i] != label[j]).any(1)
        i, j, sig = i[keep], j[keep], _matrix(t.column("sig").to_pylist())
        keep = np.concatenate([surviving(sig[i[a : a + (1 << 18)]], sig[j[a : a + (1 << 18)]], least) for a in range(0, max(1, len(i)), 1 << 18)])
        i, j = i[keep], j[keep]
        swap = (key[i, 0] > key[j, 0]) | ((key[i, 0] == key[j, 0]) & (key[i, 1] > key[j, 1]))
        column = t.column("key")
        return pa.RecordBatch.from_arrays([column.take(pa.array(np.where(swap, j, i))), column.take(pa.array(np.where(swap, i, j)))], names=["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            if not len(t):
                continue
            bucket = t.column("bucket").to_numpy()
            end = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            held = t.slice(end).combine_chunks().to_batches()[0]
            if end:
                yield survivors(t.slice(0, end).combine_chunks().to_batches()[0])
        if held is not None:
            yield survivors(held)

    return run


def _across(least: np.ndarray):
    """Of a tile of a large bucket: verified links between components, one for each two that they join."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, key, bands = _matrix(pdf["sig"]), pdf["key"].to_numpy(), np.stack(pdf["bands"].to_numpy())
        label, names = pd.factorize(pdf["label"])
        root = np.arange(len(names))
        # The band in which each class is in the bucket; by a collision of hashes it may not be one for all.
        column = (bands == pdf["bucket"].iloc[0]).argmax(1)
        sets = [np.frombuffer(x, dtype="uint64") for x in pdf["set"]]
        sizes = np.array([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(sizes) - sizes
        mark = np.zeros(int(ids.max()) + 1, dtype=bool)
        i, j, tile = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), pdf["tile"].to_numpy()
        rest = key != pdf["hub"].iloc[0]
        left, right, out = np.flatnonzero((tile == i) & rest), np.flatnonzero((tile == j) & rest), []
        for p in left:
            q = right[(root[label[right]] != root[label[p]]) & ((right > p) | (i != j))]
            # A pair that meets in an earlier band is compared there.
            q = q[~(bands[q, : column[p]] == bands[p, : column[p]]).any(1)]
            q = q[surviving(np.broadcast_to(sig[p], (len(q), sig.shape[1])), sig[q], least)] if len(q) else q
            if not len(q):
                continue
            own = ids[first[p] : first[p] + sizes[p]]
            mark[own] = True
            n = sizes[q]
            at = np.repeat(first[q] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            met = np.add.reduceat(mark[ids[at]].astype("int64"), np.cumsum(n) - n)
            mark[own] = False
            for x in q[100 * met >= 75 * (sizes[p] + n - met)]:
                a, b = root[label[p]], root[label[x]]
                if a != b:
                    root[root == b] = a
                    out.append((key[p], key[x]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def groups(docs: DataFrame, miss: float = 1e-6) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, t, n_shingles, component_id, kept."""
    least = least_matches(miss)
    first_id = F.struct(F.col("doc_id").isNull(), "doc_id", "t")
    rows = materialize(signatures(docs), "dup-rows")
    # One row for each class; what belongs to its set is equal in all its rows.
    classes = rows.where("key is not null").groupBy("key").agg(F.min(first_id).alias("d"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialize(classes.select("key", "d.doc_id", "d.t", "bands", "sig"), "dup-classes")
    bands = classes.select(F.explode("bands").alias("bucket"), "key")
    full = bands.groupBy("bucket").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(bands.join(full, "bucket").select("bucket", "key", "hub", "size"), "dup-members")
    signs = classes.select("key", "sig")
    pairs = members.where("key != hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = pairs.join(signs.select(F.col("key").alias("a"), F.col("sig").alias("x")), "a").join(signs.select(F.col("key").alias("b"), F.col("sig").alias("y")), "b")

    def test(batches):
        for b in batches:
            if len(b):
                x, y = (_matrix(b.column(c).to_pylist()) for c in ("x", "y"))
                yield b.select(["a", "b"]).filter(pa.array(surviving(x, y, least), pa.bool_()))

    pairs = materialize(pairs.select("a", "b", "x", "y").mapInArrow(lean(test), "a binary, b binary"), "dup-pairs")
    links = materialize(_verified(pairs, classes, docs), "dup-links")
    label = components(links)
    # Second round: buckets that hold more than one component.
    marked = members.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    marked = materialize(marked, "dup-marked")
    open_ = marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    marked = marked.join(open_, "bucket")
    few = materialize(marked.where(F.col("size") <= SMALL).join(signs, "key").select("bucket", "key", "hub", "label", "sig"), "dup-few")
    few = few.repartition(max(1, -(-few.count() // 4096)), "bucket").sortWithinPartitions("bucket")
    late = materialize(few.mapInArrow(lean(_listed(least)), "a binary, b binary").distinct(), "dup-late")
    more = _verified(late, classes, docs)
    many = materialize(marked.where(F.col("size") > SMALL), "dup-many")
    if many.limit(1).count():
        have = _sets(many.select("key").distinct(), classes, docs).join(classes.select("key", "bands", "sig"), "key")
        tiled = many.join(have, "key").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
        tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "key", "hub", "label", "sig", "bands", "set")
        more = more.union(tiled.groupBy("bucket", "i", "j").applyInPandas(_across(least), "a binary, b binary"))
    more = materialize(more, "dup-links")
    if more.limit(1).count():
        label = components(links.union(more))
    ids = classes.join(label, "key", "left").select("key", "doc_id", "t", F.coalesce("label", "key").alias("label"))
    ids = materialize(ids, "dup-labels")
    first = ids.groupBy("label").agg(F.min(first_id).alias("head"))
    ids = ids.join(first, "label").select("key", F.col("head.doc_id").alias("component_id"), F.col("head.t").alias("component_t"))
    out = rows.select("doc_id", "t", "n", "key").join(ids, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), (F.col("key").isNull() | (F.col("t") == F.col("component_t"))).alias("head"))


def deduplicated(docs: DataFrame, miss: float = 1e-6) -> DataFrame:
    """The rows of docs that stay, one of each group; all columns stay, whatever their names. Of rows with an
    equal doc_id and text one stays."""
    number = lambda c: F.struct(c.isNull().alias("no"), F.coalesce(c.cast("long"), F.lit(0)).alias("id"))
    stay = groups(docs, miss).where("kept and head").select(number(F.col("doc_id")).alias("id"), "t").distinct()
    # Repeated rows meet before they move, and the join finds them where they are.
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    whole = docs.select(number(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("t"), row).groupBy("id", "t").agg(F.first("row").alias("row"))
    return whole.join(stay, ["id", "t"], "left_semi").select("row.*")
