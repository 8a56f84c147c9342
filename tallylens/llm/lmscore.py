"""Stupid-backoff scores of documents under the counts of all other documents.

Three relations meet by key. Exploded n-grams: each Arrow batch of documents gives, for every order, its
distinct n-gram hashes with their counts, cut by hash range into buckets. Count tables: a bucket adds up
the counts of all batches and answers each batch with the totals of just the n-grams that it asked for.
Documents: a batch's word sequences meet its answers by a digest of the batch's words, a document's own
counts are taken off the totals, and its n-grams' scores are summed. Word sequences move once: they are read
anew for this and don't go through the buckets. Should the rows then come in other batches, the run fails.

An n-gram seen elsewhere scores count / count of its context, otherwise BACKOFF times the score of the
next shorter one; a word seen nowhere else scores BACKOFF / (all other words).

Counts are pre-added per batch before they move, so the most frequent word costs one entry a batch and
bucket, and a bucket holds about bucket_bytes / 8 distinct n-grams of all batches (there are the more
buckets, the longer the order).

Words are runs of other than ASCII white space, A-Z in lower case. Defined cases: null and wordless text
has 0 words, log_score 0 and a null mean; repeated rows are documents of their own and see each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow_batches, lean, materialize

BACKOFF = 0.4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: The bits of an n-gram's hash that move, for n of 2 and more: 56. Of d distinct n-grams a share of d / 2^56
#: meets another one's count, 1.4e-5 of a million million.
_KEPT = np.uint64(((1 << 56) - 1) << 8)
_ROWS = "kind int, key long, batch long, part int, a binary, b binary, c binary, ids array<long>, known array<boolean>"


def _hashed(text: bytes | None) -> np.ndarray:
    """The words' hashes."""
    words = text.translate(_LOWER).split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="uint64", count=len(words))


def longer(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that are one word longer: h of the first n - 1 words, then a word's hash."""
    x = h * _MULTIPLY + words
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(x: np.ndarray) -> bytes:
    """Integers by planes of bytes, compressed, so that high bytes cost next to nothing."""
    x = x.astype("<u8")
    planes = np.ascontiguousarray(x.view("uint8").reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = _ZSTD.decompress(data[8:], decompressed_size=8 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, dtype="uint8").reshape(8, -1).T).view("<u8").reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype="uint64")


def grams(words: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order: the hash of the n-gram that ends at each word; 0 where the text begins later."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(words))
    out, last = [words], words
    for n in range(2, order + 1):
        h = np.zeros(len(words), dtype="uint64")
        ok = at - starts >= n - 1
        h[ok] = longer(last[np.flatnonzero(ok) - 1], words[ok])
        out.append(h & _KEPT)
        last = h
    return out


def others(h: np.ndarray, ends: np.ndarray, totals: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place: how often other documents have the n-gram that ends there, 0 where none ends.
    totals: the counts of h's sorted distinct n-grams in all documents."""
    at = np.flatnonzero(ends)
    _, which, here = np.unique(h[at], return_inverse=True, return_counts=True)
    own = np.ones(len(at), dtype="int64")
    many = np.flatnonzero(here[which] > 1)  # what the batch has once, its document has once
    _, again, n = np.unique(doc[at[many]] * np.int64(len(here) + 1) + which[many], return_inverse=True, return_counts=True)
    own[many] = n[again]
    out = np.zeros(len(h), dtype="int64")
    out[at] = totals.astype("int64")[which] - own
    return out


def score(found: list[np.ndarray], totals: list, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of logs without those of the corpus's size, words scored by it, words backed off), per document.
    totals: for each order the counts of its sorted distinct hashes."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rest = [others(h, h != 0 if n else np.ones(len(h), dtype=bool), counts, doc) for n, (h, counts) in enumerate(zip(found, totals, strict=True))]
    logs, open_ = np.zeros(len(doc)), np.ones(len(doc), dtype=bool)
    factor = np.zeros(len(doc))
    for n in range(len(found) - 1, 0, -1):
        exists = found[n] != 0
        hit = open_ & exists & (rest[n] > 0)
        context = rest[n - 1][np.flatnonzero(hit) - 1]
        logs[hit] = factor[hit] + np.log(rest[n][hit] / np.maximum(context, 1))
        open_ &= ~hit
        factor[open_ & exists] += np.log(BACKOFF)
    seen = open_ & (rest[0] > 0)
    logs[seen] = factor[seen] + np.log(rest[0][seen])
    none = open_ & ~seen
    logs[none] = factor[none] + np.log(BACKOFF)
    n = len(sizes)
    return np.bincount(doc, logs, n), np.bincount(doc, open_, n).astype("int64"), np.bincount(doc, (factor < 0) | none, n).astype("int64")


def score_documents(docs: DataFrame, *, order: int = 3, bucket_bytes: int = 12 << 20, batch_rows: int = 2500) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, log_score, mean_log_score, n_backed_off."""
    in_arrow_batches(docs.sparkSession, batch_rows)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size * order // (2 * bucket_bytes)))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()))

    def read(batches):
        """Of each batch: itself, its digest, its word hashes in a row and its documents' sizes in words."""
        for b in batches:
            each = [_hashed(t.as_py()) for t in b.column("text").cast(pa.binary())]
            sizes = np.array([len(x) for x in each], dtype="int64")
            words = np.concatenate(each) if each else np.zeros(0, dtype="uint64")
            del each
            yield b, xxhash.xxh3_64_intdigest(sizes.tobytes() + words.tobytes()) >> 1, words, sizes

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "key", "batch", "part", "a", "b", "c", "ids", "known"])

    def sequences(batches):
        for b, number, words, sizes in read(batches):
            keys, at = np.unique(words, return_inverse=True)
            yield packed([(1, 0, number, 0, pack_sorted(keys), pack(at), pack(sizes), b.column("doc_id").fill_null(0).to_pylist(), b.column("doc_id").is_valid().to_pylist())])

    def explode(batches):
        for _, number, words, sizes in read(batches):
            rows = []
            for n, h in enumerate(grams(words, sizes, order)):
                keys, counts = np.unique(h[h != 0] if n else h, return_counts=True)
                # Equal ranges of the hash's upper half; only those that the batch has n-grams in.
                bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                ends = np.flatnonzero(np.diff(bucket, append=np.uint64(buckets)))
                for a, e in zip(np.append(0, ends + 1), ends + 1, strict=False):
                    rows.append((0, int(bucket[a]), number, n, pack_sorted(keys[a:e]), pack(counts[a:e]), None, None, None))
            if rows:
                yield packed(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def answer(table: pa.Table) -> pa.Table:
        parts, asks, counts = table.column("part").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist()
        replies: list = [None] * len(parts)
        for part in set(parts):
            who = [k for k, p in enumerate(parts) if p == part]
            keys = [unpack_sorted(asks[k]) for k in who]
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([unpack(counts[k]) for k in who]))
            ends = np.cumsum([len(x) for x in keys])
            for k, e, x in zip(who, ends, keys, strict=True):
                replies[k] = pack(total[inverse[e - len(x) : e]].astype("uint64"))
        table = table.set_column(table.schema.get_field_index("b"), "b", pa.array(replies, pa.binary()))
        return table.set_column(table.schema.get_field_index("a"), "a", pa.nulls(len(table), pa.binary()))

    answered = texts.mapInArrow(lean(explode), _ROWS).groupBy("key").applyInArrow(answer, _ROWS)

    def finish(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_pylist()
        mains = [i for i, t in enumerate(kind) if t]
        # Batches of equal words meet here together, and their answers are equal.
        replies = {(p, k): i for i, (p, k, t) in enumerate(zip(table.column("part").to_pylist(), table.column("key").to_pylist(), kind, strict=True)) if not t}
        if not mains:
            raise ValueError("the documents came in other batches when they were read anew")
        keys = unpack_sorted(table.column("a")[mains[0]].as_py())
        words, sizes = keys[unpack(table.column("b")[mains[0]].as_py()).astype("int64")], unpack(table.column("c")[mains[0]].as_py()).astype("int64")
        if len(words) and not replies:
            raise ValueError("the documents came in other batches when they were read anew")
        found = grams(words, sizes, order)
        totals = []
        for n in range(order):
            counts = [unpack(table.column("b")[i].as_py()) for (p, _), i in sorted(replies.items()) if p == n]
            totals.append(np.concatenate(counts) if counts else np.zeros(0, dtype="uint64"))
        logs, by_size, backed = score(found, totals, sizes)
        out = []
        for main in mains:
            ids = table.column("ids")[main].as_py()
            known = np.array(table.column("known")[main].as_py(), dtype=bool)
            out.append(pa.table({"doc_id": pa.array(np.array(ids, dtype="int64"), mask=~known), "n_words": sizes, "logs": logs, "by_size": by_size, "n_backed_off": backed}))
        return pa.concat_tables(out)

    done = answered.union(texts.mapInArrow(lean(sequences), _ROWS)).groupBy("batch").applyInArrow(finish, "doc_id long, n_words long, logs double, by_size long, n_backed_off long")
    done = materialize(done, "lm-scores")
    total = done.agg(F.sum("n_words")).first()[0] or 0
    log_score = F.col("logs") - F.col("by_size") * F.log(F.greatest(F.lit(1), F.lit(total) - F.col("n_words")).cast("double"))
    done = done.withColumn("log_score", log_score)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return done.select("doc_id", "n_words", "log_score", mean.alias("mean_log_score"), "n_backed_off")
