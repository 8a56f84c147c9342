"""Packing of documents along a space-filling curve.

A document's ids, hashed into PLACES signed counts (square roots of counts, length 1), are projected to DIMS
dimensions by a fixed random matrix; the point's place on a Hilbert curve is the document's key. Documents
are sorted by key over range partitions, so that neighbours in a sequence tend to use the same ids, and
their ids are laid in a row and cut at every multiple of the sequence length. What remains behind the last
full sequence goes to sequences whose lengths are powers of two, which need no padding: no sequence does.

A text is encoded once. Its ids move once, to their range, as 16-bit numbers if the vocabulary allows and as
32-bit ones else; each part's rows carry how many ids stand before them in the part, so that the whole order needs
only the parts' sums (one row a part). The ids as first written are deleted once the parts are.

Defined cases: null and empty text have the end id alone; rows of equal key and text stand together by doc_id,
a null doc_id first, and repeated rows are rows of their own, whom a stored number tells apart, so that any
number of equal rows can be split over parts; an empty table gives an empty result. Further columns of docs
are ignored. Points don't depend on other documents, so an added document moves no other one's key.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_from, in_arrow_batches, lean, mark, materialize
from .segments import shared, tokenizer_path

#: Places of a hashed vector, dimensions it is projected to, and bits of each on the curve (63 in all).
PLACES, DIMS, BITS = 1024, 3, 21
#: Coordinates beyond this many standard deviations lie on the curve's edge.
REACH = 4.0
SEED = 13
LENGTH = 2048


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of points, whole numbers below 2 ** bits.

    From the highest bit down, each dimension's bit tells whether the low bits of the first are inverted or
    exchanged with its own, which turns the cell's curve to where it enters the cell; what is left is the Gray
    code of the place, its bits interleaved."""
    x = points.astype("uint64").T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = np.uint64((1 << bit) - 1)
        for d in range(n):
            one = (x[d] >> np.uint64(bit)) & np.uint64(1) == 1
            swap = np.where(one, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(one, low, swap)
            x[d] ^= swap
    code = np.zeros(x.shape[1], dtype="uint64")
    for bit in range(bits - 1, -1, -1):
        for d in range(n):
            code = code << np.uint64(1) | (x[d] >> np.uint64(bit)) & np.uint64(1)
    # From Gray code to number: the exclusive or of all bits above.
    for step in (1, 2, 4, 8, 16, 32):
        code ^= code >> np.uint64(step)
    return code


def project(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A point of whole numbers for each run of ids: hashed, signed, projected. A run without ids is at the centre."""
    matrix = np.random.default_rng(SEED).standard_normal((PLACES, DIMS))
    hashed = ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    place, sign = (hashed >> np.uint64(54)).astype("int64"), 1.0 - 2.0 * ((hashed >> np.uint64(53)) & np.uint64(1)).astype("float64")
    points = np.zeros((len(sizes), DIMS))
    ends = np.cumsum(sizes)
    for a in range(0, len(sizes), 256):  # a few vectors at a time
        b = min(len(sizes), a + 256)
        lo, hi = int(ends[a] - sizes[a]), int(ends[b - 1])
        row = np.repeat(np.arange(b - a), sizes[a:b])
        sums = np.bincount(row * PLACES + place[lo:hi], sign[lo:hi], (b - a) * PLACES).reshape(b - a, PLACES)
        vectors = np.sign(sums) * np.sqrt(np.abs(sums))
        norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        points[a:b] = (vectors / np.maximum(norm, 1e-12)) @ matrix
    scaled = (np.clip(points, -REACH, REACH) + REACH) / (2 * REACH)
    return np.minimum((scaled * (1 << BITS)).astype("int64"), (1 << BITS) - 1)


_ENCODED = "doc_id long, key long, tie long, n long, width int, ids binary"


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """docs(doc_id, text) -> doc_id, key (place on the curve), tie (of the ids), n, width, ids (little-endian, of
    width bytes each)."""
    in_arrow_batches(docs.sparkSession, 2000)
    path = tokenizer or tokenizer_path()

    def run(batches):
        pieces = shared(path)
        width = 2 if max(pieces.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for b in batches:
            ids, sizes = pieces.encode(b.column("text"))
            key = hilbert(project(ids, sizes), BITS).astype("int64")
            sizes = sizes + 1
            flat = np.full(int(sizes.sum()), end_id, dtype=f"<u{width}")
            keep = np.ones(len(flat), dtype=bool)
            keep[np.cumsum(sizes) - 1] = False
            flat[keep] = ids
            ends = np.append(0, np.cumsum(sizes) * width)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype("int64")), pa.py_buffer(flat)])
            view = memoryview(flat).cast("B")
            tie = [zlib.crc32(view[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(key), pa.array(tie, pa.int64()), pa.array(sizes), pa.array(np.full(len(sizes), width, dtype="int32")), data.cast(pa.binary())], names=["doc_id", "key", "tie", "n", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _ENCODED)


def laid_out(rows: DataFrame, ids_per_part: int = 1 << 24, max_parts: int = 1 << 16) -> DataFrame:
    """rows of encoded() in curve order: part, before (ids before it in its part), doc_id, n, width, ids."""
    first = mark()
    # Written with a number of their own, so that rows equal in all else can be told apart.
    stored = materialize(rows.withColumn("u", F.monotonically_increasing_id()), "packing-ids", compression="zstd")
    total = stored.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(max_parts, -(-total // ids_per_part)), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LENGTH))
    order = ["key", "tie", "doc_id", "u"]
    ranged = stored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        before = 0
        for b in batches:
            n = b.column("n").to_numpy()
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(at), b.column("doc_id"), *[b.column(c) for c in ("n", "width", "ids")]], names=["part", "before", "doc_id", "n", "width", "ids"])

    # A part is one task's rows in order.
    placed = ranged.select("part", "doc_id", "n", "width", "ids").mapInArrow(run, "part int, before long, doc_id long, n long, width int, ids binary")
    done = materialize(placed, "packing-parts", compression="zstd")
    drop_from(rows.sparkSession, first, keep=1)
    return done


def tail_of(total: int, length: int = LENGTH) -> list[int]:
    """Where the sequences behind the last full one begin, and the end of all: lengths are powers of two."""
    at = total - total % length
    starts = [at]
    for bit in reversed(range(length.bit_length())):
        if (total - starts[0]) >> bit & 1:
            at += 1 << bit
            starts.append(at)
    return starts


def pieces_of(at: np.ndarray, n: np.ndarray, total: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of documents that begin at these places: (document, start, length, sequence, offset) of each piece."""
    full, tail = total // length, np.array(tail_of(total, length), dtype="int64")

    def sequence(p):
        return np.where(p < full * length, p // length, full + np.searchsorted(tail, p, side="right") - 1)

    def begin(s):
        return np.where(s <= full, s * length, tail[np.clip(s - full, 0, len(tail) - 1)])

    first = sequence(at)
    count = sequence(at + n - 1) - first + 1
    doc = np.repeat(np.arange(len(at)), count)
    seq = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    lo, hi = np.maximum(at[doc], begin(seq)), np.minimum((at + n)[doc], begin(seq + 1))
    return doc, lo - at[doc], hi - lo, seq, lo - begin(seq)


def pieces(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """parts of laid_out() -> doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 32 bits) of each piece."""
    sums = parts.groupBy("part").agg(F.sum("n").alias("n"))  # at most max_parts rows
    total = sums.agg(F.sum("n")).first()[0] or 0
    sums = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    based = parts.join(F.broadcast(sums), "part").select((F.col("base") + F.col("before")).alias("at"), "doc_id", "n", "width", "ids")
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            doc, start, size, seq, offset = pieces_of(b.column("at").to_numpy(), n, total, length)
            # A document's pieces cover its ids in order, so the ids of the batch stay as they are, in other runs.
            ids = b.column("ids")
            begin = int(np.frombuffer(ids.buffers()[1], dtype="int32")[ids.offset])
            wide = np.frombuffer(ids.buffers()[2], dtype=f"<u{b.column('width')[0].as_py()}", offset=begin, count=int(n.sum())).astype("<u4")
            cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(4 * np.append(0, np.cumsum(size))), pa.py_buffer(wide)])
            arrays = [b.column("doc_id").take(pa.array(doc)), *[pa.array(x, pa.int64()) for x in (start, size, n[doc], seq, offset)], cut.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "ids"])

    return based.mapInArrow(lean(run), ", ".join(f"{c} long" for c in names) + ", ids binary")


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> the pieces of all sequences, with their ids."""
    return pieces(laid_out(encoded(docs, tokenizer, end_id)), length)
