"""Token-id files in Simple-8b words.

A file is a run of blocks of at most BLOCK ids. A block is a run of little-endian 64-bit words: the top
four bits select how many ids of which width the other 60 hold (selector k: _COUNTS[k] ids of
60 // _COUNTS[k] bits, first id lowest); selector 15 is an escape, and the word after it is one id as it
is. The footer holds each group's place, each block's first word and first id, and each document's id
and size; then come its length and the magic bytes. Blocks are decoded without looking at each other.

Parts are ranges of doc_id in ascending order. A part is written under a name of its own and renamed
when whole, so that a task that runs twice leaves the same one file.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, in_arrow_batches, lean, materialize
from .segments import shared, tokenizer_path

BLOCK = 1024
MAGIC = b"TLS8B-01"
#: How many ids of equal width 60 bits hold: each count once, with its greatest width.
_COUNTS = sorted({60 // w for w in range(1, 61)}, reverse=True)
_WIDTHS = [60 // n for n in _COUNTS]
ESCAPE = 15


#: Blocks encoded together, which bounds the memory of encoding.
STRIP = 512


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids."""
    words, firsts, place = [np.zeros(0, dtype="<u8")], [np.zeros(0, dtype="int64")], 0
    for at in range(0, len(ids), STRIP * block):
        more, first = _encode_strip(ids[at : at + STRIP * block], block)
        words.append(more)
        firsts.append(first + place)
        place += len(more)
    return np.concatenate(words), np.concatenate(firsts)


def _encode_strip(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    ids = ids.astype("uint64")
    blocks = -(-len(ids) // block)
    room = _COUNTS[0]
    grid = np.zeros((blocks, block + room), dtype="uint64")
    flat = np.zeros(blocks * block, dtype="uint64")
    flat[: len(ids)] = ids
    grid[:, :block] = flat.reshape(blocks, block)
    bits = _bit_length(grid)
    width = block + room
    line = bits.reshape(-1)
    line = np.concatenate([line, np.zeros(room, dtype="uint8")])
    best = np.full(blocks * width, ESCAPE, dtype="uint8")
    power, of = 1, {1: line}
    while power * 2 <= room:
        x = of[power]
        of[power * 2] = np.maximum(x[: len(x) - power], x[power:])
        power *= 2
    for k in range(len(_COUNTS) - 1, -1, -1):  # from the fewest ids to the most
        n = _COUNTS[k]
        p = 1 << (n.bit_length() - 1)
        top = np.maximum(of[p][: blocks * width], of[p][n - p : n - p + blocks * width])
        best[top <= _WIDTHS[k]] = k
    step = np.array([*_COUNTS, *[0] * (ESCAPE - len(_COUNTS)), 1], dtype="int64")
    size = np.minimum(block, len(ids) - np.arange(blocks) * block)
    at, live = np.zeros(blocks, dtype="int64"), np.arange(blocks)
    starts, owners = [], []
    while len(live):
        starts.append(live * width + at[live])
        owners.append(live)
        at[live] += step[best[starts[-1]]]
        live = live[at[live] < size[live]]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    start, owner = start[order], owner[order]
    sel = best[start]
    slots = 1 + (sel == ESCAPE)
    place = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), dtype="<u8")
    values = grid.reshape(-1)
    for k, (n, w) in enumerate(zip(_COUNTS, _WIDTHS, strict=True)):
        who = np.flatnonzero(sel == k)
        if len(who):
            word = np.full(len(who), k << 60, dtype="uint64")
            for j in range(n):
                word |= values[start[who] + j] << np.uint64(j * w)
            words[place[who]] = word
    who = np.flatnonzero(sel == ESCAPE)
    words[place[who]] = ESCAPE << 60
    words[place[who] + 1] = values[start[who]]
    return words, place[np.searchsorted(owner, np.arange(blocks))]


def _bit_length(x: np.ndarray) -> np.ndarray:
    if x.max(initial=0) < 1 << 20:
        table = np.ceil(np.log2(np.arange(1 << 20) + 1.0)).astype("uint8")
        return table[x]
    out = np.zeros(x.shape, dtype="uint8")
    rest = x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(s)
        out[big] += s
        rest[big] >>= np.uint64(s)
    return out + (rest > 0)


def decode_blocks(words: np.ndarray, first_word: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks at once."""
    out = np.zeros(n_ids, dtype="uint64")
    if not n_ids:
        return out
    sel = (words >> np.uint64(60)).astype("uint8")
    raw = np.zeros(len(words), dtype=bool)  # the words after escapes, which may look like selectors
    hits = np.flatnonzero(sel == ESCAPE)
    if len(hits):
        # In a run of words that look like escapes, which begins after another word or with a block, escapes
        # and raw words take turns; the word after the last escape is raw, however it looks.
        start = np.ones(len(hits), dtype=bool)
        start[1:] = (np.diff(hits) > 1) | np.isin(hits[1:], first_word)
        head = np.maximum.accumulate(np.where(start, np.arange(len(hits)), 0))
        raw[hits[(np.arange(len(hits)) - head) % 2 == 0] + 1] = True
    step = np.array([*_COUNTS, *[0] * (ESCAPE - len(_COUNTS)), 1], dtype="int64")[sel]
    step[raw] = 0
    owner = np.searchsorted(first_word, np.arange(len(words)), side="right") - 1
    run = np.cumsum(step) - step
    at = run - run[first_word][owner] + owner * block
    end = np.minimum((owner + 1) * block, n_ids)
    for k, (n, w) in enumerate(zip(_COUNTS, _WIDTHS, strict=True)):
        who = np.flatnonzero((sel == k) & ~raw)
        mask = np.uint64((1 << w) - 1)
        for j in range(n if len(who) else 0):
            ok = who[at[who] + j < end[who]]
            out[at[ok] + j] = (words[ok] >> np.uint64(j * w)) & mask
    who = np.flatnonzero((sel == ESCAPE) & ~raw)
    out[at[who]] = words[who + 1]
    return out


class Writer:
    """Writes one file: groups of whole documents, then the footer."""

    def __init__(self, uri: str, temporary: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        _, self.temporary = fs.FileSystem.from_uri(temporary)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.place, self.groups, self.arrays = 0, [], []

    def add(self, doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        words, first = encode_blocks(ids)
        data = words.tobytes()
        self.out.write(data)
        self.groups.append([self.place, len(words), len(ids), len(first), len(sizes)])
        self.arrays += [first.astype("<i8"), doc_ids.astype("<i8"), known.astype("<i8"), sizes.astype("<i8")]
        self.place += len(data)

    def close(self) -> None:
        head = json.dumps(self.groups).encode()
        body = b"".join(a.tobytes() for a in self.arrays)
        footer = len(head).to_bytes(8, "little") + head + body
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)


def read(uri: str):
    """Yields (doc ids, known, sizes, ids) of each group of a file."""
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        end = f.size()
        tail = f.read_at(16, end - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        n = int.from_bytes(tail[:8], "little")
        footer = f.read_at(n, end - 16 - n)
        k = int.from_bytes(footer[:8], "little")
        groups, rest = json.loads(footer[8 : 8 + k]), np.frombuffer(footer, dtype="<i8", offset=8 + k) if (n - 8 - k) % 8 == 0 else None
        if rest is None:
            raise ValueError(f"{uri} has a broken footer")
        for place, n_words, n_ids, n_blocks, n_docs in groups:
            first, docs, known, sizes = np.split(rest[: n_blocks + 3 * n_docs], [n_blocks, n_blocks + n_docs, n_blocks + 2 * n_docs])
            rest = rest[n_blocks + 3 * n_docs :]
            words = np.frombuffer(f.read_at(n_words * 8, place), dtype="<u8")
            yield docs, known, sizes, decode_blocks(words, first, n_ids)


def write(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, rows_per_part: int = 8192, max_parts: int = 1 << 16) -> DataFrame:
    """Encodes docs(doc_id, text) into files in folder; returns part, uri, n_docs, n_ids of each, written.

    Special tokens are found in texts as the tokenizer's plain call finds them. Null text is empty, and has its
    end id alone. Rows with an equal doc_id stand together in the order of
    their texts' hashes; a null doc_id comes first."""
    spark = docs.sparkSession
    in_arrow_batches(spark, 3000)
    path = tokenizer or tokenizer_path()
    n = docs.count()
    parts = max(1, min(max_parts, -(-n // rows_per_part)))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ranged = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches):
        context = TaskContext.get()
        part = context.partitionId()
        uri = f"{folder}/part-{part:06d}.s8b"
        pieces, writer, n_docs, n_ids = shared(path), None, 0, 0
        for b in batches:
            writer = writer or Writer(uri, f"{folder}/.{part}-{context.taskAttemptId()}")
            docs_ = b.column("doc_id")
            ids, sizes = pieces.encode(b.column("text"))
            sizes += 1
            flat = np.full(int(sizes.sum()), end_id, dtype="int32")
            keep = np.ones(len(flat), dtype=bool)
            keep[np.cumsum(sizes) - 1] = False
            flat[keep] = ids
            writer.add(docs_.fill_null(0).to_numpy(zero_copy_only=False), docs_.is_valid().to_numpy(zero_copy_only=False), sizes, flat)
            n_docs, n_ids = n_docs + len(sizes), n_ids + len(flat)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return materialize(ranged.mapInArrow(lean(run), "part int, uri string, n_docs long, n_ids long"), "token-parts")


def read_documents(parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files of parts."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    parts = parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = parts.repartition(max(1, parts.count()), "part")

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist(), strict=True):
                for docs, known, sizes, ids in read(uri):
                    data = memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(sizes)
                    crc = [zlib.crc32(data[4 * int(e - s) : 4 * int(e)]) for e, s in zip(ends, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, mask=known == 0), pa.array(ends - sizes + base), pa.array(sizes), pa.array(crc, pa.int64())], schema=schema)
                    base += len(ids)

    return spread.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, **params) -> DataFrame:
    return read_documents(write(docs, fresh_dir(docs.sparkSession, "token-files"), **params))
