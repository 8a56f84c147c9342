"""Benchmark decontamination with suffix arrays over the training text.

Each Arrow batch of documents is a shard. Its words become numbers of the benchmark's vocabulary (0 for
any other word), a suffix array over the shard's words is sorted, and every benchmark suffix is
binary-searched in it as a window of `window` words (an item with fewer words is one window). Suffixes
whose first two words no window starts with cannot match and are left out of the array. Matches at
consecutive places of document and item join into longest verbatim matches; where windows are so common
that there are too many pairs of places, a suffix array over the items gives each place's longest match from
its neighbours in the array instead, however many items say the same.

The benchmark is split into blocks of about block_chars characters (an item is never split), built one
after another and written to the shared folder. A shard is searched for one block after another by the same
worker, which keeps HELD blocks in memory: neither the benchmark's size nor the documents' is bounded by a
task's memory, and nothing is shuffled.

Defined cases: null or wordless text has no words and no hits; null or wordless items match nothing;
rows with an equal item_id count as one item, those without an item_id as one whose name is empty; repeated
documents are rows of their own; of equally long matches the first in the document, then the item with the
first name, is the longest.
"""

from __future__ import annotations

import pickle
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, in_arrow_batches, lean

#: Word bytes: 0-9, a-z and all beyond ASCII; A-Z become a-z, all else a space.
_TABLE = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: Blocks that a worker keeps in memory.
HELD = 4
#: Pairs of places of a batch and the items that are joined; of more, the items' suffix array is searched.
PAIRS = 2_000_000
_FOUND = "n_words long, spans array<int>, items array<string>, longest long, longest_at long, longest_item string, longest_item_at long"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Block:
    """The windows of some benchmark items, sorted and packed for binary search."""

    def __init__(self, items: list[tuple], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        items = [("" if i is None else str(i), t) for i, t in items]
        self.names = sorted({i for i, _ in items})
        at_name = {n: k for k, n in enumerate(self.names)}
        found: dict[tuple, list] = {}
        long: dict[tuple, tuple] = {}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words((text or "").encode())]
            n = min(window, len(ids))
            if n == window:
                long[tuple(ids)] = min(long.get(tuple(ids), (name,)), (name,))
            for q in range(len(ids) - n + 1) if n else ():
                found.setdefault(tuple(ids[q : q + n]), []).append((at_name[name], q))
        self.bits = max(1, len(self.vocab).bit_length())
        self.per = 62 // self.bits
        keys = sorted(found)
        self.lengths = np.array([len(k) for k in keys], dtype="int64")
        grid = np.zeros((len(keys), window), dtype="int64")
        for r, k in enumerate(keys):
            grid[r, : len(k)] = k
        self.low = self.pack(grid)
        top = (1 << self.bits) - 1
        self.high = self.pack(np.where(np.arange(window)[None, :] < self.lengths[:, None], grid, top))
        spots = [sorted(set(found[k])) for k in keys]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in spots])]).astype("int64")
        self.where = np.array([x for y in spots for x in y], dtype="int64").reshape(-1, 2)
        # The distinct texts of at least a window, in the order of their first names.
        self.long = [(at_name[name], np.array(ids, dtype="int32")) for (name,), ids in sorted((v, k) for k, v in long.items())]
        #: Made where they are needed.
        self.array: ItemSuffixes | None = None
        self._items: dict[int, np.ndarray] = {}
        self.single = np.unique(grid[self.lengths == 1, 0])
        many = grid[self.lengths > 1]
        self.pairs = np.unique(many[:, 0] << self.bits | many[:, 1]) if len(many) else np.zeros(0, dtype="int64")

    def items(self, window: int) -> np.ndarray:
        """The items that have a window, each once."""
        if window not in self._items:
            self._items[window] = np.unique(self.where[self.first[window] : self.first[window + 1], 0])
        return self._items[window]

    def pack(self, grid: np.ndarray) -> list[np.ndarray]:
        """Columns of whole words, most significant first, in integers."""
        out = []
        for a in range(0, self.window, self.per):
            key = np.zeros(len(grid), dtype="int64")
            for j in range(a, min(a + self.per, self.window)):
                key = key << self.bits | grid[:, j]
            out.append(key)
        return out


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _bound(array: list[np.ndarray], key: list[np.ndarray], right: bool) -> np.ndarray:
    """For each key, the first place of the sorted array that is not below it (right: that is above it)."""
    lo, hi = np.zeros(len(key[0]), dtype="int64"), np.full(len(key[0]), len(array[0]), dtype="int64")
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = np.minimum(mid, len(array[0]) - 1)
        less, same = np.zeros(len(lo), dtype=bool), np.ones(len(lo), dtype=bool)
        for a, k in zip(array, key, strict=True):
            less |= same & (a[at] < k)
            same &= a[at] == k
        go = less | same if right else less
        lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def search(block: Block, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of the block's windows in a shard's numbered words: (place, window) of each."""
    s = np.concatenate([ids, np.zeros(block.window, dtype=ids.dtype)]).astype("int64")
    n = len(ids)
    here = np.flatnonzero(s[:n])
    keep = _member(block.pairs, s[here] << block.bits | s[here + 1]) & (s[here + 1] > 0)
    if len(block.single):
        keep |= _member(block.single, s[here])
    here = here[keep]
    if not len(here) or not len(block.lengths):
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
    keys = block.pack(s[here[:, None] + np.arange(block.window)])
    order = np.lexsort(keys[::-1])
    suffixes, keys = here[order], [k[order] for k in keys]
    lo, hi = _bound(keys, block.low, False), _bound(keys, block.high, True)
    count = hi - lo
    which = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return suffixes[at], which


class ItemSuffixes:
    """The suffix array of a block's items, with names for their stretches of 1, 2, 4, ... words: equal stretches
    have equal names, so that common prefixes are measured in steps of halved length."""

    def __init__(self, long: list[tuple[int, np.ndarray]]):
        self.item = np.array([k for k, _ in long], dtype="int64")
        sizes = np.array([len(x) for _, x in long], dtype="int64")
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.text = np.concatenate([y for _, x in long for y in (x, np.zeros(1, dtype="int32"))]).astype("int64")
        n = len(self.text)
        #: Names of each level, -1 where a stretch would pass the item's end; and the pairs that make them.
        self.names, self.pairs = [np.where(self.text > 0, self.text, -1)], []
        rank, step = self.text.copy(), 1
        while step < sizes.max():
            last = self.names[-1]
            after = np.append(last[step:], np.full(step, -1))[:n]
            whole = (last >= 0) & (after >= 0)
            pair = last * (n + int(self.text.max()) + 2) + after
            known = np.unique(pair[whole])
            name = np.full(n, -1, dtype="int64")
            name[whole] = np.searchsorted(known, pair[whole])
            self.pairs.append(known)
            self.names.append(name)
            # The order of suffixes by twice as many words; what lies behind an item's end counts as nothing.
            ahead = np.append(rank[step:], np.zeros(step, dtype="int64"))[:n]
            ahead[last < 0] = 0
            rank = np.unique(rank * (int(max(rank.max(), ahead.max())) + 1) + ahead, return_inverse=True)[1].astype("int64") + 1
            rank[self.text == 0] = 0
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.array = order[np.searchsorted(rank[order], 1) :]

    def named(self, ids: np.ndarray) -> list[np.ndarray]:
        """The names of a batch's stretches, -1 for those that no item has."""
        n = len(ids)
        out = [np.where(ids > 0, ids, -1).astype("int64")]
        for level, known in enumerate(self.pairs):
            step, last = 1 << level, out[-1]
            after = np.append(last[step:], np.full(step, -1))[:n]
            who = np.flatnonzero((last >= 0) & (after >= 0))
            pair = last[who] * (len(self.text) + int(self.text.max()) + 2) + after[who]
            name = np.full(n, -1, dtype="int64")
            hit = _member(known, pair)
            name[who[hit]] = np.searchsorted(known, pair[hit])
            out.append(name)
        return out

    def common(self, names: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words from each place p of the batch are those from place q of the items."""
        length = np.zeros(len(p), dtype="int64")
        for level in range(len(names) - 1, -1, -1):
            a, b = names[level][np.minimum(p + length, len(names[0]) - 1)], self.names[level][np.minimum(q + length, len(self.text) - 1)]
            length += ((a >= 0) & (a == b)).astype("int64") << level
        return length

    def _below(self, ids, names, p, q) -> np.ndarray:
        """Whether the items' suffix at q is before the batch's at p."""
        n = self.common(names, p, q)
        return self.text[np.minimum(q + n, len(self.text) - 1)] < ids[np.minimum(p + n, len(ids) - 1)]

    def longest(self, ids: np.ndarray, names: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """The longest match that begins at each place p of the batch: that with a neighbour in the array."""
        lo, hi = np.zeros(len(p), dtype="int64"), np.full(len(p), len(self.array), dtype="int64")
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(self.array) - 1)
            go = self._below(ids, names, p, self.array[mid])
            lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return np.maximum(*[self.common(names, p, self.array[np.clip(lo + by, 0, len(self.array) - 1)]) for by in (-1, 0)])

    def first(self, names: list[np.ndarray], p: int, length: int) -> tuple[int, int]:
        """(item, place in it) of the first item that has the `length` words from p on."""
        level = length.bit_length() - 1
        back = length - (1 << level)
        # Two stretches that overlap make up the match.
        a, b = names[level][p], names[level][p + back]
        own = self.names[level]
        at = np.flatnonzero(own == a)
        at = at[own[at + back] == b]
        k = int(np.searchsorted(self.starts, at[0], side="right") - 1)
        return int(self.item[k]), int(at[0] - self.starts[k])


def _best(out: dict[int, tuple], doc: np.ndarray, length, place, item, q) -> None:
    """Keeps the longest match of each document: of equal ones the first place, then the first item and place there."""
    order = np.lexsort((q, item, place, -length, doc))
    for k in order[np.append(True, doc[order][1:] != doc[order][:-1])] if len(order) else ():
        new = (int(length[k]), int(place[k]), int(item[k]), int(q[k]))
        old = out.get(int(doc[k]))
        if old is None or (-new[0], *new[1:]) < (-old[0], *old[1:]):
            out[int(doc[k])] = new


def _longest(block: Block, ids, place, which, doc) -> dict[int, tuple]:
    """doc -> (length, place, item, place in item) of its longest verbatim match."""
    out: dict[int, tuple] = {}
    short = block.lengths[which] < block.window
    # An item of fewer words than a window matches whole; of those with the same words, the first counts.
    where = block.where[block.first[which[short]]]
    _best(out, doc[short], block.lengths[which[short]], place[short], where[:, 0], where[:, 1])
    place, which, doc = place[~short], which[~short], doc[~short]
    n = block.first[which + 1] - block.first[which]
    if n.sum() > PAIRS:
        array = block.array = block.array or ItemSuffixes(block.long)
        names = array.named(ids)
        place, at = np.unique(place, return_index=True)
        doc, length = doc[at], array.longest(ids, names, place)
        order = np.lexsort((place, -length, doc))
        for k in order[np.append(True, doc[order][1:] != doc[order][:-1])]:
            item, q = array.first(names, int(place[k]), int(length[k]))
            _best(out, doc[k : k + 1], length[k : k + 1], place[k : k + 1], np.array([item]), np.array([q]))
        return out
    p, d = np.repeat(place, n), np.repeat(doc, n)
    at = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.first[which], n)
    item, q = block.where[at, 0], block.where[at, 1]
    order = np.lexsort((p, p - q, item, d))
    p, d, item, q = (x[order] for x in (p, d, item, q))
    new = np.ones(len(p), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(p))) + block.window - 1
    _best(out, d[start], length, p[start], item[start], q[start])
    return out


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """The distinct keys, which are sorted, and the values of each."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at].tolist(), [x.tolist() for x in np.split(values, at[1:])]


def scan(block: Block, texts: list) -> list[tuple]:
    """(n_words, spans, items, best) of each text: spans is a flat list of merged [from, to) word places, best
    the longest match as (-length, place, item, place in item), or None."""
    get = block.vocab.get
    parts = []
    for t in texts:
        w = words(t) if t else []
        parts.append(np.fromiter(map(get, w, repeat(0)), dtype="int32", count=len(w)))
    sizes = np.array([len(p) for p in parts], dtype="int64")
    gap = np.zeros(1, dtype="int32")
    ids = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    out = [[int(n), [], [], None] for n in sizes]
    place, which = search(block, ids)
    if not len(place):
        return out
    doc = np.searchsorted(starts, place, side="right") - 1
    mark = np.zeros(len(ids) + block.window + 1, dtype="int64")
    np.add.at(mark, place, 1)
    np.add.at(mark, place + block.lengths[which], -1)
    inside = np.cumsum(mark) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype("int8")))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        k = int(np.searchsorted(starts, a, side="right") - 1)
        out[k][1].extend((int(a - starts[k]), int(b - starts[k])))
    pairs = np.unique(doc * len(block.lengths) + which)
    for k, own in zip(*_grouped(pairs // len(block.lengths), pairs % len(block.lengths)), strict=True):
        out[k][2].extend(block.names[i] for i in np.unique(np.concatenate([block.items(w) for w in own])))
    for k, (length, p, item, q) in _longest(block, ids, place, which, doc).items():
        out[k][3] = (-length, p - int(starts[k]), block.names[item], q)
    return out


def merged(spans: list[int], more: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted([*zip(spans[::2], spans[1::2]), *zip(more[::2], more[1::2])]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out.extend((a, b))
    return out


def blocks_of(benchmark: DataFrame, window: int, block_chars: int) -> list[str]:
    """Writes the blocks, of about block_chars characters each, one after another; where they lie."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    numbered = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("b"))
    folder, out = fresh_dir(spark, "benchmark"), []
    for k in range(blocks):
        items = [(r[0], r[1]) for r in numbered.where(F.col("b") == k).select("item_id", "text").collect()]
        files, path = fs.FileSystem.from_uri(f"{folder}/{k}")
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as f:
            f.write(pickle.dumps(Block(items, window)))
        out.append(f"{folder}/{k}")
    return out


_held: dict[str, Block] = {}


def _block(uri: str) -> Block:
    if uri not in _held:
        while len(_held) >= HELD:
            del _held[next(iter(_held))]
        files, path = fs.FileSystem.from_uri(uri)
        with files.open_input_stream(path) as f:
            _held[uri] = pickle.loads(f.read())
    return _held[uri]


def scan_all(uris: list[str], texts: list) -> list[list]:
    """What scan() finds for all blocks together."""
    out = scan(_block(uris[0]), texts)
    for uri in uris[1:]:
        for one, more in zip(out, scan(_block(uri), texts), strict=True):
            one[1], one[2] = merged(one[1], more[1]), one[2] + more[2]
            one[3] = min((x for x in (one[3], more[3]) if x), default=None)
    return out


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_chars: int = 8 << 20) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, spans (flat array of hit word ranges), items (names of
    those that occur, sorted), and the longest verbatim match: its words, place, item and place in the item.
    Further columns of docs are ignored."""
    in_arrow_batches(docs.sparkSession, 2000)
    uris = blocks_of(benchmark, window, block_chars)
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.int64())
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches):
        for b in batches:
            rows = scan_all(uris, b.column("text").cast(pa.binary()).to_pylist())
            best = [r[3] or (0, None, None, None) for r in rows]
            cols = [[r[0] for r in rows], [r[1] for r in rows], [sorted(set(r[2])) for r in rows], [-x[0] for x in best], *[[x[k] for x in best] for k in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id long, {_FOUND}")


def report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at,
    longest_item, longest_item_at."""
    found = find(docs, benchmark, **params)
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        *[x.split()[0] for x in _FOUND.split(", ")[3:]],
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_chars: int = 8 << 20) -> DataFrame:
    """The rows of docs without any hit; all columns stay."""
    in_arrow_batches(docs.sparkSession, 2000)
    uris = blocks_of(benchmark, window, block_chars)

    def run(batches):
        for b in batches:
            rows = scan_all(uris, b.column("text").cast(pa.binary()).to_pylist())
            yield b.filter(pa.array([not r[1] for r in rows], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
