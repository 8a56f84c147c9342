"""Edit-aware token counts.

A document keeps a tree of sums over its pieces (runs of whole pre-tokens, see segments): a leaf holds
LEAF pieces, a node FAN leaves or nodes, each with its characters and tokens. Trees are stored beside the
texts. An edit finds the leaves it touches by descending the tree, takes a leaf of context where it comes
within two characters of an end, re-encodes just these leaves' text, and updates the sums on the way to the
root; nodes that grow too wide are split. The outer ends of the re-encoded text are cuts that the edit
cannot undo, so the count stays exact. Texts with pieces of more than WIDE characters, as where words aren't set
apart by spaces, are cut between letters, digits and signs too; only a run of one kind, such as a clause of
Chinese letters, is re-encoded whole.

Defined cases: null and empty text have no tokens; an edit's range is clipped to the text, null ends and
texts count as nothing; edits apply in their given order, each to the text that the earlier ones left;
edits of unknown documents, and edits without a doc_id, are left out; rows with an equal doc_id get the
same edits each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow_batches, lean, materialize
from .segments import Pieces, cut, cut_finely, plain, shared, tokenizer_path

#: Pieces in a leaf, children of a node, and characters from which on a piece is cut finely.
LEAF, FAN, WIDE = 8, 32, 100


def _pieces(text: str) -> list[str]:
    return [x for piece in cut(text) for x in ((piece,) if len(piece) <= WIDE else cut_finely(piece))]


class TokenTree:
    """The tokens of one text under edits. chars, tokens: those of each leaf."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text = text
        self.chars = [chars[a : a + FAN] for a in range(0, len(chars), FAN)] or [[]]
        self.tokens = [tokens[a : a + FAN] for a in range(0, len(tokens), FAN)] or [[]]
        self.reencoded = 0
        self._build()

    def _build(self) -> None:
        """The sums of all nodes: levels[0] over the leaves' blocks, the last has one entry."""
        chars, tokens = [sum(x) for x in self.chars], [sum(x) for x in self.tokens]
        self.levels = [(chars, tokens)]
        while len(chars) > 1:
            chars, tokens = ([sum(x[a : a + FAN]) for a in range(0, len(x), FAN)] for x in (chars, tokens))
            self.levels.append((chars, tokens))

    @property
    def n_chars(self) -> int:
        return self.levels[-1][0][0]

    @property
    def n_tokens(self) -> int:
        return self.levels[-1][1][0]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf, its first character) of a character's place; the end counts as the last one."""
        at, node, base = min(at, self.n_chars - 1), 0, 0
        for sums in [*(chars for chars, _ in self.levels[-2::-1]), None]:
            children = self.chars[node] if sums is None else sums[node * FAN : (node + 1) * FAN]
            for k, n in enumerate(children):
                if at < base + n:
                    break
                base += n
            if sums is not None:
                node = node * FAN + k
        return node, k, base

    def _step(self, block: int, leaf: int, by: int) -> tuple[int, int] | None:
        """The next (by = 1) or previous leaf."""
        leaf += by
        while not 0 <= leaf < len(self.chars[block]):
            block += by
            if not 0 <= block < len(self.chars):
                return None
            leaf = 0 if by > 0 else len(self.chars[block]) - 1
        return block, leaf

    def begin(self, start: int, end: int, new: str) -> tuple[list[str], tuple]:
        """Replaces the characters from start to before end by new: the pieces to encode, and what finish()
        needs besides their token counts."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        if not self.n_chars:
            self.text, spot = new, (0, 0, 0, 0)
            region = new
        else:
            b0, l0, first = self._find(start)
            while start < first + 2 and (at := self._step(b0, l0, -1)):
                b0, l0 = at
                first -= self.chars[b0][l0]
            b1, l1, last = self._find(max(start, end - 1))
            last += self.chars[b1][l1]
            while end > last - 1 and (at := self._step(b1, l1, 1)):
                b1, l1 = at
                last += self.chars[b1][l1]
            region = self.text[first:start] + new + self.text[end:last]
            self.text = self.text[:start] + new + self.text[end:]
            spot = (b0, l0, b1, l1 + 1)
        self.reencoded += len(region)
        return _pieces(region), spot

    def finish(self, pieces: list[str], counts: list[int], spot: tuple) -> None:
        """Puts the leaves of newly encoded pieces in place and updates the sums above them."""
        b0, l0, b1, l1 = spot
        for leaves, values in ((self.chars, [len(p) for p in pieces]), (self.tokens, counts)):
            fresh = [sum(values[a : a + LEAF]) for a in range(0, len(values), LEAF)]
            tail = leaves[b1][l1:]
            leaves[b0] = leaves[b0][:l0] + fresh
            for b in range(b0 + 1, b1 + 1):
                leaves[b] = []
            leaves[b1] = leaves[b1] + tail
        wide = [b for b in range(b0, b1 + 1) if len(self.chars[b]) > 2 * FAN]
        for b in reversed(wide):
            for leaves in (self.chars, self.tokens):
                leaves[b : b + 1] = [leaves[b][a : a + FAN] for a in range(0, len(leaves[b]), FAN)]
        if wide:
            return self._build()
        for kind, leaves in enumerate((self.chars, self.tokens)):
            for b in range(b0, b1 + 1):
                by, node = sum(leaves[b]) - self.levels[0][kind][b], b
                for level in self.levels:
                    level[kind][node] += by
                    node //= FAN
        return None

    def edit(self, start: int, end: int, new: str, encoder: Pieces) -> None:
        edit_all([self], [(start, end, new)], encoder)

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for b in self.chars for x in b], [x for b in self.tokens for x in b]


def edit_all(trees: list[TokenTree], edits: list[tuple], encoder: Pieces) -> None:
    """One edit (start, end, new) of each tree; the touched pieces of all are encoded in one call."""
    begun = [t.begin(*e) for t, e in zip(trees, edits, strict=True)]
    counts = [len(x) for x in encoder.whole([p for pieces, _ in begun for p in pieces])]
    at = 0
    for tree, (pieces, spot) in zip(trees, begun, strict=True):
        tree.finish(pieces, counts[at : at + len(pieces)], spot)
        at += len(pieces)


def leaves_of(texts: pa.Array, encoder: Pieces) -> list[tuple[list[int], list[int]]]:
    """(characters, tokens) of the leaves of each text; pieces met before are not encoded again."""
    out: list = [([], [])] * len(texts)
    # A text of an even look with a wide piece is cut as the others are.
    even = plain(texts) & ~pc.fill_null(pc.match_substring_regex(texts, rf"[^ \n]{{{WIDE},}}"), False).to_numpy(zero_copy_only=False)
    if even.any():
        codes, starts = encoder.codes(texts.filter(pa.array(even)))
        n = np.diff(np.append(starts, len(codes)))
        leaves = -(-n // LEAF)
        ends = np.cumsum(leaves)
        first = np.repeat(starts, leaves) + LEAF * (np.arange(ends[-1]) - np.repeat(ends - leaves, leaves))
        chars, tokens = (np.add.reduceat(x[codes], first) for x in (encoder.chars(), encoder.flat()[2]))
        for k, end, size in zip(np.flatnonzero(even), ends, leaves, strict=True):
            out[k] = chars[end - size : end].tolist(), tokens[end - size : end].tolist()
    for k in np.flatnonzero(~even):
        pieces = _pieces(texts[int(k)].as_py() or "")
        counts = [len(x) for x in encoder.whole(pieces)] if pieces else []
        out[k] = tuple([sum(x[a : a + LEAF]) for a in range(0, len(x), LEAF)] for x in ([len(p) for p in pieces], counts))
    return out


def trees(texts: list[str | None], encoder: Pieces) -> list[TokenTree]:
    return [TokenTree(t or "", *x) for t, x in zip(texts, leaves_of(pa.array(texts, pa.string()), encoder), strict=True)]


_LEAVES = "leaf_chars array<int>, leaf_tokens array<int>"


def with_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs(doc_id, text) with the leaves of their trees: doc_id, text, leaf_chars, leaf_tokens."""
    in_arrow_batches(docs.sparkSession, 3000)
    path = tokenizer or tokenizer_path()

    def run(batches):
        encoder = shared(path)
        for b in batches:
            chars, tokens = zip(*leaves_of(b.column("text"), encoder), strict=True) if len(b) else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.list_(pa.int32())) for x in (chars, tokens)]], names=["doc_id", "text", "leaf_chars", "leaf_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id long, text string, {_LEAVES}")


def sampled_edits(doc_id: Column, n_chars: Column) -> Column:
    """Three edits that depend on doc_id and length alone: a replacement, an insertion and a deletion."""
    x = F.shiftrightunsigned(F.xxhash64(doc_id), 32)
    spot = [F.pmod(F.shiftright(x, s), n_chars + 1) for s in (0, 7, 13)]
    each = ((spot[0], spot[0] + 12, F.lit(" revised text\n")), (spot[1], spot[1], F.concat(F.lit("in"), F.repeat(F.lit("sert "), (x % 3).cast("int")))), (spot[2], spot[2] + 40, F.lit("")))
    return F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), new.alias("new")) for a, b, new in each])


def with_edits(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """stored rows with the column edits, from edits(doc_id, seq, start, end, new) in order of seq."""
    by = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_of"))
    by = by.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new"))), lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["new"].alias("new"))).alias("edits"))
    return stored.join(by, stored["doc_id"] == by["_of"], "left").drop("_of")


def edited(stored: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """stored(doc_id, text, leaf_chars, leaf_tokens, edits) after the edits, with new text and leaves, and
    n_tokens and n_chars before, n_edits, n_tokens_edited, n_chars_edited and n_chars_reencoded."""
    in_arrow_batches(stored.sparkSession, 1000)
    path = tokenizer or tokenizer_path()
    counts = ("n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_reencoded")
    schema = f"doc_id long, text string, {_LEAVES}, " + ", ".join(f"{c} long" for c in counts)

    def run(batches):
        encoder = shared(path)
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits")]
            made = [TokenTree(t or "", c or [], n or []) for t, c, n in zip(*cols[:3], strict=True)]
            todo = [e or [] for e in cols[3]]
            before = [t.n_tokens for t in made]
            for turn in range(max(map(len, todo), default=0)):
                who = [k for k, e in enumerate(todo) if len(e) > turn]
                edit_all([made[k] for k in who], [(todo[k][turn]["start"] or 0, todo[k][turn]["end"] or 0, todo[k][turn]["new"] or "") for k in who], encoder)
            leaves = list(zip(*[t.leaves() for t in made], strict=True)) or [[], []]
            numbers = [before, [len(e) for e in todo], [t.n_tokens for t in made], [t.n_chars for t in made], [t.reencoded for t in made]]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([t.text for t in made], pa.string()), *[pa.array(x, pa.list_(pa.int32())) for x in leaves], *[pa.array(x, pa.int64()) for x in numbers]],
                names=["doc_id", "text", "leaf_chars", "leaf_tokens", *counts],
            )

    return stored.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits").mapInArrow(lean(run), schema)


def count_edited(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited and
    n_chars_reencoded under the sampled edits. Trees are stored first and read for the edits."""
    stored = materialize(with_trees(docs, tokenizer), "token-trees")
    n_chars = F.aggregate("leaf_chars", F.lit(0).cast("long"), lambda a, x: a + x)
    done = edited(stored.withColumn("edits", sampled_edits(F.col("doc_id"), n_chars)), tokenizer)
    return done.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_reencoded")
