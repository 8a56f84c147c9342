"""Exact byte-level BPE of whole texts with a memory of pieces.

A text is cut where the tokenizer's own pattern always starts a new pre-token: before a space that
follows no white space, and before a line feed between two other characters that are no white space; where
there are rare kinds of white space, also before a tab or carriage return, and never after a rare one.
Merges never cross pre-tokens, so the ids of a text are the ids of its pieces in a row, and a piece that
was met before needs no new encoding. Whole batches are cut and their distinct pieces found by Arrow's
kernels, so that Python sees each distinct piece of a batch once. In encode(), texts with rare kinds of
white space, or with spaces or line feeds in a row, go to the tokenizer in one go.

The tokenizer's special tokens are found in texts, as its plain call does; they hold no white space.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Kinds of white space (and what some pattern engines take for it) besides space and line feed: from, to.
_KINDS = ((0x09, 0x09), (0x0B, 0x0D), (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_SPACES = "".join(f"{chr(a)}-{chr(b)}" for a, b in _KINDS)
_CUT = re.compile(rf"(?<=[^\s{_SPACES}])(?=[ \t\r]|\n[^\s{_SPACES}])")
#: A text that isn't plain: a space or line feed at an end or beside another, or a rare kind.
_UNEVEN = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _KINDS) + "]"
#: Stands before a text's first piece, which has no space before it. No plain text holds it.
_HEAD = "\n\n"
#: Pieces kept in memory; when there are more, those met least often are forgotten.
LIMIT = 600_000
#: Pieces joined into one call of the tokenizer.
JOIN = 512


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain(texts: pa.Array) -> np.ndarray:
    """Whether every space and line feed of a text, neither null nor empty, stands alone between other characters."""
    even = pc.invert(pc.match_substring_regex(texts, _UNEVEN))
    return pc.fill_null(pc.and_(even, pc.greater(pc.binary_length(texts), 0)), False).to_numpy(zero_copy_only=False)


def cut(text: str) -> list[str]:
    """The pieces of a text, cut at white space; their concatenation is the text."""
    if not text:
        return []
    return _CUT.split(text)


#: Letters, digits and signs that every version of Unicode takes for such: ASCII, Latin, Greek,
#: Cyrillic, kana, CJK and Hangul, with their punctuation.
_LETTERS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF\u0391-\u03A1\u03A3-\u03CE\u0400-\u0481\u3041-\u3096\u30A1-\u30FA\u3400-\u4DB5\u4E00-\u9FA5\uAC00-\uD7A3"
_DIGITS = r"0-9\uFF10-\uFF19"
_SIGNS = r"!-/:-@\[-`{-~\u00A1\u00A7\u00AB\u00BB\u00BF\u2010-\u2027\u2030-\u203A\u3001-\u3003\u3008-\u3011\uFF01-\uFF0F\uFF1A-\uFF20"
#: Between a letter, digit or sign and one of another kind the pattern always starts anew, but for a letter behind an
#: apostrophe, which may be a contraction.
_KIND = re.compile(rf"(?<=[{_LETTERS}])(?=[{_DIGITS}{_SIGNS}])|(?<=[{_DIGITS}])(?=[{_LETTERS}{_SIGNS}])|(?<=[{_SIGNS}])(?=[{_DIGITS}])|(?<=[{_SIGNS}])(?<!')(?=[{_LETTERS}])")


def cut_finely(text: str) -> list[str]:
    """The pieces of a text, cut at white space and between letters, digits and signs; a run of one kind stays
    whole, as no place within it is sure to be one where the tokenizer starts anew."""
    return [x for piece in cut(text) for x in _KIND.split(piece)]


class Pieces:
    """Encodes texts by pieces. path: a tokenizer file of the tokenizers library."""

    def __init__(self, path: str | None = None, limit: int = LIMIT):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or tokenizer_path())
        self.limit = limit
        size = self.tok.get_vocab_size()
        tokens = [self.tok.id_to_token(i) or "" for i in range(size)]
        # In joined pieces a token opens a piece if it begins with a space or is a line feed.
        self.opens = np.array([t[:1] in ("Ġ", "Ċ") for t in tokens], dtype=bool)
        self.clear()

    def clear(self) -> None:
        #: The pieces, and of each its ids, how many, and how often it was met.
        self.names = pa.array([], pa.string())
        self.parts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.hits = np.zeros(0, dtype="int64")
        self._flat = None

    def forget(self) -> None:
        """Keeps the pieces that were met again, at most half of the limit of them."""
        ids, first, size = self.flat()
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-self.hits[keep], kind="stable")[: self.limit // 2]])
        names, hits, kept = self.names.take(pa.array(keep)), self.hits[keep] // 2, spread(ids, first[keep], size[keep])
        self.clear()
        self.names, self.parts, self.sizes, self.hits = names, [kept], [size[keep]], hits

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, by the tokenizer alone."""
        return [np.array(e.ids, dtype="int32") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> None:
        """Adds pieces; in them a leading space is left out, a leading line feed stands for itself, and the
        mark before a text's first piece for nothing."""
        head = pc.starts_with(new, _HEAD)
        heads, rest = new.filter(head), new.filter(pc.invert(head))
        full = pc.if_else(pc.starts_with(rest, "\n"), rest, pc.binary_join_element_wise("", rest, " ")).to_pylist()
        groups = [full[a : a + JOIN] for a in range(0, len(full), JOIN)]
        for group, ids in zip(groups, self.whole(["".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(group) and at[0] == 0:
                self._add(ids, np.diff(np.append(at, len(ids))))
            else:
                self._add_each(self.whole(group))
        if len(heads):
            self._add_each(self.whole(pc.utf8_slice_codeunits(heads, len(_HEAD)).to_pylist()))
        self.names = pa.concat_arrays([self.names, rest, heads])
        self.hits = np.append(self.hits, np.zeros(len(new), dtype="int64"))
        self._flat = None

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.append(ids)
        self.sizes.append(sizes)

    def _add_each(self, each: list[np.ndarray]) -> None:
        self._add(np.concatenate(each), np.array([len(x) for x in each], dtype="int64"))

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and each piece's first place and size."""
        if self._flat is None:
            ids = np.concatenate(self.parts) if self.parts else np.zeros(0, dtype="int32")
            sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, dtype="int64")
            self.parts, self.sizes = [ids], [sizes]
            self._flat = ids, np.cumsum(sizes) - sizes, sizes
        return self._flat

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of plain texts: the numbers of all pieces in a row, and each text's first place."""
        if len(self.names) > self.limit:
            self.forget()
        spaced = pc.replace_substring(texts, "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise(_HEAD, spaced, ""), " ")
        words = lists.flatten()
        number = pc.index_in(words, value_set=self.names)
        if number.null_count:
            first = len(self.names)
            unknown = words.filter(number.is_null())
            self._learn(unknown.unique())
            late = pc.index_in(unknown, value_set=self.names[first:])
            new = number.is_null().to_numpy(zero_copy_only=False)
            number = number.fill_null(0).to_numpy().copy()
            number[new] = late.to_numpy() + first
        else:
            number = number.to_numpy()
        self.hits += np.bincount(number, minlength=len(self.names))
        offsets = lists.offsets.to_numpy().astype("int64")
        return number, offsets[:-1] - offsets[0]

    def chars(self) -> np.ndarray:
        """The characters of each piece, with the space that its name lacks."""
        n = pc.utf8_length(self.names).to_numpy().astype("int64")
        head, feed = (pc.starts_with(self.names, x).to_numpy(zero_copy_only=False) for x in (_HEAD, "\n"))
        return np.where(head, n - len(_HEAD), np.where(feed, n, n + 1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; a null or empty text has none."""
        even = plain(texts)
        sizes = np.zeros(len(texts), dtype="int64")
        ids = np.zeros(0, dtype="int32")
        if even.any():
            codes, starts = self.codes(texts.filter(pa.array(even)))
            flat, first, size = self.flat()
            ids = spread(flat, first[codes], size[codes])
            sizes[even] = np.add.reduceat(size[codes], starts)
        slow = np.flatnonzero(~even & pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
        if not len(slow):
            return ids, sizes
        each = self.whole(texts.take(pa.array(slow)).to_pylist())
        sizes[slow] = [len(x) for x in each]
        out = np.zeros(int(sizes.sum()), dtype="int32")
        out[np.repeat(even, sizes)] = ids
        for x, end in zip(each, np.cumsum(sizes)[slow], strict=True):
            out[end - len(x) : end] = x
        return out, sizes

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        flat, sizes = self.encode(pa.array(texts, pa.string()))
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []


def spread(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at first and have the given sizes, in a row."""
    ends = np.cumsum(size)
    at = np.repeat((first - ends + size).astype("int32"), size)
    at += np.arange(len(at), dtype="int32")
    return flat[at]


_shared: dict = {}


def shared(path: str) -> Pieces:
    """One memory of pieces for each tokenizer file and Python worker, which serves task after task."""
    if path not in _shared:
        _shared[path] = Pieces(path)
    return _shared[path]
