"""Words of whole batches of texts, found by a table over their bytes.

In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so wherever words and what stands between
them are told apart by ASCII characters alone, bytes tell them apart as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def keeping(drop: str) -> np.ndarray:
    """The table of all bytes but the ASCII characters in drop."""
    table = np.ones(256, dtype=bool)
    table[list(drop.encode("ascii"))] = False
    return table


#: ASCII letters and all that is beyond ASCII.
LETTERS = keeping("".join(chr(c) for c in range(128) if not chr(c).isalpha()))
#: All but space, tab, line feed, vertical tab, form feed and carriage return.
NO_SPACE = keeping(" \t\n\v\f\r")

_LOWER = np.arange(256, dtype="uint8")
_LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, A-Z lower-cased, and the places where texts begin, with the end. A null
    text is empty."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype="int64" if wide else "int32")[texts.offset : texts.offset + len(texts) + 1].astype("int64")
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype="uint8")[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype="uint8")
    return _LOWER[data], offsets - offsets[0]


def spans(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, end) of each run of places that are inside; a run ends at an edge. edges: ascending, the last
    one is the end of all."""
    first = np.empty(len(inside) + 1, dtype=bool)
    first[1:-1] = inside[1:] != inside[:-1]
    first[:1] = first[-1:] = True
    first[edges] = True
    at = np.flatnonzero(first)
    own = np.flatnonzero(inside[at[:-1]])
    return at[own], at[own + 1]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings at data[start:end], of spans that are ascending and not empty; what lies between is left out."""
    keep = np.zeros(len(data) + 1, dtype="int8")
    keep[start] = 1
    keep[end] -= 1
    kept = data[np.cumsum(keep[:-1], dtype="int8").astype(bool)]
    offsets = np.append(0, np.cumsum(end - start))
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype("int64")), pa.py_buffer(kept))


def tokens(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, lower-cased (A-Z), and the text of each."""
    data, edges = text_bytes(texts)
    start, end = spans(table[data], edges)
    row = np.searchsorted(edges, start, side="right") - 1
    return strings(data, start, end), row
