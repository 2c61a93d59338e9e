"""Texts of a whole Arrow batch cut into sentence-like units with array operations.

A unit ends at a full stop, exclamation or question mark before white space or the end, at an ideographic
stop, at a blank line, or at a line feed that no lower-case letter follows (that one is a wrapped line). All work is
on the UTF-8 bytes of the batch at once; no text is cut short and nothing is done per character in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, DIGIT, STOP, OTHER = 0, 1, 2, 3, 4
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[np.r_[65:91, 97:123, 128:256]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[33, 46, 63]] = STOP
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True


@dataclass
class Units:
    """Offsets are bytes of ``data``. ``doc`` is the row of the batch; units of a row are in order."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    stopped: np.ndarray
    words: np.ndarray
    codes: np.ndarray
    wide: np.ndarray
    links: np.ndarray
    filled: np.ndarray
    kind: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def sentences(self, min_words: int = 4, min_wide: int = 6) -> np.ndarray:
        """Units that are running sentences: stopped, of some words, not mostly numbers or links."""
        words = (self.words >= min_words) & (self.codes * 4 <= self.words + self.codes)
        return self.stopped & (words | (self.wide >= min_wide)) & (self.links <= 1)


def parts(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``size`` bytes of text, at least one row each: work arrays are many times as large as
    the text, and a batch is bounded by rows, not by bytes."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(length)
    at = 0
    while at < batch.num_rows:
        base = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows; nulls are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _per_unit(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int32)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def units_of(column: pa.Array) -> Units:
    raw, off = bytes_of(column)
    n = len(raw)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return Units(raw, z, z, z, z.astype(bool), z, z, z, z, z, np.zeros(0, dtype=np.uint8))
    kind = _CLASS[raw]
    nxt = np.empty(n, dtype=np.uint8)  # class of the next byte, space at the end of a row
    nxt[:-1] = kind[1:]
    nxt[-1] = SPACE
    last = off[1:][off[1:] > off[:-1]] - 1
    nxt[last] = SPACE
    stop = (kind == STOP) & (nxt == SPACE)
    wide_lead = (raw >= 0xE3) & (raw <= 0xED)
    at = np.flatnonzero(raw[: n - 2] == 0xE3) if n > 2 else np.zeros(0, dtype=np.int64)
    at = at[(raw[at + 1] == 0x80) & (raw[at + 2] == 0x82)]
    stop[at + 2] = True
    feed = raw == 10
    follow = np.zeros(n, dtype=bool)
    follow[:-1] = _LOWER[raw[1:]]
    cut = stop | (feed & ~follow)
    cut[last] = True
    end = np.flatnonzero(cut) + 1
    start = np.empty_like(end)
    start[0] = 0
    start[1:] = end[:-1]
    word = kind == LETTER
    head = word.copy()
    head[1:] &= (kind[:-1] == SPACE) | (kind[:-1] == OTHER)
    digit = kind == DIGIT
    code = digit.copy()
    code[1:] &= (kind[:-1] == SPACE) | (kind[:-1] == OTHER)
    slash = np.zeros(n, dtype=bool)
    at = np.flatnonzero(raw[: max(n - 2, 0)] == 58)
    slash[at[(raw[at + 1] == 47) & (raw[at + 2] == 47)]] = True
    stopped = stop[end - 1]
    return Units(
        raw, start, end, np.searchsorted(off, start, side="right") - 1, stopped, _per_unit(head, start, end), _per_unit(code, start, end),
        _per_unit(wide_lead, start, end), _per_unit(slash, start, end), _per_unit(kind != SPACE, start, end), kind,
    )
