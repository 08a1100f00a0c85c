"""Numpy helpers on spans of a byte buffer, shared by the structural-indexing operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; null rows have empty spans."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
    return raw[lo:hi], off - lo


def chunks(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes; a longer text is a range of its own."""
    n = len(column)
    if not n:
        return
    _, off = text_buffers(column)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return base + np.arange(total)


def ranks(groups: np.ndarray) -> np.ndarray:
    """0-based rank of each element inside its run of equal group values (groups are sorted)."""
    n = len(groups)
    if not n:
        return np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    return np.arange(n) - np.repeat(head, np.diff(np.concatenate((head, [n]))))


def equals(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, word: bytes) -> np.ndarray:
    """Which spans hold exactly ``word``."""
    out = lengths == len(word)
    at = np.flatnonzero(out)
    for k, byte in enumerate(word):
        if not len(at):
            break
        at = at[buf[starts[at] + k] == byte]
    out[:] = False
    out[at] = True
    return out
