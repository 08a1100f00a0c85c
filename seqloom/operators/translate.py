"""Translation and codon measures of whole batches of DNA texts, as maps over Arrow.

A text becomes a row of base codes; a codon is a number below 64, looked up once.  All texts of a
chunk are handled together: the two strands, the three offsets, stops and sums are a few numpy
operations each.

Defined results: null texts give no row; texts of one or two letters give no frame and measures of 0;
letters other than A, C, G, T and U make a codon unknown (``X``, and left out of the measures).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codons import RARE, usage_table, weights
from ..functions.sequence import _AMINO, _BASES, CODONS, COMPLEMENT_FROM, COMPLEMENT_TO, FRAMES
from .spans import chunks, text_buffers

FRAME_COLUMNS = "label string, frame_no int, nt_offset int, is_reverse boolean, sequence string, stop_positions array<int>"
#: Letters that are handled at a time.
CHUNK_LETTERS = 4 << 20

_UNKNOWN = 64
_CODE = np.full(256, 255, np.uint8)
for _k, _b in enumerate(_BASES):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _k
_CODE[ord("U")] = _CODE[ord("u")] = _CODE[ord("T")]
_RESIDUE = np.frombuffer((_AMINO + "X").encode(), np.uint8)
_PAIRED = np.full(256, ord("N"), np.uint8)
for _a, _b in zip(COMPLEMENT_FROM, COMPLEMENT_TO):
    _PAIRED[ord(_a)] = ord(_b)
_NAMES = [a + b + c for a in _BASES for b in _BASES for c in _BASES]


def codon_numbers(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the codon at each start, 64 if it is unknown."""
    code = _CODE[letters]
    a, b, c = code[starts], code[starts + 1], code[starts + 2]
    out = a * np.uint8(16) + b * np.uint8(4) + c
    out[(a > 3) | (b > 3) | (c > 3)] = _UNKNOWN
    return out


def _frames(letters: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(frame, rows that have it, codons of each, residues of all) of a chunk of texts."""
    size = np.diff(off)
    mirror = np.repeat(off[:-1] + off[1:] - 1, size) - np.arange(len(letters))
    strands = letters, _PAIRED[letters[mirror]]
    for k in range(6):
        n = np.maximum(size - k % 3, 0) // 3
        rows = np.flatnonzero(n)
        n = n[rows]
        yield k, rows, n, _RESIDUE[codon_numbers(strands[k // 3], expand_steps(off[rows] + k % 3, n))]


def _texts(letters: np.ndarray, n: np.ndarray) -> pa.Array:
    off = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(letters)))


def _mapped(df: DataFrame, keep: tuple[str, ...], text: str, columns: str, body) -> DataFrame:
    """``keep`` and ``columns`` from ``body(letters, offsets)``, which yields (rows, arrays) of a chunk of texts."""
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, *(c.split()[0] for c in columns.split(", "))]

    def run(batches):
        for batch in batches:
            for at, to in chunks(batch.column(len(keep)), CHUNK_LETTERS):
                part = batch.slice(at, to - at)
                for rows, arrays in body(*text_buffers(part.column(len(keep)))):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(len(keep))), *arrays], names=names)

    source = df.select(*keep, F.col(text).alias("_text")).filter("_text is not null")
    return source.mapInArrow(run, f"{kept}, {columns}")


def six_frames_of(df: DataFrame, *keep: str, text: str = "s") -> DataFrame:
    """A row per frame of every DNA text: ``keep``, label, frame_no (0..5), nt_offset, is_reverse, sequence, stop_positions.

    Stops read through as ``X`` and their 0-based places are kept; frames without a codon are left out.
    """

    def body(letters, off):
        for k, rows, n, aa in _frames(letters, off):
            stop = np.flatnonzero(aa == ord("*"))
            first = np.concatenate(([0], np.cumsum(n)))
            owner = np.searchsorted(first, stop, "right") - 1
            per = np.bincount(owner, minlength=len(n))
            stops = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), pa.array((stop - first[owner]).astype(np.int32)))
            full = lambda value, kind, n=len(n): pa.array(np.full(n, value), kind)
            label = pa.DictionaryArray.from_arrays(full(0, pa.int32()), pa.array([FRAMES[k]])).cast(pa.string())
            yield rows, [label, full(k, pa.int32()), full(k % 3, pa.int32()), full(k >= 3, pa.bool_()), _texts(np.where(aa == ord("*"), ord("X"), aa).astype(np.uint8), n), stops]

    return _mapped(df, keep, text, FRAME_COLUMNS, body)


def codon_measures(df: DataFrame, *keep: str, text: str = "s", usage: dict[str, float] | None = None) -> DataFrame:
    """``keep``, cai, mean_usage and rare of every coding text, read in its first frame.

    ``cai`` is the geometric mean of the codons' weights and ``mean_usage`` the mean usage per thousand, over known
    codons other than stops (0 if there is none); ``rare`` counts rare codons.
    """
    usage = usage or usage_table()
    coding = np.array([CODONS[c] != "*" for c in _NAMES] + [False])
    logs = weights(usage)
    table = np.zeros((65, 3))
    table[:64] = [[log(logs[c]) if c in logs else 0.0, usage.get(c, 0.0) if CODONS[c] != "*" else 0.0, float(c in RARE)] for c in _NAMES]

    def body(letters, off):
        n = np.diff(off) // 3
        row = np.repeat(np.arange(len(n)), n)
        codon = codon_numbers(letters, expand_steps(off[:-1], n))
        known = np.bincount(row, weights=coding[codon], minlength=len(n))
        log_sum, used, rare = (np.bincount(row, weights=table[codon, k], minlength=len(n)) for k in range(3))
        least = np.maximum(known, 1)
        yield np.arange(len(n)), [pa.array(np.where(known > 0, np.exp(log_sum / least), 0.0)), pa.array(used / least), pa.array(rare.astype(np.int32))]

    return _mapped(df, keep, text, "cai double, mean_usage double, rare int", body)


def expand_steps(starts: np.ndarray, counts: np.ndarray, step: int = 3) -> np.ndarray:
    """start, start + step, ... of each row, ``counts`` of them."""
    return np.repeat(starts - step * (np.cumsum(counts) - counts), counts) + step * np.arange(int(counts.sum()))

