"""Delimited text lines: load the valid rows, set the others apart with the first reason that holds.

A line holds five comma-separated fields.  The quotes of a whole batch of lines are
numbered per line; the parity of that number tells delimiters from quoted commas, and
the neighbours of each quote tell whether the quoting is sound, so lines are judged
without a per-character state machine.

Reasons in order: ``broken_quoting``, ``column_count``, ``bad_input_type``, ``bad_sequence``.
Defined results: a null line counts as empty (``column_count``); blanks are Unicode white
space; repeated lines are judged one by one; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import chunks, text_buffers

REASONS = ("broken_quoting", "column_count", "bad_input_type", "bad_sequence")
FIELDS = ("id", "sequence", "input_type", "species", "bit_score")
# Residue and nucleotide alphabets and the lengths from which a sequence is refused.
PROTEIN, DNA = b"ACDEFGHIKLMNPQRSTVWYX*", b"ACGTUNRYKMSWBDHV"
PROTEIN_LIMIT, DNA_LIMIT = 10_000, 100_000
CHUNK_BYTES = 8 << 20

_QUOTE, _COMMA = ord('"'), ord(",")
_ASCII_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\v\f\x1c\x1d\x1e\x1f", np.uint8))
_GAP = np.isin(np.arange(256), np.frombuffer(b"-.", np.uint8))


def _alphabet(letters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(letters + letters.lower(), np.uint8))


_IS_PROTEIN, _IS_DNA = _alphabet(PROTEIN), _alphabet(DNA)


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _field(buf: np.ndarray, start: int, end: int) -> str:
    text = buf[start:end].tobytes().decode("utf-8", "replace")
    return text[1:-1].replace('""', '"') if text.startswith('"') else text


def judge(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(reason code or -1 per line, bytes, field starts[n, 5], field ends[n, 5]); spans are set where the count fits."""
    n = len(lines)
    buf, off = text_buffers(lines)
    lo, hi = off[:-1].copy(), off[1:].copy()
    tail = np.flatnonzero(hi > lo)
    hi[tail] -= buf[hi[tail] - 1] == 13
    reason = np.full(n, -1, np.int8)

    mark = np.flatnonzero((buf == _QUOTE) | (buf == _COMMA))
    line = np.searchsorted(off, mark, side="right") - 1
    inside_line = mark < hi[line]
    mark, line = mark[inside_line], line[inside_line]
    quote = buf[mark] == _QUOTE
    before = np.cumsum(quote) - quote
    first = np.searchsorted(line, np.arange(n))
    base = np.concatenate((before, [int(quote.sum())]))[first]
    odd = ((before - base[line]) & 1).astype(bool)

    q, ql, closing = mark[quote], line[quote], odd[quote]
    after = np.where(q + 1 < hi[ql], buf[np.minimum(q + 1, len(buf) - 1)], _COMMA) if len(q) else q
    ahead = np.where(q > lo[ql], buf[np.maximum(q - 1, 0)], _COMMA) if len(q) else q
    # an opening quote follows a delimiter, or the closing quote whose pair it makes
    prev_closes = np.concatenate(([False], closing[:-1] & (q[1:] - q[:-1] == 1) & (ql[1:] == ql[:-1]))) if len(q) else closing
    sound = np.where(closing, (after == _QUOTE) | (after == _COMMA), (ahead == _COMMA) | prev_closes)
    reason[ql[~sound]] = 0
    reason[np.bincount(ql, minlength=n) % 2 == 1] = 0

    comma = ~quote & ~odd
    c, cl = mark[comma], line[comma]
    fields = np.bincount(cl, minlength=n) + 1
    reason[(reason < 0) & (fields != 5)] = 1

    starts, ends = np.zeros((n, 5), np.int64), np.zeros((n, 5), np.int64)
    good = np.flatnonzero(reason < 0)
    if len(good):
        cuts = c[np.isin(cl, good)].reshape(-1, 4)
        starts[good, 0], starts[good, 1:] = lo[good], cuts + 1
        ends[good, :4], ends[good, 4] = cuts, hi[good]
        _judge_values(buf, starts, ends, good, reason)
    return reason, buf, starts, ends


def _judge_values(buf, starts, ends, good, reason) -> None:
    words = [_field(buf, s, e).strip().lower() for s, e in zip(starts[good, 2], ends[good, 2])]
    dna = np.array([w == "dna" for w in words], bool)
    known = dna | np.array([w == "protein" for w in words], bool)
    reason[good[~known]] = 2
    rows, dna = good[known], dna[known]
    s, e = starts[rows, 1].copy(), ends[rows, 1].copy()
    quoted = (e - s >= 2) & (buf[np.minimum(s, len(buf) - 1)] == _QUOTE)
    s, e = s + quoted, e - quoted
    gap = _running(_GAP[buf])
    ok_p, ok_d = _running(_IS_PROTEIN[buf] | _GAP[buf]), _running(_IS_DNA[buf] | _GAP[buf])
    # outer blanks: only where a span begins or ends with one, which is rare
    edge = np.flatnonzero((e > s) & (_ASCII_BLANK[buf[np.minimum(s, len(buf) - 1)]] | _ASCII_BLANK[buf[np.maximum(e - 1, 0)]]))
    for i in edge:
        text = buf[s[i] : e[i]].tobytes()
        s[i] += len(text) - len(text.lstrip(b" \t\n\r\v\f\x1c\x1d\x1e\x1f"))
        e[i] = max(s[i], e[i] - (len(text) - len(text.rstrip(b" \t\n\r\v\f\x1c\x1d\x1e\x1f"))))
    e = np.maximum(s, e)
    size = (e - s) - (gap[e] - gap[s])
    fit = np.where(dna, ok_d[e] - ok_d[s], ok_p[e] - ok_p[s]) == e - s
    bad = ~fit | (size == 0) | (size >= np.where(dna, DNA_LIMIT, PROTEIN_LIMIT))
    # Unicode white space and letters whose upper case is plain are looked at one by one
    other = _running(buf >= 128)
    for i in np.flatnonzero(bad & (other[e] > other[s])):
        text = buf[s[i] : e[i]].tobytes().decode("utf-8", "replace").replace('""', '"')
        text = text.strip().replace("-", "").replace(".", "").upper()
        allowed = set((DNA if dna[i] else PROTEIN).decode())
        bad[i] = not text or not set(text) <= allowed or len(text) >= (DNA_LIMIT if dna[i] else PROTEIN_LIMIT)
    reason[rows[bad]] = 3


def _ready(df: DataFrame, key: str, line: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("line_no"), F.coalesce(F.col(line), F.lit("")).alias("raw_line"))


def rejected_lines(df: DataFrame, key: str = "line_no", line: str = "raw_line") -> DataFrame:
    """``line_no, reason, raw_line`` of every line that cannot be loaded."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        words = pa.array(REASONS)
        for batch in batches:
            for at, to in chunks(batch.column(1), CHUNK_BYTES):
                part = batch.slice(at, to - at)
                reason, *_ = judge(part.column(1))
                bad = pa.array(np.flatnonzero(reason >= 0))
                if len(bad):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(bad), words.take(pa.array(reason[reason >= 0])), part.column(1).take(bad)], names=["line_no", "reason", "raw_line"]
                    )

    return _ready(df, key, line).mapInArrow(run, "line_no bigint, reason string, raw_line string")


def loaded_lines(df: DataFrame, key: str = "line_no", line: str = "raw_line") -> DataFrame:
    """The valid lines as typed rows: fields unquoted, sequence stripped of gaps and in upper case.

    ``species`` is null where empty; ``bit_score`` is null where empty or no number.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in chunks(batch.column(1), CHUNK_BYTES):
                part = batch.slice(at, to - at)
                reason, buf, s, e = judge(part.column(1))
                rows = np.flatnonzero(reason < 0)
                if not len(rows):
                    continue
                text = [[_field(buf, s[i, k], e[i, k]) for i in rows] for k in range(5)]
                text[1] = [x.strip().replace("-", "").replace(".", "").upper() for x in text[1]]
                text[2] = [x.strip().lower() for x in text[2]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *[pa.array(x, pa.string()) for x in text]], names=["line_no", *FIELDS])

    raw = _ready(df, key, line).mapInArrow(run, "line_no bigint, id string, sequence string, input_type string, species string, bit_score string")
    return raw.withColumn("species", F.nullif(F.trim("species"), F.lit(""))).withColumn("bit_score", F.expr("try_cast(trim(bit_score) as double)"))
