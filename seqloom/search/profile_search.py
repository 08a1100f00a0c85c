"""Sequences against every profile: local Viterbi scores, spans and state paths.

All sequences of a batch go through a profile together, in order of length: one step of the
recurrence is a few numpy operations over (sequences, states), the chain of deletes a running
maximum.  A first pass in single precision keeps nothing but scores.  Sequences that pass the
threshold go through a second one in double precision, which keeps where each cell came from
(one byte), and all of their paths are walked back together.

Nothing is cut by e-value, coverage or a prefilter; only the score threshold applies.  A path is
the text of its kinds (``m``, ``i``, ``d``) from state ``hmm_start`` on; matches and deletes move
to the next state.  Ties go to the start of the alignment, then match, insert, delete.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.profiles import BACKGROUND, RESIDUES, Profile

HITS = "key bigint, part int, hmm_name string, profile_ordinal int, bit_score double, evalue double, evalue_text string, seq_start int, seq_end int, hmm_start int, hmm_end int, path string"
_LOG0 = -1e9
#: Codes of letters: the residues, any other letter (scores 0 everywhere), no letter (behind the text).
_OTHER, _NO_LETTER = 20, 21
_CODE = np.full(256, _OTHER, np.int64)
for _i, _aa in enumerate(RESIDUES):
    _CODE[ord(_aa)] = _i
#: Sequences that go through a profile at a time, and cells whose origins are kept at a time.
BATCH, TRACED_CELLS = 128, 32 << 20
#: Rest of a sequence that is searched again on either side of a hit.
LEAST_REST = 30
#: Letters times profiles that one task searches.
TASK_WORK = 40_000_000
#: Single precision's margin below the threshold, in bits.
MARGIN = 0.05


class Model:
    """Log-odds form of a profile, in both precisions."""

    def __init__(self, p: Profile):
        n = p.length
        self.name, self.length, self.mu, self.lam = p.name, n, p.mu, p.lam
        emit = np.log(np.maximum(p.match, 1e-9) / BACKGROUND)
        emit = np.concatenate((emit, np.zeros((n, 1)), np.full((n, 1), _LOG0)), axis=1).T.copy()
        move = np.log(np.maximum(p.trans, 1e-9)).T.copy()
        enter = log(2.0 / (n * (n + 1))) if n else 0.0
        self.forms = {t: (emit.astype(t), move.astype(t), t(enter)) for t in (np.float32, np.float64)}


def _outside(size: np.ndarray) -> np.ndarray:
    """The length model: entering, leaving and staying outside, relative to the null model."""
    return np.log(size / (size + 3.0)) * size - np.log(size / (size + 1.0)) * size + np.log(3.0 / (size + 3.0)) - np.log(1.0 / (size + 1.0))


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in seqs])
    x = np.full((int(size.max(initial=0)), len(seqs)), _NO_LETTER, np.int64)
    for k, s in enumerate(seqs):
        x[: len(s), k] = s
    return x, size


def scores(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Bits of the best local alignment of each sequence.

    Arrays are (states, sequences) with empty states in front, so that a step to the next state is a shifted view of
    contiguous memory and the running maximum over deletes a few shifted maxima of doubling reach.
    """
    x, size = _padded(seqs)
    emit, (mm, mi, md, im, ii, dm, dd), enter = model.forms[np.float32]
    n, m = len(seqs), model.length
    shifts = [1 << k for k in range((m - 1).bit_length())]
    pad = max([1, *shifts])
    M, I, D, other = (np.full((pad + m, n), _LOG0, np.float32) for _ in range(4))
    now, before = slice(pad, None), slice(pad - 1, -1)
    run = np.concatenate(([0], np.cumsum(dd[:-1])))
    tiled = lambda v: np.repeat(np.asarray(v, np.float32)[:, None], n, axis=1)
    behind = lambda v, first=0.0: np.concatenate(([first], v[:-1]))
    by_mm, by_im, by_dm, opening = tiled(behind(mm)), tiled(behind(im)), tiled(behind(dm)), tiled(behind(md, _LOG0) - run)
    by_ii, by_mi, deletes, fresh = tiled(ii), tiled(mi), tiled(run), tiled(np.full(m, enter))
    best, t, u = (np.full((m, n), _LOG0, np.float32) for _ in range(3))
    by_state = np.ascontiguousarray(emit.T)
    for codes in x:
        np.add(M[before], by_mm, out=t)
        np.add(I[before], by_im, out=u)
        np.maximum(t, u, out=t)
        np.add(D[before], by_dm, out=u)
        np.maximum(t, u, out=t)
        np.maximum(t, fresh, out=t)
        np.add(I[now], by_ii, out=I[now])
        np.add(M[now], by_mi, out=u)
        np.maximum(I[now], u, out=I[now])
        np.take(by_state, codes, axis=1, out=u, mode="clip")
        np.add(t, u, out=M[now])
        np.maximum(best, M[now], out=best)
        # D[k] = max over j < k of M[j] + md[j] + the deletes between
        here, there = D, other
        np.add(M[before], opening, out=here[now])
        for s in shifts:
            np.maximum(here[now], here[pad - s : pad - s + m], out=there[now])
            here, there = there, here
        np.add(here[now], deletes, out=D[now])
    return (best.max(axis=0) + _outside(size)) / log(2.0)


def aligned(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Bits, span [start, end), states [hmm_start, hmm_end] (1-based) and kinds of the best local alignment of each sequence."""
    x, size = _padded(seqs)
    emit, (mm, mi, md, im, ii, dm, dd), enter = model.forms[np.float64]
    n, m, longest = len(seqs), model.length, len(x)
    M, I, D = (np.full((n, m), _LOG0) for _ in range(3))
    run = np.concatenate(([0], np.cumsum(dd[:-1])))
    # per cell: where a match came from (0 start, 1 match, 2 insert, 3 delete), +4 insert from insert, +8 delete from delete
    came = np.zeros((longest, n, m), np.uint8)
    best, end, state = np.full(n, _LOG0), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)
    for i, codes in enumerate(x):
        top = np.full((n, m), enter)
        source = came[i]
        for kind, (prev, move) in enumerate(((M, mm), (I, im), (D, dm)), 1):
            cand = prev[:, :-1] + move[:-1]
            better = cand > top[:, 1:]
            np.maximum(top[:, 1:], cand, out=top[:, 1:])
            np.putmask(source[:, 1:], better, kind)
        stay, open_ = I + ii, M + mi
        source |= (stay > open_).view(np.uint8) << 2
        I = np.maximum(stay, open_)
        M = top + emit[codes]
        opened = np.concatenate((np.full((n, 1), _LOG0), M[:, :-1] + md[:-1]), axis=1) - run
        D = np.maximum.accumulate(opened, axis=1)
        source |= (D > opened).view(np.uint8) << 3
        D += run
        k = M.argmax(axis=1)
        top = M[rows, k]
        won = top > best
        best[won], end[won], state[won] = top[won], i + 1, k[won]
    # all paths are walked back together
    kinds = np.zeros((longest + m + 1, n), np.uint8)
    i, k, kind, live, step = end - 1, state.copy(), np.full(n, ord("m"), np.uint8), np.flatnonzero(best > _LOG0 / 2), 0
    while len(live):
        kinds[step, live] = kind[live]
        c, now = came[i[live], live, k[live]], kind[live]
        match, insert = now == ord("m"), now == ord("i")
        nxt = np.where(match, np.array([0, ord("m"), ord("i"), ord("d")], np.uint8)[c & 3], np.where(insert, np.where(c & 4, ord("i"), ord("m")), np.where(c & 8, ord("d"), ord("m"))))
        more = nxt != 0
        i[live] -= more & (match | insert)
        k[live] -= more & ~insert
        kind[live] = nxt
        live = live[more]
        step += 1
    bits = (best + _outside(size)) / log(2.0)
    return bits, i, end, k + 1, state + 1, [kinds[:step, r][::-1].tobytes().replace(b"\0", b"").decode() for r in range(n)]


def stable_evalues(bits: np.ndarray, mu: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Gumbel e-values and their short texts, taken in log space where a value would underflow."""
    z = lam * (bits * log(2.0) - mu)
    with np.errstate(over="ignore", under="ignore"):
        value = np.where(z <= 700, -np.expm1(-np.exp(-z)), 0.0)
    return value, [_short(v) if v > 0 else _short_power(-t / log(10.0)) for v, t in zip(value.tolist(), z.tolist())]


def _short(value: float) -> str:
    p = int(np.floor(log10(value)))
    lead = round(value / 10.0**p, 1)
    return f"{lead / 10 if lead >= 10 else lead:.1f}e{p + (lead >= 10)}"


def _short_power(power: float) -> str:
    p = int(np.floor(power))
    return f"{10 ** (power - p):.1f}e{p}"


def search(models: list[Model], texts: list[str], threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (row, profile ordinal, bits, start, end, hmm_start, hmm_end, path) of the hits of each group of texts."""
    codes = [_CODE[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)] for t in texts]
    for ordinal, model in enumerate(models):
        todo = [(row, 0, c) for row, c in enumerate(codes) if len(c)]
        while todo:
            todo.sort(key=lambda x: len(x[2]))
            passed, rest = [], []
            for at in range(0, len(todo), BATCH):
                part = todo[at : at + BATCH]
                passed += [part[k] for k in np.flatnonzero(scores(model, [c for *_, c in part]) >= threshold - MARGIN)]
            while passed:
                n = max(1, min(BATCH, TRACED_CELLS // (len(passed[-1][2]) * model.length)))
                part, passed = passed[-n:], passed[:-n]
                bits, start, end, h0, h1, paths = aligned(model, [c for *_, c in part])
                ok = np.flatnonzero(bits >= threshold)
                rows, shift = (np.array([x[k] for x in part], np.int64) for k in (0, 1))
                if len(ok):
                    yield rows[ok], np.full(len(ok), ordinal), bits[ok], (start + shift)[ok], (end + shift)[ok], h0[ok], h1[ok], [paths[k] for k in ok]
                for k in ok:
                    row, moved, c = part[k]
                    if start[k] >= LEAST_REST:
                        rest.append((row, moved, c[: start[k]]))
                    if len(c) - end[k] >= LEAST_REST:
                        rest.append((row, moved + int(end[k]), c[end[k] :]))
            todo = rest


def find_hits(records: DataFrame, profiles: list[Profile], threshold: float = 120.0, key: str = "key", part: str = "part", text: str = "sequence") -> DataFrame:
    """Hits of ``records`` (key, part, sequence); profiles travel as one broadcast.

    Only valid protein texts are searched; others (null ones too) have no hits.  The work is in the search,
    not in the bytes: texts are spread over tasks by the letters that there are to search.
    """
    spark = records.sparkSession
    models = spark.sparkContext.broadcast([Model(p) for p in profiles])
    names = [f.split()[0] for f in HITS.split(", ")]

    def run(batches):
        known = models.value
        label = pa.array([m.name for m in known], pa.string())
        mu, lam = np.array([m.mu for m in known]), np.array([m.lam for m in known])
        for batch in batches:
            for row, ordinal, bits, s, e, a, z, paths in search(known, batch.column(2).to_pylist(), threshold):
                value, shown = stable_evalues(bits, mu[ordinal], lam[ordinal])
                take, which = pa.array(row), pa.array(ordinal.astype(np.int32))
                spans = [pa.array(x.astype(np.int32)) for x in (s, e, a, z)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), label.take(which), which, pa.array(bits), pa.array(value), pa.array(shown), *spans, pa.array(paths)], names=names)

    rows = records.select(F.col(key).cast("bigint"), F.col(part).cast("int"), F.col(text)).filter(F.col(text).rlike(r"\A[ACDEFGHIKLMNPQRSTVWYX*]+\z") & (F.length(text) < 10_000))
    letters = rows.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-letters * len(profiles) // TASK_WORK))
    return rows.repartition(int(tasks)).mapInArrow(run, HITS)
