"""Numbering of selected domains as one map over Arrow batches.

Labels depend on a domain's chain, its states and kinds and, in one rule, its residues; not on
where it lies.  So each distinct pattern is numbered once per task, on places instead of letters, and a
batch's numberings are gathered from the patterns with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import number, reach, stitch
from .tables import CHAINS, LETTERS, NONE, Canonical, resolve_scheme, scheme_for

NUMBERED = "key bigint, part int, domain_index int, seq_start int, seq_end int, state_sequence string, numbering array<struct<position:int,insertion:string,amino_acid:string>>"
#: Distinct patterns that a task keeps.
PATTERNS = 100_000
_CODES = [*LETTERS, NONE]
_CODE_OF = {c: k for k, c in enumerate(_CODES)}
#: Places stand for letters while a pattern is numbered: characters of a private range.
_PLACE = 0xF0000


class Pattern:
    """Numbering of one pattern: ``position``, ``code``, ``place`` (-1: a gap), the 128 ``states``' places, the span; None ``position``: not covered."""

    def __init__(self, scheme: str, chain: str, vector: list, length: int, letters: str | None):
        text = letters if letters is not None else "".join(map(chr, range(_PLACE, _PLACE + length)))
        found = number(scheme, chain, vector, text)
        if found is None:
            self.position = None
            return
        labels, first, last = found
        self.span = (first, last + 1) if first is not None else None
        self.position = np.array([p for (p, _), _ in labels], np.int32)
        self.code = np.array([_CODE_OF[c] for (_, c), _ in labels], np.int8)
        if letters is None:
            self.place = np.array([-1 if aa == "-" else ord(aa) - _PLACE for _, aa in labels], np.int64)
        else:  # residues keep their order
            at = iter(range(first or 0, length))
            self.place = np.array([-1 if aa == "-" else next(at) for _, aa in labels], np.int64)
        self.states = np.full(128, -1, np.int64)
        for state, kind, at in vector:
            if kind == "m" and at is not None and 1 <= state <= 128:
                self.states[state - 1] = at


def _flat_paths(column: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states, kinds, offsets) of paths given as arrays of (state, kind) or as texts of kinds from state ``first``."""
    if pa.types.is_list(column.type):
        column = pc.if_else(pc.is_null(column), pa.scalar([], column.type), column) if column.null_count else column
        off = column.offsets.to_numpy().astype(np.int64)
        flat = column.flatten()
        kinds = np.frombuffer("".join(k if k in ("m", "i", "d") else "?" for k in flat.field("kind").to_pylist()).encode(), np.uint8)
        return pc.fill_null(flat.field("state"), 0).to_numpy(zero_copy_only=False).astype(np.int64), kinds, off - off[0]
    texts = column.to_pylist()
    size = np.array([len(t or "") for t in texts], np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    kinds = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    moves = np.cumsum(kinds != ord("i"))
    before = np.concatenate(([0], moves))[off[:-1]]
    return moves - np.repeat(before - first + 1, size), kinds, off


def _patterns(scheme: str, batch: pa.RecordBatch, j_parts: bool, known: dict) -> Iterator[tuple[int, int, Pattern]]:
    """(row, sequence index of place 0, pattern) of every domain that the scheme covers."""
    col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    ints = {c: col[c].to_numpy(zero_copy_only=False) for c in ("domain_index", "n_domains", "seq_start", "seq_end", "hmm_start", "hmm_end", "model_length")}
    states, kinds, off = _flat_paths(col["path"], ints["hmm_start"].astype(np.int64))
    chains, sequences = col["chain_type"].to_pylist(), col["sequence"].to_pylist()
    j_regions = col["j_region"].to_pylist() if j_parts else None
    front, behind = reach(*(ints[c].astype(np.int64) for c in ("domain_index", "n_domains", "seq_start", "seq_end", "hmm_start", "hmm_end", "model_length")), np.array([len(s) for s in sequences]))
    named = {c: any(isinstance(r, Canonical) for r in s.rules.values()) for c in {*chains} if (s := scheme_for(scheme, c))}
    for r, chain in enumerate(chains):
        if chain not in named:
            continue
        lo, hi = off[r], off[r + 1]
        s, k = states[lo:hi], kinds[lo:hi]
        n_front, n_behind, start, end = int(front[r]), int(behind[r]), int(ints["hmm_start"][r]), int(ints["hmm_end"][r])
        base = int(ints["seq_start"][r]) - n_front
        j = j_regions[r] if j_parts else None
        j_key = None if not j else (j["first"] - base, tuple(j["states"]), j["kinds"])
        used = n_front + int(np.count_nonzero(k != ord("d"))) + n_behind if not j_key else j_key[0] + len(j_key[1])
        length = min(len(sequences[r]) - base, used + 1)
        letters = sequences[r][base : base + length] if named[chain] else None
        key = (chain, n_front, n_behind, start if n_front else 0, end if n_behind else 0, s.tobytes(), k.tobytes(), j_key, length, letters)
        pattern = known.get(key)
        if pattern is None:
            at = n_front
            vector = [(start - x, "m", n_front - x) for x in range(n_front, 0, -1)]
            for state, kind in zip(s.tolist(), k.tobytes().decode()):
                if kind == "d":
                    vector.append((state, "d", None))
                elif kind != "?":
                    vector.append((state, kind, at))
                    at += 1
            vector += [(end + 1 + x, "m", at + x) for x in range(n_behind)]
            if j_key:
                vector = stitch(vector, [(state, kind, j_key[0] + x) for x, (state, kind) in enumerate(zip(j_key[1], j_key[2]))])
            if len(known) >= PATTERNS:
                known.clear()
            pattern = known[key] = Pattern(scheme, chain, vector, length, letters)
        if pattern.position is not None:
            yield r, base, pattern


def _letters(codes: np.ndarray) -> pa.Array:
    """One text a code point."""
    if not len(codes) or codes.max() < 128:
        return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32)), pa.py_buffer(codes.astype(np.uint8)))
    return pa.array(list(codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")), pa.string())


def number_domains(domains: DataFrame, scheme: str, j_parts: bool = False) -> DataFrame:
    """``NUMBERED`` rows of ``domains``: hit columns, ``sequence``, ``n_domains`` and ``model_length``.

    ``path`` is an array of (state, kind) or a text of kinds that starts at ``hmm_start``.  With ``j_parts`` a
    column ``j_region`` (first sequence index, states, kinds) is stitched on where it is present.  A domain whose chain the
    scheme does not cover is dropped, and its index stays a hole.
    """
    name = resolve_scheme(scheme)
    if name is None:
        raise ValueError(f"unknown scheme {scheme!r}")
    names = [c.split()[0] for c in NUMBERED.split(", ", 6)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = list(_patterns(name, batch, j_parts, known))
            if not rows:
                continue
            at, base = np.array([r for r, *_ in rows]), np.array([b for _, b, _ in rows], np.int64)
            found = [p for *_, p in rows]
            col = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            texts = [col["sequence"][int(r)].as_py() for r in at]
            letters = np.frombuffer(("".join(texts) + "-").encode("utf-32-le", "surrogatepass"), np.uint32)  # the last one stands for gaps
            begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1])) + base
            size = np.array([len(p.position) for p in found])
            place = np.concatenate([p.place for p in found])
            aa = letters[np.where(place >= 0, place + np.repeat(begin, size), -1)]
            cells = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([p.position for p in found])), pa.array(_CODES).take(pa.array(np.concatenate([p.code for p in found]))), _letters(aa)], names=["position", "insertion", "amino_acid"]
            )
            numbering = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), cells)
            states = np.stack([p.states for p in found])
            line = letters[np.where(states >= 0, states + begin[:, None], -1)]
            line = np.where((line >= ord("a")) & (line <= ord("z")), line - 32, line)
            text = [x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for x in line]
            spans = [p.span for p in found]
            old = [col[c].to_numpy(zero_copy_only=False)[at] for c in ("seq_start", "seq_end")]
            start, end = (np.array([s[k] + b if s else o for s, b, o in zip(spans, base, old[k])], np.int32) for k in (0, 1))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(col[c].take(take) for c in ("key", "part", "domain_index")), pa.array(start), pa.array(end), pa.array(text, pa.string()), numbering], names=names)

    columns = ["key", "part", "domain_index", "n_domains", "model_length", "seq_start", "seq_end", "hmm_start", "hmm_end", "path", "sequence", "chain_type", *(["j_region"] if j_parts else [])]
    ints = {"key": "bigint", **dict.fromkeys(["part", "domain_index", "n_domains", "model_length", "seq_start", "seq_end", "hmm_start", "hmm_end"], "int")}
    live = domains.filter("sequence is not null and path is not null").filter(F.col("chain_type").isin(*CHAINS) if name != "imgt" and name != "aho" else F.col("chain_type").isNotNull())
    return live.select(*[F.col(c).cast(ints[c]) if c in ints else F.col(c) for c in columns]).mapInArrow(run, NUMBERED)

