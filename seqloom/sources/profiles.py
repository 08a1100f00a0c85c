"""Profile HMMs: HMMER3 text, or built from a germline table."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..numbering.tables import blosum62
from ..runtime import whole_text

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
# Background frequencies of the residues (Robinson and Robinson), in alphabetical order.
BACKGROUND = np.array([0.0787945, 0.0151600, 0.0535222, 0.0668298, 0.0397062, 0.0695071, 0.0229198, 0.0590092, 0.0594422, 0.0963728, 0.0237718, 0.0414386, 0.0482904, 0.0395639, 0.0540978, 0.0683364, 0.0540687, 0.0673417, 0.0114135, 0.0304133])


@dataclass
class Profile:
    """Probabilities of one profile: match [L, 20], transitions [L, 7] (MM MI MD IM II DM DD) and the score's Gumbel."""

    name: str
    match: np.ndarray
    trans: np.ndarray
    mu: float = 0.0
    lam: float = log(2.0)

    @property
    def length(self) -> int:
        return len(self.match)


def parse_hmmer3(text: str) -> list[Profile]:
    """Profiles of a HMMER3 ASCII file; raises ValueError on text that is not one."""
    out, name, stats, rows, trans, body = [], "", (0.0, log(2.0)), [], [], False
    value = lambda x: 0.0 if x == "*" else exp(-float(x))
    lines = iter(text.splitlines())
    for line in lines:
        word = line.split()
        if not word:
            continue
        if word[0] == "NAME":
            name, rows, trans, body = word[1], [], [], False
        elif word[:3] == ["STATS", "LOCAL", "VITERBI"]:
            stats = (float(word[3]), float(word[4]))
        elif word[0] == "HMM":
            next(lines)
            body = True
        elif word[0] == "COMPO" or (body and not rows and not word[0].isdigit()):
            # composition, then insert emissions and transitions of the begin state
            if word[0] == "COMPO":
                next(lines)
            next(lines)
        elif word[0] == "//":
            if not rows:
                raise ValueError(f"profile {name!r} has no states")
            out.append(Profile(name, np.array(rows), np.array(trans), *stats))
            rows = []
        elif body:
            if int(word[0]) != len(rows) + 1:
                raise ValueError(f"profile {name!r}: state {word[0]} out of order")
            rows.append([value(x) for x in word[1:21]])
            next(lines)
            trans.append([value(x) for x in next(lines).split()[:7]])
    if not out:
        raise ValueError("no profile found")
    return out


def _mixed(counts: np.ndarray, weight: float = 6.0) -> np.ndarray:
    """Counts with substitution-weighted pseudocounts."""
    sub = np.array([[2.0 ** (blosum62(a, b) / 2) for b in RESIDUES] for a in RESIDUES]) * BACKGROUND
    sub /= sub.sum(axis=1, keepdims=True)
    total = counts.sum(axis=1, keepdims=True)
    share = np.divide(counts, total, out=np.tile(BACKGROUND, (len(counts), 1)), where=total > 0)
    return (counts + weight * (share @ sub)) / (total + weight)


def from_germlines(germlines: DataFrame) -> list[Profile]:
    """One profile per species and chain with V and J genes: columns of the 128 aligned states.

    The gene table is small by nature; it is read on the driver like any model file.
    """
    genes: dict[tuple[int, str, str], dict[str, list[str]]] = {}
    for r in germlines.select("species_ordinal", "species", "chain_type", "segment", "aligned_seq", "gene_ordinal").orderBy("species_ordinal", "chain_type", "segment", "gene_ordinal").collect():
        genes.setdefault((r.species_ordinal, r.species, r.chain_type), {}).setdefault(r.segment, []).append(r.aligned_seq)
    out = []
    for (_, species, chain), part in sorted(genes.items()):
        if "V" not in part or "J" not in part:
            continue
        counts, depth = np.zeros((128, 20)), np.zeros(128)
        for group in part.values():
            for seq in group:
                for k, aa in enumerate(seq[:128]):
                    i = RESIDUES.find(aa)
                    if i >= 0:
                        counts[k, i] += 1 / len(group)
                        depth[k] += 1 / len(group)
        match = _mixed(counts * 8)
        trans = np.tile([0.98, 0.01, 0.01, 0.7, 0.3, 0.7, 0.3], (128, 1))
        # states that no gene fills (the loop between the segments) are easily skipped
        gap = np.clip(1 - np.minimum(depth, 1), 0, 0.9)
        nxt = np.append(gap[1:], 0.0)
        trans[:, 2] = np.clip(0.01 + nxt * 0.3, 0, 0.5)
        trans[:, 0] = 1 - trans[:, 1] - trans[:, 2]
        trans[:, 6] = np.clip(0.3 + 0.6 * nxt, 0, 0.9)
        trans[:, 5] = 1 - trans[:, 6]
        out.append(Profile(f"{species}_{chain}", match, trans))
    return out


def read_hmmer3(spark: SparkSession, path: str) -> list[Profile]:
    """Profiles of a file on any file system that Spark reads; a model file, small by nature."""
    return parse_hmmer3(whole_text(spark, path))
