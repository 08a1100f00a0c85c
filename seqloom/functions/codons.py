"""Codon usage tables, and expressions over arrays of codons."""

from __future__ import annotations

from itertools import groupby
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import CODONS

# E. coli K-12 codon usage per thousand (public table), in TCAG order.
_ORDER = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
_PER_THOUSAND = """
22.4 16.6 13.9 13.7  8.5 8.6 7.2 8.9  16.2 12.2 2.0 0.2  5.2 6.4 0.9 15.2
11.0 11.1 3.9 52.6  7.0 5.5 8.4 23.2  12.9 9.7 15.3 28.8  20.9 22.0 3.6 5.4
30.5 25.1 4.4 27.9  9.0 23.4 7.1 14.4  17.7 21.7 33.6 10.3  8.8 16.1 2.1 1.2
18.3 15.3 10.9 26.4  15.3 25.5 20.1 33.6  32.1 19.1 39.4 17.8  24.7 29.6 8.0 11.1
"""
RARE = ("AGA", "AGG", "CGA", "CGG", "CTA", "ATA", "CCC")


def usage_table() -> dict[str, float]:
    """Codons per thousand."""
    return dict(zip(_ORDER, map(float, _PER_THOUSAND.split())))


def weights(usage: dict[str, float]) -> dict[str, float]:
    """Relative adaptiveness: frequency over the highest among the codons of the same residue."""
    by_residue = sorted((CODONS[c], c) for c in usage if CODONS[c] != "*")
    out = {}
    for _, box in groupby(by_residue, key=lambda x: x[0]):
        names = [c for _, c in box]
        top = max(usage[c] for c in names)
        out |= {c: usage[c] / top for c in names}
    return out


def has_amber(codon_array: Column) -> Column:
    return F.exists(codon_array, lambda c: F.translate(F.upper(c), "U", "T") == "TAG")


def amber_fixed(codon_array: Column) -> Column:
    """The coding text with every in-frame TAG read as CAG."""
    return F.array_join(F.transform(codon_array, lambda c: F.when(F.translate(F.upper(c), "U", "T") == "TAG", "CAG").otherwise(c)), "")
