"""Sequence functions as Column expressions: cleaning, validation, translation, coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets, length limits, IUPAC complements and the standard genetic code.
PROTEIN_LETTERS, PROTEIN_LIMIT = "ACDEFGHIKLMNPQRSTVWYX*", 10_000
DNA_LETTERS, DNA_LIMIT = "ACGTUNRYKMSWBDHV", 100_000
COMPLEMENT_FROM = "ACGTURYKMBDHVSW"
COMPLEMENT_TO = "TGCAAYRMKVHDBSW"
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}
FRAMES = ("+1", "+2", "+3", "-1", "-2", "-3")

_AMBIGUOUS_OR_STOP = "X"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body (and its lambdas) name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(s: Column) -> Column:
    """Without gap marks and in upper case; other than ASCII letters stay as they are."""
    return F.translate(F.translate(s, "-.", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def valid_protein(s: Column) -> Column:
    """Only residue letters and fewer than 10,000 of them; the empty text passes."""
    return s.rlike(r"\A[ACDEFGHIKLMNPQRSTVWYX*]*\z") & (F.length(s) < PROTEIN_LIMIT)


def valid_dna(s: Column) -> Column:
    """Only IUPAC nucleotide letters and fewer than 100,000 of them."""
    return s.rlike(r"\A[ACGTUNRYKMSWBDHV]*\z") & (F.length(s) < DNA_LIMIT)


def reverse_complement(dna: Column) -> Column:
    """IUPAC reverse complement; U pairs like T, unknown letters become N."""
    known = F.regexp_replace(F.reverse(dna), f"[^{COMPLEMENT_FROM}]", "N")
    return F.translate(known, COMPLEMENT_FROM, COMPLEMENT_TO)


def codons(dna: Column) -> Column:
    """Whole codons of a text, as an array; a trailing one or two letters are left out."""

    def cut(s: Column) -> Column:
        n = F.floor(F.length(s) / 3).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(s, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))

    return let(dna, cut)


def amino_acid(codon: Column) -> Column:
    """One-letter residue, ``*`` for a stop, ``X`` for anything ambiguous."""

    # three letters to a number by their places in TCAG, then one character of the table: no map lookup
    def residue(t: Column) -> Column:
        a, b, c = (F.instr(F.lit(_BASES), F.substring(t, k, 1)) for k in (1, 2, 3))
        known = (a > 0) & (b > 0) & (c > 0) & (F.length(t) == 3)
        return F.when(known, F.substring(F.lit(_AMINO), (a - 1) * 16 + (b - 1) * 4 + c, F.lit(1))).otherwise(_AMBIGUOUS_OR_STOP)

    return let(F.translate(codon, "U", "T"), residue)


def residues(dna: Column) -> Column:
    """Residue of every codon, as an array in which stops are ``*``."""
    return F.transform(codons(dna), amino_acid)


def nt_range(nt_offset: Column, is_reverse: Column, length: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Forward-strand nucleotide range of a residue span in a frame."""
    lo, hi = nt_offset + start * 3, nt_offset + end * 3
    return F.when(is_reverse, length - hi).otherwise(lo), F.when(is_reverse, length - lo).otherwise(hi)


def coding_dna(dna: Column, nt_start: Column, nt_end: Column, is_reverse: Column) -> Column:
    """The coding strand of a forward-strand range."""
    part = F.substring(dna, nt_start + 1, nt_end - nt_start)
    return F.when(is_reverse, reverse_complement(part)).otherwise(part)


def flank_before(peptide: Column, start: Column) -> Column:
    """From the nearest ``M`` in front of the domain, or from the beginning, up to it."""
    head = F.substring(peptide, F.lit(1), start)
    last = F.length(head) - F.instr(F.reverse(head), F.lit("M")) + 1
    return F.when(F.instr(head, "M") > 0, F.substr(head, last)).otherwise(head)


def flank_after(peptide: Column, end: Column, stops: Column) -> Column:
    """From the domain's end to the first stop behind it, or to the end."""
    stop = F.coalesce(F.array_min(F.filter(stops, lambda p: p >= end)), F.length(peptide))
    return F.substring(peptide, end + 1, stop - end)


def stops_inside(stops: Column, start: Column, end: Column) -> Column:
    return F.filter(stops, lambda p: (p >= start) & (p < end))


def wrapped(s: Column, width: int = 60) -> Column:
    """Line breaks after every ``width`` letters."""
    return F.regexp_replace(s, f"(?s)(.{{{width}}})(?=.)", "$1\n")


def csv_field(s: Column) -> Column:
    """Quoted where it holds a comma, quote or line break; quotes doubled."""
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def looks_like_dna(letters: Column) -> Column:
    """At least 30 letters after white space and gaps are gone, all of them IUPAC nucleotides."""
    plain = F.upper(F.regexp_replace(letters, r"[\s\-.]", ""))
    return (F.length(plain) >= 30) & plain.rlike(rf"\A[{DNA_LETTERS}]*\z")
