"""Names, chains, positions and e-values as Column expressions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..numbering.tables import CDR_RANGES, CHAINS, cdr_ranges

UNKNOWN_SPECIES, UNKNOWN_CHAIN = "unknown", "H"


def profile_species(name: Column) -> Column:
    """Species part of a profile name, before its first ``_``."""
    return F.when(F.instr(name, "_") > 0, F.substring_index(name, "_", 1)).otherwise(UNKNOWN_SPECIES)


def profile_chain(name: Column) -> Column:
    """Chain part of a profile name, behind its first ``_``."""
    at = F.instr(name, "_")
    return F.when(at > 0, F.substr(name, at + 1)).otherwise(UNKNOWN_CHAIN)


def class_of_chain(chain: Column) -> Column:
    """Chain class: K and L are L, unknown chains are H."""
    return F.when(chain.isin("K", "L"), "L").when(chain.isin("A", "B", "G", "D"), chain).otherwise("H")


def allowed_chains(restrict: str, scheme: str) -> list[str]:
    """Chains that a restriction keyword leaves, in canonical order; unknown keywords leave all.

    Schemes other than imgt and aho cover antibody chains only.
    """
    groups = {"ig": "HKL", "tr": "ABGD", "heavy": "H", "light": "KL", "h": "H", "k": "K", "l": "L", "a": "A", "b": "B"}
    chosen = groups.get(restrict.strip().lower(), "".join(CHAINS))
    if scheme not in ("imgt", "aho"):
        chosen = "".join(c for c in chosen if c in "HKL")
    return [c for c in CHAINS if c in chosen]


def position_label(position: Column, insertion: Column) -> Column:
    return F.concat(position.cast("string"), F.trim(insertion))


def position_key(position: Column, insertion: Column) -> Column:
    return F.concat_ws("|", position.cast("string"), insertion)


def cdr_of(position: Column, scheme: Column, klass: Column) -> Column:
    """``cdr1``..``cdr3`` of a position, or the empty text."""
    out = F.lit("")
    for (name, k), ranges in CDR_RANGES.items():
        others = [c for s, c in CDR_RANGES if s == name and c != "*"]
        here = (scheme == name) & ((klass == k) if k != "*" else ~F.coalesce(klass, F.lit("")).isin(*others) if others else F.lit(True))
        for n, (a, b) in enumerate(ranges, 1):
            out = F.when(here & position.between(a, b), f"cdr{n}").otherwise(out)
    return out


def scope_ranges(scope: str, scheme: str, klass: str) -> list[tuple[int, int]] | None:
    """Position ranges of a scope: None for ``full``, no range at all for an unknown scope."""
    if scope == "full":
        return None
    r = cdr_ranges(scheme, klass)
    wanted = {"cdr1": (0,), "cdr2": (1,), "cdr3": (2,), "cdrs": (0, 1, 2)}.get(scope, ())
    return [r[k] for k in wanted if k < len(r)]


def evalue(bits: Column, mu: Column, lam: Column) -> Column:
    """Gumbel e-value of a bit score against one model, exact for small values."""
    z = lam * (bits * F.lit(log(2.0)) - mu)
    return F.when(z > 700, 0.0).otherwise(-F.expm1(-F.exp(-z)))


def evalue_text(value: Column) -> Column:
    """One decimal and the bare exponent, as ``2.8e-40``."""
    exponent = F.floor(F.log10(value))
    mantissa = F.round(value / F.pow(F.lit(10.0), exponent), 1)
    carried = F.when(mantissa >= 10, exponent + 1).otherwise(exponent)
    shown = F.when(mantissa >= 10, F.lit(1.0)).otherwise(mantissa)
    return F.when(value == 0, "0.0e0").otherwise(F.concat(F.format_string("%.1f", shown), F.lit("e"), carried.cast("string")))
