"""Duplicate results: the canonical member of each group, result classes and counts.

Works on a results table: ``ordinal, sequence, input_type, domains`` (array of structs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import coding_dna, let, normalise
from .translate import codon_measures


def residue_text(numbering: Column) -> Column:
    """Residues of a numbering without gaps."""
    return F.array_join(F.filter(F.transform(numbering, lambda r: r["amino_acid"]), lambda a: a.isNotNull() & (a != "-")), "")


def present_domains(domains: Column) -> Column:
    return F.filter(F.coalesce(domains, F.slice(domains, 1, 0)), lambda d: d.isNotNull())


def is_dna(input_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(input_type)) == "dna", F.lit(False))


def has_stop(domains: Column) -> Column:
    """Some domain reads through a stop."""
    return F.coalesce(F.exists(domains, lambda d: F.size(d["stop_positions"]) > 0), F.lit(False))


def _amber_as_q(domain: Column, residues: Column, dna: Column) -> Column:
    """``residues`` of a domain with ``X`` read as ``Q`` where its codon is TAG; the k-th residue has the k-th codon."""
    reverse = F.coalesce(F.startswith(domain["translation_frame"], F.lit("-")), F.lit(False))
    coding = F.upper(F.coalesce(coding_dna(dna, domain["nt_start"], domain["nt_end"], reverse), F.lit("")))
    read = lambda c: F.transform(F.split(residues, ""), lambda aa, k: F.when((aa == "X") & (F.substring(c, k * 3 + 1, F.lit(3)) == "TAG"), "Q").otherwise(aa))
    return F.when(F.contains(residues, F.lit("X")), F.array_join(let(coding, read), "")).otherwise(residues)


def duplicate_key(sequence: Column, input_type: Column, domains: Column, readthrough_as_q: bool = False) -> Column:
    """What makes two results the same: DNA by chain and residues of its domains, else the raw sequence; upper case.

    With ``readthrough_as_q`` an amber stop that a domain reads through counts as a ``Q``; other stops stay ``X``.
    """
    d = present_domains(domains)
    text = lambda x: F.coalesce(residue_text(x["numbering"]), F.lit(""))
    shown = (lambda x: F.when(has_stop(domains), _amber_as_q(x, text(x), normalise(sequence))).otherwise(text(x))) if readthrough_as_q else text
    translated = F.array_join(F.transform(d, lambda x: F.concat(F.coalesce(x["chain_type"], F.lit("")), F.lit(":"), shown(x))), "|")
    return F.upper(F.when(is_dna(input_type) & (F.size(d) > 0), translated).otherwise(F.coalesce(sequence, F.lit(""))))


def codon_scores(coding: DataFrame, key: str = "result_no") -> DataFrame:
    """``key, score``: codon adaptation of every result, summed over its domains (``coding`` has a row a domain with its coding DNA)."""
    measured = codon_measures(coding, key, text="coding")
    # rounded, so that sums in another order are still equal
    return measured.groupBy(key).agg(F.round(F.sum("cai"), 9).alias("score"))


def mark_canonical(results: DataFrame, ordinal: str = "result_no", scores: DataFrame | None = None, keep: tuple[str, ...] = (), readthrough_as_q: bool = False) -> DataFrame:
    """``ordinal, keep, has_stop, n_domains, canonical, slot, is_canonical`` of every result.

    Within a group: stop-free before others, then the higher codon score (stop-free only; results that
    ``scores`` does not name have 0), then the earlier one; ``slot`` is the place of the group's first member.  Only
    flags and 96 bits of the key's hash are shuffled, never a document.  The choice is a minimum of a struct,
    combined map-side, so a group of very many copies costs no more than others; the join back leaves a
    hot key to the adaptive skew join.
    """
    key = duplicate_key(F.col("sequence"), F.col("input_type"), F.col("domains"), readthrough_as_q)
    marked = results.select(ordinal, *keep, has_stop(F.col("domains")).alias("has_stop"), F.greatest(F.size(present_domains(F.col("domains"))), F.lit(0)).alias("n_domains"), key.alias("_key"))
    marked = marked.withColumns({"_h": F.xxhash64("_key"), "_g": F.hash("_key")}).drop("_key")
    if scores is not None:
        marked = marked.join(scores.select(ordinal, F.col("score").alias("_score")), ordinal, "left")
    score = F.when(F.col("has_stop"), F.lit(0.0)).otherwise(F.coalesce("_score", F.lit(0.0))) if scores is not None else F.lit(0.0)
    rank = F.struct(F.col("has_stop").alias("stop"), (-score).alias("score"), F.col(ordinal).alias("ordinal"))
    best = marked.groupBy("_h", "_g").agg(F.min(rank)["ordinal"].alias("canonical"), F.min(ordinal).alias("slot"))
    joined = marked.join(best, ["_h", "_g"])
    return joined.select(ordinal, *keep, "has_stop", "n_domains", "canonical", "slot", (F.col("canonical") == F.col(ordinal)).alias("is_canonical"))


def result_classes(marked: DataFrame) -> DataFrame:
    """Adds ``class_stop, class_no_domain, class_correct, class_usable``."""
    stop, none = F.col("has_stop"), F.col("n_domains") == 0
    return marked.withColumns({"class_stop": stop, "class_no_domain": none, "class_correct": ~none & ~stop, "class_usable": ~none & ~stop & F.col("is_canonical")})


def summary(classed: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda c: F.count_if(F.col(c))
    return classed.agg(
        F.count("*").alias("total"),
        n("class_correct").alias("correct"),
        n("is_canonical").alias("unique_results"),
        F.count_if(~F.col("is_canonical")).alias("duplicates"),
        n("class_stop").alias("with_stop"),
        n("class_no_domain").alias("no_domain"),
        n("class_usable").alias("usable"),
    )


def duplicate_members(marked: DataFrame, ordinal: str = "result_no") -> DataFrame:
    """``canonical, size, member``: a flat row for every other member of every group with duplicates; no list is gathered."""
    others = marked.filter("not is_canonical")
    sizes = others.groupBy("canonical").agg((F.count("*") + 1).alias("size"))
    return others.select("canonical", F.col(ordinal).alias("member")).join(sizes, "canonical").select("canonical", "size", "member")


def duplicate_groups(marked: DataFrame, ordinal: str = "result_no") -> DataFrame:
    """``canonical, size, duplicates`` of every group with duplicates; ``duplicates`` lists all other members.

    The list of a group lies in one row, whatever its size; :func:`duplicate_members` has the same as flat rows.
    """
    return marked.filter("not is_canonical").groupBy("canonical").agg((F.count("*") + 1).alias("size"), F.sort_array(F.collect_list(ordinal)).alias("duplicates"))


def for_download(classed: DataFrame, omit_stops: bool = True, omit_no_domain: bool = True, unique_only: bool = False) -> DataFrame:
    """The rows an export takes."""
    keep = F.lit(True)
    if omit_stops:
        keep = keep & ~F.col("class_stop")
    if omit_no_domain:
        keep = keep & ~F.col("class_no_domain")
    if unique_only:
        keep = keep & F.col("is_canonical")
    return classed.filter(keep)
