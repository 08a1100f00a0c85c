"""Base quality of traces and the codon track along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import amino_acid, let, reverse_complement


def _round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def mean_quality(qualities: Column) -> Column:
    """Phred value of the mean error probability, 60 if that is 0; null without values."""
    mean = F.aggregate(qualities, F.lit(0.0), lambda a, q: a + F.pow(F.lit(10.0), -q / 10.0)) / F.size(qualities)
    return F.when(F.size(qualities) > 0, F.when(mean > 0, _round_half_up(-10 * F.log10(mean))).otherwise(60))


def share_from(qualities: Column, least: int = 20) -> Column:
    """Percent of values of at least ``least``."""
    return F.when(F.size(qualities) > 0, _round_half_up(100.0 * F.size(F.filter(qualities, lambda q: q >= least)) / F.size(qualities)))


def span_qualities(qualities: Column, nt_start: Column, nt_end: Column) -> Column:
    """Values of a forward-strand range."""
    return F.slice(qualities, nt_start + 1, F.greatest(nt_end - nt_start, F.lit(0)))


def codon_track(bases: Column, nt_start: Column, nt_end: Column, is_reverse: Column, flank: int = 0) -> Column:
    """Array of (k, codon, residue, is_stop, base_start, is_flank) along the coding strand of a range.

    ``base_start`` is the forward-strand index of the codon's first letter in reading order.  ``flank`` whole codons on
    either side are shown as well, as far as there are any; they have k below 0 or beyond the range.
    """
    n = F.floor((nt_end - nt_start) / 3).cast("int")
    length = F.length(bases)
    # whole codons of the flanks, in reading order: towards the end in front of a reverse range
    room = lambda letters: F.least(F.lit(flank), F.floor(letters / 3)).cast("int")
    first_end, last_start = F.when(is_reverse, nt_end).otherwise(nt_start), F.when(is_reverse, nt_end - n * 3).otherwise(nt_start + n * 3)
    before = room(F.when(is_reverse, length - first_end).otherwise(first_end)) if flank else F.lit(0)
    behind = room(F.when(is_reverse, last_start).otherwise(length - last_start)) if flank else F.lit(0)
    lo = F.when(is_reverse, last_start - behind * 3).otherwise(nt_start - before * 3)
    part = F.substring(bases, lo + 1, (before + n + behind) * 3)
    coding = F.when(is_reverse, reverse_complement(part)).otherwise(part)

    def at(strand: Column, i: Column) -> Column:
        codon = F.substring(strand, (i + before) * 3 + 1, F.lit(3))
        aa = amino_acid(codon)
        place = F.when(is_reverse, nt_end - 1 - i * 3).otherwise(nt_start + i * 3)
        return F.struct(i.alias("k"), codon.alias("codon"), aa.alias("residue"), (aa == "*").alias("is_stop"), place.alias("base_start"), ((i < 0) | (i >= n)).alias("is_flank"))

    return F.when(n > 0, let(coding, lambda strand: F.transform(F.sequence(-before, n + behind - 1), lambda i: at(strand, i))))


def residue_codon(bases: Column, nt_start: Column, nt_end: Column, is_reverse: Column, k: Column) -> Column:
    """Codon of the k-th (0-based) residue of a range, in reading order; null beyond its end."""
    codon = F.when(is_reverse, reverse_complement(F.substring(bases, nt_end - 3 * k - 2, F.lit(3)))).otherwise(F.substring(bases, nt_start + 3 * k + 1, F.lit(3)))
    return F.when((k >= 0) & (k < F.floor((nt_end - nt_start) / 3)), codon)


def domain_qualities(results: DataFrame, traces: DataFrame) -> DataFrame:
    """``id, domain_pos, mean_quality, share20`` of every domain of results that have a trace.

    Results without a trace stay, with null values; a domain without a nucleotide range has none either.
    """
    d = results.select("id", F.posexplode("domains").alias("domain_pos", "d")).filter("d is not null").select("id", "domain_pos", F.col("d.nt_start").alias("a"), F.col("d.nt_end").alias("b"))
    span = span_qualities(F.col("quality"), F.col("a"), F.col("b"))
    q = d.join(traces.select("id", "quality"), "id", "left").withColumn("q", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), span))
    return q.select("id", "domain_pos", mean_quality(F.col("q")).alias("mean_quality"), share_from(F.col("q")).alias("share20"))
