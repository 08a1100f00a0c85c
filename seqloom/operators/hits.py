"""Choosing among profile hits: thresholds, chain and species filters, non-overlap, best frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import allowed_chains, profile_chain, profile_species


def above_threshold(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.filter(F.col("bit_score") >= threshold)


def of_chains(hits: DataFrame, restrict: str = "", scheme: str = "imgt") -> DataFrame:
    return hits.filter(profile_chain(F.col("hmm_name")).isin(*allowed_chains(restrict, scheme)))


def prefer_species(hits: DataFrame, species: list[str] | None, key: str = "result_no") -> DataFrame:
    """Hits of the asked species; a sequence that has none keeps all of its hits."""
    names = [s.strip().lower() for s in species or [] if s.strip()]
    if not names:
        return hits
    asked = F.lower(profile_species(F.col("hmm_name"))).isin(*names)
    # distinct keys are aggregated map-side, so a sequence with very many hits is no hot group
    some = hits.filter(asked).select(key).distinct().withColumn("_some", F.lit(True))
    return hits.join(some, key, "left").filter(asked | F.col("_some").isNull()).drop("_some")


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Half-open spans that share a position."""
    return (start_b < end_a) & (start_a < end_b)


def best_apart(hits: Column) -> Column:
    """Greedy choice in an array of structs (rank, start, end, ...): in rank order, whatever overlaps nothing chosen.

    ``rank`` is any orderable first field (negative score, then an ordinal); the result is in order of ``start``.
    """
    ordered = F.array_sort(hits)
    empty = F.slice(hits, 1, 0)
    chosen = F.aggregate(ordered, empty, lambda acc, h: F.when(F.exists(acc, lambda c: overlaps(c["start"], c["end"], h["start"], h["end"])), acc).otherwise(F.concat(acc, F.array(h))))
    return F.array_sort(chosen, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def select_domains(hits: DataFrame, key: str = "result_no", ordinal: str = "hit_no") -> DataFrame:
    """Non-overlapping hits of each sequence, best score first; ``domain_index`` counts them by start.

    Of hits with one span only the best can be chosen, so each span is reduced map-side before a
    sequence's hits form one array: its size is bounded by the sequence's spans, not by the rows.
    Hits with a null or NaN score or no span take no part.
    """
    rows = hits.filter("bit_score is not null and not isnan(bit_score) and seq_start is not null and seq_end is not null")
    # an empty span overlaps nothing, not even its like
    alone = F.when(F.col("seq_end") <= F.col("seq_start"), F.col(ordinal))
    best = rows.groupBy(key, F.col("seq_start").alias("start"), F.col("seq_end").alias("end"), alone.alias("_alone")).agg(F.min(F.struct((-F.col("bit_score")).alias("rank"), F.col(ordinal).alias("ordinal"))).alias("b"))
    h = F.struct(F.col("b.rank").alias("rank"), F.col("b.ordinal").alias("ordinal"), "start", "end")
    kept = best.groupBy(key).agg(best_apart(F.collect_list(h)).alias("kept"))
    return kept.select(key, F.posexplode("kept").alias("domain_index", "d")).select(
        key, "domain_index", F.col("d.ordinal").alias(ordinal), (-F.col("d.rank")).alias("bit_score"), F.col("d.start").alias("seq_start"), F.col("d.end").alias("seq_end")
    )


def frame_rank() -> Column:
    """Order of frames, best first: most domains, highest total, highest score of its first domain, then frame order."""
    return F.struct((-F.col("n_domains")).alias("n"), (-F.col("total_score")).alias("total"), (-F.col("first_score")).alias("first"), "frame_no")


def best_frame(frames: DataFrame, key: str = "ordinal") -> DataFrame:
    """The best frame of every sequence by :func:`frame_rank`.

    ``frames`` has one row a frame with ``frame_no, n_domains, total_score, first_score``; the choice is a
    minimum, combined map-side.
    """
    rest = [c for c in frames.columns if c != key]
    best = frames.filter("n_domains > 0").groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), frame_rank()).alias("_b"))
    return best.select(key, *[F.col("_b").getField(c).alias(c) for c in rest])


def with_profile(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"species": profile_species(F.col("hmm_name")), "chain_type": profile_chain(F.col("hmm_name"))})
