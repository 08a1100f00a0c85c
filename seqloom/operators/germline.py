"""Closest germline genes of aligned domains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, maybe_broadcast, small

#: Tasks that score the distinct state texts of one file split.
TASKS_A_SPLIT = 8


def identity(query: Column, germline: Column) -> Column:
    """Share of the germline's 128 first positions other than gaps that the query matches; 0 if there are none."""
    g = F.substring(germline, 1, 128)
    filled = F.length(F.replace(g, F.lit("-"), F.lit("")))
    # Levenshtein and Hamming built-ins do not skip gaps; a fold over positions does, without leaving the JVM
    same = F.aggregate(
        F.sequence(F.lit(1), F.lit(128)),
        F.lit(0),
        lambda acc, i: acc + F.when((F.substring(g, i, F.lit(1)) != "-") & (F.substring(g, i, F.lit(1)) == F.substring(query, i, F.lit(1))), 1).otherwise(0),
    )
    return F.when(filled > 0, same / filled).otherwise(0.0)


def species_order(germlines: DataFrame) -> DataFrame:
    """Canonical order of species: that of the heavy V genes."""
    return germlines.filter("segment = 'V' and chain_type = 'H'").groupBy("species").agg(F.min("species_ordinal").alias("species_rank"))


def model_lengths(germlines: DataFrame) -> DataFrame:
    """Model length of each species and chain: the first J gene without its trailing gaps."""
    j = germlines.filter("segment = 'J'").groupBy("species", "chain_type").agg(F.min_by("aligned_seq", "gene_ordinal").alias("s"))
    return j.select("species", "chain_type", F.length(F.rtrim(F.translate("s", "-", " "))).alias("model_length"))


def missing_species(germlines: DataFrame, species: list[str]) -> DataFrame:
    """Chains for which an asked species has no V genes: no assignment is made for them."""
    v = germlines.filter("segment = 'V'").select("chain_type", "species").distinct()
    wanted = v.select("chain_type").distinct().withColumn("species", F.explode(F.array(*[F.lit(s) for s in species])))
    return wanted.join(v, ["chain_type", "species"], "left_anti").select("chain_type").distinct()


def _order(germlines: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        return species_order(germlines)
    return germlines.sparkSession.createDataFrame([(s, k) for k, s in enumerate(names)], "species string, species_rank int")


def _score_by_join(ask: DataFrame, germlines: DataFrame, order: DataFrame) -> DataFrame:
    """Best genes of distinct (chain_type, state_sequence), for gene tables of any size: joins and argmax by struct."""
    v = germlines.filter("segment = 'V'").join(maybe_broadcast(order), "species")
    score = lambda rank: F.struct(identity(F.col("state_sequence"), F.col("aligned_seq")).alias("identity"), (-F.col(rank)).alias("r"), (-F.col("gene_ordinal")).alias("o"))
    best_v = (
        ask.join(v.select("chain_type", "species", "species_rank", "gene", "gene_ordinal", "aligned_seq"), "chain_type")
        .groupBy("chain_type", "state_sequence")
        .agg(F.max(F.struct(score("species_rank").alias("s"), "species", "gene")).alias("v"))
        .select("chain_type", "state_sequence", F.col("v.species").alias("identity_species"), F.col("v.gene").alias("v_gene"), F.col("v.s.identity").alias("v_identity"))
    )
    j = germlines.filter("segment = 'J'").select("chain_type", F.col("species").alias("identity_species"), "gene", "gene_ordinal", "aligned_seq")
    return (
        best_v.join(j, ["chain_type", "identity_species"], "left")
        .groupBy("chain_type", "state_sequence", "identity_species", "v_gene", "v_identity")
        .agg(F.max(F.struct(score("gene_ordinal").alias("s"), "gene")).alias("j"))
        .select("chain_type", "state_sequence", "identity_species", "v_gene", "v_identity", F.coalesce("j.gene", F.lit("")).alias("j_gene"), F.when(F.col("j.gene").isNull(), 0.0).otherwise(F.col("j.s.identity")).alias("j_identity"))
    )


def letter_matrix(texts: list[str]) -> np.ndarray:
    """The first 128 letters of each text as bytes, ``-`` behind its end; letters beyond ASCII match nothing."""
    flat = "".join(t[:128].ljust(128, "-") for t in texts).encode("ascii", "replace")
    return np.frombuffer(flat, np.uint8).reshape(len(texts), 128)


class _Genes:
    """Genes of one segment, chain (and species) as a letter matrix in order of preference."""

    def __init__(self, rows: list):
        self.species, self.gene = np.array([r.species for r in rows]), np.array([r.gene for r in rows])
        self.letters = letter_matrix([r.aligned_seq for r in rows]).copy()
        self.size = np.maximum((self.letters != ord("-")).sum(axis=1), 1)
        # a gap matches no letter
        self.letters[self.letters == ord("-")] = 0

    def best(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gene, identity) of each row of letters; the first of equal genes wins."""
        at, top = np.zeros(len(query), np.int64), np.zeros(len(query))
        for k in range(0, len(query), 64):
            same = query[k : k + 64, None, :] == self.letters[None]
            # eight flags a word are added at once (no byte exceeds 16), then the bytes of the sum
            words = same.view(np.uint64).sum(axis=2, dtype=np.uint64)
            share = ((words * np.uint64(0x0101010101010101)) >> np.uint64(56)) / self.size
            at[k : k + 64], top[k : k + 64] = share.argmax(axis=1), share.max(axis=1)
        return at, top


BEST = "chain_type string, state_sequence string, identity_species string, v_gene string, v_identity double, j_gene string, j_identity double"


def _score_by_matrix(ask: DataFrame, germlines: DataFrame, order: DataFrame) -> DataFrame:
    """The same from a gene table that was found small: letter matrices, broadcast."""
    v = germlines.filter("segment = 'V'").join(F.broadcast(order), "species").orderBy("species_rank", "gene_ordinal").collect()
    j = germlines.filter("segment = 'J'").orderBy("gene_ordinal").collect()
    table_v = {c: _Genes([r for r in v if r.chain_type == c]) for c in sorted({r.chain_type for r in v})}
    table_j = {k: _Genes([r for r in j if (r.chain_type, r.species) == k]) for k in {(r.chain_type, r.species) for r in j}}
    spark = ask.sparkSession
    genes = spark.sparkContext.broadcast((table_v, table_j))

    def run(batches):
        tv, tj = genes.value
        for batch in batches:
            chains = batch.column(0).to_pylist()
            q = letter_matrix(batch.column(1).to_pylist())
            by_chain: dict[str, list[int]] = {}
            for r, c in enumerate(chains):
                by_chain.setdefault(c, []).append(r)
            for chain, rows in by_chain.items():
                if chain not in tv:
                    continue
                mine = q[rows]
                at, top = tv[chain].best(mine)
                species, n = tv[chain].species[at], len(rows)
                j_gene, j_top = np.full(n, "", object), np.zeros(n)
                for sp in np.unique(species):
                    own = np.flatnonzero(species == sp)
                    if (chain, sp) in tj:
                        ja, jt = tj[chain, sp].best(mine[own])
                        j_gene[own], j_top[own] = tj[chain, sp].gene[ja], jt
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(species.tolist()), pa.array(tv[chain].gene[at].tolist()), pa.array(top), pa.array(j_gene.tolist(), pa.string()), pa.array(j_top)],
                    names=[c.split()[0] for c in BEST.split(", ")],
                )

    # a text takes far longer to score than to move: few bytes are many cores' work
    return ask.repartition(max(spark.sparkContext.defaultParallelism, TASKS_A_SPLIT * ask.rdd.getNumPartitions())).mapInArrow(run, BEST)


def assign_germlines(domains: DataFrame, germlines: DataFrame, keys: list[str], species: list[str] | None = None) -> DataFrame:
    """``keys``, identity_species, v_gene, v_identity, j_gene, j_identity of each domain.

    ``domains`` has ``keys``, ``chain_type`` and ``state_sequence`` (128 characters).  The V gene
    with the highest identity wins, ties by species order, then gene order; the J gene is
    the best of the V gene's species.  Equal (chain, state sequence) domains are scored once.
    An asked species without V genes for a chain leaves that chain without assignment.
    """
    names = list(dict.fromkeys(s.strip().lower() for s in species or [] if s.strip()))
    if names:
        domains = domains.join(maybe_broadcast(missing_species(germlines, names)), "chain_type", "left_anti")
    ask = domains.select("chain_type", "state_sequence").filter("chain_type is not null and state_sequence is not null").distinct()
    ask = Scratch(domains.sparkSession, "genes").table(ask)
    score = _score_by_matrix if small(germlines, germlines.count(), 256) else _score_by_join
    return domains.join(score(ask, germlines, _order(germlines, names)), ["chain_type", "state_sequence"]).select(*keys, "identity_species", "v_gene", "v_identity", "j_gene", "j_identity")
