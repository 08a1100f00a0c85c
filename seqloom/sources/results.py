"""Result documents read back from JSON text, missing fields defaulted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENT = (
    "id string, sequence string, input_type string, domains array<struct<domain_index int, species string, chain_type string, chain_class string, "
    "identity_species string, v_gene string, v_identity double, j_gene string, j_identity double, scheme string, bit_score double, evalue double, evalue_text string, "
    "seq_start int, seq_end int, translation_frame string, nt_start int, nt_end int, stop_positions array<int>, flank_before string, flank_after string, "
    "numbering array<struct<position int, insertion string, amino_acid string>>>>"
)


def read_results(df: DataFrame, text: str = "payload", *keep: str) -> DataFrame:
    """``keep`` and ``id, sequence, input_type, domains``; text that does not parse gives null domains."""
    doc = F.from_json(F.col(text), DOCUMENT, {"mode": "PERMISSIVE"})
    return df.select(*keep, doc.alias("d")).select(
        *keep, F.coalesce("d.id", F.lit("")).alias("id"), F.coalesce("d.sequence", F.lit("")).alias("sequence"), F.coalesce("d.input_type", F.lit("protein")).alias("input_type"), F.col("d.domains").alias("domains")
    )


def position_cells(results: DataFrame, key: str) -> DataFrame:
    """``key, domain_pos, chain_class, position, insertion, amino_acid`` with defaults 0, blank and ``-``."""
    d = results.select(key, F.posexplode("domains").alias("domain_pos", "d")).filter("d is not null")
    cells = d.select(key, "domain_pos", F.coalesce("d.chain_class", F.lit("H")).alias("chain_class"), F.explode("d.numbering").alias("r"))
    return cells.select(
        key, "domain_pos", "chain_class", F.coalesce("r.position", F.lit(0)).alias("position"), F.coalesce("r.insertion", F.lit(" ")).alias("insertion"), F.coalesce("r.amino_acid", F.lit("-")).alias("amino_acid")
    )
