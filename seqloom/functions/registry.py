"""The most used functions as SQL functions of a session; their bodies are SQL, so the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sequence import COMPLEMENT_FROM, COMPLEMENT_TO, DNA_LETTERS, DNA_LIMIT, PROTEIN_LETTERS, PROTEIN_LIMIT

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FUNCTIONS = {
    "seq_clean": ("s STRING", "STRING", f"translate(translate(s, '-.', ''), '{_LOWER}', '{_UPPER}')"),
    "seq_is_dna": ("s STRING", "BOOLEAN", f"length(s) < {DNA_LIMIT} AND length(translate(s, '{DNA_LETTERS}', '')) = 0"),
    "seq_is_protein": ("s STRING", "BOOLEAN", f"length(s) < {PROTEIN_LIMIT} AND length(translate(s, '{PROTEIN_LETTERS}', '')) = 0"),
    "seq_reverse_complement": ("s STRING", "STRING", f"translate(regexp_replace(reverse(s), '[^{COMPLEMENT_FROM}]', 'N'), '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}')"),
    "profile_species": ("name STRING", "STRING", "CASE WHEN instr(name, '_') > 0 THEN substring_index(name, '_', 1) ELSE 'unknown' END"),
    "profile_chain": ("name STRING", "STRING", "CASE WHEN instr(name, '_') > 0 THEN substr(name, instr(name, '_') + 1) ELSE 'H' END"),
    "chain_class": ("chain STRING", "STRING", "CASE WHEN chain IN ('K', 'L') THEN 'L' WHEN chain IN ('A', 'B', 'G', 'D') THEN chain ELSE 'H' END"),
    "spans_overlap": ("a_start INT, a_end INT, b_start INT, b_end INT", "BOOLEAN", "b_start < a_end AND a_start < b_end"),
    "position_label": ("position INT, insertion STRING", "STRING", "concat(CAST(position AS STRING), trim(insertion))"),
}


def register(spark: SparkSession) -> list[str]:
    """Define all functions in the session; returns their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
