"""Germline genes from ordered JSON: segment, chain, species, gene; the order carries meaning."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import whole_text

SCHEMA = "segment string, chain_type string, species string, species_ordinal int, gene string, gene_ordinal int, aligned_seq string"


def germline_rows(text: str) -> list[tuple]:
    """Rows of ``{"V": {chain: {species: {gene: sequence}}}, "J": ...}`` with ordinals in file order."""
    return [
        (segment, chain, species, s, gene, g, seq)
        for segment, chains in json.loads(text).items()
        for chain, by_species in chains.items()
        for s, (species, genes) in enumerate(by_species.items())
        for g, (gene, seq) in enumerate(genes.items())
    ]


def read_germlines(spark: SparkSession, path: str) -> DataFrame:
    """Gene rows of a JSON file on any file system that Spark reads."""
    return spark.createDataFrame(germline_rows(whole_text(spark, path)), SCHEMA)


def available_species(germlines: DataFrame) -> DataFrame:
    """Species with V genes of any chain, sorted."""
    return germlines.filter("segment = 'V'").select("species").distinct().orderBy("species")
