"""FASTA text as records: one row a record, in file order.

Files are cut at lines that begin with ``>`` by the text reader's record separator, so a
file of any size is read in parallel without gathering it.  Text before the first header
is dropped; the id is the whole trimmed header; residues lose gap marks and turn upper case;
records without a name or without residues are left out.  ``ordinal`` follows file and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import normalise
from ..runtime import maybe_broadcast


def _parsed(value: Column) -> tuple[Column, Column]:
    """(id, sequence) of a record's text without its ``>``."""
    lines = F.split(F.regexp_replace(value, "\r\n?", "\n"), "\n")
    trim = lambda x: F.btrim(x, F.lit(" \t\r"))
    return trim(F.element_at(lines, 1)), normalise(F.array_join(F.transform(F.slice(lines, 2, 2_000_000_000), trim), ""))


def _records(rows: DataFrame, *keep: str) -> DataFrame:
    head, body = _parsed(F.col("value"))
    return rows.select(*keep, head.alias("id"), body.alias("sequence")).filter("id <> '' and sequence <> ''")


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """``ordinal, source_file, id, sequence`` of FASTA files."""
    raw = spark.read.text(list(paths), lineSep="\n>").select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("ordinal")
    )
    # the separator eats the mark of all records but a file's first; a first chunk without it stands before any header
    heads = raw.filter("_block = 0").groupBy("source_file").agg(F.min_by(F.startswith("value", F.lit(">")), "ordinal").alias("marked"), F.min("ordinal").alias("ordinal")).filter("not marked")
    rows = raw.join(maybe_broadcast(heads.select("source_file", "ordinal")), ["source_file", "ordinal"], "left_anti")
    return _records(rows.withColumn("value", F.when(F.startswith("value", F.lit(">")), F.substr("value", F.lit(2))).otherwise(F.col("value"))), "ordinal", "source_file")


def split_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, record_no, id, sequence`` of FASTA texts held in rows (``record_no`` from 1)."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(F.col(text), "\r\n?", "\n")), "\n>")
    return _records(df.select(key, F.posexplode(parts).alias("record_no", "value")).filter("record_no > 0"), key, "record_no")


def looks_like_dna_input(records: DataFrame) -> DataFrame:
    """One row: whether all letters together are nucleotides and at least 30 (``is_dna``)."""
    return records.agg(F.coalesce(F.bool_and(F.col("sequence").rlike(r"\A[ACGTUNRYKMSWBDHV]*\z")) & (F.sum(F.length("sequence")) >= 30), F.lit(False)).alias("is_dna"))
