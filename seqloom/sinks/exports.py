"""Results as JSON, wide CSV, line report and FASTA variants.

Every export is a DataFrame of finished text lines or cells keyed by record and domain, so
that the writer stays distributed; :func:`write_text` orders and writes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codons import amber_fixed, has_amber
from ..functions.labels import position_label
from ..functions.sequence import codons, coding_dna, csv_field, wrapped
from ..numbering.tables import CDR_RANGES
from ..operators.dedup import present_domains, residue_text
from ..operators.identity import PAIRS_AT_ONCE, counted, packed, percents, residue_grid
from ..operators.positions import aligned_texts, aligned_texts_of, label_columns, position_union_of, residue_rows, union_order
from ..runtime import maybe_broadcast

#: Rows of an identity matrix that one task writes, at least.
LINES_A_TASK = 256

# The leading columns of the wide table.
WIDE_COLUMNS = ["Id", "domain_no", "hmm_species", "chain_type", "e-value", "score", "seqstart_index", "seqend_index", "identity_species", "v_gene", "v_identity", "j_gene", "j_identity", "heavy_cdr3_length", "full_length_aa"]


def as_json(results: DataFrame, *keep: str) -> DataFrame:
    """One JSON document a record; what is missing is written as null."""
    return results.select(*keep, F.to_json(F.struct("id", "sequence", "input_type", "domains"), {"ignoreNullFields": "false"}).alias("document"))


def domain_rows(results: DataFrame, key: str = "result_no") -> DataFrame:
    """One row a domain: record columns, ``domain_pos``, ``n_domains`` and ``d``."""
    kept = results.withColumn("_d", present_domains(F.col("domains")))
    return kept.select(key, "id", "sequence", "input_type", F.size("_d").alias("n_domains"), F.posexplode("_d").alias("domain_pos", "d"))


def domain_label(id: Column, n: Column, pos: Column) -> Column:
    """Record name, with ``_d1`` and so on if it has several domains."""
    return F.when(n > 1, F.concat(id, F.lit("_d"), (pos + 1).cast("string"))).otherwise(id)


def _fasta(rows: DataFrame, key: str, text: Column) -> DataFrame:
    label = domain_label(F.coalesce("id", F.lit("")), F.col("n_domains"), F.col("domain_pos"))
    out = rows.select(key, "domain_pos", label.alias("label"), text.alias("text")).filter("text <> ''")
    return out.select(key, "domain_pos", F.concat(F.lit(">"), "label", F.lit("\n"), wrapped(F.col("text"))).alias("record"))


def fasta_residues(results: DataFrame, key: str = "result_no") -> DataFrame:
    """Residues of every domain without gaps."""
    return _fasta(domain_rows(results, key), key, residue_text(F.col("d.numbering")))


def _coding(rows: DataFrame) -> DataFrame:
    dna = F.upper(F.translate("sequence", "-.", ""))
    ok = (F.lower(F.trim("input_type")) == "dna") & F.col("d.nt_start").isNotNull() & F.col("d.nt_end").isNotNull()
    reverse = F.startswith("d.translation_frame", F.lit("-"))
    return rows.filter(ok).withColumn("coding", coding_dna(dna, F.col("d.nt_start"), F.col("d.nt_end"), F.coalesce(reverse, F.lit(False))))


def coding_rows(results: DataFrame, key: str = "result_no") -> DataFrame:
    """``key, domain_pos, coding`` of every domain of DNA records that has a nucleotide range."""
    return _coding(domain_rows(results, key)).select(key, "domain_pos", "coding")


def fasta_coding(results: DataFrame, key: str = "result_no") -> DataFrame:
    """Coding-strand DNA of every domain of DNA records."""
    return _fasta(_coding(domain_rows(results, key)), key, F.col("coding"))


def fasta_amber_fixed(results: DataFrame, key: str = "result_no") -> DataFrame:
    """Coding DNA of domains with an in-frame TAG, read as CAG."""
    rows = _coding(domain_rows(results, key)).withColumn("_c", codons(F.col("coding"))).filter(has_amber(F.col("_c")))
    return _fasta(rows, key, amber_fixed(F.col("_c")))


def heavy_cdr3_length(d: Column) -> Column:
    """Residues in the third loop of a heavy chain's scheme, null for others."""
    out = F.lit(None).cast("int")
    for (scheme, klass), ranges in CDR_RANGES.items():
        if klass in ("H", "*"):
            a, b = ranges[2]
            n = F.size(F.filter(d["numbering"], _in_range(a, b)))
            exact = ("H" == klass) or (scheme, "H") not in CDR_RANGES
            if exact:
                out = F.when((d["scheme"] == scheme) & (d["chain_class"] == "H"), n).otherwise(out)
    return out


def _in_range(a: int, b: int):
    return lambda r: r["position"].between(a, b) & (r["amino_acid"] != "-")


def wide_table(results: DataFrame, key: str = "result_no") -> DataFrame:
    """One row a domain: ``key`` and ``domain_pos``, the fixed columns, then one column a position of the whole set.

    The rows are in no order; :func:`write_text` brings the lines of :func:`csv_lines` into that of the records.
    """
    rows = domain_rows(results, key)
    d = F.col("d")
    percent = lambda c: F.when(d[c] > 0, F.format_string("%.2f", d[c])).otherwise("")
    head = rows.select(
        key, "domain_pos", F.col("id").alias("Id"), F.col("domain_pos").alias("domain_no"), d["species"].alias("hmm_species"), d["chain_type"].alias("chain_type"), d["evalue_text"].alias("e-value"),
        F.format_string("%.1f", d["bit_score"]).alias("score"), d["seq_start"].alias("seqstart_index"), (d["seq_end"] - 1).alias("seqend_index"), d["identity_species"].alias("identity_species"), d["v_gene"].alias("v_gene"),
        percent("v_identity").alias("v_identity"), d["j_gene"].alias("j_gene"), percent("j_identity").alias("j_identity"), F.when(d["chain_class"] == "H", heavy_cdr3_length(d)).alias("heavy_cdr3_length"), residue_text(d["numbering"]).alias("full_length_aa"), d["numbering"].alias("numbering"),
    )
    labels = union_order(position_union_of(results, key))
    return label_columns(head, labels, key, "domain_pos", *WIDE_COLUMNS)


def csv_lines(table: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the other columns of a table as one CSV text ``line`` a row (without the header)."""
    cell = lambda c: csv_field(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    return table.select(*keys, F.concat_ws(",", *[cell(c) for c in table.columns if c not in keys]).alias("line"))


# Lines of the report.
_HIT_LINES = "# Most significant HMM hit\n#|species|chain_type|e-value|score|seqstart_index|seqend_index|\n"
_GENE_LINES = "# Most sequence-identical germlines\n#|species|v_gene|v_identity|j_gene|j_identity|\n"


def line_report(results: DataFrame, key: str = "result_no") -> DataFrame:
    """One text a record: headers, hit line, germline block where anything is known, numbered residues, ``//``."""
    d = present_domains(F.col("domains"))
    text = lambda c: F.coalesce(c, F.lit(""))
    piped = lambda *cells: F.concat(F.lit("#|"), F.concat_ws("|", *cells), F.lit("|"))

    def block(x: Column, i: Column) -> Column:
        last = F.when(x["seq_end"] > x["seq_start"], x["seq_end"] - 1).otherwise(x["seq_end"])
        hit = piped(text(x["species"]), text(x["chain_type"]), text(x["evalue_text"]), F.format_string("%.1f", x["bit_score"]), x["seq_start"].cast("string"), last.cast("string"))
        gene = lambda c: F.when(text(x[c]) == "", "unknown").otherwise(x[c])
        share = lambda c: F.format_string("%.2f", F.coalesce(x[c], F.lit(0.0)))
        known = (F.concat(text(x["identity_species"]), text(x["v_gene"]), text(x["j_gene"])) != "") | (F.coalesce(x["v_identity"], F.lit(0.0)) != 0) | (F.coalesce(x["j_identity"], F.lit(0.0)) != 0)
        genes = piped(text(x["identity_species"]), gene("v_gene"), share("v_identity"), gene("j_gene"), share("j_identity"))
        rows = F.transform(x["numbering"], lambda r: F.concat_ws(" ", x["chain_class"], F.rpad(r["position"].cast("string"), 5, " "), F.when(text(r["insertion"]) == "", " ").otherwise(r["insertion"]), r["amino_acid"]))
        return F.concat_ws(
            "\n",
            F.format_string("# Domain %d of %d", i + 1, F.size(d)),
            F.concat(F.lit(_HIT_LINES), hit),
            F.when(known, F.concat(F.lit(_GENE_LINES), genes)),
            F.concat(F.lit("# Scheme = "), text(x["scheme"])),
            F.when(F.coalesce(F.size(x["numbering"]), F.lit(0)) <= 0, F.concat(F.lit("# Warning: "), text(x["scheme"]), F.lit(" scheme could not be applied to this sequence."))).otherwise(F.array_join(rows, "\n")),
        )

    some = F.when(F.size(d) > 0, F.concat(F.lit("# numbered\n"), F.array_join(F.transform(d, block), "\n")))
    return results.select(key, F.concat_ws("\n", F.concat(F.lit("# "), text(F.col("id"))), some, F.lit("//")).alias("report"))


def write_text(rows: DataFrame, column: str, path: str, *order: str) -> None:
    """Write finished texts in order, as the parts of one folder (range-partitioned, so parts follow each other)."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode("overwrite").text(path)


def aligned_fasta(results: DataFrame, key: str = "result_no", codon: bool = False) -> DataFrame:
    """Every domain over the union of all records' positions; with ``codon`` three letters a position (DNA records only)."""
    kept = results.withColumn("domains", present_domains(F.col("domains")))
    rows = domain_rows(results, key)
    if codon:
        w = Window.partitionBy("result_no", "domain_pos").orderBy("idx")
        coding = _coding(rows).select(F.col(key).alias("result_no"), "domain_pos", codons(F.col("coding")).alias("_c"))
        live = residue_rows(kept, key).filter("amino_acid <> '-'").withColumn("_n", F.row_number().over(w)).join(coding, ["result_no", "domain_pos"])
        cells = live.withColumn("codon", F.coalesce(F.try_element_at("_c", F.col("_n")), F.lit("---"))).drop("_c", "_n")
        text = aligned_texts(cells, "---", "codon", position_union_of(kept, key))
    else:
        text = aligned_texts_of(kept, key)
    named = rows.select(F.col(key).alias("result_no"), "domain_pos", domain_label(F.coalesce("id", F.lit("")), F.col("n_domains"), F.col("domain_pos")).alias("label"))
    return named.join(text, ["result_no", "domain_pos"]).select("result_no", "domain_pos", "label", "aligned")


# Names of the scopes in a matrix's comment line.
_SCOPES = {"full": "Full sequence", "cdr1": "CDR1", "cdr2": "CDR2", "cdr3": "CDR3", "cdrs": "All CDRs"}


@lru_cache(4)
def _percent_texts(most: int) -> pa.Array:
    """Text of the identity at union * (most + 1) + equal residues."""
    return pa.array(["%.2f" % x for x in percents(most, None).ravel().tolist()], pa.string())


def identity_csv(order: DataFrame, vectors: DataFrame, scope: str = "full", scheme: str = "imgt") -> DataFrame:
    """Matrix lines of every class in clustered order: ``chain_class, class_no, place, line``.

    ``order`` has chain_class, member, place, label; ``vectors`` are encoded.  Classes follow each other by their first
    member (``class_no``); place -3 is the empty line
    between two classes, -2 the class's comment line, -1 its line of labels.  Each task writes the
    lines of a block of rows against the whole class, a few at a time; a class is sent once for every block, so
    blocks are as few as keep the cores busy.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = vectors.join(order.select("chain_class", "member", "place", csv_field(F.col("label")).alias("label")), ["chain_class", "member"])
    size = F.greatest(F.lit(LINES_A_TASK), F.ceil((F.max("place") + 1) / (2 * cores))).cast("int")
    classes = order.groupBy("chain_class").agg(size.alias("size"), F.floor(F.max("place") / size).cast("int").alias("n"), F.min("member").alias("first"))
    classes = classes.select("chain_class", "size", "n", F.size(F.filter(F.collect_list("first").over(Window.partitionBy(F.lit(1))), lambda f: f < F.col("first"))).alias("class_no"))
    sent = rows.join(maybe_broadcast(classes), "chain_class").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    # a block needs the labels of its own lines, the first one those of the class
    sent = sent.withColumn("label", F.when((F.col("k") == 0) | (F.floor(F.col("place") / F.col("size")) == F.col("k")), F.col("label")))

    def lines(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        klass, block = (k.as_py() for k in key)
        part = pa.Table.from_batches(batches).select(["class_no", "size", "place", "label", "codes", "width"]).to_pandas().sort_values("place", ignore_index=True)
        class_no, size, n = int(part["class_no"].iloc[0]), int(part["size"].iloc[0]), len(part)

        def batch(place: list[int], text: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(klass, pa.string()), len(place)), pa.repeat(pa.scalar(class_no, pa.int32()), len(place)), pa.array(place, pa.int32()), text], names=["chain_class", "class_no", "place", "line"])

        if not block:
            head = ["", f"# Chain: {klass} | Scope: {_SCOPES.get(scope, scope)} | Scheme: {scheme} | N={n}", ",".join(["", *part["label"]])][not class_no :]
            yield batch(list(range(-len(head), 0)), pa.array(head, pa.string()))
        bits, label = packed(residue_grid(part)), pa.array(part["label"], pa.string())
        most = -(-int(2 * bits.size.max() + 1) // 64) * 64
        texts, step = _percent_texts(most), max(1, PAIRS_AT_ONCE // n)
        for i in range(block * size, end := min(n, (block + 1) * size), step):
            same, union = counted(bits.part(i, min(i + step, end)), bits)
            code = union * np.int32(most + 1) + same
            code[np.arange(len(code)), np.arange(i, i + len(code))] = most + 2  # itself: one of one
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, n, dtype=np.int32)), texts.take(pa.array(code.ravel())))
            yield batch(part["place"].iloc[i : i + len(code)].tolist(), pc.binary_join_element_wise(label.slice(i, len(code)), pc.binary_join(cells, ","), ","))

    sent = sent.select("chain_class", "class_no", "size", "k", "place", "label", "codes", "width").repartition(4 * cores, "chain_class", "k")
    return sent.groupBy("chain_class", "k").applyInArrow(lines, "chain_class string, class_no int, place int, line string")
