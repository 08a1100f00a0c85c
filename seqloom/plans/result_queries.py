"""Queries over numbered result documents: duplicates, classes, positions, exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import compute_pim
from ..functions.labels import cdr_of, position_label
from ..functions.sequence import normalise
from ..numbering.tables import CDR_RANGES, NAMES, cdr_ranges
from ..operators import dedup as D
from ..operators import positions as P
from ..operators.flatten import json_tables
from ..operators.identity import labelled_domains
from ..operators.quality import domain_qualities, mean_quality, share_from
from ..runtime import spread, table
from ..sinks import exports as X
from ..sources.abif import as_records, encode_abif, traces_of
from ..sources.results import position_cells, read_results
from .pipeline import peptides, with_totals


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "numbering_results").select("result_no", "id", "sequence", "input_type", "domains")


def _marked(spark, sf_dir, **options) -> DataFrame:
    """Marks with the domains' codon adaptation as tie-break."""
    r = _results(spark, sf_dir)
    return D.mark_canonical(r, scores=D.codon_scores(X.coding_rows(r)), keep=("id",), **options)


def duplicate_marks(spark, sf_dir):
    """Canonical member and slot of every result."""
    return _marked(spark, sf_dir).select("result_no", "canonical", "slot", "is_canonical")


def duplicate_marks_amber(spark, sf_dir):
    """The same with amber stops read as Q."""
    return _marked(spark, sf_dir, readthrough_as_q=True).select("result_no", "canonical", "slot", "is_canonical")


def duplicate_groups(spark, sf_dir):
    g = D.duplicate_groups(_marked(spark, sf_dir))
    return g.select("canonical", "size", F.array_join(F.transform("duplicates", lambda x: x.cast("string")), ",").alias("duplicates"))


def duplicate_members(spark, sf_dir):
    """The same groups as flat rows, one for every other member."""
    return D.duplicate_members(_marked(spark, sf_dir))


def result_classes(spark, sf_dir):
    c = D.result_classes(_marked(spark, sf_dir))
    return c.select("result_no", "class_stop", "class_no_domain", "class_correct", "class_usable")


def summary_counts(spark, sf_dir):
    return D.summary(D.result_classes(_marked(spark, sf_dir)))


def download_set(spark, sf_dir):
    """What an export takes by default, unique results only."""
    return D.for_download(D.result_classes(_marked(spark, sf_dir)), unique_only=True).select("result_no", "id")


def _cells(spark, sf_dir) -> DataFrame:
    return P.residue_rows(_results(spark, sf_dir))


def position_union(spark, sf_dir):
    u = P.position_union_of(_results(spark, sf_dir))
    return u.select(position_label(F.col("position"), F.col("insertion")).alias("label"), "max_rank", F.col("first_seen.result_no").alias("first_result"))


def wide_positions(spark, sf_dir):
    """The wide table over the whole set's positions, as CSV lines."""
    return X.csv_lines(X.wide_table(_results(spark, sf_dir)), "result_no", "domain_pos")


def gap_filled(spark, sf_dir):
    f = P.filled_gaps(_cells(spark, sf_dir))
    return f.groupBy("result_no", "domain_pos").agg(F.count("*").alias("cells"), F.count_if(F.col("amino_acid") == "-").alias("gaps"))


def aligned_residues(spark, sf_dir):
    """Aligned FASTA text of every domain."""
    return P.aligned_texts_of(spread(_results(spark, sf_dir)))


def aligned_codons(spark, sf_dir):
    """Aligned FASTA text of the coding DNA of every domain, three letters a position."""
    return X.aligned_fasta(_results(spark, sf_dir), codon=True)


def loop_positions(spark, sf_dir):
    """Loop of every numbered residue, counted by domain."""
    d = X.domain_rows(_results(spark, sf_dir)).select("result_no", "domain_pos", F.col("d.scheme").alias("scheme"), F.col("d.chain_class").alias("k"), F.explode("d.numbering").alias("r"))
    loop = cdr_of(F.col("r.position"), F.col("scheme"), F.col("k"))
    return d.select("result_no", "domain_pos", loop.alias("loop")).filter("loop <> ''").groupBy("result_no", "domain_pos", "loop").agg(F.count("*").alias("n"))


def loop_ranges(spark, sf_dir):
    """Residues in the loops of each domain's scheme and class, by a range join."""
    ranges = [(name, k, f"cdr{n + 1}", a, b) for name in NAMES for k in "HLABGD" for n, (a, b) in enumerate(cdr_ranges(name, k))]
    r = spark.createDataFrame(ranges, "scheme string, chain_class string, cdr string, first int, last int")
    return P.loop_residues(_cells(spark, sf_dir), r).groupBy("scheme", "cdr", "amino_acid").agg(F.count("*").alias("n"))


def heavy_cdr3(spark, sf_dir):
    d = X.domain_rows(_results(spark, sf_dir)).filter("d.chain_class = 'H' and d.numbering is not null")
    return d.select("result_no", "domain_pos", X.heavy_cdr3_length(F.col("d")).alias("cdr3_length"))


def domain_labels(spark, sf_dir):
    d = X.domain_rows(_results(spark, sf_dir)).select("result_no", "domain_pos", F.coalesce("d.chain_class", F.lit("H")).alias("chain_class"))
    return labelled_domains(d)


def fasta_residues(spark, sf_dir):
    return X.fasta_residues(_results(spark, sf_dir))


def fasta_coding(spark, sf_dir):
    return X.fasta_coding(_results(spark, sf_dir))


def fasta_amber(spark, sf_dir):
    return X.fasta_amber_fixed(_results(spark, sf_dir))


def progress_totals(spark, sf_dir):
    """Totals of a run, counted while its documents are written."""
    docs, seen = with_totals(table(spark, sf_dir, "numbering_results").select("result_no", "domains"))
    docs.write.format("noop").mode("overwrite").save()
    t = seen.get
    return spark.createDataFrame([(t["sequences"], t["domains"], t["without_domain"])], "sequences long, domains long, without_domain long")


def _traces(spark, sf_dir) -> DataFrame:
    """DNA records written as trace files and read back; qualities follow from record and place."""
    r = table(spark, sf_dir, "numbering_results").filter("lower(trim(input_type)) = 'dna'").select("result_no", normalise(F.col("sequence")).alias("s")).filter(F.col("s").rlike(r"\A[A-Z]{1,30000}\z"))

    def write(batches):
        for pdf in batches:
            raw = [encode_abif(s.lower(), [(k * 7 + n) % 60 for k in range(len(s))], [[k] * 3 for k in range(4)], [k % 9 for k in range(len(s))]) for n, s in zip(pdf["result_no"], pdf["s"])]
            yield pd.DataFrame({"id": pdf["result_no"].astype(str), "source_file": "", "content": raw})

    return traces_of(r.mapInPandas(write, "id string, source_file string, content binary"))


def trace_records(spark, sf_dir):
    """Traces as records, with the mean quality of the whole read."""
    t = _traces(spark, sf_dir)
    q = F.col("quality")
    return as_records(t).join(t.select("id", "trace_length", F.size("peak_locations").alias("peaks"), mean_quality(q).alias("mean_quality"), share_from(q).alias("share20")), "id")


def trace_domains(spark, sf_dir):
    """Quality of every domain of the results that have a trace; domains of the others keep null values."""
    r = table(spark, sf_dir, "numbering_results").select(F.col("result_no").cast("string").alias("id"), "domains")
    return domain_qualities(r, _traces(spark, sf_dir))


def searchable_records(spark, sf_dir):
    """Peptides that every record gives to the search: itself or its valid frames; invalid records stay, with none."""
    r = table(spark, sf_dir, "numbering_results").select(F.col("result_no").alias("key"), "sequence", "input_type")
    p = peptides(r).groupBy("key").agg(F.count("*").alias("parts"), F.sum(F.length("sequence")).alias("letters"))
    kind = F.when(F.lower(F.trim("input_type")) == "dna", "dna").otherwise("protein").alias("input_type")
    return r.select("key", kind).join(p, "key", "left").select(F.col("key").alias("result_no"), "input_type", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("letters", F.lit(0)).alias("letters"))


def json_documents(spark, sf_dir):
    """Result documents written as JSON and read back: records and their domains."""
    r = read_results(X.as_json(_results(spark, sf_dir), "result_no"), "document", "result_no")
    d = r.select("result_no", "id", "sequence", "input_type", F.posexplode_outer("domains").alias("domain_pos", "d"))
    fields = ("domain_index", "species", "chain_type", "v_gene", "v_identity", "j_gene", "scheme", "bit_score", "evalue", "evalue_text", "seq_start", "seq_end", "nt_start", "nt_end", "translation_frame", "flank_after")
    return d.select("result_no", "id", "sequence", "input_type", "domain_pos", *[F.col(f"d.{c}").alias(c) for c in fields], F.array_join(F.transform("d.stop_positions", lambda x: x.cast("string")), ",").alias("stops"))


def json_roundtrip(spark, sf_dir):
    """Position cells of result documents written as JSON and read back."""
    return position_cells(read_results(X.as_json(_results(spark, sf_dir), "result_no"), "document", "result_no"), "result_no")


def line_reports(spark, sf_dir):
    return X.line_report(_results(spark, sf_dir))


def json_cells(spark, sf_dir):
    """Position cells of JSON payloads in any dirt, through the structural index, counted by domain."""
    t = json_tables(table(spark, sf_dir, "result_json"))
    n = t["numbering"].groupBy("parent_no", "domain_pos").agg(F.count("*").alias("cells"), F.sum(F.coalesce("position", F.lit(0))).alias("positions"), F.count_if(F.coalesce("amino_acid", F.lit("-")) == "-").alias("gaps"))
    d = t["domains"].select("parent_no", "domain_pos", F.coalesce("chain_class", F.lit("H")).alias("chain_class"))
    return d.join(n, ["parent_no", "domain_pos"]).withColumnRenamed("parent_no", "doc_no")


def matrix_lines(spark, sf_dir):
    """Identity matrices of the result domains, as CSV lines in clustered order."""
    return compute_pim(table(spark, sf_dir, "numbering_results").select("result_no", "id", "domains"), key="result_no")


QUERIES = {
    f.__name__: f
    for f in (
        duplicate_marks, duplicate_marks_amber, duplicate_groups, duplicate_members, result_classes, summary_counts, download_set, position_union, wide_positions, gap_filled, aligned_residues, aligned_codons, loop_positions,
        loop_ranges, heavy_cdr3, domain_labels, fasta_residues, fasta_coding, fasta_amber, json_documents, json_roundtrip, line_reports, json_cells, matrix_lines, progress_totals, trace_records, trace_domains, searchable_records,
    )
}

from .document_queries import _P3  # noqa: E402
from .sequence_queries import _FRAMES, _WEIGHT, CLEAN, codons_sql, rc_sql  # noqa: E402

_DOMAINS = "dom AS (SELECT result_no, id, sequence, input_type, list_filter(coalesce(domains, []), lambda d: d IS NOT NULL) AS ds FROM numbering_results)"
_CELLS = """
d AS (SELECT result_no, unnest(domains) AS d, (generate_subscripts(domains, 1) - 1)::INT AS domain_pos FROM numbering_results),
n AS (SELECT result_no, domain_pos, d.chain_class AS chain_class, unnest(d.numbering) AS r, generate_subscripts(d.numbering, 1) - 1 AS idx FROM d WHERE d IS NOT NULL),
cells AS (SELECT result_no, domain_pos, chain_class, idx, r.position AS position, CASE WHEN trim(coalesce(r.insertion, '')) = '' THEN ' ' ELSE r.insertion END AS insertion, r.amino_acid AS amino_acid FROM n WHERE r IS NOT NULL)"""
_RESIDUES = "array_to_string(list_filter(list_transform(d.numbering, lambda r: r.amino_acid), lambda a: a IS NOT NULL AND a <> '-'), '')"
_UNION = _CELLS + """,
isl AS (SELECT *, row_number() OVER (PARTITION BY result_no, domain_pos ORDER BY idx) - row_number() OVER (PARTITION BY result_no, domain_pos, position ORDER BY idx) AS g FROM cells),
rk AS (SELECT *, (row_number() OVER (PARTITION BY result_no, domain_pos, position, g ORDER BY idx) - 1)::INT AS rank FROM isl),
u AS (SELECT position, insertion, max(rank) AS max_rank, min((result_no, domain_pos, idx)) AS seen FROM rk GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY position, max_rank, seen) - 1 AS place FROM u)"""
_CODING = f"""cod AS (SELECT result_no, domain_pos, n_domains, id, CASE WHEN d.translation_frame LIKE '-%' THEN {rc_sql("part")} ELSE part END AS coding FROM (
  SELECT result_no, domain_pos, n_domains, id, d, substr(upper(replace(replace(sequence, '-', ''), '.', '')), d.nt_start + 1, d.nt_end - d.nt_start) AS part
  FROM (SELECT result_no, id, sequence, input_type, len(ds) AS n_domains, unnest(ds) AS d, (generate_subscripts(ds, 1) - 1)::INT AS domain_pos FROM dom)
  WHERE lower(trim(input_type)) = 'dna' AND d.nt_start IS NOT NULL AND d.nt_end IS NOT NULL))"""


def _marked_sql(residues: str) -> str:
    return f"""{_DOMAINS}, {_CODING},
w(c, weight) AS (VALUES {_WEIGHT}),
score AS (SELECT result_no, round(sum(cai), 9) AS cai FROM (SELECT result_no, domain_pos, exp(avg(ln(weight))) AS cai FROM (SELECT result_no, domain_pos, unnest({codons_sql("replace(upper(coding), 'U', 'T')")}) AS c FROM cod) JOIN w USING (c) GROUP BY 1, 2) GROUP BY 1),
keyed AS (SELECT result_no, id, len(ds) AS n, len(list_filter(ds, lambda d: len(d.stop_positions) > 0)) > 0 AS stop,
  upper(CASE WHEN lower(trim(input_type)) = 'dna' AND len(ds) > 0 THEN array_to_string(list_transform(ds, lambda d: coalesce(d.chain_type, '') || ':' || coalesce({residues}, '')), '|') ELSE coalesce(sequence, '') END) AS k FROM dom),
marked AS (SELECT keyed.*, first_value(result_no) OVER (PARTITION BY k ORDER BY stop, CASE WHEN stop THEN 0 ELSE coalesce(cai, 0) END DESC, result_no) AS canonical, min(result_no) OVER (PARTITION BY k) AS slot
  FROM keyed LEFT JOIN score USING (result_no)),
classed AS (SELECT *, canonical = result_no AS is_canonical, stop AS class_stop, n = 0 AS class_no_domain, n > 0 AND NOT stop AS class_correct, n > 0 AND NOT stop AND canonical = result_no AS class_usable FROM marked)"""


# the coding strand of a domain inside a document's list
_PART = "substr(upper(replace(replace(sequence, '-', ''), '.', '')), d.nt_start + 1, d.nt_end - d.nt_start)"
_STRAND = f"coalesce(upper(CASE WHEN d.translation_frame LIKE '-%' THEN {rc_sql(_PART)} ELSE {_PART} END), '')"
_AMBER = f"""CASE WHEN len(list_filter(ds, lambda y: len(y.stop_positions) > 0)) > 0 THEN array_to_string(list_transform(string_split({_RESIDUES}, ''), lambda aa, i: CASE WHEN aa = 'X' AND substr({_STRAND}, ((i - 1) * 3 + 1)::INT, 3) = 'TAG' THEN 'Q' ELSE aa END), '') ELSE {_RESIDUES} END"""
_MARKED = _marked_sql(_RESIDUES)


def _record_sql(source: str, text: str) -> str:
    wrap = f"array_to_string(list_transform(range((length({text}) + 59) // 60), lambda i: substr({text}, (i * 60 + 1)::INT, 60)), E'\\n')"
    return f"SELECT result_no, domain_pos, '>' || coalesce(id, '') || CASE WHEN n_domains > 1 THEN '_d' || (domain_pos + 1) ELSE '' END || E'\\n' || {wrap} AS record FROM {source} WHERE {text} <> ''"


def _loop_sql(p: str, scheme: str, k: str) -> str:
    out = []
    for (name, klass), ranges in CDR_RANGES.items():
        others = [c for s, c in CDR_RANGES if s == name and c != "*"]
        who = f"{k} = '{klass}'" if klass != "*" else f"coalesce({k}, '') NOT IN ({', '.join(repr(c) for c in others)})" if others else "true"
        out += [f"WHEN {scheme} = '{name}' AND {who} AND {p} BETWEEN {a} AND {b} THEN 'cdr{n}'" for n, (a, b) in enumerate(ranges, 1)]
    return f"CASE {' '.join(out)} ELSE '' END"


_PRESENT = _UNION.replace("domains", "ds").replace("FROM numbering_results", "FROM dom")
_LABEL = "coalesce(id, '') || CASE WHEN n_domains > 1 THEN '_d' || (domain_pos + 1) ELSE '' END"
_X = "x AS (SELECT result_no, id, len(ds) AS n_domains, unnest(ds) AS d, (generate_subscripts(ds, 1) - 1)::INT AS domain_pos FROM dom)"


def _fixed(x: str, digits: int) -> str:
    """A number with so many decimals, halves up."""
    return f"CAST(round(CAST({x} AS DECIMAL(18, 8)), {digits}) AS DECIMAL(18, {digits}))::VARCHAR"


def _csv(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[,"\\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


_HEAVY = f"len(list_filter(d.numbering, lambda r: {_loop_sql('r.position', 'd.scheme', 'd.chain_class')} = 'cdr3' AND r.amino_acid <> '-'))::VARCHAR"
_WIDE = ["id", "domain_pos::VARCHAR", "d.species", "d.chain_type", "d.evalue_text", f"coalesce({_fixed('d.bit_score', 1)}, 'null')", "d.seq_start::VARCHAR", "(d.seq_end - 1)::VARCHAR", "d.identity_species", "d.v_gene",
  f"CASE WHEN d.v_identity > 0 THEN {_fixed('d.v_identity', 2)} END", "d.j_gene", f"CASE WHEN d.j_identity > 0 THEN {_fixed('d.j_identity', 2)} END", f"CASE WHEN d.chain_class = 'H' AND d.numbering IS NOT NULL THEN {_HEAVY} END", _RESIDUES]
_REPORT_ROW = "array_to_string(list_filter([d.chain_class, substr(rpad(r.position::VARCHAR, 5, ' '), 1, 5), CASE WHEN coalesce(r.insertion, '') = '' THEN ' ' ELSE r.insertion END, r.amino_acid], lambda c: c IS NOT NULL), ' ')"
_BLOCK = f"""'# Domain ' || (domain_pos + 1) || ' of ' || n_domains || E'\\n' || {X._HIT_LINES!r}_nl || '#|' || array_to_string(list_filter([coalesce(d.species, ''), coalesce(d.chain_type, ''), coalesce(d.evalue_text, ''), coalesce({_fixed("d.bit_score", 1)}, 'null'),
    d.seq_start::VARCHAR, (CASE WHEN d.seq_end > d.seq_start THEN d.seq_end - 1 ELSE d.seq_end END)::VARCHAR], lambda c: c IS NOT NULL), '|') || '|' ||
  CASE WHEN coalesce(d.identity_species, '') || coalesce(d.v_gene, '') || coalesce(d.j_gene, '') <> '' OR coalesce(d.v_identity, 0) <> 0 OR coalesce(d.j_identity, 0) <> 0 THEN E'\\n' || {X._GENE_LINES!r}_nl || '#|' || coalesce(d.identity_species, '') || '|' ||
    CASE WHEN coalesce(d.v_gene, '') = '' THEN 'unknown' ELSE d.v_gene END || '|' || {_fixed("coalesce(d.v_identity, 0)", 2)} || '|' || CASE WHEN coalesce(d.j_gene, '') = '' THEN 'unknown' ELSE d.j_gene END || '|' || {_fixed("coalesce(d.j_identity, 0)", 2)} || '|' ELSE '' END ||
  E'\\n# Scheme = ' || coalesce(d.scheme, '') || E'\\n' || CASE WHEN coalesce(len(d.numbering), 0) = 0 THEN '# Warning: ' || coalesce(d.scheme, '') || ' scheme could not be applied to this sequence.' ELSE array_to_string(list_transform(d.numbering, lambda r: {_REPORT_ROW}), E'\\n') END"""
for _text in (X._HIT_LINES, X._GENE_LINES):
    _BLOCK = _BLOCK.replace(f"{_text!r}_nl", "E" + repr(_text))

_TRACES = f"""t AS (SELECT result_no, s, list_transform(range(length(s)), lambda k: (k * 7 + result_no) % 60) AS q FROM (SELECT result_no, {CLEAN} AS s FROM numbering_results WHERE lower(trim(input_type)) = 'dna') WHERE regexp_full_match(s, '[A-Z]+') AND length(s) <= 30000)"""


def _quality_sql(q: str) -> str:
    mean = f"list_aggregate(list_transform({q}, lambda x: pow(10.0, -x / 10.0)), 'avg')"
    return f"CASE WHEN len({q}) > 0 THEN floor(-10 * log10({mean}) + 0.5)::INT END AS mean_quality, CASE WHEN len({q}) > 0 THEN floor(100.0 * len(list_filter({q}, lambda x: x >= 20)) / len({q}) + 0.5)::INT END AS share20"


SQL = {
    "progress_totals": "SELECT count(*) AS sequences, sum(coalesce(len(domains), 0))::BIGINT AS domains, count(*) FILTER (coalesce(len(domains), 0) = 0) AS without_domain FROM numbering_results",
    "trace_records": f"WITH {_TRACES} SELECT result_no::VARCHAR AS id, s AS sequence, 'dna' AS input_type, 3 AS trace_length, length(s)::INT AS peaks, {_quality_sql('q')} FROM t",
    "trace_domains": f"""WITH {_TRACES}, d AS (SELECT result_no, unnest(domains) AS d, (generate_subscripts(domains, 1) - 1)::INT AS domain_pos FROM numbering_results),
j AS (SELECT d.result_no, domain_pos, CASE WHEN d.nt_start IS NOT NULL AND d.nt_end IS NOT NULL THEN q[(d.nt_start + 1):(d.nt_start + greatest(0, d.nt_end - d.nt_start))] END AS q FROM d LEFT JOIN t ON t.result_no = d.result_no WHERE d IS NOT NULL)
SELECT result_no::VARCHAR AS id, domain_pos, {_quality_sql('q')} FROM j""",
    "searchable_records": f"""WITH {_FRAMES}, p AS (SELECT result_no, count(*) AS parts, sum(length(sequence))::BIGINT AS letters FROM (SELECT result_no, sequence FROM pep WHERE regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWYX*]*') AND length(sequence) < 10000
  UNION ALL SELECT result_no, s FROM (SELECT result_no, {CLEAN} AS s FROM numbering_results WHERE coalesce(lower(trim(input_type)), '') <> 'dna') WHERE regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWYX*]+') AND length(s) < 10000) GROUP BY 1)
SELECT r.result_no, CASE WHEN lower(trim(input_type)) = 'dna' THEN 'dna' ELSE 'protein' END AS input_type, coalesce(parts, 0) AS parts, coalesce(letters, 0)::BIGINT AS letters FROM numbering_results r LEFT JOIN p ON p.result_no = r.result_no""",
    "json_documents": """SELECT result_no, coalesce(id, '') AS id, coalesce(sequence, '') AS sequence, coalesce(input_type, 'protein') AS input_type, domain_pos, d.domain_index, d.species, d.chain_type, d.v_gene, d.v_identity, d.j_gene, d.scheme, d.bit_score, d.evalue, d.evalue_text,
  d.seq_start, d.seq_end, d.nt_start, d.nt_end, d.translation_frame, d.flank_after, CASE WHEN d.stop_positions IS NOT NULL THEN coalesce(array_to_string(d.stop_positions, ','), '') END AS stops
FROM (SELECT *, unnest(CASE WHEN len(domains) > 0 THEN domains ELSE [NULL] END) AS d, unnest(CASE WHEN len(domains) > 0 THEN range(len(domains))::INT[] ELSE [NULL] END) AS domain_pos FROM numbering_results)""",
    "json_roundtrip": """SELECT result_no, domain_pos, chain_class, coalesce(r.position, 0) AS position, coalesce(r.insertion, ' ') AS insertion, coalesce(r.amino_acid, '-') AS amino_acid
FROM (SELECT result_no, domain_pos, coalesce(d.chain_class, 'H') AS chain_class, unnest(d.numbering) AS r FROM (SELECT result_no, unnest(domains) AS d, (generate_subscripts(domains, 1) - 1)::INT AS domain_pos FROM numbering_results) WHERE d IS NOT NULL)""",
    "json_cells": _P3 + """SELECT c.parent_no AS doc_no, c.domain_pos, coalesce(any_value(t.d->>'$.chain_class'), 'H') AS chain_class, count(*) AS cells, sum(coalesce(try_cast(r->>'$.position' AS INT), 0))::BIGINT AS positions, count(*) FILTER (coalesce(r->>'$.amino_acid', '-') = '-') AS gaps
FROM (SELECT parent_no, domain_pos, unnest(n) AS r FROM lists) c JOIN text t ON t.parent_no = c.parent_no AND t.domain_pos = c.domain_pos GROUP BY 1, 2""",
    "wide_positions": f"""WITH {_DOMAINS}, {_X}, {_UNION}, h AS (SELECT result_no, domain_pos, array_to_string([{", ".join(f"coalesce({_csv(c)}, '')" for c in _WIDE)}], ',') AS head FROM x),
p AS (SELECT result_no, unnest(ds) AS d, (generate_subscripts(ds, 1) - 1)::INT AS domain_pos FROM dom), pn AS (SELECT result_no, domain_pos, unnest(d.numbering) AS r, generate_subscripts(d.numbering, 1) AS i FROM p),
m AS (SELECT result_no, domain_pos, map(list(place ORDER BY place), list(aa ORDER BY place)) AS m FROM (SELECT result_no, domain_pos, o.place, arg_min(r.amino_acid, i) AS aa FROM pn JOIN o ON o.position = r.position AND o.insertion = CASE WHEN trim(coalesce(r.insertion, '')) = '' THEN ' ' ELSE r.insertion END GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT h.result_no, h.domain_pos, head || ',' || array_to_string(list_transform(range((SELECT count(*) FROM u)), lambda i: coalesce(m[i], '-')), ',') AS line FROM h LEFT JOIN m ON m.result_no = h.result_no AND m.domain_pos = h.domain_pos""",
    "aligned_codons": f"""WITH {_DOMAINS}, {_CODING}, {_PRESENT}, live AS (SELECT *, row_number() OVER (PARTITION BY result_no, domain_pos ORDER BY idx) AS k FROM cells WHERE amino_acid <> '-'),
cc AS (SELECT l.result_no, l.domain_pos, o.place, min(coalesce(({codons_sql("coding")})[k], '---')) AS codon FROM live l JOIN cod ON cod.result_no = l.result_no AND cod.domain_pos = l.domain_pos JOIN o ON o.position = l.position AND o.insertion = l.insertion GROUP BY 1, 2, 3),
m AS (SELECT result_no, domain_pos, map(list(place ORDER BY place), list(codon ORDER BY place)) AS m FROM cc GROUP BY 1, 2)
SELECT m.result_no, m.domain_pos, {_LABEL} AS label, array_to_string(list_transform(range((SELECT count(*) FROM u)), lambda i: coalesce(m[i], '---')), '') AS aligned FROM m JOIN cod USING (result_no, domain_pos)""",
    "line_reports": f"""WITH {_DOMAINS}, {_X}, b AS (SELECT result_no, string_agg({_BLOCK}, E'\\n' ORDER BY domain_pos) AS t FROM x GROUP BY 1)
SELECT dom.result_no, '# ' || coalesce(id, '') || E'\\n' || CASE WHEN b.t IS NOT NULL THEN E'# numbered\\n' || b.t || E'\\n' ELSE '' END || '//' AS report FROM dom LEFT JOIN b USING (result_no)""",
    "duplicate_marks": f"WITH {_MARKED} SELECT result_no, canonical, slot, is_canonical FROM classed",
    "duplicate_marks_amber": f"WITH {_marked_sql(_AMBER)} SELECT result_no, canonical, slot, is_canonical FROM classed",
    "duplicate_groups": f"""WITH {_MARKED} SELECT canonical, count(*) AS size, array_to_string(list_sort(list(result_no) FILTER (result_no <> canonical)), ',') AS duplicates
FROM marked GROUP BY 1 HAVING count(*) > 1""",
    "duplicate_members": f"WITH {_MARKED} SELECT canonical, size, result_no AS member FROM (SELECT *, count(*) OVER (PARTITION BY canonical) AS size FROM marked) WHERE canonical <> result_no",
    "result_classes": f"WITH {_MARKED} SELECT result_no, class_stop, class_no_domain, class_correct, class_usable FROM classed",
    "summary_counts": f"""WITH {_MARKED} SELECT count(*) AS total, count(*) FILTER (class_correct) AS correct, count(*) FILTER (is_canonical) AS unique_results, count(*) FILTER (NOT is_canonical) AS duplicates,
  count(*) FILTER (class_stop) AS with_stop, count(*) FILTER (class_no_domain) AS no_domain, count(*) FILTER (class_usable) AS usable FROM classed""",
    "download_set": f"WITH {_MARKED} SELECT result_no, id FROM classed WHERE NOT class_stop AND NOT class_no_domain AND is_canonical",
    "position_union": f"WITH {_UNION} SELECT position || trim(insertion) AS label, max_rank, seen[1] AS first_result FROM u".replace("seen[1]", "struct_extract_at(seen, 1)"),
    "gap_filled": f"""WITH {_CELLS}, l AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY result_no, domain_pos ORDER BY idx), 0) AS b FROM cells)
SELECT result_no, domain_pos, (count(*) + sum(greatest(0, position - b - 1)))::BIGINT AS cells, (count(*) FILTER (amino_acid = '-') + sum(greatest(0, position - b - 1)))::BIGINT AS gaps FROM l GROUP BY 1, 2""",
    "aligned_residues": f"""WITH {_UNION}, m AS (SELECT result_no, domain_pos, map(list(place ORDER BY place), list(amino_acid ORDER BY place)) AS m
  FROM (SELECT DISTINCT c.result_no, c.domain_pos, o.place, c.amino_acid FROM cells c JOIN o ON o.position = c.position AND o.insertion = c.insertion) GROUP BY 1, 2)
SELECT result_no, domain_pos, array_to_string(list_transform(range((SELECT count(*) FROM u)), lambda i: coalesce(m[i], '-')), '') AS aligned FROM m""",
    "loop_positions": f"""WITH {_DOMAINS}, x AS (SELECT result_no, unnest(ds) AS d, (generate_subscripts(ds, 1) - 1)::INT AS domain_pos FROM dom),
r AS (SELECT result_no, domain_pos, d.scheme AS scheme, d.chain_class AS k, unnest(d.numbering) AS r FROM x), l AS (SELECT result_no, domain_pos, {_loop_sql("r.position", "scheme", "k")} AS loop FROM r)
SELECT result_no, domain_pos, loop, count(*) AS n FROM l WHERE loop <> '' GROUP BY 1, 2, 3""",
    "loop_ranges": f"""WITH {_DOMAINS}, x AS (SELECT unnest(ds) AS d FROM dom), r AS (SELECT d.scheme AS scheme, d.chain_class AS k, unnest(d.numbering) AS r FROM x),
l AS (SELECT scheme, {_loop_sql("r.position", "scheme", "k")} AS cdr, r.amino_acid AS amino_acid FROM r WHERE k IN ('H', 'L', 'A', 'B', 'G', 'D'))
SELECT scheme, cdr, amino_acid, count(*) AS n FROM l WHERE cdr <> '' GROUP BY 1, 2, 3""",
    "heavy_cdr3": f"""WITH {_DOMAINS}, x AS (SELECT result_no, unnest(ds) AS d, (generate_subscripts(ds, 1) - 1)::INT AS domain_pos FROM dom)
SELECT result_no, domain_pos, len(list_filter(d.numbering, lambda r: {_loop_sql("r.position", "d.scheme", "d.chain_class")} = 'cdr3' AND r.amino_acid <> '-'))::INT AS cdr3_length
FROM x WHERE d.chain_class = 'H' AND d.numbering IS NOT NULL""",
    "domain_labels": f"""WITH {_DOMAINS}, x AS (SELECT result_no, coalesce(d.chain_class, 'H') AS chain_class, domain_pos FROM (SELECT result_no, unnest(ds) AS d, (generate_subscripts(ds, 1) - 1)::INT AS domain_pos FROM dom)),
k AS (SELECT *, row_number() OVER (PARTITION BY result_no, chain_class ORDER BY domain_pos) AS k FROM x)
SELECT result_no, domain_pos, chain_class, CASE WHEN k = 1 THEN result_no::VARCHAR ELSE result_no || '_' || chain_class || k END AS label FROM k""",
    "fasta_residues": f"WITH {_DOMAINS}, x AS (SELECT result_no, id, len(ds) AS n_domains, unnest(ds) AS d, (generate_subscripts(ds, 1) - 1)::INT AS domain_pos FROM dom), t AS (SELECT *, {_RESIDUES} AS t FROM x) " + _record_sql("t", "t"),
    "fasta_coding": f"WITH {_DOMAINS}, {_CODING} " + _record_sql("cod", "coding"),
    "fasta_amber": f"""WITH {_DOMAINS}, {_CODING}, c AS (SELECT *, {codons_sql("coding")} AS c FROM cod),
a AS (SELECT *, array_to_string(list_transform(c, lambda x: CASE WHEN replace(upper(x), 'U', 'T') = 'TAG' THEN 'CAG' ELSE x END), '') AS t FROM c WHERE len(list_filter(c, lambda x: replace(upper(x), 'U', 'T') = 'TAG')) > 0) """
    + _record_sql("a", "t"),
}
