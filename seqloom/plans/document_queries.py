"""Queries over result documents and raw lines, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flatten import child_tables, json_tables, link_json, link_typed
from ..operators.rejects import loaded_lines, rejected_lines
from ..runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every domain, stop and inserted residue of both document tables as a linked flat row."""
    typed = link_typed(table(spark, sf_dir, "numbering_results")).withColumn("src_table", F.lit("numbering_results"))
    text = link_json(table(spark, sf_dir, "result_json")).withColumn("src_table", F.lit("result_json"))
    return typed.unionByName(text).select("src_table", "parent_no", "domain_pos", "item", "item_pos")


def p3_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domains child table (without its own children)."""
    d = child_tables(table(spark, sf_dir, "numbering_results"))["domains"]
    return d.select("result_no", "domain_pos", "domain_index", "scheme", "v_gene", "bit_score", "seq_start", "seq_end")


def p3_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbering child table, one row a numbered position."""
    return child_tables(table(spark, sf_dir, "numbering_results"))["numbering"]


def p3_json_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domains of JSON documents with their values."""
    d = json_tables(table(spark, sf_dir, "result_json"))["domains"]
    return d.select("parent_no", "domain_pos", "domain_index", "scheme", "chain_type", "v_gene", "j_gene", "v_identity", "bit_score", "seq_start", "seq_end")


def p3_json_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered residues of JSON documents with their values."""
    return json_tables(table(spark, sf_dir, "result_json"))["numbering"]


def p3_json_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop positions of JSON documents."""
    return json_tables(table(spark, sf_dir, "result_json"))["stop_positions"]


def p3_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents: one row a valid JSON document."""
    return json_tables(table(spark, sf_dir, "result_json"))["documents"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that cannot be loaded, with the first reason that holds."""
    return rejected_lines(table(spark, sf_dir, "raw_records")).select("line_no", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines as typed rows."""
    return loaded_lines(table(spark, sf_dir, "raw_records"))


QUERIES = {f.__name__: f for f in (p3_found, p3_domains, p3_numbering, p3_json_documents, p3_json_domains, p3_json_numbering, p3_json_stops, p4_found, p4_loaded)}

_P3 = """
WITH typed AS (
  SELECT result_no AS parent_no, d, i::INT AS domain_pos
  FROM (SELECT result_no, unnest(domains) AS d, generate_subscripts(domains, 1) - 1 AS i FROM numbering_results) WHERE d IS NOT NULL
), docs AS (
  SELECT doc_no, json_extract(payload, '$.domains') AS v FROM result_json WHERE json_valid(payload)
), boxed AS (
  SELECT doc_no, CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) WHEN json_type(v) IS NULL OR json_type(v) = 'NULL' THEN []::JSON[] ELSE [v] END AS a FROM docs
), text AS (
  SELECT * FROM (SELECT doc_no AS parent_no, unnest(a) AS d, (generate_subscripts(a, 1) - 1)::INT AS domain_pos FROM boxed) WHERE json_type(d) <> 'NULL'
), kids AS (
  SELECT parent_no, domain_pos, json_extract(d, '$.stop_positions') AS s, json_extract(d, '$.numbering') AS n FROM text
), lists AS (
  SELECT parent_no, domain_pos,
    CASE WHEN json_type(s) = 'ARRAY' THEN CAST(s AS JSON[]) WHEN coalesce(json_type(s), 'NULL') = 'NULL' THEN []::JSON[] ELSE [s] END AS s,
    CASE WHEN json_type(n) = 'ARRAY' THEN CAST(n AS JSON[]) WHEN coalesce(json_type(n), 'NULL') = 'NULL' THEN []::JSON[] ELSE [n] END AS n FROM kids
)
"""

_LINKED = """SELECT 'numbering_results' AS src_table, parent_no, domain_pos, 'domain' AS item, 0 AS item_pos FROM typed
UNION ALL SELECT 'numbering_results', parent_no, domain_pos, 'stop', (generate_subscripts(d.stop_positions, 1) - 1)::INT FROM typed
UNION ALL SELECT 'numbering_results', parent_no, domain_pos, 'residue', k FROM (
  SELECT parent_no, domain_pos, unnest(d.numbering) AS r, (generate_subscripts(d.numbering, 1) - 1)::INT AS k FROM typed) WHERE trim(r.insertion) <> ''
UNION ALL SELECT 'result_json', parent_no, domain_pos, 'domain', 0 FROM text
UNION ALL SELECT 'result_json', parent_no, domain_pos, 'stop', (generate_subscripts(s, 1) - 1)::INT FROM lists
UNION ALL SELECT 'result_json', parent_no, domain_pos, 'residue', k FROM (
  SELECT parent_no, domain_pos, unnest(n) AS r, (generate_subscripts(n, 1) - 1)::INT AS k FROM lists) WHERE trim(r->>'$.insertion') <> ''
"""

_LINES = r"""
WITH lines AS (SELECT line_no, regexp_replace(raw_line, '\r$', '') AS l FROM raw_records),
cut AS (
  SELECT line_no, regexp_full_match(l, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS sound,
    list_transform(regexp_extract_all(l || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f
  FROM lines),
vals AS (
  SELECT *, lower(trim(f[3], E' \t')) AS kind, upper(replace(replace(trim(f[2], E' \t'), '-', ''), '.', '')) AS s FROM cut),
judged AS (
  SELECT *, CASE WHEN NOT sound THEN 'broken_quoting' WHEN len(f) <> 5 THEN 'column_count'
    WHEN kind NOT IN ('dna', 'protein') THEN 'bad_input_type'
    WHEN s = '' OR NOT regexp_full_match(s, CASE kind WHEN 'dna' THEN '[ACGTUNRYKMSWBDHV]*' ELSE '[ACDEFGHIKLMNPQRSTVWYX*]*' END)
      OR length(s) >= CASE kind WHEN 'dna' THEN 100000 ELSE 10000 END THEN 'bad_sequence' END AS reason
  FROM vals)
"""

SQL = {
    "p3_found": _P3 + _LINKED,
    "p3_json_documents": """SELECT doc_no AS parent_no, payload->>'$.id' AS id, payload->>'$.sequence' AS sequence, payload->>'$.input_type' AS input_type
FROM result_json WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'""",
    "p3_json_domains": _P3
    + """SELECT parent_no, domain_pos, try_cast(d->>'$.domain_index' AS INT) AS domain_index, d->>'$.scheme' AS scheme, d->>'$.chain_type' AS chain_type, d->>'$.v_gene' AS v_gene, d->>'$.j_gene' AS j_gene,
  try_cast(d->>'$.v_identity' AS DOUBLE) AS v_identity, try_cast(d->>'$.bit_score' AS DOUBLE) AS bit_score, try_cast(d->>'$.seq_start' AS INT) AS seq_start, try_cast(d->>'$.seq_end' AS INT) AS seq_end FROM text""",
    "p3_json_numbering": _P3
    + """SELECT parent_no, domain_pos, item_pos, try_cast(r->>'$.position' AS INT) AS position, r->>'$.insertion' AS insertion, r->>'$.amino_acid' AS amino_acid
FROM (SELECT parent_no, domain_pos, unnest(n) AS r, (generate_subscripts(n, 1) - 1)::INT AS item_pos FROM lists)""",
    "p3_json_stops": _P3 + "SELECT parent_no, domain_pos, item_pos, try_cast(v->>'$' AS INT) AS stop_position FROM (SELECT parent_no, domain_pos, unnest(s) AS v, (generate_subscripts(s, 1) - 1)::INT AS item_pos FROM lists)",
    "p3_domains": """
SELECT result_no, (i - 1)::INT AS domain_pos, d.domain_index, d.scheme, d.v_gene, d.bit_score, d.seq_start, d.seq_end
FROM (SELECT result_no, unnest(domains) AS d, generate_subscripts(domains, 1) AS i FROM numbering_results) WHERE d IS NOT NULL""",
    "p3_numbering": """
SELECT result_no, domain_pos, item_pos, r.position, r.insertion, r.amino_acid FROM (
  SELECT result_no, domain_pos, unnest(d.numbering) AS r, (generate_subscripts(d.numbering, 1) - 1)::INT AS item_pos FROM (
    SELECT result_no, unnest(domains) AS d, (generate_subscripts(domains, 1) - 1)::INT AS domain_pos FROM numbering_results) WHERE d IS NOT NULL)""",
    "p4_found": _LINES + "SELECT line_no, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded": _LINES
    + """SELECT line_no, f[1] AS id, s AS sequence, kind AS input_type, nullif(trim(f[4]), '') AS species,
  try_cast(nullif(trim(f[5]), '') AS DOUBLE) AS bit_score FROM judged WHERE reason IS NULL""",
}
