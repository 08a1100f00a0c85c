"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .languages import label_languages, wrong_labels
from .leaks import find_leaks
from .mixing import Mix
from .near_pairs import NearPairs
from .term_counts import marked_terms, term_counts
from .top_bands import top_n


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best hits of every profile."""
    best = top_n(table(spark, sf_dir, "viterbi_hits"), "hmm_name", "bit_score", "hit_no", 10)
    return best.select(F.col("g").alias("hmm_name"), "rank_no", F.col("i").alias("hit_no"))


FIELDS = ["v_gene", "j_gene", "chain_type"]


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every gene and chain name."""
    return term_counts(table(spark, sf_dir, "domain_results"), FIELDS, "result_no", "dom_no")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are too rare or too common."""
    rows = table(spark, sf_dir, "domain_results")
    total = rows.select("result_no").filter("result_no is not null").distinct().count()
    return marked_terms(p2_counts(spark, sf_dir), total).filter("mark is not null").select("field_name", "term", "mark")


def _near(spark: SparkSession, sf_dir: str) -> NearPairs:
    rows = table(spark, sf_dir, "numbering_results")
    return NearPairs(rows, "result_no", "sequence", F.col("domains.v_gene"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records with nearly the same sequence and compatible genes."""
    return _near(spark, sf_dir).pairs()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every record and with how many records it is paired."""
    return _near(spark, sf_dir).classes()


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a passage of an item, verbatim or with one word edited."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which at least 12 consecutive words of an item stand consecutively."""
    return p6_leaks(spark, sf_dir).filter("edits = 0").select("doc_id", "item_id")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).documents


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mix reaches."""
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).shares()


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    return label_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents that mix languages or carry no or a wrong label."""
    return wrong_labels(p8_stretches(spark, sf_dir)).select("doc_id", "seg_no", "lang")


QUERIES = {f.__name__: f for f in (p1_found, p2_counts, p2_found, p5_found, p5_classes, p6_leaks, p6_found, p7_mix, p7_shares, p8_stretches, p8_found)}

_TERMS = """
WITH names AS (
  SELECT 'v_gene' AS field_name, dom_no, result_no, unnest(regexp_split_to_array(v_gene, '[,;|]')) AS x FROM domain_results
  UNION ALL SELECT 'j_gene', dom_no, result_no, unnest(regexp_split_to_array(j_gene, '[,;|]')) FROM domain_results
  UNION ALL SELECT 'chain_type', dom_no, result_no, unnest(regexp_split_to_array(chain_type, '[,;|]')) FROM domain_results
), terms AS (
  SELECT field_name, upper(trim(x, E' \\t\\r\\n')) AS term, dom_no, result_no FROM names
), counts AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT result_no) AS records
  FROM (SELECT DISTINCT * FROM terms WHERE term NOT IN ('', '-')) GROUP BY 1, 2)
"""

_PAIRS = """s AS (SELECT result_no, regexp_replace(upper(sequence), '[^A-Z*]', '', 'g') AS q,
    list_filter(list_distinct(list_transform(coalesce(domains, []), lambda d: regexp_replace(upper(split_part(coalesce(d.v_gene, ''), '*', 1)), '\\s+', '', 'g'))), lambda g: g <> '') AS genes
  FROM numbering_results),
r AS (SELECT * FROM s WHERE length(q) >= 20),
g AS (SELECT DISTINCT result_no, substring(q, i::INT, 6) AS x FROM (SELECT result_no, q, unnest(range(1, length(q) - 4)) AS i FROM r)),
n AS (SELECT result_no, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.result_no AS a, b.result_no AS b, count(*) AS o FROM g a JOIN g b ON a.x = b.x AND a.result_no < b.result_no GROUP BY 1, 2),
pairs AS (
SELECT o.a AS result_a, o.b AS result_b FROM o JOIN n na ON na.result_no = o.a JOIN n nb ON nb.result_no = o.b
JOIN r ra ON ra.result_no = o.a JOIN r rb ON rb.result_no = o.b
WHERE 3 * o.o >= na.n + nb.n AND (len(ra.genes) = 0 OR len(rb.genes) = 0 OR list_has_any(ra.genes, rb.genes)))
"""

SQL = {
    "p1_found": """
SELECT hmm_name, rank_no, hit_no FROM (
  SELECT hmm_name, hit_no, row_number() OVER (PARTITION BY hmm_name ORDER BY bit_score DESC, hit_no)::INT AS rank_no
  FROM (SELECT DISTINCT hmm_name, bit_score, hit_no FROM viterbi_hits WHERE hmm_name IS NOT NULL AND bit_score IS NOT NULL AND NOT isnan(bit_score)))
WHERE rank_no <= 10""",
    "p2_counts": _TERMS + "SELECT * FROM counts",
    "p2_found": _TERMS
    + """SELECT field_name, term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark FROM counts
WHERE records <= 2 OR records > 0.1 * (SELECT count(DISTINCT result_no) FROM domain_results)""",
    "p5_found": "WITH " + _PAIRS + "SELECT * FROM pairs",
    "p5_classes": "WITH "
    + _PAIRS
    + """, c AS (SELECT k, count(*) AS links FROM (SELECT result_a AS k FROM pairs UNION ALL SELECT result_b FROM pairs) GROUP BY 1)
SELECT r.result_no, min(r.result_no) OVER (PARTITION BY r.q) AS class_id, coalesce(c.links, 0)::BIGINT AS links FROM r LEFT JOIN c ON c.k = r.result_no""",
    "p6_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\p{Cf}', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '\p{Cf}', '', 'g')), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, list_slice(w, k, k + 11) AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT item_id, list_slice(w, k, k + 11) AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
}
