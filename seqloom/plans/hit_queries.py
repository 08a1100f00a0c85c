"""Queries over profile hits and germline genes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import class_of_chain, profile_chain, profile_species
from ..numbering.tables import NAMES
from ..operators.germline import assign_germlines, identity, model_lengths
from ..operators.hits import above_threshold, best_frame, of_chains, prefer_species, select_domains
from ..operators.identity import cell_vectors, clustered_order, domain_vectors, encoded, vector_pairs
from ..operators.positions import state_texts_of
from ..runtime import Scratch, maybe_broadcast, spread, table
from ..sources.germlines import available_species as species_of
from ..sources.profiles import from_germlines
from . import pipeline


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without redeliveries; ``hit_no`` is their ordinal."""
    h = table(spark, sf_dir, "viterbi_hits").filter("bit_score is not null and not isnan(bit_score) and hmm_name is not null")
    return h.select("hit_no", "result_no", "hmm_name", "bit_score", "seq_start", "seq_end", "hmm_start", "hmm_end").distinct()


def profile_names(spark, sf_dir):
    n = table(spark, sf_dir, "viterbi_hits").select("hmm_name").filter("hmm_name is not null").distinct()
    chain = profile_chain(F.col("hmm_name"))
    return n.select("hmm_name", profile_species(F.col("hmm_name")).alias("species"), chain.alias("chain_type"), class_of_chain(chain).alias("chain_class"))


def score_threshold(spark, sf_dir):
    return above_threshold(_hits(spark, sf_dir), 120.0).groupBy("hmm_name").agg(F.count("*").alias("n"))


#: Keywords that restrict a search to some chains; the last two restrict nothing.
RESTRICTIONS = ("ig", "tr", "heavy", "light", "H", "k", "l", "a", "b", "g", "")


def chain_restrict(spark, sf_dir):
    """Hits that every restriction keyword leaves under an antibody scheme and under one for all chains, by profile."""
    hits = _hits(spark, sf_dir).groupBy("hmm_name").agg(F.count("*").alias("n"))
    parts = [of_chains(hits, word, scheme).select(F.lit(word).alias("restrict"), F.lit(scheme).alias("scheme"), "hmm_name", "n") for word in RESTRICTIONS for scheme in ("imgt", "kabat")]
    return reduce(DataFrame.unionByName, parts)


def species_fallback(spark, sf_dir):
    return prefer_species(_hits(spark, sf_dir), ["mouse", "rat"]).select("hit_no", "result_no")


def greedy_domains(spark, sf_dir):
    """Non-overlapping hits of every result, best first."""
    return select_domains(_hits(spark, sf_dir)).select("result_no", "domain_index", "hit_no", "seq_start", "seq_end")


def frame_choice(spark, sf_dir):
    """The best of six parts of each result's hits."""
    h = _hits(spark, sf_dir).withColumn("frame_no", F.pmod("hit_no", F.lit(6)).cast("int"))
    first = F.min_by("bit_score", F.struct("seq_start", "hit_no"))
    f = h.groupBy("result_no", "frame_no").agg(F.count("*").alias("n_domains"), F.round(F.sum("bit_score"), 3).alias("total_score"), first.alias("first_score"))
    return best_frame(f, "result_no").select("result_no", "frame_no", "n_domains", "total_score")


def germline_species(spark, sf_dir):
    return species_of(table(spark, sf_dir, "germlines"))


def germline_model_lengths(spark, sf_dir):
    return model_lengths(table(spark, sf_dir, "germlines"))


def scheme_catalog(spark, sf_dir):
    """The schemes and how many profiles the gene table gives."""
    n = table(spark, sf_dir, "germlines").groupBy("species", "chain_type").agg(F.count_distinct("segment").alias("k")).filter("k = 2").agg(F.count("*").alias("profiles"))
    return n.select(F.explode(F.array(*[F.lit(x) for x in NAMES])).alias("scheme"), "profiles")


def _state_texts(spark, sf_dir) -> DataFrame:
    """The 128 states of every imgt-numbered domain, from its stored numbering."""
    d = spread(table(spark, sf_dir, "numbering_results").select("result_no", F.posexplode("domains").alias("domain_pos", "d")).filter("d is not null and d.scheme = 'imgt' and d.chain_type is not null"))
    return state_texts_of(d.select("result_no", "domain_pos", F.col("d.chain_type").alias("chain_type"), F.col("d.numbering").alias("numbering")), "result_no", "domain_pos", "chain_type")


def state_texts(spark, sf_dir):
    return _state_texts(spark, sf_dir)


def germline_genes(spark, sf_dir):
    """Closest V and J genes of every imgt-numbered domain."""
    texts = Scratch(spark, "states").table(_state_texts(spark, sf_dir))
    out = assign_germlines(texts, table(spark, sf_dir, "germlines"), ["result_no", "domain_pos"])
    return out.withColumns({"v_identity": F.round("v_identity", 6), "j_identity": F.round("j_identity", 6)})


def germline_genes_of(spark, sf_dir):
    """As above, from an asked list of species only."""
    texts = Scratch(spark, "states").table(_state_texts(spark, sf_dir))
    out = assign_germlines(texts, table(spark, sf_dir, "germlines"), ["result_no", "domain_pos"], ["mouse", "human"])
    return out.select("result_no", "domain_pos", "identity_species", "v_gene")


def germline_identity(spark, sf_dir):
    """Identity of every J gene with the first J gene of its chain in canonical order."""
    j = table(spark, sf_dir, "germlines").filter("segment = 'J'")
    first = j.groupBy("chain_type").agg(F.min_by("aligned_seq", F.struct("species_ordinal", "gene_ordinal")).alias("q"))
    return j.join(maybe_broadcast(first), "chain_type").select("chain_type", "species", "gene", F.round(identity(F.col("q"), F.col("aligned_seq")), 6).alias("identity"))


def _gene_cells(spark, sf_dir) -> DataFrame:
    """Germline V genes as numbered residues: one member a gene, one class a chain."""
    v = table(spark, sf_dir, "germlines").filter("segment = 'V'").withColumn("member", F.concat_ws("|", "species", "gene"))
    cells = v.select(F.col("chain_type").alias("chain_class"), "member", F.posexplode(F.split("aligned_seq", "")).alias("p", "amino_acid"))
    return cells.select("chain_class", "member", (F.col("p") + 1).alias("position"), F.lit(" ").alias("insertion"), "amino_acid").filter("amino_acid <> ''")


def identity_matrix(spark, sf_dir):
    """Identity of all pairs of V genes of a chain (the gene table is fixed in size)."""
    vectors = Scratch(spark, "genes").table(encoded(cell_vectors(_gene_cells(spark, sf_dir))))
    return vector_pairs(vectors, 6)


def identity_order(spark, sf_dir):
    """Average-linkage order of the V genes of each chain."""
    return clustered_order(encoded(cell_vectors(_gene_cells(spark, sf_dir))))


def _domain_vectors(spark, sf_dir) -> DataFrame:
    """Every numbered result domain of a known class as a vector; its member is record * 4096 + place."""
    d = table(spark, sf_dir, "numbering_results").select("result_no", F.posexplode("domains").alias("domain_pos", "d")).filter("d.chain_class <> ''")
    rows = d.select(F.col("d.chain_class").alias("chain_class"), (F.col("result_no") * 4096 + F.col("domain_pos")).alias("member"), F.col("d.numbering").alias("numbering"))
    return Scratch(spark, "identity").table(encoded(domain_vectors(rows)))


def domain_identity(spark, sf_dir):
    """Identity of all pairs of result domains of a class."""
    return vector_pairs(_domain_vectors(spark, sf_dir), 6)


def domain_order(spark, sf_dir):
    """Average-linkage order of the result domains of each class."""
    return clustered_order(_domain_vectors(spark, sf_dir))


def _documents(spark, sf_dir):
    r = table(spark, sf_dir, "numbering_results").select(F.col("result_no").alias("key"), "id", "sequence", "input_type")
    g = table(spark, sf_dir, "germlines")
    return r, from_germlines(g), g


def profile_search(spark, sf_dir):
    """Hits of every record, DNA in six frames, against every profile built from the gene table; equal peptides are searched once."""
    r, profiles, _ = _documents(spark, sf_dir)
    kept = pipeline.searched_texts(Scratch(spark, "search").table(pipeline.peptides(r)), profiles, 60.0)
    hits = kept.select("key", "part", F.posexplode("kept").alias("domain_index", "h"))
    return hits.select("key", "part", "domain_index", "h.hmm_name", F.round("h.bit_score", 6).alias("bit_score"), F.col("h.start").alias("seq_start"), F.col("h.end").alias("seq_end"), "h.hmm_start", "h.hmm_end", "h.path")


def number_sequences(spark, sf_dir):
    """The whole pipeline: every record searched, numbered and assigned its genes (imgt)."""
    r, profiles, g = _documents(spark, sf_dir)
    return pipeline.numbered_domains(r, profiles, g, threshold=60.0).drop("numbering", "stop_positions")


QUERIES = {
    f.__name__: f
    for f in (
        profile_names, score_threshold, chain_restrict, species_fallback, greedy_domains, frame_choice, germline_species, germline_model_lengths, scheme_catalog,
        state_texts, germline_genes, germline_genes_of, germline_identity, identity_matrix, identity_order, domain_identity, domain_order, profile_search, number_sequences,
    )
}

_HITS = "hits AS (SELECT DISTINCT hit_no, result_no, hmm_name, bit_score, seq_start, seq_end, hmm_start, hmm_end FROM viterbi_hits WHERE bit_score IS NOT NULL AND NOT isnan(bit_score) AND hmm_name IS NOT NULL)"
_SPECIES = "CASE WHEN strpos(hmm_name, '_') > 0 THEN substr(hmm_name, 1, strpos(hmm_name, '_') - 1) ELSE 'unknown' END"
_CHAIN = "CASE WHEN strpos(hmm_name, '_') > 0 THEN substr(hmm_name, strpos(hmm_name, '_') + 1) ELSE 'H' END"
_STATES = """
d AS (SELECT result_no, unnest(domains) AS d, (generate_subscripts(domains, 1) - 1)::INT AS domain_pos FROM numbering_results),
c AS (SELECT result_no, domain_pos, d.chain_type AS chain_type, unnest(d.numbering) AS r, generate_subscripts(d.numbering, 1) AS idx FROM d WHERE d IS NOT NULL AND d.scheme = 'imgt' AND d.chain_type IS NOT NULL AND d.numbering IS NOT NULL),
p AS (SELECT result_no, domain_pos, chain_type, r.position AS p, arg_min(r.amino_acid, idx) AS aa FROM c WHERE coalesce(trim(r.insertion), '') = '' AND r.position BETWEEN 1 AND 128 AND r.amino_acid IS NOT NULL GROUP BY 1, 2, 3, 4),
m AS (SELECT result_no, domain_pos, chain_type, map(list(p ORDER BY p), list(aa ORDER BY p)) AS m FROM p GROUP BY 1, 2, 3),
states AS (SELECT result_no, domain_pos, chain_type, array_to_string(list_transform(range(1, 129), lambda i: coalesce(m[i::INT], '-')), '') AS state_sequence FROM m)"""
_IDENTITY = """coalesce(len(list_filter(range(1, 129), lambda i: substr(g.aligned_seq, i::INT, 1) <> '-' AND substr(g.aligned_seq, i::INT, 1) = substr(s.state_sequence, i::INT, 1)))
  / nullif(len(replace(substr(g.aligned_seq, 1, 128), '-', '')), 0), 0.0)"""


def _assign_sql(order: str) -> str:
    return f"""WITH {_STATES}, ask AS (SELECT DISTINCT chain_type, state_sequence FROM states), sp(species, species_rank) AS ({order}),
v AS (SELECT s.*, g.species, sp.species_rank, g.gene, g.gene_ordinal, {_IDENTITY} AS identity
  FROM ask s JOIN germlines g ON g.chain_type = s.chain_type AND g.segment = 'V' JOIN sp ON sp.species = g.species),
bv AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY chain_type, state_sequence ORDER BY identity DESC, species_rank, gene_ordinal) = 1),
j AS (SELECT s.chain_type, s.state_sequence, g.gene, g.gene_ordinal, {_IDENTITY} AS identity FROM bv s JOIN germlines g ON g.chain_type = s.chain_type AND g.segment = 'J' AND g.species = s.species),
bj AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY chain_type, state_sequence ORDER BY identity DESC, gene_ordinal) = 1)
"""


SQL = {
    "profile_names": f"""SELECT hmm_name, species, chain_type, CASE WHEN chain_type IN ('K', 'L') THEN 'L' WHEN chain_type IN ('A', 'B', 'G', 'D') THEN chain_type ELSE 'H' END AS chain_class
FROM (SELECT DISTINCT hmm_name, {_SPECIES} AS species, {_CHAIN} AS chain_type FROM viterbi_hits WHERE hmm_name IS NOT NULL)""",
    "score_threshold": f"WITH {_HITS} SELECT hmm_name, count(*) AS n FROM hits WHERE bit_score >= 120 GROUP BY 1",
    "chain_restrict": f"""WITH {_HITS}, w(restrict, chains) AS (VALUES ('ig', 'HKL'), ('tr', 'ABGD'), ('heavy', 'H'), ('light', 'KL'), ('H', 'H'), ('k', 'K'), ('l', 'L'), ('a', 'A'), ('b', 'B'), ('g', 'HKLABGD'), ('', 'HKLABGD')),
s(scheme, covered) AS (VALUES ('imgt', 'HKLABGD'), ('kabat', 'HKL')), n AS (SELECT hmm_name, {_CHAIN} AS chain, count(*) AS n FROM hits GROUP BY 1, 2)
SELECT restrict, scheme, hmm_name, n FROM n, w, s WHERE length(chain) = 1 AND strpos(chains, chain) > 0 AND strpos(covered, chain) > 0""",
    "species_fallback": f"""WITH {_HITS}, a AS (SELECT *, lower({_SPECIES}) IN ('mouse', 'rat') AS asked FROM hits)
SELECT hit_no, result_no FROM (SELECT *, bool_or(asked) OVER (PARTITION BY result_no) AS has_any FROM a) WHERE asked OR NOT has_any""",
    "greedy_domains": f"""WITH {_HITS}, s AS (SELECT result_no, list({{'h': hit_no, 's': seq_start, 'e': seq_end}} ORDER BY bit_score DESC, hit_no) AS l
  FROM (SELECT * FROM hits WHERE seq_start IS NOT NULL AND seq_end IS NOT NULL) GROUP BY 1),
r AS (SELECT result_no, list_reduce(list_transform(l, lambda x: [x]), lambda acc, h: CASE WHEN len(list_filter(acc, lambda c: h[1].s < c.e AND c.s < h[1].e)) > 0 THEN acc ELSE list_concat(acc, h) END) AS k FROM s),
u AS (SELECT result_no, unnest(k) AS d FROM r)
SELECT result_no, (row_number() OVER (PARTITION BY result_no ORDER BY d.s) - 1)::INT AS domain_index, d.h AS hit_no, d.s AS seq_start, d.e AS seq_end FROM u""",
    "frame_choice": f"""WITH {_HITS}, f AS (SELECT result_no, (hit_no % 6)::INT AS frame_no, count(*) AS n_domains, round(sum(bit_score), 3) AS total_score, arg_min(bit_score, (seq_start, hit_no)) AS first_score FROM hits GROUP BY 1, 2)
SELECT result_no, frame_no, n_domains, total_score FROM f QUALIFY row_number() OVER (PARTITION BY result_no ORDER BY n_domains DESC, total_score DESC, first_score DESC, frame_no) = 1""",
    "germline_species": "SELECT DISTINCT species FROM germlines WHERE segment = 'V'",
    "germline_model_lengths": "SELECT species, chain_type, length(rtrim(arg_min(aligned_seq, gene_ordinal), '-'))::INT AS model_length FROM germlines WHERE segment = 'J' GROUP BY 1, 2",
    "scheme_catalog": "SELECT scheme, profiles FROM (SELECT unnest(['imgt', 'chothia', 'kabat', 'martin', 'aho', 'wolfguy']) AS scheme), (SELECT count(*) AS profiles FROM (SELECT species, chain_type FROM germlines GROUP BY 1, 2 HAVING count(DISTINCT segment) = 2))",
    "state_texts": f"WITH {_STATES} SELECT * FROM states",
    "germline_genes": _assign_sql("SELECT species, min(species_ordinal) FROM germlines WHERE segment = 'V' AND chain_type = 'H' GROUP BY 1")
    + """SELECT s.result_no, s.domain_pos, bv.species AS identity_species, bv.gene AS v_gene, round(bv.identity, 6) AS v_identity, coalesce(bj.gene, '') AS j_gene, round(coalesce(bj.identity, 0.0), 6) AS j_identity
FROM states s JOIN bv USING (chain_type, state_sequence) LEFT JOIN bj USING (chain_type, state_sequence)""",
    "germline_genes_of": _assign_sql("VALUES ('mouse', 0), ('human', 1)")
    + """SELECT s.result_no, s.domain_pos, bv.species AS identity_species, bv.gene AS v_gene FROM states s JOIN bv USING (chain_type, state_sequence)
WHERE s.chain_type IN (SELECT chain_type FROM germlines WHERE segment = 'V' AND species IN ('mouse', 'human') GROUP BY 1 HAVING count(DISTINCT species) = 2)""",
    "germline_identity": f"""WITH q AS (SELECT chain_type, arg_min(aligned_seq, (species_ordinal, gene_ordinal)) AS state_sequence FROM germlines WHERE segment = 'J' GROUP BY 1)
SELECT g.chain_type, g.species, g.gene, round({_IDENTITY}, 6) AS identity FROM germlines g JOIN q s ON s.chain_type = g.chain_type WHERE g.segment = 'J'""",
    "identity_matrix": """WITH v AS (SELECT chain_type AS chain_class, species || '|' || gene AS member, aligned_seq AS q FROM germlines WHERE segment = 'V'),
c AS (SELECT chain_class, member, p, substr(q, p::INT, 1) AS aa FROM (SELECT *, unnest(range(1, length(q) + 1)) AS p FROM v)),
l AS (SELECT * FROM c WHERE aa <> '-'), n AS (SELECT chain_class, member, count(*) AS n FROM l GROUP BY 1, 2),
m AS (SELECT a.chain_class, a.member AS a, b.member AS b, count(*) AS n_both, count(*) FILTER (a.aa = b.aa) AS n_same FROM l a JOIN l b ON a.chain_class = b.chain_class AND a.p = b.p AND a.member < b.member GROUP BY 1, 2, 3)
SELECT x.chain_class, x.member AS a, y.member AS b, round(100.0 * coalesce(n_same, 0) / (x.n + y.n - coalesce(n_both, 0)), 6) AS identity
FROM n x JOIN n y ON x.chain_class = y.chain_class AND x.member < y.member LEFT JOIN m ON m.chain_class = x.chain_class AND m.a = x.member AND m.b = y.member""",
    "domain_identity": """WITH d AS (SELECT result_no, unnest(domains) AS d, generate_subscripts(domains, 1) - 1 AS k FROM numbering_results),
c AS (SELECT d.chain_class AS chain_class, result_no * 4096 + k AS member, unnest(d.numbering) AS r, generate_subscripts(d.numbering, 1) AS idx FROM d WHERE d.chain_class <> ''),
l AS (SELECT chain_class, member, r.position AS p, coalesce(trim(r.insertion), '') AS i, arg_max(r.amino_acid, idx) AS aa FROM c WHERE r.amino_acid <> '-' GROUP BY 1, 2, 3, 4),
n AS (SELECT c.chain_class, c.member, coalesce(any_value(s.n), 0) AS n FROM c LEFT JOIN (SELECT chain_class, member, count(*) AS n FROM l GROUP BY 1, 2) s ON s.chain_class = c.chain_class AND s.member = c.member WHERE c.r IS NOT NULL GROUP BY 1, 2),
m AS (SELECT a.chain_class, a.member AS a, b.member AS b, count(*) AS n_both, count(*) FILTER (a.aa = b.aa) AS n_same FROM l a JOIN l b ON a.chain_class = b.chain_class AND a.p = b.p AND a.i = b.i AND a.member < b.member GROUP BY 1, 2, 3)
SELECT x.chain_class, x.member AS a, y.member AS b, round(coalesce(100.0 * coalesce(n_same, 0) / nullif(x.n + y.n - coalesce(n_both, 0), 0), 0.0), 6) AS identity
FROM n x JOIN n y ON x.chain_class = y.chain_class AND x.member < y.member LEFT JOIN m ON m.chain_class = x.chain_class AND m.a = x.member AND m.b = y.member""",
}
