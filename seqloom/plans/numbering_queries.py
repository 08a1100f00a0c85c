"""Queries of the numbering schemes, and the same numbering said in SQL over sets of rows.

Three sources of state vectors, all whole: the imgt-numbered domains of the result documents; every V gene
with its chain's first J gene, with insertions of many lengths behind many states, loops up to and
beyond their limits, and deletions; and the stored state paths of the hits of protein records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import profile_chain
from ..functions.sequence import normalise
from ..numbering.tables import BLOSUM62, LETTERS, NAMES, WOLF_L1, WOLF_L1_OTHER, Canonical, Fill, FrontLetters, FrontStretch, Symmetric, scheme_for
from ..numbering.udf import number_domains
from ..runtime import maybe_broadcast, table

#: Key ranges of the three sources.
GENES, HITS = 10**15, 2 * 10**15
#: Residues behind each gene's vector, which a scheme may take in.
TAIL = "AC"
_INSERTED = (0, 1, 2, 3, 5, 26, 27)
_COLUMNS = ("key", "part", "domain_index", "n_domains", "model_length", "seq_start", "seq_end", "hmm_start", "hmm_end", "path", "sequence", "chain_type")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of stored imgt numberings: letters are insertions, ``-`` is a deletion."""
    d = table(spark, sf_dir, "numbering_results").select("result_no", F.posexplode("domains").alias("p", "d")).filter("d is not null and d.scheme = 'imgt' and d.chain_type is not null and size(d.numbering) > 0")
    kind = lambda r: F.when(r["amino_acid"] == "-", "d").when(F.trim(r["insertion"]) != "", "i").otherwise("m")
    path = F.transform("d.numbering", lambda r: F.struct(r["position"].alias("state"), kind(r).alias("kind")))
    text = F.array_join(F.filter(F.transform("d.numbering", lambda r: r["amino_acid"]), lambda a: a != "-"), "")
    return d.select((F.col("result_no") * 4096 + F.col("p")).alias("key"), path.alias("path"), text.alias("sequence"), F.col("d.chain_type").alias("chain_type"))


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "germlines")
    j = g.filter("segment = 'J'").groupBy("chain_type").agg(F.min_by("aligned_seq", F.struct("species_ordinal", "gene_ordinal")).alias("j"))
    v = g.filter("segment = 'V'").join(maybe_broadcast(j), "chain_type").withColumn("u", F.col("species_ordinal") * 1000 + F.col("gene_ordinal"))
    at = lambda c, p: F.substring(c, p, F.lit(1))
    letter = lambda p: F.when((F.col("u") % 3 == 0) & ((p * 7 + F.col("u")) % 17 == 0), "-").when(at("aligned_seq", p) != "-", at("aligned_seq", p)).otherwise(at("j", p))
    extra = lambda p: F.when(p == 1 + F.col("u") * 37 % 128, F.element_at(F.array(*map(F.lit, _INSERTED)), (F.col("u") % 7 + 1).cast("int"))).otherwise(0) + F.when(p == 111, F.col("u") * 3 % 50).otherwise(0)
    cell = lambda p, aa, kind: F.struct(p.alias("state"), kind.alias("kind"), aa.alias("aa"))
    piece = lambda p: F.concat(F.array(cell(p, letter(p), F.when(letter(p) == "-", "d").otherwise("m"))), F.array_repeat(cell(p, F.lit("G"), F.lit("i")), extra(p).cast("int")))
    cells = v.select((F.lit(GENES) + F.ascii("chain_type") * 10_000_000 + F.col("u")).alias("key"), "chain_type", F.flatten(F.transform(F.sequence(F.lit(1), F.lit(128)), piece)).alias("c"))
    text = F.array_join(F.filter(F.transform("c", lambda x: x["aa"]), lambda a: a != "-"), "")
    return cells.select("key", F.transform("c", lambda x: F.struct(x["state"].alias("state"), x["kind"].alias("kind"))).alias("path"), F.concat(text, F.lit(TAIL)).alias("sequence"), "chain_type")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with a stored path that fits their span, beside their protein sequence.

    A null input type counts as protein, as everywhere; hits of DNA records are left out, because no frame is stored with them.
    """
    h = table(spark, sf_dir, "viterbi_hits").filter("path is not null and size(path) > 0 and hmm_name is not null and hmm_start is not null and hmm_end is not null")
    newest = F.max_by(F.struct("result_no", "hmm_name", "seq_start", "seq_end", "hmm_start", "hmm_end", "path"), "loaded_at")
    h = h.groupBy("hit_no").agg(newest.alias("h")).select("hit_no", "h.*")
    r = table(spark, sf_dir, "numbering_results").select("result_no", normalise(F.col("sequence")).alias("sequence"), "input_type").filter("coalesce(lower(trim(input_type)), '') <> 'dna' and sequence is not null")
    seated = F.size(F.filter("path", lambda s: s["kind"] != "d"))
    j = h.join(r, "result_no").filter((F.col("seq_start") >= 0) & (F.col("seq_end") <= F.length("sequence")) & (seated == F.col("seq_end") - F.col("seq_start")))
    return j.select((F.lit(HITS) + F.col("hit_no")).alias("key"), F.lit(0).alias("domain_index"), F.lit(1).alias("n_domains"), "seq_start", "seq_end", "hmm_start", "hmm_end", "path", "sequence", profile_chain(F.col("hmm_name")).alias("chain_type"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as :func:`number_domains` takes them; those of the first two sources reach out to nothing."""
    fixed = _stored(spark, sf_dir).unionByName(_genes(spark, sf_dir)).withColumns({"domain_index": F.lit(1), "n_domains": F.lit(2), "seq_start": F.lit(0), "seq_end": F.length("sequence"), "hmm_start": F.lit(1), "hmm_end": F.lit(128)})
    return fixed.unionByName(_hits(spark, sf_dir)).withColumns({"part": F.lit(-1), "model_length": F.lit(128)}).select(*_COLUMNS)


def _numbering(scheme: str):
    def query(spark, sf_dir):
        n = number_domains(vectors(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism), scheme)
        label = lambda x: F.concat(x["position"].cast("string"), F.trim(x["insertion"]), F.lit(":"), x["amino_acid"])
        return n.select("key", "seq_start", "seq_end", "state_sequence", F.array_join(F.transform("numbering", label), " ").alias("numbering"))

    query.__name__ = f"numbering_{scheme}"
    query.__doc__ = f"State vectors numbered by the {scheme} scheme."
    return query


QUERIES = {f"numbering_{name}": _numbering(name) for name in NAMES}


# -- SQL ----------------------------------------------------------------------------------------

_VECTORS = f"""
stored AS (SELECT result_no * 4096 + k AS key, d.chain_type AS chain, d.numbering AS l FROM (SELECT result_no, unnest(domains) AS d, generate_subscripts(domains, 1) - 1 AS k FROM numbering_results)
  WHERE d IS NOT NULL AND d.scheme = 'imgt' AND d.chain_type IS NOT NULL AND len(d.numbering) > 0),
s AS (SELECT key, chain, generate_subscripts(l, 1) * 100 AS k, unnest(l) AS r FROM stored),
j AS (SELECT chain_type, arg_min(aligned_seq, (species_ordinal, gene_ordinal)) AS j FROM germlines WHERE segment = 'J' GROUP BY 1),
v AS (SELECT {GENES} + ascii(chain_type) * 10000000 + species_ordinal * 1000 + gene_ordinal AS key, chain_type AS chain, species_ordinal * 1000 + gene_ordinal AS u, aligned_seq AS a, j, unnest(range(1, 129)) AS p
  FROM germlines JOIN j USING (chain_type) WHERE segment = 'V'),
g AS (SELECT key, chain, p, CASE WHEN u % 3 = 0 AND (p * 7 + u) % 17 = 0 THEN '-' WHEN a[p] <> '-' THEN a[p] ELSE j[p] END AS aa,
  CASE WHEN p = 1 + u * 37 % 128 THEN ({list(_INSERTED)})[u % 7 + 1] ELSE 0 END + CASE WHEN p = 111 THEN u * 3 % 50 ELSE 0 END AS n FROM v),
h0 AS (SELECT hit_no, unnest(arg_max({{'result_no': result_no, 'hmm_name': hmm_name, 'seq_start': seq_start, 'seq_end': seq_end, 'hmm_start': hmm_start, 'hmm_end': hmm_end, 'path': path}}, loaded_at)) FROM viterbi_hits
  WHERE path IS NOT NULL AND len(path) > 0 AND hmm_name IS NOT NULL AND hmm_start IS NOT NULL AND hmm_end IS NOT NULL GROUP BY 1),
h1 AS (SELECT {HITS} + hit_no AS key, CASE WHEN strpos(hmm_name, '_') > 0 THEN substr(hmm_name, strpos(hmm_name, '_') + 1) ELSE 'H' END AS chain, seq_start, seq_end, hmm_start, hmm_end, path,
  translate(replace(replace(sequence, '-', ''), '.', ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS q
  FROM h0 JOIN numbering_results USING (result_no) WHERE coalesce(lower(trim(input_type)), '') <> 'dna' AND sequence IS NOT NULL),
h AS (SELECT *, CASE WHEN hmm_start BETWEEN 2 AND 5 THEN CASE WHEN hmm_start - 1 > seq_start THEN greatest(0, least(seq_start, hmm_start - 1 - seq_start)) ELSE hmm_start - 1 END ELSE 0 END AS front,
  CASE WHEN hmm_end > 123 AND hmm_end < 128 THEN least(length(q) - seq_end, 128 - hmm_end) ELSE 0 END AS behind
  FROM h1 WHERE seq_start >= 0 AND seq_end <= length(q) AND len(list_filter(path, lambda x: x.kind <> 'd')) = seq_end - seq_start),
hp AS (SELECT key, chain, k, x.state AS state, x.kind AS kind, q, seq_start + count(*) FILTER (x.kind <> 'd') OVER (PARTITION BY key ORDER BY k) AS here FROM (SELECT *, unnest(path) AS x, generate_subscripts(path, 1) * 100 AS k FROM h)),
raw AS (
  SELECT key, chain, k, r.position AS state, CASE WHEN r.amino_acid = '-' THEN 'd' WHEN trim(r.insertion) <> '' THEN 'i' ELSE 'm' END AS kind, r.amino_acid AS aa FROM s
  UNION ALL SELECT key, chain, p * 100, p, CASE WHEN aa = '-' THEN 'd' ELSE 'm' END, aa FROM g
  UNION ALL SELECT key, chain, p * 100 + i, p, 'i', 'G' FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM g)
  UNION ALL SELECT key, chain, k, state, kind, CASE WHEN kind <> 'd' THEN q[here] ELSE '-' END FROM hp
  UNION ALL SELECT key, chain, -i, hmm_start - i, 'm', q[seq_start - i + 1] FROM (SELECT *, unnest(range(1, front + 1)) AS i FROM h)
  UNION ALL SELECT key, chain, 1000000 + i, hmm_end + i, 'm', q[seq_end + i] FROM (SELECT *, unnest(range(1, behind + 1)) AS i FROM h)),
base AS (SELECT key, 0 AS base, NULL AS behind FROM stored UNION ALL SELECT DISTINCT key, 0, '{TAIL}' FROM v UNION ALL SELECT key, seq_start - front, substr(q, seq_end + behind + 1, 1) FROM h)"""

_ZONE = "CASE WHEN state < 23 THEN -1 WHEN state BETWEEN 25 AND 27 THEN 25 WHEN state BETWEEN 38 AND 40 THEN 38 WHEN state BETWEEN 54 AND 56 THEN 54 WHEN state BETWEEN 65 AND 67 THEN 65 WHEN state BETWEEN 103 AND 105 THEN 103 WHEN state BETWEEN 117 AND 119 THEN 117 END"

# insertions at the edges of frameworks; residues are counted (n) before anything moves
_SMOOTH = f"""
seen AS (SELECT *, {_ZONE} AS zone, (count(*) FILTER (kind <> 'd') OVER (PARTITION BY key ORDER BY k) - 1)::INT AS n FROM raw),
turn AS (SELECT *, coalesce((zone IS NULL) <> lag(zone IS NULL) OVER (PARTITION BY key ORDER BY k), false)::INT AS t FROM seen),
runs AS (SELECT *, sum(t) OVER (PARTITION BY key ORDER BY k) AS run FROM turn),
about AS (SELECT key, run, max(run) OVER (PARTITION BY key) AS final_run, count(*) FILTER (kind = 'i') AS ins, arg_max(zone, k) AS z, arg_min(state, k) AS s0, count(*) FILTER (kind <> 'd') AS c,
  coalesce(min(k) FILTER (kind <> 'd'), 1e9) AS k_first, coalesce(arg_min(state, k) FILTER (kind = 'm'), 1) AS m0, count(*) FILTER (kind = 'm') AS ms, list(state ORDER BY k) FILTER (kind = 'm') AS matched FROM runs GROUP BY 1, 2),
judged AS (SELECT r.*, z, s0, c, ins, m0, matched, c - ms AS extra_front, count(*) FILTER (r.k < k_first) OVER (PARTITION BY r.key, r.run) AS lead, zone IS NOT NULL AND r.run < final_run AND ins > 0 AS edit,
  row_number() OVER (PARTITION BY r.key, r.run, r.kind <> 'd' ORDER BY r.k) AS i FROM runs r JOIN about a ON a.key = r.key AND a.run = r.run),
live AS (SELECT *, edit AND NOT (z = -1 AND s0 - 1 + lead < ins) AS moved, m0 - greatest(0, m0 - extra_front) AS fronts FROM judged),
vec AS (SELECT key, chain, k, n, aa,
  CASE WHEN NOT moved THEN state WHEN z = -1 THEN CASE WHEN i <= fronts THEN greatest(0, m0 - extra_front) + i - 1 ELSE matched[i - fronts] END
    WHEN z IN (25, 54, 103) THEN z + least(i, 3) - 1 WHEN i <= c - 3 THEN z ELSE z + i - greatest(0, c - 3) - 1 + greatest(0, 3 - c) END AS state,
  CASE WHEN NOT moved THEN kind WHEN z IN (-1, 25, 54, 103) THEN 'm' WHEN i <= c - 3 THEN 'i' ELSE 'm' END AS kind
  FROM live WHERE NOT moved OR (kind <> 'd' AND (z <> -1 OR i <= fronts + len(matched)))),
states AS (SELECT key, array_to_string(list_transform(range(1, 129), lambda x: coalesce(m[x::INT], '-')), '') AS state_sequence
  FROM (SELECT key, map(list(state::INT ORDER BY state), list(upper(aa) ORDER BY state)) AS m FROM (SELECT key, state, arg_max(aa, k) AS aa FROM raw WHERE kind = 'm' AND state BETWEEN 1 AND 128 GROUP BY 1, 2) GROUP BY 1))"""

# labels as aligned: letters count insertions since the last seated state, dropped states pull the numbers behind them
_LABELS = """
keyed AS (SELECT vec.*, {who} AS who FROM vec),
placed AS (SELECT v.*, s.state IS NOT NULL AS dropped, (SELECT max(region) FROM layout l WHERE l.who = v.who AND l.first_state <= v.state) AS own, row_number() OVER (PARTITION BY key ORDER BY k) AS no
  FROM keyed v LEFT JOIN dropped_states s ON s.who = v.who AND s.state = v.state WHERE v.state BETWEEN 1 AND 128 AND v.who IS NOT NULL),
regional AS (SELECT *, last_value(CASE WHEN kind <> 'i' OR no = 1 THEN own END IGNORE NULLS) OVER (PARTITION BY key ORDER BY k) AS region,
  CASE WHEN kind = 'i' OR (kind = 'm' AND dropped AND coalesce(lag(kind) OVER (PARTITION BY key ORDER BY k), 'd') <> 'd') THEN 1 ELSE 0 END AS inc,
  (kind <> 'i' AND NOT dropped)::INT AS fresh FROM placed),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY k) AS grp, sum((dropped AND kind <> 'i')::INT) OVER (PARTITION BY key, region ORDER BY k) AS pulled,
  coalesce(last_value(CASE WHEN kind = 'm' OR fresh = 1 THEN state END IGNORE NULLS) OVER (PARTITION BY key ORDER BY k), 1) AS last_state FROM regional),
counted AS (SELECT *, sum(inc) OVER (PARTITION BY key, grp ORDER BY k) - 1 AS l0 FROM grouped),
lettered AS (SELECT c.*, CASE WHEN l0 <= 25 THEN l0 ELSE (l0 - 1) % 25 + 1 END AS letter, (l.off - pulled + last_state)::INT AS pos, l.wraps FROM counted c JOIN layout l ON l.who = c.who AND l.region = c.region),
failed AS (SELECT key, min(k) AS k FROM lettered WHERE letter >= 25 AND NOT wraps AND NOT (kind = 'd' AND dropped) GROUP BY 1),
cells AS (SELECT key, who, region, k, n, aa, pos, CASE WHEN letter < 0 THEN ' ' ELSE letters[letter::INT + 1] END AS code, row_number() OVER (PARTITION BY key, region ORDER BY k) AS r FROM lettered, alphabet WHERE kind <> 'd'),
span AS (SELECT l.key, min(n) AS n0, max(n) FILTER (f.k IS NULL OR l.k <= f.k) AS n1, bool_or(f.k IS NOT NULL) AS broken FROM lettered l LEFT JOIN failed f ON f.key = l.key WHERE kind <> 'd' GROUP BY 1),
sizes AS (SELECT key, who, region, count(*)::INT AS n, arg_min(pos, k)::INT AS start, count(*) FILTER (code <> ' ')::INT AS lettered, string_agg(upper(aa), '' ORDER BY k) AS text FROM cells GROUP BY 1, 2, 3)"""

# labels anew, from the length of a region: one list of labels per region, in order
_RULES = """
ruled AS (SELECT z.*, u.kind, u.ord, u.onto, u.most, u.lone, u.a, u.b, u.form FROM sizes z JOIN rules u ON u.who = z.who AND u.region = z.region
  WHERE (u.applies IS NULL OR list_contains(u.applies, z.n)) AND (u.guard IS NULL OR coalesce((SELECT y.n FROM sizes y WHERE y.key = z.key AND y.region = u.guard), 0) > u.guard_n) AND (u.kind <> 'letters' OR lettered > 0)),
best AS (SELECT key, arg_max(positions, (score, -no)) AS positions FROM (SELECT r.key, f.no, f.positions, sum(coalesce(b.score, -1)) AS score
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM ruled WHERE form) r JOIN forms f ON f.n = r.n LEFT JOIN blosum b ON b.a = r.text[r.i] AND b.b = f.consensus[r.i] GROUP BY 1, 2, 3) GROUP BY 1),
fresh AS (SELECT r.key, r.region, r.n, CASE
    WHEN kind = 'form' THEN list_transform(coalesce(b.positions, list_sort((SELECT any_value(o) FROM other_form)[1:r.n])), lambda p: {'p': p, 'l': 0, 'c': ' '})
    WHEN kind = 'letters' THEN list_concat(list_transform(range(start, onto + 1), lambda p: {'p': p::INT, 'l': 0, 'c': ' '}), list_transform(range(1, lettered + 1), lambda i: {'p': onto, 'l': i::INT, 'c': letters[i::INT]}),
      list_transform(range(onto + 1, b_end + 1), lambda p: {'p': p::INT, 'l': 0, 'c': ' '}))
    WHEN kind = 'stretch' AND r.n > b_end - start + 1 THEN list_concat(list_transform(range(start, onto + 1), lambda p: {'p': p::INT, 'l': 0, 'c': ' '}),
      list_transform(range(1, r.n - (b_end - start + 1) + 1), lambda i: {'p': onto, 'l': i::INT, 'c': letters[i::INT]}), list_transform(range(onto + 1, b_end + 1), lambda p: {'p': p::INT, 'l': 0, 'c': ' '}))
    WHEN kind = 'stretch' THEN list_transform(list_sort(list_concat([onto], list_filter(range(start, b_end + 1)::INT[], lambda p: p <> onto))[b_end - start + 1 - r.n + 1:]), lambda p: {'p': p, 'l': 0, 'c': ' '})
    WHEN r.n = 1 AND lone IS NOT NULL THEN [{'p': lone, 'l': 0, 'c': ' '}]
    ELSE list_sort(list_concat(list_transform(ord[1:r.n], lambda p: {'p': p, 'l': 0, 'c': ' '}),
      CASE WHEN onto IS NULL THEN [] ELSE list_transform(range(1, greatest(0, r.n - len(ord)) + 1), lambda i: {'p': onto, 'l': i::INT, 'c': letters[i::INT]}) END)) END AS labels,
    (most IS NOT NULL AND r.n > most) OR (kind = 'fill' AND r.n - len(ord) > 52) OR (kind = 'form' AND b.positions IS NULL AND r.n > (SELECT len(any_value(o)) FROM other_form))
      OR (kind = 'letters' AND lettered > 52) OR (kind = 'stretch' AND r.n - (b_end - start + 1) > 52) AS too_long
  FROM (SELECT *, b AS b_end FROM ruled WHERE kind <> 'symmetric') r LEFT JOIN best b ON b.key = r.key, alphabet),
both_ends AS (SELECT key, region, n, a, b, b - a + 1 AS size, ((least(n, b - a + 1) + 1) // 2)::INT AS front, (least(n, b - a + 1) // 2)::INT AS back, n > most AS too_long
  FROM (SELECT y.key, y.region, coalesce(z.n, 0) AS n, u.a, u.b, u.most FROM (SELECT DISTINCT l.key, u.region, u.who FROM (SELECT DISTINCT key, who FROM placed) l JOIN rules u ON u.who = l.who AND u.kind = 'symmetric') y
    JOIN rules u ON u.who = y.who AND u.region = y.region LEFT JOIN sizes z ON z.key = y.key AND z.region = y.region)),
mirrored AS (SELECT key, region, too_long, list_concat(list_transform(range(a, a + front), lambda p: {'p': p::INT, 'c': ' ', 'filled': true}),
    list_transform(range(a + front, b - back + 1), lambda p: {'p': p::INT, 'c': ' ', 'filled': false}),
    CASE WHEN n > size THEN list_transform(range(1, n - size - (n - size + 1) // 2 + 1), lambda i: {'p': (a + front - 1)::INT, 'c': letters[i::INT], 'filled': true}) ELSE [] END,
    CASE WHEN n > size THEN list_transform(range(1, (n - size + 1) // 2 + 1), lambda i: {'p': (b - back + 1)::INT, 'c': letters[((n - size + 1) // 2 + 1 - i)::INT], 'filled': true}) ELSE [] END,
    list_transform(range(b - back + 1, b + 1), lambda p: {'p': p::INT, 'c': ' ', 'filled': true})) AS labels FROM both_ends, alphabet),
slots AS (SELECT key, region, l.p AS pos, l.c AS code, l.filled AS filled, o, sum(l.filled::INT) OVER (PARTITION BY key, region ORDER BY o) AS r FROM (SELECT key, region, unnest(labels) AS l, generate_subscripts(labels, 1) AS o FROM mirrored)),
void AS (SELECT key FROM span WHERE broken UNION SELECT key FROM fresh WHERE too_long OR len(labels) < n UNION SELECT key FROM both_ends WHERE too_long)"""

_OUT = """
line AS (
  SELECT c.key, c.region, c.r AS o, coalesce(f.labels[c.r::INT].p, c.pos) AS pos, coalesce(f.labels[c.r::INT].c, c.code) AS code, c.aa, c.n FROM cells c LEFT JOIN fresh f ON f.key = c.key AND f.region = c.region
    WHERE NOT EXISTS (SELECT 1 FROM slots s WHERE s.key = c.key AND s.region = c.region)
  UNION ALL SELECT s.key, s.region, s.o, s.pos, s.code, CASE WHEN s.filled THEN c.aa ELSE '-' END, c.n FROM slots s LEFT JOIN cells c ON s.filled AND c.key = s.key AND c.region = s.region AND c.r = s.r),
filled AS (SELECT *, lag(pos, 1, 0) OVER (PARTITION BY key ORDER BY region, o) AS before FROM line),
text AS (SELECT key, string_agg(CASE WHEN {gaps} AND pos > before + 1 THEN array_to_string(list_transform(range(before + 1, pos), lambda p: p || ':-'), ' ') || ' ' ELSE '' END || pos || trim(code) || ':' || aa, ' ' ORDER BY region, o) AS t,
  last((pos = 148 AND code = ' ' AND aa <> '-') ORDER BY region, o) AS open_end FROM filled GROUP BY 1),
final AS (SELECT k.key, p.n0, p.n1, x.t, {tail} AND x.open_end AND b.behind <> '' AND v.key IS NULL AND p.n1 = whole.n AS more, b.base, b.behind, v.key IS NOT NULL AS void
  FROM (SELECT DISTINCT key FROM keyed WHERE who IS NOT NULL) k JOIN base b ON b.key = k.key JOIN (SELECT key, max(n) AS n FROM seen GROUP BY 1) whole ON whole.key = k.key
  LEFT JOIN span p ON p.key = k.key LEFT JOIN text x ON x.key = k.key LEFT JOIN void v ON v.key = k.key)
SELECT f.key, (base + n0)::INT AS seq_start, (base + n1 + 1 + coalesce(more, false)::INT)::INT AS seq_end, s.state_sequence, CASE WHEN void THEN '' ELSE coalesce(t, '') || CASE WHEN more THEN ' 149:' || behind[1] ELSE '' END END AS numbering
FROM final f JOIN states s ON s.key = f.key"""


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return f"{list(x)}::INT[]" if isinstance(x, (tuple, list)) else repr(x)

    body = ", ".join(f"({', '.join(map(cell, r))})" for r in rows) or f"({', '.join(['NULL'] * len(columns.split(',')))})"
    return f"{name}({columns}) AS (VALUES {body})"


def numbering_sql(scheme: str) -> str:
    """The scheme over all vectors: its regions and rules as tables, its steps as queries over them."""
    chains = {"imgt": "'*'", "aho": "CASE WHEN chain IN ('L', 'K', 'A', 'B') THEN chain ELSE 'H' END"}
    who = chains.get(scheme, "CASE WHEN chain = 'H' THEN 'H' WHEN chain IN ('K', 'L') THEN 'L' END")
    known = {"imgt": {"*": "H"}, "aho": {c: c for c in "HLKAB"}}.get(scheme, {"H": "H", "L": "L"})
    layout, dropped, rules = [], [], []
    for key, chain in known.items():
        s = scheme_for(scheme, chain)
        layout += [(key, k, first, off, k in s.wrap) for k, (first, off) in enumerate(s.layout)]
        dropped += [(key, x) for x in sorted(s.drop)]
        for k, r in s.rules.items():
            guard = s.only_if.get(k, (None, None))
            applies = [n for n in range(400) if r.applies(n)] if isinstance(r, Fill) and r.applies else None
            kind = {Fill: "fill", FrontLetters: "letters", FrontStretch: "stretch", Canonical: "form", Symmetric: "symmetric"}[type(r)]
            at = {"fill": "letters_on", "letters": "on", "stretch": "on"}.get(kind)
            a, b = (r.first, r.last) if kind == "symmetric" else (None, {"letters": "tail", "stretch": "end"}.get(kind))
            rules.append((key, k, kind, r.order if kind == "fill" else None, getattr(r, at) if at else None, getattr(r, "most", None), getattr(r, "single", None), a, getattr(r, b) if isinstance(b, str) else b, *guard, applies, kind == "form"))
    any_scheme = scheme_for(scheme, "H")
    tables = [
        _values("layout", "who, region, first_state, off, wraps", layout),
        _values("dropped_states", "who, state", dropped),
        _values("rules", "who, region, kind, ord, onto, most, lone, a, b, guard, guard_n, applies, form", rules),
        _values("forms", "n, no, consensus, positions", [(n, k, text, positions) for n, forms in WOLF_L1.items() for k, (text, positions) in enumerate(forms)]),
        _values("blosum", "a, b, score", [(a, b, v) for (a, b), v in BLOSUM62.items()] if scheme == "wolfguy" else []),
        f"other_form AS (SELECT {list(WOLF_L1_OTHER)} AS o)",
        f"alphabet AS (SELECT {LETTERS} AS letters)",
    ]
    out = _OUT.format(gaps=str(any_scheme.gaps).lower(), tail=str(any_scheme.tail_position is not None).lower())
    return f"WITH {', '.join(tables)}, {_VECTORS}, {_SMOOTH}, {_LABELS.format(who=who)}, {_RULES}, {out}"


SQL = {f"numbering_{name}": numbering_sql(name) for name in NAMES}
