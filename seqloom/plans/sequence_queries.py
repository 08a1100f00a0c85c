"""Queries over raw sequences: reading, cleaning, translation, codons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codons as C
from ..functions import sequence as S
from ..functions.labels import evalue, evalue_text
from ..operators.quality import codon_track, mean_quality, residue_codon, share_from
from ..operators.translate import codon_measures, six_frames_of
from ..runtime import spread, table
from ..sources.fasta import looks_like_dna_input, split_text


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "numbering_results").select("result_no", "sequence", "input_type")


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised, valid DNA records."""
    r = _records(spark, sf_dir).filter(F.lower(F.trim("input_type")) == "dna").select("result_no", S.normalise(F.col("sequence")).alias("s"))
    return r.filter(S.valid_dna(F.col("s")))


def fasta_records(spark, sf_dir):
    """FASTA records inside document texts."""
    return split_text(table(spark, sf_dir, "documents"), "doc_id", "text")


def fasta_roundtrip(spark, sf_dir):
    """Sequences written as wrapped FASTA and read back."""
    r = _records(spark, sf_dir).select("result_no", S.normalise(F.col("sequence")).alias("s")).filter(F.col("s").rlike(r"\A[A-Z*]+\z"))
    text = r.select("result_no", F.concat(F.lit(">rec "), F.col("result_no").cast("string"), F.lit("\n"), S.wrapped(F.col("s")), F.lit("\n")).alias("text"))
    return split_text(text, "result_no", "text").select("result_no", "id", "sequence")


def seq_normalise(spark, sf_dir):
    return _records(spark, sf_dir).select("result_no", S.normalise(F.col("sequence")).alias("clean"))


def seq_validate(spark, sf_dir):
    r = _records(spark, sf_dir).select("result_no", S.normalise(F.col("sequence")).alias("s"))
    return r.select("result_no", S.valid_protein(F.col("s")).alias("is_protein"), S.valid_dna(F.col("s")).alias("is_dna"))


def reverse_complement(spark, sf_dir):
    return _dna(spark, sf_dir).select("result_no", S.reverse_complement(F.col("s")).alias("rc"))


def _frames(spark, sf_dir) -> DataFrame:
    return six_frames_of(spread(_dna(spark, sf_dir).withColumn("n", F.length("s"))), "result_no", "n")


def six_frames(spark, sf_dir):
    return _frames(spark, sf_dir).select("result_no", "label", "sequence", F.array_join(F.transform("stop_positions", lambda x: x.cast("string")), ",").alias("stops"))


def _framed_domains(spark, sf_dir) -> DataFrame:
    """Every stored domain span of valid DNA records, in its own translation frame."""
    d = table(spark, sf_dir, "numbering_results").select("result_no", F.posexplode("domains").alias("domain_pos", "d")).filter("d.seq_start is not null and d.seq_end is not null and d.translation_frame is not null")
    d = d.select("result_no", "domain_pos", F.col("d.seq_start").alias("a"), F.col("d.seq_end").alias("b"), F.col("d.translation_frame").alias("label"))
    return _frames(spark, sf_dir).join(d, ["result_no", "label"])


def nt_ranges(spark, sf_dir):
    """Forward-strand range of every stored domain in its frame."""
    lo, hi = S.nt_range(F.col("nt_offset"), F.col("is_reverse"), F.col("n"), F.col("a"), F.col("b"))
    return _framed_domains(spark, sf_dir).select("result_no", "domain_pos", "label", lo.alias("nt_start"), hi.alias("nt_end"))


def flanks(spark, sf_dir):
    """Flanks and inner stops of every stored domain in its frame."""
    f, a, b = _framed_domains(spark, sf_dir), F.col("a"), F.col("b")
    stops = F.col("stop_positions")
    return f.select(
        "result_no", "domain_pos", S.flank_before(F.col("sequence"), a).alias("flank_before"), S.flank_after(F.col("sequence"), b, stops).alias("flank_after"), F.size(S.stops_inside(stops, a, b)).alias("stops_inside")
    )


def frame_flanks(spark, sf_dir):
    """The same of the middle third of every frame."""
    n = F.length("sequence")
    f, a, b, stops = _frames(spark, sf_dir), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"), F.col("stop_positions")
    return f.select(
        "result_no", "label", S.flank_before(F.col("sequence"), a).alias("flank_before"), S.flank_after(F.col("sequence"), b, stops).alias("flank_after"), F.size(S.stops_inside(stops, a, b)).alias("stops_inside")
    )


def codon_scores(spark, sf_dir):
    m = codon_measures(spread(_dna(spark, sf_dir)), "result_no")
    return m.select("result_no", F.round("cai", 6).alias("cai"), F.round(F.col("mean_usage") + 1e-9, 6).alias("mean_usage"), "rare")


def amber_fix(spark, sf_dir):
    c = S.codons(F.col("s"))
    return _dna(spark, sf_dir).filter(C.has_amber(c)).select("result_no", C.amber_fixed(c).alias("fixed"))


def codon_positions(spark, sf_dir):
    """Codon track of all six frames of every DNA record."""
    n, k = F.length("s"), F.col("frame_no")
    d = _dna(spark, sf_dir).withColumn("frame_no", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("w", (F.floor((n - k % 3) / 3) * 3).cast("int"))
    reverse = k >= 3
    start = F.when(reverse, n - k % 3 - F.col("w")).otherwise(k % 3)
    t = spread(d).select("result_no", "frame_no", F.inline(codon_track(F.col("s"), start, start + F.col("w"), reverse)))
    return t.select("result_no", "frame_no", "k", "codon", "residue", "is_stop", "base_start")


def domain_codons(spark, sf_dir):
    """Codon track of every stored domain of DNA records, with three flanking codons on either side and a flag for them."""
    r = table(spark, sf_dir, "numbering_results").filter(F.lower(F.trim("input_type")) == "dna").select("result_no", S.normalise(F.col("sequence")).alias("s"), F.posexplode("domains").alias("domain_pos", "d"))
    d = r.filter("d.nt_start >= 0 and d.nt_end <= length(s) and d.nt_end > d.nt_start")
    reverse = F.coalesce(F.startswith("d.translation_frame", F.lit("-")), F.lit(False))
    t = spread(d).select("result_no", "domain_pos", F.inline(codon_track(F.col("s"), F.col("d.nt_start"), F.col("d.nt_end"), reverse, 3)))
    return t.select("result_no", "domain_pos", "k", "codon", "residue", "is_stop", "base_start", "is_flank")


def residue_codons(spark, sf_dir):
    """Codon of every residue of every stored domain of DNA records; the place behind the last one has none."""
    r = table(spark, sf_dir, "numbering_results").filter(F.lower(F.trim("input_type")) == "dna").select("result_no", S.normalise(F.col("sequence")).alias("s"), F.posexplode("domains").alias("domain_pos", "d"))
    d = r.filter("d.nt_start >= 0 and d.nt_end <= length(s) and d.nt_end > d.nt_start").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.expr("d.nt_end - d.nt_start") / 3).cast("int"))))
    reverse = F.coalesce(F.startswith("d.translation_frame", F.lit("-")), F.lit(False))
    return spread(d).select("result_no", "domain_pos", "k", residue_codon(F.col("s"), F.col("d.nt_start"), F.col("d.nt_end"), reverse, F.col("k")).alias("codon"))


def text_wrap(spark, sf_dir):
    return _records(spark, sf_dir).select("result_no", S.wrapped(S.normalise(F.col("sequence"))).alias("wrapped"))


def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "raw_records").select("line_no", S.csv_field(F.col("raw_line")).alias("cell"))


def dna_sniff(spark, sf_dir):
    """Whether all sequences together look like DNA."""
    return looks_like_dna_input(_records(spark, sf_dir).select(S.normalise(F.coalesce("sequence", F.lit(""))).alias("sequence")))


def dna_sniff_records(spark, sf_dir):
    return _records(spark, sf_dir).select("result_no", S.looks_like_dna(F.coalesce("sequence", F.lit(""))).alias("looks_dna"))


def phred_summary(spark, sf_dir):
    """Mean quality and share from 20 of a user's event values taken as Phred scores."""
    q = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.least(F.floor("value"), F.lit(60)).cast("int")).alias("q"))
    return q.select("user_id", mean_quality(F.col("q")).alias("mean_q"), share_from(F.col("q")).alias("share20"))


def evalues(spark, sf_dir):
    """Gumbel e-values on a log scale, for one model of mu -9.5 and lambda 0.71."""
    v = evalue(F.col("bit_score") / 10, F.lit(-9.5), F.lit(0.71))
    hits = table(spark, sf_dir, "viterbi_hits").filter("bit_score is not null and not isnan(bit_score)").select("hit_no", "bit_score").distinct()
    return hits.select("hit_no", F.round(F.log10(v), 6).alias("log_evalue"))


def evalue_texts(spark, sf_dir):
    """Short texts of the hits' e-values."""
    hits = table(spark, sf_dir, "viterbi_hits").filter("evalue is not null and not isnan(evalue) and evalue_text is not null").select("hit_no", "evalue").distinct()
    return hits.select("hit_no", evalue_text(F.col("evalue")).alias("evalue_text"))


QUERIES = {
    f.__name__: f
    for f in (
        fasta_records, fasta_roundtrip, seq_normalise, seq_validate, reverse_complement, six_frames, nt_ranges, flanks, frame_flanks, codon_scores, amber_fix, codon_positions, domain_codons, residue_codons,
        text_wrap, csv_escape, dna_sniff, dna_sniff_records, phred_summary, evalues, evalue_texts,
    )
}


# -- SQL ----------------------------------------------------------------------------------------

ASCII_UPPER = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
CLEAN = ASCII_UPPER.format("replace(replace(sequence, '-', ''), '.', '')")
_VALID_DNA = "regexp_full_match(s, '[ACGTUNRYKMSWBDHV]*') AND length(s) < 100000"
DNA = f"dna AS (SELECT result_no, s FROM (SELECT result_no, {CLEAN} AS s FROM numbering_results WHERE lower(trim(input_type)) = 'dna') WHERE {_VALID_DNA})"


def rc_sql(s: str) -> str:
    return f"translate(regexp_replace(reverse({s}), '[^{S.COMPLEMENT_FROM}]', 'N', 'g'), '{S.COMPLEMENT_FROM}', '{S.COMPLEMENT_TO}')"


def aa_sql(c: str) -> str:
    place = lambda k: f"strpos('TCAG', substr({c}, {k}, 1))"
    return f"CASE WHEN length({c}) = 3 AND {place(1)} > 0 AND {place(2)} > 0 AND {place(3)} > 0 THEN substr('{S._AMINO}', (({place(1)} - 1) * 16 + ({place(2)} - 1) * 4 + {place(3)})::INT, 1) ELSE 'X' END"


def codons_sql(s: str) -> str:
    return f"list_transform(range(length({s}) // 3), lambda i: substr({s}, (i * 3 + 1)::INT, 3))"


_FRAMES = f"""{DNA}, strands AS (
  SELECT result_no, length(s) AS n, k AS frame_no, (['+1', '+2', '+3', '-1', '-2', '-3'])[k + 1] AS label,
    substr(CASE WHEN k < 3 THEN s ELSE {rc_sql("s")} END, (k % 3 + 1)::INT) AS x FROM dna, (SELECT unnest(range(6)) AS k)),
frames AS (
  SELECT result_no, n, frame_no, label, list_transform({codons_sql("replace(x, 'U', 'T')")}, lambda c: {aa_sql("c")}) AS aa FROM strands WHERE length(x) >= 3),
pep AS (
  SELECT *, replace(list_aggregate(aa, 'string_agg', ''), '*', 'X') AS sequence, list_filter(range(len(aa)), lambda i: aa[i + 1] = '*') AS stops FROM frames)"""
_FRAMED = """spans AS (SELECT result_no, domain_pos, d.seq_start AS a, d.seq_end AS b, d.translation_frame AS label FROM (SELECT result_no, unnest(domains) AS d, (generate_subscripts(domains, 1) - 1)::INT AS domain_pos FROM numbering_results)
  WHERE d.seq_start IS NOT NULL AND d.seq_end IS NOT NULL AND d.translation_frame IS NOT NULL),
framed AS (SELECT p.*, domain_pos, a, b FROM pep p JOIN spans s ON s.result_no = p.result_no AND s.label = p.label)"""
_FLANKS = """CASE WHEN regexp_extract(substr(sequence, 1, a::INT), '(M[^M]*)$', 1) <> '' THEN regexp_extract(substr(sequence, 1, a::INT), '(M[^M]*)$', 1) ELSE substr(sequence, 1, a::INT) END AS flank_before,
  substr(sequence, (b + 1)::INT, (greatest(0, coalesce(list_min(list_filter(stops, lambda p: p >= b)), length(sequence)) - b))::INT) AS flank_after, len(list_filter(stops, lambda p: p >= a AND p < b))::INT AS stops_inside"""
_SPANS = f"""r AS (SELECT result_no, s, unnest(domains) AS d, (generate_subscripts(domains, 1) - 1)::INT AS domain_pos FROM (SELECT result_no, domains, {CLEAN} AS s FROM numbering_results WHERE lower(trim(input_type)) = 'dna')),
w AS (SELECT result_no, domain_pos, s, d.nt_start AS a, d.nt_end AS b, coalesce(d.translation_frame LIKE '-%', false) AS rev FROM r WHERE d.nt_start >= 0 AND d.nt_end <= length(s) AND d.nt_end > d.nt_start)"""
_USAGE = ", ".join(f"('{c}', {v})" for c, v in C.usage_table().items() if S.CODONS[c] != "*")
_WEIGHT = ", ".join(f"('{c}', {v!r})" for c, v in C.weights(C.usage_table()).items())

SQL = {
    "fasta_records": r"""
WITH cut AS (SELECT doc_id, string_split(E'\n' || regexp_replace(text, '\r\n?', E'\n', 'g'), E'\n>') AS p FROM documents),
rec AS (SELECT doc_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS record_no FROM cut),
lines AS (SELECT doc_id, record_no, list_transform(string_split(v, E'\n'), lambda x: trim(x, E' \t\r')) AS l FROM rec WHERE record_no > 0)
SELECT doc_id, record_no::INT AS record_no, l[1] AS id, translate(replace(replace(array_to_string(l[2:], ''), '-', ''), '.', ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS sequence
FROM lines WHERE l[1] <> '' AND array_to_string(l[2:], '') <> '' AND replace(replace(array_to_string(l[2:], ''), '-', ''), '.', '') <> ''""",
    "fasta_roundtrip": f"SELECT result_no, 'rec ' || result_no AS id, {CLEAN} AS sequence FROM numbering_results WHERE regexp_full_match({CLEAN}, '[A-Z*]+')",
    "seq_normalise": f"SELECT result_no, {CLEAN} AS clean FROM numbering_results",
    "seq_validate": f"""SELECT result_no, regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWYX*]*') AND length(s) < 10000 AS is_protein, {_VALID_DNA} AS is_dna
FROM (SELECT result_no, {CLEAN} AS s FROM numbering_results)""",
    "reverse_complement": f"WITH {DNA} SELECT result_no, {rc_sql('s')} AS rc FROM dna",
    "six_frames": f"WITH {_FRAMES} SELECT result_no, label, sequence, coalesce(array_to_string(stops, ','), '') AS stops FROM pep",
    "nt_ranges": f"""WITH {_FRAMES}, {_FRAMED} SELECT result_no, domain_pos, label, (CASE WHEN frame_no < 3 THEN frame_no % 3 + 3 * a ELSE n - frame_no % 3 - 3 * b END)::INT AS nt_start,
  (CASE WHEN frame_no < 3 THEN frame_no % 3 + 3 * b ELSE n - frame_no % 3 - 3 * a END)::INT AS nt_end FROM framed""",
    "flanks": f"WITH {_FRAMES}, {_FRAMED} SELECT result_no, domain_pos, {_FLANKS} FROM framed",
    "frame_flanks": f"WITH {_FRAMES}, framed AS (SELECT *, length(sequence) // 3 AS a, 2 * length(sequence) // 3 AS b FROM pep) SELECT result_no, label, {_FLANKS} FROM framed",
    "codon_scores": f"""WITH {DNA}, c AS (SELECT result_no, unnest({codons_sql("replace(s, 'U', 'T')")}) AS c FROM dna),
u(c, usage) AS (VALUES {_USAGE}), w(c, weight) AS (VALUES {_WEIGHT}),
a AS (SELECT c.result_no, exp(avg(ln(weight))) AS cai, avg(usage) AS mean_usage, count(*) FILTER (c.c IN {C.RARE}) AS rare
  FROM c LEFT JOIN u ON u.c = c.c LEFT JOIN w ON w.c = c.c GROUP BY 1)
SELECT d.result_no, round(coalesce(cai, 0.0), 6) AS cai, round(coalesce(mean_usage, 0.0) + 1e-9, 6)::DOUBLE AS mean_usage, coalesce(rare, 0)::INT AS rare FROM dna d LEFT JOIN a ON a.result_no = d.result_no""",
    "amber_fix": f"""WITH {DNA}, c AS (SELECT result_no, {codons_sql("s")} AS c FROM dna)
SELECT result_no, array_to_string(list_transform(c, lambda x: CASE WHEN replace(x, 'U', 'T') = 'TAG' THEN 'CAG' ELSE x END), '') AS fixed
FROM c WHERE len(list_filter(c, lambda x: replace(x, 'U', 'T') = 'TAG')) > 0""",
    "codon_positions": f"""WITH {DNA}, c AS (SELECT result_no, length(s) AS n, k AS frame_no, CASE WHEN k < 3 THEN s ELSE {rc_sql("s")} END AS r FROM dna, (SELECT unnest(range(6)) AS k)),
k AS (SELECT result_no, n, frame_no, substr(r, (frame_no % 3 + 1)::INT) AS x, unnest(range((n - frame_no % 3) // 3)) AS k FROM c), t AS (SELECT *, substr(x, (k * 3 + 1)::INT, 3) AS codon FROM k)
SELECT result_no, frame_no::INT AS frame_no, k::INT AS k, codon, {aa_sql("replace(codon, 'U', 'T')")} AS residue, {aa_sql("replace(codon, 'U', 'T')")} = '*' AS is_stop,
  (CASE WHEN frame_no < 3 THEN frame_no + k * 3 ELSE n - 1 - frame_no % 3 - k * 3 END)::INT AS base_start FROM t""",
    "domain_codons": f"""WITH {_SPANS}, c AS (SELECT *, (b - a) // 3 AS n, unnest(range(-3, (b - a) // 3 + 3)) AS k FROM w),
p AS (SELECT *, CASE WHEN rev THEN b - 3 * k - 3 ELSE a + 3 * k END AS lo FROM c), t AS (SELECT *, CASE WHEN rev THEN {rc_sql("substr(s, (lo + 1)::INT, 3)")} ELSE substr(s, (lo + 1)::INT, 3) END AS codon FROM p WHERE lo >= 0 AND lo + 3 <= length(s))
SELECT result_no, domain_pos, k::INT AS k, codon, {aa_sql("replace(codon, 'U', 'T')")} AS residue, {aa_sql("replace(codon, 'U', 'T')")} = '*' AS is_stop, (CASE WHEN rev THEN lo + 2 ELSE lo END)::INT AS base_start, k < 0 OR k >= n AS is_flank FROM t""",
    "residue_codons": f"""WITH {_SPANS}, c AS (SELECT *, unnest(range((b - a) // 3 + 1)) AS k FROM w)
SELECT result_no, domain_pos, k::INT AS k, CASE WHEN k < (b - a) // 3 THEN CASE WHEN rev THEN {rc_sql("substr(s, (b - 3 * k - 2)::INT, 3)")} ELSE substr(s, (a + 3 * k + 1)::INT, 3) END END AS codon FROM c""",
    "text_wrap": f"""SELECT result_no, array_to_string(list_transform(range((length(s) + 59) // 60), lambda i: substr(s, (i * 60 + 1)::INT, 60)), E'\\n') AS wrapped
FROM (SELECT result_no, {CLEAN} AS s FROM numbering_results)""",
    "csv_escape": r"""SELECT line_no, CASE WHEN regexp_matches(raw_line, '[,"\n]') THEN '"' || replace(raw_line, '"', '""') || '"' ELSE raw_line END AS cell FROM raw_records""",
    "dna_sniff": f"SELECT bool_and(regexp_full_match(s, '[ACGTUNRYKMSWBDHV]*')) AND sum(length(s)) >= 30 AS is_dna FROM (SELECT {CLEAN.replace('sequence', 'coalesce(sequence, chr(45))')} AS s FROM numbering_results)",
    "dna_sniff_records": r"SELECT result_no, length(s) >= 30 AND regexp_full_match(s, '[ACGTUNRYKMSWBDHV]*') AS looks_dna FROM (SELECT result_no, upper(regexp_replace(coalesce(sequence, ''), '[\s\-.]', '', 'g')) AS s FROM numbering_results)",
    "phred_summary": """WITH q AS (SELECT user_id, least(floor(value), 60)::INT AS q FROM events)
SELECT user_id, floor(-10 * log10(avg(pow(10.0, -q / 10.0))) + 0.5)::INT AS mean_q, floor(100.0 * count(*) FILTER (q >= 20) / count(*) + 0.5)::INT AS share20 FROM q GROUP BY 1""",
    "evalues": """WITH z AS (SELECT DISTINCT hit_no, bit_score, exp(-0.71 * (bit_score / 10 * ln(2.0) + 9.5)) AS x FROM viterbi_hits WHERE bit_score IS NOT NULL AND NOT isnan(bit_score))
SELECT hit_no, round(log10(CASE WHEN x < 1e-4 THEN x - x * x / 2 + x * x * x / 6 ELSE 1 - exp(-x) END), 6) AS log_evalue FROM z""",
    "evalue_texts": r"SELECT DISTINCT hit_no, regexp_replace(regexp_replace(evalue_text, 'e-0+(\d)', 'e-\1'), 'e\+0*(\d)', 'e\1') AS evalue_text FROM viterbi_hits WHERE evalue IS NOT NULL AND NOT isnan(evalue) AND evalue_text IS NOT NULL",
}
