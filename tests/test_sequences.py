"""Sequence functions, sources and exports."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import codons as C
from seqloom.functions import labels as B
from seqloom.functions import sequence as S
from seqloom.operators import dedup as D
from seqloom.operators import quality as Q
from seqloom.operators.germline import _order, _score_by_join, _score_by_matrix, assign_germlines, model_lengths
from seqloom.operators.hits import best_frame, of_chains, prefer_species, select_domains
from seqloom.operators.identity import leaf_order, pairwise_identity
from seqloom.operators.translate import codon_measures, six_frames_of
from seqloom.operators.positions import aligned_texts, aligned_texts_of, filled_gaps, position_union, position_union_of, residue_rows, union_order
from seqloom.search.profile_search import Model, aligned, scores, stable_evalues
from seqloom.sinks import exports as X
from seqloom.sources import abif, fasta, germlines, profiles
from seqloom.sources.results import DOCUMENT, position_cells, read_results


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_clean_and_check(spark):
    r = one(spark, a=S.normalise(F.lit("ac-t.gé")), b=S.valid_protein(F.lit("")), c=S.valid_protein(F.lit("MJ")), d=S.valid_dna(F.lit("ACGTN")), e=S.valid_dna(F.lit("ACG\n")), f=S.valid_protein(F.repeat(F.lit("A"), F.lit(10_000))), g=S.valid_dna(F.lit(None).cast("string")))
    assert tuple(r) == ("ACTGé", True, False, True, False, False, None)


def frames(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    out = {}
    for r in six_frames_of(df, "k").collect():
        out.setdefault(r.k, {})[r.label] = (r.sequence, r.stop_positions)
    return out


def test_frames(spark):
    long = "ACGTTGCAAT" * 9000
    f = frames(spark, "ATGGAATGAAAA", "ATGGANAAA", "AC", "", None, "ACGT", "augUAGuaa", long)
    assert f[0]["+1"] == ("MEXK", [2])
    assert f[1]["+1"] == ("MXK", []) and list(f[5]) == ["+1", "+2", "-1", "-2"] and set(f) == {0, 1, 5, 6, 7}
    assert f[6]["+1"] == ("MXX", [1, 2]) and len(f[7]["-3"][0]) == (len(long) - 2) // 3
    for k, text in ((0, "ATGGAATGAAAA"), (7, long)):
        back = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for label, strand in (("+2", text[1:]), ("-1", back), ("-3", back[2:])):
            aa = "".join(S.CODONS[strand[i : i + 3]] for i in range(0, len(strand) - 2, 3))
            assert f[k][label] == (aa.replace("*", "X"), [i for i, x in enumerate(aa) if x == "*"])


def test_strands(spark):
    dna = "ACGTURYKMSWBDHVN"
    r = one(spark, a=S.reverse_complement(F.lit(dna)), b=S.reverse_complement(S.reverse_complement(F.lit("ACGTRYKMSWBDHVN"))), c=S.reverse_complement(F.lit("A?C")))
    assert (r.a, r.b, r.c) == ("NBDHVWSKMRYAACGT", "ACGTRYKMSWBDHVN", "GNT")
    n, off, s, e = 20, 1, 2, 4
    fwd = "ACGGTCAATGCCTTAGGACT"
    lo, hi = one(spark, a=S.nt_range(F.lit(off), F.lit(True), F.lit(n), F.lit(s), F.lit(e))[0], b=S.nt_range(F.lit(off), F.lit(True), F.lit(n), F.lit(s), F.lit(e))[1])
    got = one(spark, a=S.coding_dna(F.lit(fwd), F.lit(lo), F.lit(hi), F.lit(True))).a
    rc = fwd[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got == rc[off + 3 * s : off + 3 * e]


def test_codons(spark):
    c = S.codons(F.lit("ATGTAGAGACTG"))
    r = one(spark, b=C.has_amber(c), c=C.amber_fixed(c))
    assert (r.b, r.c) == (True, "ATGCAGAGACTG")
    texts = ["ATGTAGAGACTG", "CTGATT", "TAG", "CTGUUU", "", "AC", "NNNCTG", None]
    got = {r.k: r for r in codon_measures(spark.createDataFrame(list(enumerate(texts)), "k int, s string"), "k").collect()}
    assert set(got) == set(range(7)) and got[0].rare == 1 and abs(got[1].cai - 1.0) < 1e-12
    assert [got[k].cai for k in (2, 4, 5)] == [0.0] * 3 == [got[k].mean_usage for k in (2, 4, 5)]
    assert abs(got[3].mean_usage - (52.6 + 22.4) / 2) < 1e-9 and got[6].mean_usage == 52.6
    assert len(C.usage_table()) == 64 and sum(v == 1.0 for v in C.weights(C.usage_table()).values()) >= 20


def test_flanks(spark):
    r = one(spark, a=S.flank_before(F.lit("AMCMDEFG"), F.lit(5)), b=S.flank_before(F.lit("ACDEFG"), F.lit(3)), c=S.flank_after(F.lit("ACDEFGHI"), F.lit(3), F.array(F.lit(1), F.lit(6))), d=S.flank_after(F.lit("ACDEFGHI"), F.lit(3), F.array().cast("array<int>")), e=S.flank_before(F.lit("ABC"), F.lit(0)))
    assert tuple(r) == ("MD", "ACD", "EFG", "EFGHI", "")


def test_labels(spark):
    names = F.array(*[F.lit(x) for x in ("human_H", "a_b_C", "plain")])
    r = one(spark, a=F.transform(names, B.profile_species), b=F.transform(names, B.profile_chain), c=B.position_label(F.lit(111), F.lit("A")), d=B.position_label(F.lit(1), F.lit(" ")), e=B.evalue_text(F.lit(2.84e-40)), f=B.evalue_text(F.lit(9.97e-5)), g=B.cdr_of(F.lit(30), F.lit("chothia"), F.lit("H")), h=B.cdr_of(F.lit(30), F.lit("x"), F.lit("H")))
    assert tuple(r) == (["human", "a", "unknown"], ["H", "b_C", "H"], "111A", "1", "2.8e-40", "1.0e-4", "cdr1", "")
    value, text = stable_evalues(np.array([2000.0, 100.0]), np.zeros(2), np.full(2, 0.7))
    assert value[0] == 0.0 and text[0].endswith("e-422") and (value[1], text[1]) == (pytest.approx(np.exp(-70 * np.log(2)), rel=1e-9), "8.5e-22")


HITS = "result_no long, hmm_name string, bit_score double, hit_no long, seq_start int, seq_end int"


def test_species_and_chains(spark):
    h = spark.createDataFrame([(1, "human_H", 100.0, 1, 0, 120), (1, "mouse_H", 95.0, 2, 0, 120), (1, "human_K", 90.0, 3, 0, 110), (2, "human_H", 9.0, 4, 0, 9)], HITS)
    assert {r.hit_no for r in prefer_species(h, ["mouse"]).collect()} == {2, 4}
    assert prefer_species(h, ["rabbit"]).count() == 4 == prefer_species(h, []).count()
    assert {r.hit_no for r in of_chains(h, "light").collect()} == {3}


def test_greedy_choice(spark):
    rows = [(1, "a_H", 50.0, 1, 0, 10), (1, "a_H", 60.0, 2, 5, 15), (1, "a_H", 40.0, 3, 15, 20), (1, "a_H", 40.0, 4, 14, 21), (1, "a_H", float("nan"), 5, 30, 40), (1, None, None, 6, 30, 40), (2, "x", 1.0, 7, 3, 4), (2, "x", 1.0, 7, 3, 4)]
    got = sorted(tuple(r) for r in select_domains(spark.createDataFrame(rows, HITS)).collect())
    assert got == [(1, 0, 2, 60.0, 5, 15), (1, 1, 3, 40.0, 15, 20), (2, 0, 7, 1.0, 3, 4)]


def test_frame_choice(spark):
    rows = [(1, 0, 1, 50.0, 50.0), (1, 1, 2, 40.0, 10.0), (1, 2, 2, 40.0, 20.0), (1, 3, 2, 40.0, 20.0), (2, 0, 0, 0.0, 0.0)]
    got = best_frame(spark.createDataFrame(rows, "ordinal long, frame_no int, n_domains int, total_score double, first_score double")).collect()
    assert [(r.ordinal, r.frame_no) for r in got] == [(1, 2)]


def gene(segment, chain, species, s, name, g, seq):
    return (segment, chain, species, s, name, g, seq.ljust(128, "-"))


def test_germlines(spark):
    rows = [gene("V", "H", "human", 0, "v1", 0, "ACDE"), gene("V", "H", "human", 0, "v2", 1, "ACDE"), gene("V", "H", "mouse", 1, "v3", 0, "ACDE"), gene("V", "A", "human", 0, "va", 0, "WW"), gene("J", "H", "human", 0, "j1", 0, "-" * 116 + "WGQG"), gene("J", "H", "human", 0, "j2", 1, "-" * 116 + "WGQA")]
    g = spark.createDataFrame(rows, germlines.SCHEMA)
    q = lambda s, j="": s.ljust(116, "-") + j.ljust(12, "-")
    d = spark.createDataFrame([(1, "H", q("ACDF", "WGQA")), (2, "H", q("")), (3, "A", q("WY")), (4, "G", q("AA")), (5, None, q("AA"))], "k long, chain_type string, state_sequence string")
    got = {r.k: tuple(r)[1:] for r in assign_germlines(d, g, ["k"]).collect()}
    assert got == {1: ("human", "v1", 0.75, "j2", 1.0), 2: ("human", "v1", 0.0, "j1", 0.0), 3: ("human", "va", 0.5, "", 0.0)}
    asked = {r.k: (r.identity_species, r.v_gene) for r in assign_germlines(d, g, ["k"], ["mouse", "human"]).collect()}
    assert asked == {1: ("mouse", "v3"), 2: ("mouse", "v3")}
    ask = d.select("chain_type", "state_sequence").filter("chain_type is not null").distinct()
    assert {tuple(r) for r in _score_by_join(ask, g, _order(g, [])).collect()} == {tuple(r) for r in _score_by_matrix(ask, g, _order(g, [])).collect()}
    assert {tuple(r) for r in model_lengths(g).collect()} == {("human", "H", 120)}
    assert [r[0] for r in germlines.available_species(g).collect()] == ["human", "mouse"]
    text = json.dumps({"V": {"H": {"b": {"g2": "AC", "g1": "AD"}, "a": {"g": "C"}}}})
    assert germlines.germline_rows(text) == [("V", "H", "b", 0, "g2", 0, "AC"), ("V", "H", "b", 0, "g1", 1, "AD"), ("V", "H", "a", 1, "g", 0, "C")]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("stray\nACGT\n>one two\nac-t.g\n\n>\nGG\n>empty\n>three\r\nMK T\r\nLV\r\n")
    (tmp_path / "b.fa").write_text(">seq1\nac-t.g\n>seq2\nA.C-G\n")
    got = [(r.id, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()]
    assert got == [("one two", "ACTG"), ("three", "MK TLV")]
    assert sorted((r.id, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path)).collect()) == [("one two", "ACTG"), ("seq1", "ACTG"), ("seq2", "ACG"), ("three", "MK TLV")]
    big = "".join(f">r{k}\n{'ACGT' * 30}\n" for k in range(3000))
    (tmp_path / "c.fa").write_text(big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = fasta.read_fasta(spark, str(tmp_path / "c.fa"))
        assert rows.count() == 3000 == rows.select("id").distinct().count()
        assert [r.id for r in rows.orderBy("ordinal").collect()] == [f"r{k}" for k in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def abif_bytes(bases=b"acgt", quality=(10, 20, 30, 40), drop=()):
    blocks = [(b"PBAS", 2, 2, 1, bases), (b"PLOC", 2, 4, 2, struct.pack(">4h", 1, 5, 9, 13)), (b"FWO_", 1, 2, 1, b"GATC")]
    blocks += [(b"DATA", 9 + k, 4, 2, struct.pack(">5h", *[k * 10 + i for i in range(5)])) for k in range(4)]
    if quality is not None:
        blocks.append((b"PCON", 2, 2, 1, bytes(quality)))
    blocks = [b for b in blocks if (b[0], b[1]) not in drop]
    body, entries, at = b"", b"", 128
    for name, number, kind, width, raw in blocks:
        inline = len(raw) <= 4
        where = raw.ljust(4, b"\0") if inline else struct.pack(">I", at)
        entries += struct.pack(">4sihhii4si", name, number, kind, width, len(raw) // width, len(raw), where, 0)
        if not inline:
            body, at = body + raw, at + len(raw)
    head = b"ABIF" + struct.pack(">h", 101) + struct.pack(">4sihhiiii", b"tdir", 1, 1023, 28, len(blocks), 28 * len(blocks), at, 0)
    return head.ljust(128, b"\0") + body + entries


def test_traces(spark, tmp_path):
    t = abif.parse_abif(abif_bytes())
    assert (t["bases"], t["quality"], t["peak_locations"], t["base_order"], t["trace_length"]) == ("ACGT", [10, 20, 30, 40], [1, 5, 9, 13], "GATC", 5)
    assert t["channels"]["A"] == [10, 11, 12, 13, 14]
    assert abif.parse_abif(abif_bytes(quality=None))["quality"] == []
    again = abif.parse_abif(abif.encode_abif("acgtn", [1, 2, 3, 4, 60], [[5, 6], [7], [8], [9]], [0, 3, 9, 12, 300]))
    assert (again["bases"], again["quality"], again["channels"]["G"], again["peak_locations"], again["trace_length"]) == ("ACGTN", [1, 2, 3, 4, 60], [5, 6], [0, 3, 9, 12, 300], 2)
    assert abif.parse_abif(b"JUNK" + b"\0" * 200) is None is abif.parse_abif(abif_bytes(drop=[(b"DATA", 10)])) and abif.parse_abif(b"ABIF") is None
    (tmp_path / "read 1.ab1").write_bytes(abif_bytes())
    (tmp_path / "bad.AB1").write_bytes(b"nothing")
    (tmp_path / "x.fasta").write_text(">p\nMKT\n")
    got = abif.read_abif(spark, str(tmp_path)).collect()
    assert [(r.id, r.bases, r.channels["C"][0]) for r in got] == [("read 1", "ACGT", 30)]
    inputs = abif.read_inputs(spark, str(tmp_path)).collect()
    assert {(r.id, r.input_type) for r in inputs} == {("read 1", "dna"), ("p", "dna")}


def test_quality(spark):
    r = one(spark, a=Q.mean_quality(F.array(F.lit(10), F.lit(20))), b=Q.share_from(F.array(F.lit(10), F.lit(20), F.lit(30))), c=Q.mean_quality(F.array().cast("array<int>")), d=Q.span_qualities(F.array(*[F.lit(k) for k in range(6)]), F.lit(2), F.lit(4)))
    assert tuple(r) == (13, 67, None, [2, 3])
    assert one(spark, c=Q.residue_codon(F.lit("AACTACCATGG"), F.lit(2), F.lit(8), F.lit(True), F.lit(1)), d=Q.residue_codon(F.lit("ACG"), F.lit(0), F.lit(3), F.lit(False), F.lit(1)))[:] == ("TAG", None)
    results = spark.createDataFrame([("r", [(0, 2), (2, 4), (None, None)]), ("none", [(0, 2)])], "id string, domains array<struct<nt_start int, nt_end int>>")
    traces = spark.createDataFrame([("r", [10, 20, 30, 30])], "id string, quality array<int>")
    got = {(x.id, x.domain_pos): (x.mean_quality, x.share20) for x in Q.domain_qualities(results, traces).collect()}
    assert got == {("r", 0): (13, 50), ("r", 1): (30, 100), ("r", 2): (None, None), ("none", 0): (None, None)}
    t = one(spark, t=Q.codon_track(F.lit("AACTACCATGG"), F.lit(2), F.lit(8), F.lit(True))).t
    assert [(x.codon, x.residue, x.base_start) for x in t] == [("TGG", "W", 7), ("TAG", "*", 4)]


RESULTS = f"result_no long, {DOCUMENT}"


def domain(k=0, chain="H", stops=(), numbering=(), **more):
    base = dict(domain_index=k, species="human", chain_type=chain, chain_class=chain, identity_species="", v_gene="", v_identity=0.0, j_gene="", j_identity=0.0, scheme="imgt", bit_score=150.06, evalue=1e-40, evalue_text="1.0e-40", seq_start=0, seq_end=3, translation_frame="", nt_start=None, nt_end=None, stop_positions=list(stops), flank_before="", flank_after="", numbering=[{"position": p, "insertion": i, "amino_acid": a} for p, i, a in numbering])
    return base | more


def test_duplicates(spark):
    n = [(1, " ", "A"), (2, " ", "-"), (3, " ", "C")]
    rows = [
        (1, "a", "ATGTAG", "dna", [domain(stops=[1], numbering=n)]), (2, "b", "ATGCAG", "dna", [domain(numbering=n)]), (3, "c", "atgcag", "dna", [domain(numbering=n)]),
        (4, "d", "MKT", "protein", None), (5, "e", "mkt", "protein", []), (6, "f", None, None, [None]), (7, "g", "MKT", "protein", [domain(numbering=n)]),
    ]
    scores = spark.createDataFrame([(k, 0.9 if k == 3 else 0.5) for k in (1, 2, 3)], "result_no long, score double")
    marked = D.mark_canonical(spark.createDataFrame(rows, RESULTS), scores=scores)
    got = {r.result_no: (r.canonical, r.slot, r.is_canonical) for r in marked.collect()}
    assert got == {1: (3, 1, False), 2: (3, 1, False), 3: (3, 1, True), 4: (4, 4, True), 5: (4, 4, False), 6: (6, 6, True), 7: (4, 4, False)}
    classed = D.result_classes(marked)
    assert tuple(D.summary(classed).first()) == (7, 3, 3, 4, 1, 3, 1)
    assert {(r.canonical, r.size, tuple(r.duplicates)) for r in D.duplicate_groups(marked).collect()} == {(3, 3, (1, 2)), (4, 3, (5, 7))}
    assert {r.result_no for r in D.for_download(classed).collect()} == {2, 3, 7}


def test_amber_stops_count_as_q(spark):
    cells = lambda s: [(k + 1, " ", a) for k, a in enumerate(s)]
    span = dict(nt_start=0, nt_end=9, translation_frame="+1")
    rows = [
        (1, "a", "ATGTAGAAA", "dna", [domain(stops=[1], numbering=cells("MX-K"), **span)]), (2, "b", "ATGCAGAAA", "dna", [domain(numbering=cells("MQK"), **span)]),
        (3, "c", "ATGTAAAAA", "dna", [domain(stops=[1], numbering=cells("MXK"), **span)]), (4, "d", "TTTCTACAT", "dna", [domain(stops=[1], numbering=cells("MXK"), **span | {"translation_frame": "-1"})]),
    ]
    df = spark.createDataFrame(rows, RESULTS)
    of = lambda **o: {r.result_no: r.canonical for r in D.mark_canonical(df, **o).collect()}
    assert of() == {1: 1, 2: 2, 3: 1, 4: 1} and of(readthrough_as_q=True) == {1: 2, 2: 2, 3: 3, 4: 2}
    total = {r.result_no: r.score for r in D.codon_scores(X.coding_rows(df)).collect()}
    one_ = {r.result_no: r.cai for r in codon_measures(X.coding_rows(df), "result_no", text="coding").collect()}
    assert total.keys() == one_.keys() and all(abs(total[k] - one_[k]) < 1e-8 for k in total)


def test_positions_and_exports(spark, tmp_path):
    rows = [
        (1, "r1", "MKTLLV", "protein", [domain(numbering=[(1, " ", "A"), (111, "A", "C"), (112, "A", "D"), (112, " ", "E")], v_gene="IGHV1", v_identity=0.5), domain(1, "K", numbering=[(3, " ", "F")], chain_class="L")]),
        (2, 'r,"2"', "ATGTAGCAG", "dna", [domain(numbering=[(1, " ", "M"), (2, " ", "X"), (4, " ", "Q")], nt_start=0, nt_end=9, translation_frame="+1")]), (3, "r3", "X", "protein", []),
    ]
    df = spark.createDataFrame(rows, RESULTS)
    cells = residue_rows(df)
    assert union_order(position_union(cells)) == ["1", "2", "3", "4", "111A", "112A", "112"]
    assert {tuple(r) for r in position_union_of(df).collect()} == {tuple(r) for r in position_union(cells).collect()}
    assert {tuple(r) for r in aligned_texts_of(df).collect()} == {tuple(r) for r in aligned_texts(cells).collect()}
    assert position_union_of(df.limit(0)).count() == 0 == aligned_texts_of(df.limit(0)).count()
    texts = {(r.result_no, r.domain_pos): r.aligned for r in aligned_texts(cells).collect()}
    assert texts == {(1, 0): "A---CDE", (1, 1): "--F----", (2, 0): "MX-Q---"}
    assert filled_gaps(cells).filter("result_no = 1 and domain_pos = 1").count() == 3
    wide = X.wide_table(df)
    assert wide.columns == ["result_no", "domain_pos"] + X.WIDE_COLUMNS + ["1", "2", "3", "4", "111A", "112A", "112"]
    first = wide.orderBy("result_no", "domain_pos").collect()[0]
    assert (first["Id"], first["score"], first["v_identity"], first["j_identity"], first["seqend_index"], first["heavy_cdr3_length"], first["full_length_aa"], first["2"]) == ("r1", "150.1", "0.50", "", 2, 3, "ACDE", "-")
    assert [r.record for r in X.fasta_residues(df).orderBy("result_no", "domain_pos").collect()] == [">r1_d1\nACDE", ">r1_d2\nF", '>r,"2"\nMXQ']
    assert [r.record for r in X.fasta_coding(df).collect()] == ['>r,"2"\nATGTAGCAG'] and [r.record for r in X.fasta_amber_fixed(df).collect()] == ['>r,"2"\nATGCAGCAG']
    assert {(r.result_no, r.aligned) for r in X.aligned_fasta(df, codon=True).collect()} == {(2, "ATGTAG---CAG---------")}
    assert {(r.label, r.aligned) for r in X.aligned_fasta(df).collect()} == {("r1_d1", "A---CDE"), ("r1_d2", "--F----"), ('r,"2"', "MX-Q---")}
    report = {r.result_no: r.report.split("\n") for r in X.line_report(df).collect()}
    assert report[3] == ["# r3", "//"]
    assert report[1][:5] == ["# r1", "# numbered", "# Domain 1 of 2", "# Most significant HMM hit", "#|species|chain_type|e-value|score|seqstart_index|seqend_index|"]
    assert report[1][5] == "#|human|H|1.0e-40|150.1|0|2|" and report[1][8] == "#||IGHV1|0.50|unknown|0.00|" and report[1][9] == "# Scheme = imgt"
    assert report[1][10:12] == ["H 1       A", "H 111   A C"] and "# Domain 2 of 2" in report[1] and sum(x.startswith("# Most sequence") for x in report[1]) == 1
    X.write_text(X.line_report(df), "report", str(tmp_path / "report"), "result_no")
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()].count("//") == 3
    line = X.csv_lines(wide, "result_no", "domain_pos").orderBy("result_no", "domain_pos").collect()[2].line
    assert line.startswith('"r,""2""",0,human')
    back = read_results(X.as_json(df, "result_no"), "document", "result_no")
    assert {tuple(r) for r in position_cells(back, "result_no").collect()} == {tuple(r) for r in cells.select("result_no", "domain_pos", "chain_class", "position", "insertion", "amino_acid").collect()}
    assert read_results(spark.createDataFrame([("{oops",)], "payload string")).first().domains is None


def test_identity(spark):
    cells = [("H", m, p, " ", a) for m, s in (("a", "ACDE"), ("b", "ACDF"), ("c", "W")) for p, a in enumerate(s)] + [("H", "a", 9, " ", "-"), ("L", "z", 1, " ", "A")]
    got = {(r.a, r.b): r.identity for r in pairwise_identity(spark.createDataFrame(cells, "chain_class string, member string, position int, insertion string, amino_acid string")).collect()}
    assert got == {("a", "b"): 75.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    d = np.array([[0, 4, 1, 9], [4, 0, 5, 3], [1, 5, 0, 8], [9, 3, 8, 0]], float)
    assert leaf_order(d) == [0, 2, 1, 3] and leaf_order(np.zeros((1, 1))) == [0] and leaf_order(np.zeros((3, 3))) == [0, 1, 2]


HMM = """HMMER3/f [3.1]
NAME  toy_H
LENG  2
ALPH  amino
STATS LOCAL MSV       -8.0  0.70
STATS LOCAL VITERBI   -9.0  0.71
STATS LOCAL FORWARD   -4.0  0.71
HMM          A        C        D        E        F        G        H        I        K        L        M        N        P        Q        R        S        T        V        W        Y
            m->m     m->i     m->d     i->m     i->i     d->m     d->d
  COMPO   {c}
          {c}
          0.01 5.0 5.0 0.6 0.7 0.0 *
      1   0.01 {r} 1 - - -
          {c}
          0.01 5.0 5.0 0.6 0.7 0.5 0.9
      2   5.0 0.01 {q} 2 - - -
          {c}
          0.01 5.0 * 0.6 0.7 0.0 *
//
"""


def toy(text="ACDEFGHIKLMNPQRSTVWY" * 2):
    match = np.full((len(text), 20), 0.01)
    for k, aa in enumerate(text):
        match[k, profiles.RESIDUES.index(aa)] = 0.81
    return profiles.Profile("toy_H", match, np.tile([0.98, 0.01, 0.01, 0.7, 0.3, 0.7, 0.3], (len(text), 1)))


def test_profiles():
    text = HMM.replace("{c}", " ".join(["3.0"] * 20)).replace("{r}", " ".join(["5.0"] * 19)).replace("{q}", " ".join(["5.0"] * 18))
    (p,) = profiles.parse_hmmer3(text)
    assert (p.name, p.length, p.mu, p.lam) == ("toy_H", 2, -9.0, 0.71) and p.trans[1, 2] == 0.0 and abs(p.match[0, 0] - np.exp(-0.01)) < 1e-12
    for bad in ("", "NAME x\n//\n"):
        with pytest.raises(ValueError):
            profiles.parse_hmmer3(bad)


def code(s):
    return np.array([profiles.RESIDUES.index(a) if a in profiles.RESIDUES else 20 for a in s])


def test_planted_domains_are_found():
    m = Model(toy())
    whole = "ACDEFGHIKLMNPQRSTVWY" * 2
    seqs = ["WWWW" + whole + "GG", "KK" + whole[:10] + whole[12:], whole[:20] + "WW" + whole[20:], "PPPPPPPPPP", whole[5:35]]
    coded = [code(s) for s in seqs]
    bits, start, end, a, z, path = aligned(m, coded)
    assert bits[0] > 100 > bits[3] and (start[0], end[0], a[0], z[0]) == (4, 44, 1, 40)
    assert (start[1], end[1]) == (2, 40) and (start[4], end[4], a[4], z[4]) == (0, 30, 6, 35)
    assert path[1] == "m" * 10 + "dd" + "m" * 28 and path[2] == "m" * 20 + "ii" + "m" * 20 and path[4] == "m" * 30
    assert np.allclose(scores(m, coded), bits, atol=1e-3)


def plain_viterbi(p, seq):
    """Best local alignment by the recurrence, cell by cell: nats without the length model, and its path."""
    n, neg = p.length, float("-inf")
    emit = np.log(np.maximum(p.match, 1e-9) / profiles.BACKGROUND)
    mm, mi, md, im, ii, dm, dd = np.log(np.maximum(p.trans, 1e-9)).T
    enter = np.log(2.0 / (n * (n + 1)))
    best, rows = (neg, None), {}
    for i, x in enumerate(seq):
        for k in range(n):
            at = lambda j, s, kind: rows.get((j, s, kind), (neg, None))
            options = [(enter, (i, k, ""))]
            if k:
                options += [(at(i - 1, k - 1, c)[0] + t[k - 1], at(i - 1, k - 1, c)[1]) for c, t in (("m", mm), ("i", im), ("d", dm))]
            score, origin = max(options, key=lambda o: o[0])
            if origin is None:
                score, origin = options[0]
            rows[i, k, "m"] = score + (emit[k, x] if x < 20 else 0.0), (*origin[:2], origin[2] + "m")
            score, origin = max(((at(i - 1, k, c)[0] + t[k], at(i - 1, k, c)[1]) for c, t in (("m", mi), ("i", ii))), key=lambda o: o[0])
            if origin:
                rows[i, k, "i"] = score, (*origin[:2], origin[2] + "i")
            if k:
                score, origin = max(((at(i, k - 1, c)[0] + t[k - 1], at(i, k - 1, c)[1]) for c, t in (("m", md), ("d", dd))), key=lambda o: o[0])
                if origin:
                    rows[i, k, "d"] = score, (*origin[:2], origin[2] + "d")
            if rows[i, k, "m"][0] > best[0]:
                best = rows[i, k, "m"][0], (i + 1, k + 1, rows[i, k, "m"][1])
    return best


def test_search_agrees_with_the_plain_recurrence():
    rng = np.random.default_rng(3)
    match = rng.dirichlet(np.ones(20) * 0.3, 14)
    trans = np.column_stack([*rng.dirichlet([8, 1, 1], 14).T, *rng.dirichlet([2, 1], 14).T, *rng.dirichlet([2, 1], 14).T])
    p = profiles.Profile("r_H", match, trans)
    seqs = [rng.integers(0, 21, n) for n in (1, 2, 9, 17, 25, 30)]
    for k in range(8):  # cut and stretched copies of the profile's best text
        own = match.argmax(axis=1).tolist()
        own[5 : 5 + k % 3] = []
        own[9:9] = rng.integers(0, 20, k % 4).tolist()
        seqs.append(np.array([*rng.integers(0, 20, 3), *own, *rng.integers(0, 20, 2)]))
    m = Model(p)
    bits, start, end, a, z, path = aligned(m, seqs)
    size = np.array([len(s) for s in seqs])
    nats = bits * np.log(2) - (np.log(size / (size + 3.0)) * size - np.log(size / (size + 1.0)) * size + np.log(3.0 / (size + 3.0)) - np.log(1.0 / (size + 1.0)))
    for k, s in enumerate(seqs):
        score, (e, last, (first, state, kinds)) = plain_viterbi(p, s.tolist())
        assert abs(score - nats[k]) < 1e-9 and (start[k], end[k], a[k], z[k], path[k]) == (first, e, state + 1, last, kinds)
    assert np.allclose(scores(m, seqs), bits, atol=1e-3) and any("d" in x for x in path)


def test_sql_functions(spark):
    from seqloom.functions.registry import register

    assert len(register(spark)) == 9
    r = spark.sql("SELECT seq_clean('ac-t.g'), seq_is_dna('ACGN'), seq_is_dna('ACE'), seq_is_protein('MK*'), seq_reverse_complement('ACGU?'), profile_species('a_b_C'), profile_chain('a_b_C'), chain_class('K'), spans_overlap(0, 5, 5, 9), position_label(111, 'A'), position_label(1, ' ')").first()
    assert tuple(r) == ("ACTG", True, False, True, "NACGT", "a", "b_C", "L", False, "111A", "1")
    df = spark.createDataFrame([("ac-t",), (None,)], "s string")
    df.createOrReplaceTempView("seqs")
    assert {x[0] for x in spark.sql("SELECT seq_clean(s) FROM seqs").collect()} == {"ACT", None}
