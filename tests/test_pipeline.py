"""The whole pipeline on the smallest tables, its options, and its streaming form."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.plans import pipeline
from seqloom.plans.catalog import queries, sql
from seqloom.runtime import Scratch, maybe_broadcast, scratch_root, table
from seqloom.sources.profiles import from_germlines
from seqloom.streaming import number_stream as N


@pytest.fixture(scope="module")
def inputs(spark, sf):
    g = table(spark, sf, "germlines")
    r = table(spark, sf, "numbering_results").select(F.col("result_no").alias("key"), "id", "sequence", "input_type", "domains")
    return r, from_germlines(g), g


def test_numbered_documents_agree_with_stored_ones(spark, inputs):
    r, p, g = inputs
    few = r.filter("key <= 30")
    docs = pipeline.number_sequences(few.drop("domains"), p, g, threshold=60.0).collect()
    assert len(docs) == few.count() and all(d.domains is not None for d in docs)
    stored = {x.key: x.domains for x in few.collect()}
    same = total = 0
    for d in docs:
        for x in d.domains:
            known = [y for y in stored[d.key] or [] if y is not None and y.seq_start == x.seq_start]
            total += 1
            same += any(y.chain_type == x.chain_type and y.species == x.species and y.translation_frame == x.translation_frame for y in known)
            assert [c.amino_acid for c in x.numbering if c.amino_acid != "-"] and x.scheme == "imgt"
            assert (x.nt_start is None) == (x.translation_frame == "")
    assert total >= 15 and same >= 0.7 * total


def test_bad_records_stay(spark, inputs):
    _, p, g = inputs
    rows = [(1, "a", None, "protein"), (2, "b", "", None), (3, "c", "JJJ", "protein"), (4, "d", "AC", "dna"), (5, None, "M" * 12_000, "protein")]
    df = spark.createDataFrame(rows, "key long, id string, sequence string, input_type string")
    got = pipeline.number_sequences(df, p[:2], g).collect()
    assert sorted(r.key for r in got) == [1, 2, 3, 4, 5] and all(r.domains == [] for r in got)
    with pytest.raises(ValueError):
        pipeline.number_sequences(df, p[:2], g, scheme="none")
    assert pipeline.parse_input_type(" DNA ") == "dna" and pipeline.parse_input_type(None) == "protein"


def planted(g, loop="ARDYW", chain="H"):
    """A domain of the first species' genes of a chain with a given third loop."""
    row = lambda s: g.filter((F.col("segment") == s) & (F.col("chain_type") == chain)).orderBy("species_ordinal", "gene_ordinal").first().aligned_seq
    v, j = row("V"), row("J")
    return v[:106].replace("-", "") + loop + j[116:].replace("-", "")


def test_planted_domain_is_found_in_each_frame(spark, inputs):
    _, p, g = inputs
    codon = {}
    for c, aa in S.CODONS.items():
        codon.setdefault(aa, c)
    protein = planted(g)
    dna = "".join(codon[a] for a in protein)
    back = dna[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(1, "+1", dna, "dna"), (2, "+3", "GC" + dna + "A", "DNA "), (3, "-2", back + "T", "dna"), (4, "", "mk-" + protein[:40].lower() + ".." + protein[40:], None), (5, "+1", dna.replace("T", "U"), "dna")]
    df = spark.createDataFrame(rows, "key long, id string, sequence string, input_type string")
    found = {d.key: d for d in pipeline.number_sequences(df, p, g, threshold=60.0).collect()}
    for key, frame, *_ in rows:
        (d,) = found[key].domains
        assert d.translation_frame == frame and d.chain_type == "H" and "".join(c.amino_acid for c in d.numbering if c.amino_acid != "-") in protein
        assert (d.nt_start is None) == (key == 4) and d.seq_end - d.seq_start == sum(c.amino_acid != "-" for c in d.numbering)
        if key != 4:
            cut = found[key].sequence[d.nt_start : d.nt_end].replace("U", "T")
            cut = cut[::-1].translate(str.maketrans("ACGT", "TGCA")) if frame[0] == "-" else cut
            assert cut in dna and len(cut) == 3 * (d.seq_end - d.seq_start)


def test_j_region_behind_a_long_loop_is_rescued(spark, inputs):
    _, p, g = inputs
    loop = "PEDRAGSYNTEKDPGSREQANSTPDGKERSANPQTEDGSKRNAEPQ"
    df = spark.createDataFrame([(1, "x", planted(g, loop), "protein")], "key long, id string, sequence string, input_type string")
    last = lambda **o: [d.numbering[-1].position for d in pipeline.numbered_domains(df, p, g, threshold=60.0, **o).collect()]
    (cut,), (whole,) = last(rescue=False), last()
    assert cut < 120 and whole >= 126


def test_totals_are_counted_in_passing(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "key long, domains array<int>")
    docs, seen = pipeline.with_totals(df)
    assert docs.count() == 3 and seen.get == {"sequences": 3, "domains": 2, "without_domain": 2}


def test_restricted_chains_and_schemes(spark, inputs):
    r, p, g = inputs
    few = r.filter("key <= 12").drop("domains")
    heavy = pipeline.numbered_domains(few, p, g, scheme="kabat", threshold=60.0, restrict="heavy").collect()
    assert heavy and {x.chain_type for x in heavy} == {"H"} and {x.scheme for x in heavy} == {"kabat"}


def test_stream_of_lines(spark, sf, tmp_path):
    lines = table(spark, sf, "raw_records")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    lines.repartition(2).write.parquet(src)
    stream = N.line_stream(spark, src, lines.schema)
    good, bad = N.checked(stream)
    q = N.number_stream(good, lambda b: N.translated(b, "line_no"), out, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out + "/*").select("line_no").distinct().count() > 0
    w = bad.writeStream.format("memory").queryName("bad_lines").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("bad_lines").count() == queries()["p4_found"](spark, sf).count()


def test_stream_of_redeliveries(spark, sf, tmp_path):
    hits = table(spark, sf, "viterbi_hits").select("hit_no", F.col("loaded_at").cast("timestamp").alias("loaded_at"))
    src = str(tmp_path / "src")
    hits.coalesce(1).write.parquet(src)
    s = spark.readStream.schema(hits.schema).parquet(src)
    for name, df, mode in (("once", N.without_redeliveries(s, ["hit_no"], delay="1000 days"), "append"), ("days", N.arrivals(s, delay="1000 days"), "complete")):
        q = df.writeStream.format("memory").outputMode(mode).queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == hits.select("hit_no").distinct().count()
    assert spark.table("days").agg(F.sum("n")).first()[0] == hits.count()


def test_scratch(spark):
    s = Scratch(spark, "test")
    t = s.table(spark.range(10))
    assert t.count() == 10 and t._seqloom_path.startswith(scratch_root(spark))
    s.drop(t)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "ResolvedHint" in plan(maybe_broadcast(spark.range(5), 5)) and "ResolvedHint" not in plan(maybe_broadcast(spark.range(5), 10**9))


def test_queries_are_complete():
    assert set(sql()) <= set(queries())


@pytest.mark.parametrize("name", ["numbering_wolfguy", "wide_positions", "line_reports", "json_documents", "aligned_codons", "identity_order"])
def test_queries_without_sql_run(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_api(spark, inputs):
    from seqloom import api

    _, p, g = inputs
    assert api.available_schemes()[0] == "imgt" and api.num_profiles(p) == len(p) and "human" in api.available_species(g)
    assert api.parse_species('[" Human ", ""]') == ["human"] and api.parse_species("oops") is None is api.parse_species("[]")
    r = api.records_of(spark, ">a b\nMK-T\n>c\nLV\n")
    assert [(x.key, x.id, x.sequence) for x in r.collect()] == [(1, "a b", "MKT"), (2, "c", "LV")]
    assert api.number_sequences(r, p[:1], g, scheme="nothing").count() == 0


def test_matrix(spark):
    from seqloom import api
    from tests_support import domain_struct

    rows = [(1, "a", [domain_struct("H", "ACDE"), domain_struct("H", "ACDF")]), (2, 'b,"', [domain_struct("H", "WWWW"), domain_struct("L", "A")])]
    df = spark.createDataFrame(rows, "key long, id string, domains array<struct<chain_class string, numbering array<struct<position int, insertion string, amino_acid string>>>>")
    got = {(r.chain_class, r.place): r.line for r in api.compute_pim(df).collect()}
    assert [(r.class_no, r.line) for r in api.compute_pim(df).filter("place < 0").orderBy("class_no", "place").collect()] == [(0, "# Chain: H | Scope: Full sequence | Scheme: imgt | N=3"), (0, ',a,a_H2,"b,"""'), (1, ""), (1, "# Chain: L | Scope: Full sequence | Scheme: imgt | N=1"), (1, ',"b,"""')]
    assert {k: v for k, v in got.items() if k[1] >= 0} == {("H", 0): "a,100.00,75.00,0.00", ("H", 1): "a_H2,75.00,100.00,0.00", ("H", 2): '"b,""",0.00,0.00,100.00', ("L", 0): '"b,""",100.00'}
    assert api.compute_pim(df, scope="cdr1").count() == 0 == api.compute_pim(df, scope="x").count()
