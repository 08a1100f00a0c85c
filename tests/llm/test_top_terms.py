"""Top items and term counts against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import term_counts as T
from seqloom.llm.top_bands import _without, top_n

HITS = "hmm_name string, bit_score double, hit_no long, g string, band int, rank_no int"


def brute_top(rows, n):
    groups = defaultdict(set)
    for name, score, hit, *_ in rows:
        if name is not None and score is not None and not math.isnan(score):
            groups[name].add((-score, hit is None, hit if hit is not None else 0))
    return {(g, k + 1, None if missing else hit) for g, s in groups.items() for k, (_, missing, hit) in enumerate(sorted(s)[:n])}


def rows_with_everything(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        name = "hot" if rng.random() < 0.34 else f"p{rng.integers(200)}" if rng.random() < 0.98 else None
        score = [None, float("nan"), float(rng.integers(6)), float(rng.random() * 50)][rng.choice(4, p=[0.02, 0.02, 0.4, 0.56])]
        rows.append((name, score, int(i) if rng.random() < 0.99 else None, "clash", 1, 2))
    return rows + rows[::7]


@pytest.mark.parametrize(("n", "limit"), [(10, 1 << 20), (3, 0), (1, 1 << 20)])
def test_top_n(spark, n, limit):
    rows = rows_with_everything()
    got = top_n(spark.createDataFrame(rows, HITS).repartition(5), "hmm_name", "bit_score", "hit_no", n, broadcast_bytes=limit)
    assert {(r.g, r.rank_no, r.i) for r in got.collect()} == brute_top(rows, n)


def test_top_n_of_equal_scores(spark):
    rows = [("a", 1.0, k, None, None, None) for k in range(500)]
    got = top_n(spark.createDataFrame(rows, HITS), "hmm_name", "bit_score", "hit_no", 10)
    assert sorted((r.rank_no, r.i) for r in got.collect()) == [(k + 1, k) for k in range(10)]


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], HITS)
    assert top_n(df, "hmm_name", "bit_score", "hit_no").count() == 0
    none = spark.createDataFrame([(None, 1.0, 1, "", 0, 0), ("a", None, 2, "", 0, 0), ("a", float("nan"), 3, "", 0, 0)], HITS)
    assert top_n(none, "hmm_name", "bit_score", "hit_no").count() == 0


def test_salted_anti_join(spark):
    rows = spark.range(1000).select(F.concat(F.lit("g"), F.col("id") % 10).alias("g"), F.col("id").alias("i"), F.col("id").cast("double").alias("s"))
    groups = spark.createDataFrame([("g1",), ("g2",)], "g string")
    assert _without(rows, groups, 2, 10, 0).select("g").distinct().count() == 8


DOMAINS = "dom_no long, result_no long, v_gene string, j_gene string, chain_type string, term string, f int"


def brute_terms(rows):
    seen = set()
    for dom, rec, *names in rows:
        for f, value in zip(("v_gene", "j_gene", "chain_type"), names):
            for x in (value or "").replace(";", ",").replace("|", ",").split(","):
                x = x.strip().upper()
                if x and x != "-":
                    seen.add((f, x, rec, dom))
    occ, rec = Counter((f, x) for f, x, *_ in seen), defaultdict(set)
    for f, x, r, _ in seen:
        rec[f, x] |= {r} - {None}
    return {(f, x, n, len(rec[f, x])) for (f, x), n in occ.items()}


def domain_rows(n=2500, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [None, "", "-", " ighv1 ", f"IGHV{rng.integers(400)}*01", "a,b;c|a", "é,ß"][rng.choice(7, p=[0.05, 0.05, 0.05, 0.3, 0.4, 0.1, 0.05])]
        rows.append((i if rng.random() < 0.98 else None, int(rng.integers(n // 3)) if rng.random() < 0.98 else None, v, f"J{rng.integers(5)}", "H" if rng.random() < 0.6 else "k", "clash", 1))
    return rows + rows[::9]


@pytest.mark.parametrize("by_sort", [False, True])
@pytest.mark.parametrize("partition_rows", [T.PARTITION_ROWS, 300, 40])
def test_term_counts(spark, partition_rows, by_sort):
    rows = domain_rows()
    got = T.term_counts(spark.createDataFrame(rows, DOMAINS).repartition(3), ["v_gene", "j_gene", "chain_type"], "result_no", "dom_no", partition_rows, spill_by_sort=by_sort)
    want = {(f, x.replace("ß", "SS"), n, r) for f, x, n, r in brute_terms([r[:5] for r in rows])}
    assert {tuple(r) for r in got.collect()} == want


def test_partitions_are_split_again(spark):
    df = spark.createDataFrame(domain_rows(), DOMAINS)
    rows = T.explode_terms(df, ["v_gene", "j_gene", "chain_type"], "result_no", "dom_no")
    _, n, _ = T.plan_partitions(rows, 40)
    _, few, rounds = T.plan_partitions(rows, 10**9)
    assert n > 20 and few == 1 and rounds == 1


def test_oversized_bucket_of_many_terms_goes_a_level_deeper(spark, monkeypatch):
    monkeypatch.setattr(T, "FIRST_BITS", 1)
    rows = [(i, i, f"V{i}", "J", "H", "", 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOMAINS)
    _, _, rounds = T.plan_partitions(T.explode_terms(df, ["v_gene"], "result_no", "dom_no"), 20)
    assert rounds >= 2
    got = T.term_counts(df, ["v_gene", "j_gene"], "result_no", "dom_no", 20)
    assert {tuple(r) for r in got.collect()} == brute_terms([(a, b, v, j, None) for a, b, v, j, *_ in rows])


def test_terms_of_nothing(spark):
    df = spark.createDataFrame([], DOMAINS)
    assert T.term_counts(df, ["v_gene"], "result_no", "dom_no").count() == 0
    df = spark.createDataFrame([(1, 1, "x" * 200_000, None, "-", "", 0)], DOMAINS)
    got = T.term_counts(df, ["v_gene", "j_gene", "chain_type"], "result_no", "dom_no").collect()
    assert len(got) == 1 and len(got[0].term) == 200_000


def test_marks(spark):
    df = spark.createDataFrame([("v", "a", 9, 2), ("v", "b", 9, 3), ("v", "c", 9, 11), ("v", "d", 9, 10)], "field_name string, term string, occurrences long, records long")
    got = {r.term: r.mark for r in T.marked_terms(df, 100).collect()}
    assert got == {"a": "rare", "b": None, "c": "common", "d": None}


def test_aggregation_spills(spark, tmp_path):
    df = spark.range(400_000).select(F.col("id").alias("dom_no"), (F.col("id") % 99_991).alias("result_no"), F.concat(F.lit("a long enough name of a gene "), F.sha2(F.col("id").cast("string"), 256)).alias("v_gene"))
    got = T.term_counts(df, ["v_gene"], "result_no", "dom_no", 10**9, memory="60MB").agg(F.count("*"), F.sum("occurrences"), F.sum("records")).first()
    assert tuple(got) == (400_000, 400_000, 400_000)


def test_runs_end_with_a_term():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(-50, 50, 1000))
    batches = [pa.RecordBatch.from_arrays([pa.array(h[k : k + 64])] * 5, names=list("abcde")) for k in range(0, 1000, 64)]
    runs = [np.concatenate([b.column(4).to_numpy() for b in run]) for run in T._runs(iter(batches), 100)]
    assert len(runs) > 5 and np.concatenate(runs).tolist() == h.tolist()
    assert all(a[-1] < b[0] for a, b in zip(runs, runs[1:])) and all(len(r) >= 100 for r in runs[:-1])


def test_spill_folder_follows_the_file_system(spark):
    assert T._local("hdfs://nn/x") is None and T._local("s3a://b/x") is None and T._local("file:/a%20b/c") == "/a b/c"
    assert T.qualified(spark, "/somewhere").startswith("file:")


def test_hot_term_without_records_is_split(spark):
    df = spark.range(5000).select(F.col("id").alias("dom_no"), F.lit(None).cast("bigint").alias("result_no"), F.lit("hot").alias("v_gene"))
    part, n, _ = T.plan_partitions(T.explode_terms(df, ["v_gene"], "result_no", "dom_no"), 500)
    sizes = [r[1] for r in T.explode_terms(df, ["v_gene"], "result_no", "dom_no").groupBy(part.alias("p")).agg(F.count("*")).collect()]
    assert n <= 11 and len(sizes) == 10 and max(sizes) < 700
    assert [tuple(r) for r in T.term_counts(df, ["v_gene"], "result_no", "dom_no", 500).collect()] == [("v_gene", "HOT", 5000, 0)]
