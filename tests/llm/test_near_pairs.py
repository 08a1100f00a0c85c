"""The set join against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import near_pairs as N

ROWS = "result_no long, sequence string, v array<string>, c string, s string, mask string, genes string"


def norm(s):
    return "".join(c for c in (s or "").upper() if "A" <= c <= "Z" or c == "*")


def brute(rows, t=0.5, q=6, least=20):
    sets = {}
    for k, s, v, *_ in rows:
        s = norm(s)
        if k is not None and len(s) >= least:
            genes = {"".join((x or "").split("*")[0].upper().split()) for x in v or []} - {""}
            sets[k] = ({s[i : i + q] for i in range(len(s) - q + 1)}, genes)
    keys, out = sorted(sets), set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x[0] & y[0])
            if both >= t * len(x[0] | y[0]) and (not x[1] or not y[1] or x[1] & y[1]):
                out.add((a, b))
    return out


def edited(rng, s, n, letters):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        what = rng.randrange(4)
        if what == 0:
            s[k] = rng.choice(letters)
        elif what == 1:
            del s[k]
        elif what == 2:
            s.insert(k, rng.choice(letters))
        else:
            j = rng.randrange(len(s))
            cut = s[k : k + 15]
            del s[k : k + 15]
            s[j:j] = cut
    return "".join(s)


def family(seed=5, n=160):
    rng = random.Random(seed)
    protein, dna, rows, k = "ACDEFGHIKLMNPQRSTVWY", "ACGT", [], 0
    for g in range(n // 4):
        letters, size = (protein, rng.randint(20, 160)) if g % 2 else (dna, rng.randint(60, 500))
        base = "".join(rng.choice(letters) for _ in range(size))
        for _ in range(4):
            k += 1
            genes = [None, [], ["IGHV1-1*01"], [" ighv1-1*02", None], ["IGHV2"], ["IGHV2*01", "IGHV9"]][rng.randrange(6)]
            s = edited(rng, base, rng.randrange(0, 3 + size // 25), letters) if rng.random() < 0.8 else base
            rows.append((k, s.lower() if rng.random() < 0.2 else s.replace("A", "A-", 2), genes, "clash", "x", "y", "z"))
    return rows


def pairs(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    return {tuple(r) for r in N.NearPairs(df, "result_no", "sequence", F.col("v"), **options).pairs().collect()}


def test_families(spark):
    rows = family()
    want = brute(rows)
    assert len(want) > 50
    assert pairs(spark, rows) == want


def test_small_parts_and_mixed_alphabets(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 50)
    monkeypatch.setattr(N, "PACK_ENTRIES", 500)
    rng = random.Random(3)
    rows = family(9, 60)
    for g in range(6):  # sequences between the alphabets
        base = "".join(rng.choice("ACGT" if i % 3 else "ACDEFGHIKLMNPQRSTVWY") for i in range(200)) + "ACGTACGGTTACGATCCAGT" * 3
        rows += [(1000 + 10 * g + j, edited(rng, base, j * 2, "ACGT"), None, "", "", "", "") for j in range(4)]
    assert pairs(spark, rows, part_entries=300) == brute(rows)


def test_copies_and_edges(spark):
    long = "".join(random.Random(1).choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60_000))
    rows = [
        (1, "MKTAYIAKQRQISFVKSHFSRQ", ["A"], "", "", "", ""),
        (2, "mktayiakqrqisfvkshfsrq", None, "", "", "", ""),
        (3, "MKTAYIAKQRQISFVKSHFSRQ", ["B"], "", "", "", ""),
        (4, "MKTAYIAKQRQISFVKSHFSR", ["A"], "", "", "", ""),
        (5, None, None, "", "", "", ""), (6, "", None, "", "", "", ""), (7, "SHORT", None, "", "", "", ""), (None, "MKTAYIAKQRQISFVKSHFSRQ", None, "", "", "", ""),
        (8, "A" * 30, None, "", "", "", ""), (9, "A" * 40, None, "", "", "", ""), (10, long, None, "", "", "", ""), (11, long[:40_000], None, "", "", "", ""),
    ]
    assert pairs(spark, rows) == brute(rows)
    classes = {r.result_no: r for r in N.NearPairs(spark.createDataFrame(rows, ROWS), "result_no", "sequence", F.col("v")).classes().collect()}
    assert classes[1].class_id == classes[2].class_id == classes[3].class_id == 1 != classes[4].class_id
    assert classes[1].links == 2 and set(classes) == {1, 2, 3, 4, 8, 9, 10, 11}


def test_links_of_classes_are_those_of_the_pairs(spark):
    rows = family(6, 80)
    rows += [(2000 + k, rows[k % 9][1], [None, ["A"], ["B", "A*2"], ["B"], []][k % 5], *rows[0][3:]) for k in range(40)]
    near = N.NearPairs(spark.createDataFrame(rows, ROWS), "result_no", "sequence", F.col("v"))
    links = Counter(k for pair in brute(rows) for k in pair)
    assert {r.result_no: r.links for r in near.classes().collect()} == {r[0]: links[r[0]] for r in rows if len(norm(r[1])) >= 20}
    near.close()


def test_pair_between_the_routes(spark):
    """Two thirds of one set's grams and one third of the other's are nucleotide, at exactly the threshold."""
    rng = random.Random(0)
    letters = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    shared = letters("ACGT", 35) + letters("DEFHIKLMNPQRSVWY", 30)
    a, b = letters("ACGT", 30) + shared, shared + letters("DEFHIKLMNPQRSVWY", 30)
    sets = N.Sets(pa.array([a, b]), 6)
    assert sets.size.tolist() == [90, 90] and sets.plain_size.tolist() == [60, 30]
    rows = [(1, a, None, "", "", "", ""), (2, b, None, "", "", "", "")]
    assert pairs(spark, rows) == brute(rows) == {(1, 2)}


@pytest.mark.parametrize("exact", [False, True])
def test_long_lists_and_two_steps(spark, monkeypatch, exact):
    monkeypatch.setattr(N, "LIST_ENTRIES", 3)
    monkeypatch.setattr(N, "ONE_STEP", 3)
    monkeypatch.setattr(N, "PACK_ENTRIES", 4000)
    rows = family(11, 80)
    base = rows[4][1]
    rng = random.Random(1)
    rows += [(3000 + k, edited(rng, base.upper(), k % 4, "ACDEFGHIKL"), None, "", "", "", "") for k in range(20)]
    assert pairs(spark, rows, part_entries=400, exact=exact) == brute(rows)


def test_nothing(spark):
    assert N.NearPairs(spark.createDataFrame([], ROWS), "result_no", "sequence", F.col("v")).pairs().count() == 0
    assert pairs(spark, [(1, "A" * 5, None, "", "", "", "")]) == set()


def test_blocks_survive_packing():
    rng = np.random.default_rng(0)
    ids, mask, size = rng.integers(-(2**62), 2**62, 50), rng.integers(-(2**62), 2**62, 50), rng.integers(1, 500, 50)
    token, row = rng.integers(0, 1 << 41, 300).astype(np.uint64), rng.integers(0, 50, 300)
    pos, kind = rng.integers(0, 400, 300), rng.integers(0, 3, 300).astype(np.uint8)
    t, i, s, p, k, m = N._unpack(N._pack(ids, mask, size, token, row, pos, kind))
    o = np.argsort(token, kind="stable")
    assert (t == token[o]).all() and (i == ids[row[o]]).all() and (s == size[row[o]]).all() and (p == pos[o]).all() and (k == kind[o]).all() and (m == mask[row[o]]).all()


def test_recall_of_the_bands():
    assert N.miss_probability(0.5) < 5e-4 and N.miss_probability(0.6) < 1e-7
    rng = random.Random(2)
    met = total = 0
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(400))
        b = edited(rng, a, 20, "ACGT")
        s = N.Sets(pa.array([a, b]), 6)
        x, y = set(s.gram[s.row == 0].tolist()), set(s.gram[s.row == 1].tolist())
        if len(x & y) >= 0.5 * len(x | y):
            keys = N.signatures(s, np.array([0, 1]))
            total += 1
            met += (keys[0] == keys[1]).sum() >= N.MEETINGS
    assert total > 20 and met == total


def test_sets_are_exact():
    texts = ["ACGTACGTAC", "AAAAAAAAAA", "AC*DEFGHIK", "", "ACGTA"]
    s = N.Sets(pa.array(texts), 6)
    for k, t in enumerate(texts):
        assert s.size[k] == len({t[i : i + 6] for i in range(len(t) - 5)})


@pytest.mark.parametrize(("a", "b"), [(10, 20), (11, 20), (30, 30)])
def test_needed_overlap(a, b):
    need = int(N._needed(np.array([a]), np.array([b]), 0.5)[0])
    assert need / (a + b - need) >= 0.5 > (need - 1) / (a + b - need + 1)
