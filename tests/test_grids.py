"""Byte grids, state texts and numbering over batches, with nulls, odd letters and empty tables."""

import numpy as np
import pyarrow as pa

from seqloom.numbering.kernels import number, state_sequence, state_vector
from seqloom.numbering.udf import number_domains
from seqloom.operators.positions import grid_texts, state_texts_of

STATES = "k long, x string, numbering array<struct<position int, insertion string, amino_acid string>>"
DOMAINS = (
    "key long, part int, domain_index int, n_domains int, model_length int, seq_start int, seq_end int, hmm_start int, hmm_end int, path {path}, sequence string, chain_type string, bit_score double"
)


def test_grid_of_any_letters():
    row, at = np.array([0, 0, 2, 2]), np.array([1, 3, 0, 0])
    assert grid_texts(3, 4, row, at, pa.array(["A", None, "C", "D"])).to_pylist() == ["-A--", "----", "D---"]
    assert grid_texts(3, 4, row, at, pa.array(["Ä", "XY", "C", "D"])).to_pylist() == ["-Ä-XY", "----", "D---"]
    assert grid_texts(0, 4, row[:0], at[:0], pa.array([], pa.string())).to_pylist() == []


def test_state_texts(spark):
    rows = [
        (1, "a", [(1, " ", "M"), (1, "", "K"), (3, "A", "C"), (128, None, "W"), (129, " ", "Y"), (None, " ", "Y"), (5, " ", None)]),
        (2, "b", []), (3, "c", None), (4, "d", [(0, " ", "A")]), (None, None, [(2, "  ", "A"), None]),
    ]
    got = {r.k: (r.x, r.state_sequence) for r in state_texts_of(spark.createDataFrame(rows, STATES), "k", "x").collect()}
    assert got == {1: ("a", "M" + "-" * 126 + "W"), None: (None, "-A" + "-" * 126)}
    assert state_texts_of(spark.createDataFrame([], STATES), "k").count() == 0


def plain(skip, extra):
    """(path, number of residues) of matches over 1..128 with deletions and insertions."""
    path = []
    for s in range(1, 129):
        path.append((s, "d" if s in skip else "m"))
        path += [(s, "i")] * extra.get(s, 0)
    return path, sum(k != "d" for _, k in path)


def test_batches_agree_with_single_domains(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for k in range(60):
        first, last = int(rng.integers(1, 8)), int(rng.integers(118, 129))
        path, _ = plain(set(rng.choice(np.arange(first + 1, last), rng.integers(0, 9), replace=False).tolist()), {int(s): int(rng.integers(1, 5)) for s in rng.choice(np.arange(first, last), 2)})
        path = [p for p in path if first <= p[0] <= last]
        n = sum(x != "d" for _, x in path)
        front, behind = int(rng.integers(0, 6)), int(rng.integers(0, 9))
        seq = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWYX"), front + n + behind))
        chain = "HKLABGD"[k % 7]
        index, of = (0, 1) if k % 2 else (1, 2)
        rows.append((k, -1, index, of, 127 + k % 2, front, front + n, first, last, path, seq, chain, 1.0))
        vector = state_vector(path, front, front + n, first, last, len(seq), index, of, 127 + k % 2)
        for scheme in ("imgt", "chothia", "aho", "wolfguy"):
            found = number(scheme, chain, vector, seq)
            if found is not None:
                cells, a, b = found
                want[scheme, k] = ([(p, i, aa) for (p, i), aa in cells], a if a is not None else front, b + 1 if b is not None else front + n, state_sequence(vector, seq))
    stored = spark.createDataFrame(rows, DOMAINS.format(path="array<struct<state int, kind string>>"))
    texts = spark.createDataFrame([(*r[:9], "".join(k for _, k in r[9]), *r[10:]) for r in rows], DOMAINS.format(path="string"))
    for scheme in ("imgt", "chothia", "aho", "wolfguy"):
        for df in (stored, texts):
            got = {(scheme, r.key): ([tuple(c) for c in r.numbering], r.seq_start, r.seq_end, r.state_sequence) for r in number_domains(df, scheme).collect()}
            assert got == {x: w for x, w in want.items() if x[0] == scheme}


def test_odd_domains(spark):
    path, n = plain((), {})
    text = "".join("ACDEFGHIKLMNPQRSTVWY"[k % 20] for k in range(n))
    base = (0, 1, 128, 0, n, 1, 128)
    kinds = "".join(k for _, k in path)
    rows = [
        (1, -1, *base, kinds, "é" + text[1:], "H", 0.0), (2, -1, *base, kinds, None, "H", 0.0), (3, -1, *base, None, text, "H", 0.0), (4, -1, *base, kinds, text, "?", 0.0), (5, -1, *base, kinds, text, None, 0.0),
        (6, -1, *base, "d" * 128, "", "H", 0.0),
    ]
    df = spark.createDataFrame(rows, DOMAINS.format(path="string"))
    got = {r.key: r for r in number_domains(df, "imgt").collect()}
    assert set(got) == {1, 4, 6} and got[1].numbering[0].amino_acid == "é" and len(got[4].numbering) == 128
    assert got[6].state_sequence == "-" * 128 and all(c.amino_acid == "-" for c in got[6].numbering)
    assert {r.key for r in number_domains(df, "kabat").collect()} == {1, 6}
    assert number_domains(df.limit(0), "aho").count() == 0


def test_label_columns(spark):
    from seqloom.operators.positions import label_columns

    rows = [(1, "a", [(1, " ", "M"), (1, "", "K"), (3, "A", None), (9, None, "W"), (None, " ", "Y")]), (2, "b", []), (3, None, None)]
    df = spark.createDataFrame(rows, STATES)
    got = {r[0]: tuple(r)[1:] for r in label_columns(df, ["1", "3A", "7", "9"], "k", "x").collect()}
    assert got == {1: ("a", "M", "-", "-", "W"), 2: ("b", "-", "-", "-", "-"), 3: (None, "-", "-", "-", "-")}
    assert label_columns(df.limit(0), ["1"], "k").count() == 0 and label_columns(df, [], "k").count() == 3
