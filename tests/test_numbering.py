"""Numbering kernels and schemes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions.labels import allowed_chains, scope_ranges
from seqloom.numbering.kernels import fill_gaps, number, smooth, state_sequence, state_vector, stitch, symmetric_labels
from seqloom.numbering.tables import LETTERS, NAMES, SCHEMES, Symmetric, blosum62, cdr_ranges, chain_class, resolve_scheme, scheme_for

SEQ = "".join("ACDEFGHIKLMNPQRSTVWY"[i % 20] for i in range(300))


def plain(skip=(), extra=None):
    """A vector of matches over 1..128, without some states and with insertions behind others."""
    out, at = [], 0
    for s in range(1, 129):
        if s in skip:
            out.append((s, "d", None))
        else:
            out.append((s, "m", at))
            at += 1
        for _ in range((extra or {}).get(s, 0)):
            out.append((s, "i", at))
            at += 1
    return out


def labels(scheme, chain, vector):
    return [f"{p}{i.strip()}" for (p, i), aa in number(scheme, chain, vector, SEQ)[0] if aa != "-"]


def test_cdr3_of_24_residues():
    got = [f"{p}{i.strip()}" for (p, i), _ in symmetric_labels(Symmetric(105, 117, 117), 24)]
    assert got == [*map(str, range(105, 112)), "111A", "111B", "111C", "111D", "111E", "112F", "112E", "112D", "112C", "112B", "112A", *map(str, range(112, 118))]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 13, 14, 15])
def test_symmetric_keeps_all_residues(n):
    got = symmetric_labels(Symmetric(105, 117, 117), n)
    assert sum(filled for _, filled in got) == n and len(got) == max(n, 13)


@pytest.mark.parametrize(("scheme", "chain", "first", "last", "size"), [
    ("imgt", "H", "1", "128", 128), ("chothia", "H", "1", "113", 128), ("chothia", "L", "1", "108", 128), ("kabat", "H", "1", "113", 128), ("kabat", "K", "1", "108", 128),
    ("martin", "H", "1", "113", 128), ("aho", "A", "1", "149", 128), ("wolfguy", "H", "101", "411", 128), ("wolfguy", "L", "501", "811", 128),
])
def test_full_length(scheme, chain, first, last, size):
    got = labels(scheme, chain, plain())
    assert (got[0], got[-1], len(got)) == (first, last, size)


def test_imgt_deletions_and_insertions():
    got = labels("imgt", "H", plain(skip=(10, 31, 32, 33, 34, 60, 61, 73)))
    assert "10" not in got and "73" not in got and {"27", "28", "35", "38"} - set(got) == set()
    got = labels("imgt", "H", plain(extra={111: 3}))
    assert [x for x in got if x.startswith(("111", "112"))] == ["111", "111A", "112B", "112A", "112"]


def test_chothia_heavy_loops():
    # 13 states of CDR3 with one dropped residue each: lengths by deletion order
    base = plain(skip=(10, 31, 32, 33, 34, 60, 61, 73))
    got = labels("chothia", "H", base)
    assert [x for x in got if 95 <= int("".join(c for c in x if c.isdigit())) <= 102] == ["95", "96", "97", "98", "99", "100", "100A", "100B", "100C", "101", "102"]
    # a lone residue of the first loop keeps the front label
    assert [x for x in labels("chothia", "H", plain(skip=range(24, 38))) if 22 < int(x.strip("ABCDEFGH")) < 34] == ["23"]
    assert "52A" in labels("chothia", "H", plain(skip=(10, 73)))


def test_kabat_light_letters_on_27():
    got = labels("kabat", "K", plain(skip=(58, 59, 60, 61, 62, 63, 64, 73, 81, 82)))
    assert [x for x in got if x.startswith("27")] == ["27", "27A", "27B", "27C", "27D", "27E", "27F"]


def test_martin_second_loop_needs_framework_insertions():
    v = plain(skip=(10, 60, 61))
    assert labels("martin", "H", v) != labels("chothia", "H", v)


def test_too_many_insertions_leave_no_numbering():
    got = number("imgt", "H", plain(extra={70: 30}), SEQ)
    assert got[0] == [] and got[1] == 0
    assert number("chothia", "H", plain(extra={110: 40}), SEQ)[0] == []
    assert number("aho", "H", plain(extra={110: 60}), SEQ)[0] == []


def test_aho_takes_one_more_residue_behind_148():
    vector = [v for v in plain() if v[0] < 128]
    rows, _, last = number("aho", "H", vector, SEQ)
    assert rows[-1] == ((149, " "), SEQ[127]) and last == 127
    assert number("aho", "H", vector, SEQ[:127])[0][-1][0] == (148, " ")


def test_uncovered_chains_are_dropped():
    assert number("kabat", "A", plain(), SEQ) is None and number("imgt", "A", plain(), SEQ) is not None


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(NAMES), st.sampled_from("HKL"), st.sets(st.integers(1, 128), max_size=40), st.dictionaries(st.sampled_from([27, 30, 38, 56, 60, 65, 105, 110, 111, 117]), st.integers(0, 12), max_size=3))
def test_residues_keep_their_order(scheme, chain, skip, extra):
    vector = plain(skip, extra)
    rows, first, last = number(scheme, chain, vector, SEQ)
    got = "".join(aa for _, aa in rows if aa != "-")
    if rows:
        seated = [s[2] for s in smooth(vector) if s[2] is not None]
        assert got in ("".join(SEQ[i] for i in seated), "".join(SEQ[i] for i in seated) + (SEQ[last] if last is not None else ""))
        positions = [p for (p, _), _ in rows]
        assert scheme == "wolfguy" or all(a <= b for a, b in zip(positions, positions[1:])) or len(set(rows)) == len(rows)


def test_vector_reaches_out():
    path = [(s, "m") for s in range(4, 126)]
    v = state_vector(path, 3, 125, 4, 125, 200)
    assert v[0] == (1, "m", 0) and v[-1] == (128, "m", 127)
    assert state_vector(path, 1, 123, 4, 125, 200)[0] == (3, "m", 0)
    assert state_vector(path, 3, 125, 4, 125, 200, 1, 2) == [(s, "m", s - 1) for s in range(4, 126)]


def test_stitch():
    v = [(s, "m", s - 100) for s in range(100, 105)] + [(110, "m", 5)]
    j = [(117, "m", 20), (118, "m", 21), (126, "m", 22)]
    got = stitch(v, j)
    assert got[5:16] == [(105 + k, "m", 5 + k) for k in range(11)] and got[16:20] == [(116, "i", 16 + k) for k in range(4)] and got[20:] == j
    assert stitch(v[:3], j) == v[:3]


def test_small_pieces():
    assert fill_gaps([((2, " "), "A"), ((4, " "), "C")]) == [((1, " "), "-"), ((2, " "), "A"), ((3, " "), "-"), ((4, " "), "C")]
    assert state_sequence([(1, "m", 0), (2, "i", 1), (3, "d", None), (128, "m", 2)], "acd") == "A" + "-" * 126 + "D"
    assert [resolve_scheme(x) for x in ("IMGT", "c", "x")] == ["imgt", "chothia", None]
    assert [chain_class(c) for c in "HKLA?"] == ["H", "L", "L", "A", "H"]
    assert blosum62("W", "W") == 11 and blosum62("A", "R") == -1 == blosum62("X", "X") and blosum62("X", "A") == 0 and blosum62("P", "X") == -2 and blosum62("Z", "B") == 1
    assert LETTERS[25:28] == ["Z", "AA", "BB"] and len(SCHEMES) == 8
    assert scheme_for("martin", "L") is scheme_for("chothia", "K")
    assert cdr_ranges("aho", "G")[0] == (25, 42) and cdr_ranges("none", "H") == ()
    assert allowed_chains("tr", "imgt") == ["A", "B", "G", "D"] and allowed_chains("g", "kabat") == ["H", "K", "L"]
    assert scope_ranges("full", "imgt", "H") is None and scope_ranges("x", "imgt", "H") == [] and len(scope_ranges("cdrs", "kabat", "L")) == 3
