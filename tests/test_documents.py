"""Nested documents and unreadable lines, against plain one-record readers."""

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.operators import json_index
from seqloom.operators.flatten import TABLES, child_tables, json_tables, link_json, link_typed
from seqloom.operators.json_index import JsonIndex
from seqloom.operators.rejects import judge, loaded_lines, rejected_lines
from seqloom.operators.spans import chunks, expand, ranks, text_buffers


def index(*texts):
    return JsonIndex(*text_buffers(pa.array(list(texts), pa.string())))


def strict(text):
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except (ValueError, RecursionError):
        return False


GOOD = ["{}", "[]", "0", "-1.5e+3", '"a"', "null", " true ", '{"a":[1,{"b":null}],"c":"x,y]"}', '"\\u00e9\\\\\\""', "[[],{},[{}]]", '{"a":1,"a":2}', '[ "\\\\" , "{" ]']
BAD = ["", " ", "{", "}", "[1,]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "01", "1.", "tru", '"a', '"\\x"', '"\\u12g4"', "{]", "[}", '{"a":1}}', "1 2", '["a" "b"]', "{1:2}", "NaN", "[,1]", '"\t"', "\\", '{"a":"b"']


@pytest.mark.parametrize("text", GOOD + BAD)
def test_validity_alone(text):
    assert index(text).valid.tolist() == [strict(text)] == [text in GOOD]


def test_validity_does_not_depend_on_neighbours():
    texts = [x for pair in zip(GOOD, BAD) for x in pair] + BAD + GOOD[::-1]
    assert index(*texts).valid.tolist() == [strict(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='{}[]:,"\\ 10en-.u\n', max_size=12), max_size=6))
def test_validity_of_noise(texts):
    assert index(*texts).valid.tolist() == [strict(t) for t in texts]


_json = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from(["domains", "numbering", "stop_positions", "insertion", "x"]), c, max_size=4), max_leaves=30)


def brute(doc):
    many = lambda x: [] if x is None else x if isinstance(x, list) else [x]
    out = []
    for p, d in enumerate(many(doc.get("domains") if isinstance(doc, dict) else None)):
        if d is None:
            continue
        out.append((p, "domain", 0))
        if isinstance(d, dict):
            out += [(p, "stop", k) for k, _ in enumerate(many(d.get("stop_positions")))]
            for k, r in enumerate(many(d.get("numbering"))):
                if isinstance(r, dict) and r.get("insertion") is not None and str(r["insertion"]).strip():
                    out.append((p, "residue", k))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(_json, min_size=1, max_size=4), st.sampled_from([None, 1]), st.booleans())
def test_links_of_any_json(docs, indent, ascii_only):
    from seqloom.operators.flatten import _json_links

    texts = [json.dumps(d, indent=indent, ensure_ascii=ascii_only) for d in docs]
    got = {k: [] for k in range(len(docs))}
    for b in _json_links(pa.array(range(len(docs))), pa.array(texts)):
        for no, p, item, k in zip(*(c.to_pylist() for c in b.columns)):
            got[no].append((p, item, k))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(d) for k, d in enumerate(docs)}


def shown(x):
    return None if x is None else x if isinstance(x, str) else json.loads(json.dumps(x), parse_float=str, parse_int=str) if isinstance(x, (int, float)) and not isinstance(x, bool) else json.dumps(x)


def brute_values(doc, name):
    many = lambda x: [] if x is None else x if isinstance(x, list) else [x]
    of = lambda x: tuple(shown(x.get(f)) if isinstance(x, dict) else None for f in TABLES[name][1])
    if name == "documents":
        return [of(doc)] if isinstance(doc, dict) else []
    domains = [(p, d) for p, d in enumerate(many(doc.get("domains") if isinstance(doc, dict) else None)) if d is not None]
    if name == "domains":
        return [(p, *of(d)) for p, d in domains]
    return [(p, k, *(of(x) if name == "numbering" else (shown(x),))) for p, d in domains if isinstance(d, dict) for k, x in enumerate(many(d.get(name)))]


_fields = st.sampled_from(["domains", "numbering", "stop_positions", "insertion", "position", "amino_acid", "v_gene", "id", "sequence"])
_nested = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(_fields, c, max_size=5), max_leaves=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(_nested, min_size=1, max_size=4), st.booleans(), st.sampled_from(sorted(TABLES)))
def test_values_of_any_json(docs, ascii_only, name):
    from seqloom.operators.flatten import _json_values

    places, fields = TABLES[name]
    schema = pa.schema([("parent_no", pa.int64()), *((p, pa.int32()) for p in places), *((c, pa.string()) for c in fields)])
    texts = [json.dumps(d, ensure_ascii=ascii_only) for d in docs]
    got = sorted((r for b in _json_values(pa.array(range(len(docs))), pa.array(texts), name, schema) for r in zip(*(c.to_pylist() for c in b.columns))), key=str)
    want = [(k, *r) for k, d in enumerate(docs) for r in brute_values(d, name)]
    same = lambda rows: [tuple(x if not isinstance(x, str) or not x.startswith(("[", "{")) else json.loads(x) for x in r) for r in rows]
    if ascii_only:
        assert same(got) == same(sorted(want, key=str))
    assert len(got) == len(want)


def test_values_have_types(spark):
    rows = [(1, '{"id": "a\\u0041", "domains": [{"bit_score": "12.5", "seq_start": 3, "seq_end": "x", "v_gene": null}, null, {"stop_positions": "7", "numbering": {"position": "4", "insertion": "A"}}]}'), (2, "{"), (None, "{}")]
    t = json_tables(spark.createDataFrame(rows, "doc_no long, payload string"))
    assert [(r.parent_no, r.domain_pos, r.bit_score, r.seq_start, r.seq_end, r.v_gene) for r in t["domains"].orderBy("domain_pos").collect()] == [(1, 0, 12.5, 3, None, None), (1, 2, None, None, None, None)]
    assert [tuple(r) for r in t["numbering"].collect()] == [(1, 2, 0, 4, "A", None)] and [tuple(r) for r in t["stop_positions"].collect()] == [(1, 2, 0, 7)]
    assert sorted((r.parent_no or 0, r.id) for r in t["documents"].collect()) == [(0, None), (1, "aA")]
    assert all(x.count() == 0 for x in json_tables(spark.createDataFrame([], "doc_no long, payload string")).values())


def test_deep_nesting_takes_the_slow_path():
    deep = '{"domains":[{"stop_positions":[1,2],"x":' + "[" * 100 + "]" * 100 + "}]}"
    i = index("{}", deep, "{}")
    assert i.deep.tolist() == [False, True, False]
    from seqloom.operators.flatten import _json_links

    rows = [r for b in _json_links(pa.array([7, 8, 9]), pa.array(["{}", deep, "{}"])) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(rows) == [(8, 0, "domain", 0), (8, 0, "stop", 0), (8, 0, "stop", 1)]
    assert json_index.MAX_LEVELS < 100


def test_json_rows_in_spark(spark):
    rows = [
        (1, '{"domains": {"numbering": {"insertion": "A"}, "stop_positions": 4}}', "x"),
        (2, '{"domains": [null, {"numbering": [{"insertion": " "}, {"insertion": ""}, {"insertion": null}, {"insertion": "\\u0041"}]}]}', "y"),
        (3, None, None),
        (4, "", "z"),
        (5, '{"domains": [', "z"),
        (None, '{"dom\\u0061ins": [{}]}', "z"),
        (6, "[1, 2]", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_no long, payload string, item string")
    got = sorted((tuple(r) for r in link_json(df).collect()), key=str)
    want = [(1, 0, "domain", 0), (1, 0, "stop", 0), (1, 0, "residue", 0), (2, 1, "domain", 0), (2, 1, "residue", 3), (None, 0, "domain", 0)]
    assert got == sorted(want, key=str)
    assert link_json(df.limit(0)).count() == 0


TYPED = "result_no long, domains array<struct<domain_index int, result_no string, stop_positions array<int>, numbering array<struct<position int, insertion string, amino_acid string>>>>, item_pos string"


def test_typed_rows_keep_their_parent(spark):
    num = [(1, " ", "A"), (1, "A", "C"), (2, None, "D"), (2, "", "E"), (3, "B", "F")]
    rows = [(1, [(0, "a", [5, None], num), None, (2, "b", None, None)], "c"), (2, [], "c"), (3, None, None), (None, [(0, "x", [], [])], "d")]
    df = spark.createDataFrame(rows, TYPED)
    got = sorted((tuple(r) for r in link_typed(df).collect()), key=str)
    want = [(1, 0, "domain", 0), (1, 2, "domain", 0), (1, 0, "stop", 0), (1, 0, "stop", 1), (1, 0, "residue", 1), (1, 0, "residue", 4), (None, 0, "domain", 0)]
    assert got == sorted(want, key=str)
    assert link_typed(df.limit(0)).count() == 0
    tables = child_tables(df)
    assert tables["domains"].columns == ["result_no", "domain_pos", "domain_index", "domain_result_no"]
    assert tables["numbering"].count() == 5 and tables["stop_positions"].count() == 2


def machine(line):
    """One character at a time."""
    line = line or ""
    if line.endswith("\r"):
        line = line[:-1]
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return "broken_quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] != '"':
                        break
                    j += 1
                text += line[j]
                j += 1
            j += 1
            if j < len(line) and line[j] != ",":
                return "broken_quoting"
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            text = line[i:j]
            if '"' in text:
                return "broken_quoting"
        fields.append(text)
        if j >= len(line):
            break
        i = j + 1
    if len(fields) != 5:
        return "column_count"
    kind = fields[2].strip().lower()
    if kind not in ("dna", "protein"):
        return "bad_input_type"
    s = fields[1].strip().replace("-", "").replace(".", "").upper()
    letters = set("ACGTUNRYKMSWBDHV" if kind == "dna" else "ACDEFGHIKLMNPQRSTVWYX*")
    if not s or not set(s) <= letters or len(s) >= (100_000 if kind == "dna" else 10_000):
        return "bad_sequence"
    return None


NAMES = ["broken_quoting", "column_count", "bad_input_type", "bad_sequence", None]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='",a\r \n', max_size=14) | st.builds(lambda a, b, c: f"{a},{b},{c},x,1", st.sampled_from(["i", '"i,j"', '"q""q"', 'a"b']), st.sampled_from(["AC-GT", '" acgt."', "", "J", '"A"" "', "é"]), st.sampled_from(["dna", " Protein", '"DNA"', "rna"])), max_size=8))
def test_lines_of_noise(lines):
    reason, *_ = judge(pa.array(lines, pa.string()))
    assert [NAMES[r] for r in reason] == [machine(x) for x in lines]


def test_lines_in_spark(spark):
    long_ok, long_bad = "A" * 99_999, "A" * 100_000
    rows = [(1, "a,acgt,dna,,", "x"), (2, None, "x"), (3, "", None), (4, f"b,{long_ok},dna,pig,1.5\r", "x"), (5, f"b,{long_bad},dna,,", "x"), (6, '"c,""d""",M-K.,PROTEIN ,"co,w",x', "x"), (None, "q", "x"), (7, "a,acgt,dna,,", "x")]
    df = spark.createDataFrame(rows, "line_no long, raw_line string, reason string")
    assert {(r[0], r[1]) for r in rejected_lines(df).collect()} == {(2, "column_count"), (3, "column_count"), (5, "bad_sequence"), (None, "column_count")}
    good = {r.line_no: r for r in loaded_lines(df).collect()}
    assert set(good) == {1, 4, 6, 7} and good[4].bit_score == 1.5 and len(good[4].sequence) == 99_999
    assert (good[6].id, good[6].sequence, good[6].input_type, good[6].species, good[6].bit_score) == ('c,"d"', "MK", "protein", "co,w", None)
    assert rejected_lines(df.limit(0)).count() == 0 and loaded_lines(df.limit(0)).count() == 0


def test_span_helpers():
    assert expand(np.array([5, 1]), np.array([2, 3])).tolist() == [5, 6, 1, 2, 3]
    assert ranks(np.array([1, 1, 2, 2, 2])).tolist() == [0, 1, 0, 1, 2]
    assert list(chunks(pa.array(["aa", "b" * 9, "", "c"]), 4)) == [(0, 1), (1, 2), (2, 4)]
