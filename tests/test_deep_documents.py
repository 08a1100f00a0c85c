"""Payloads nested deeper than the interpreter's limit."""

import json

import numpy as np
import pytest

from seqloom.operators.flatten import json_tables, link_json, parsed

DEEP = "[" * 300_000 + "]" * 300_000


def test_deep_payload_keeps_its_rows(spark):
    body = '"domains": [{"stop_positions": [4, 9], "numbering": [{"position": 1, "insertion": "A"}, {"insertion": " "}]}, null, {"stop_positions": 3}]'
    rows = [(1, f'{{"extra": {DEEP}, {body}}}'), (2, f"{{{body}}}"), (3, f'{{"extra": {DEEP[:-1]}, {body}}}'), (4, f'{{{body}, "extra": {"[" * 70 + "]" * 70}}}')]
    got = {}
    for r in link_json(spark.createDataFrame(rows, "doc_no bigint, payload string")).collect():
        got.setdefault(r.parent_no, set()).add(tuple(r)[1:])
    assert got.keys() == {1, 2, 4} and got[1] == got[2] == got[4] and len(got[1]) == 6
    t = {name: sorted(tuple(r) for r in df.collect()) for name, df in json_tables(spark.createDataFrame(rows, "doc_no bigint, payload string")).items()}
    assert t["numbering"] == [(k, 0, n, *v) for k in (1, 2, 4) for n, v in enumerate([(1, "A", None), (None, " ", None)])]
    assert t["stop_positions"] == [(k, *x) for k in (1, 2, 4) for x in ((0, 0, 4), (0, 1, 9), (2, 0, 3))]
    assert [r[:2] for r in t["domains"]] == [(k, d) for k in (1, 2, 4) for d in (0, 2)] and [r[0] for r in t["documents"]] == [1, 2, 4]


@pytest.mark.parametrize("seed", range(10))
def test_same_texts_are_json(seed):
    r = np.random.default_rng(seed)
    pieces = ['{"a": 1', "}", "[", "]", ",", ":", '"b"', "1e5", "-0", "01", "true", "null", "NaN", " ", "\n", '"x\\u00e9"', '{"a": [1, {"b": null}]}', "[]", "{}"]
    for _ in range(2000):
        text = "".join(pieces[k] for k in r.integers(0, len(pieces), r.integers(1, 7)))
        try:
            want = json.loads(text, parse_float=str, parse_int=str, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
        except ValueError:
            with pytest.raises(ValueError):
                parsed(text)
        else:
            assert parsed(text) == want
