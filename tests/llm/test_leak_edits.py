"""Passages with a word inserted, removed or replaced are leaks as well."""

import numpy as np
import pytest

from seqloom.llm.leaks import Embedding, ItemIndex, _Hasher, edit_distance, tables_for


@pytest.mark.parametrize("edit", ["replace", "insert", "remove"])
@pytest.mark.parametrize("after", [0, 1, 5])
def test_recall_after_verification(edit, after):
    r = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    items = [word(12) for _ in range(400)]
    docs = []
    for x in items:
        at = int(r.integers(2, 10))
        passage = {"replace": [*x[:at], *word(1), *x[at + 1 :]], "insert": [*x[:at], *word(1), *x[at:]], "remove": [*x[:at], *x[at + 1 :]]}[edit]
        docs.append(" ".join([*word(4), *passage, *word(after)]))
    index = ItemIndex(list(range(400)), [" ".join(x) for x in items], Embedding(repetitions=tables_for(1)))
    rows, window, edits = index.matches(docs, _Hasher(), 1)
    own = rows == index.item[window]
    assert own.all() and (edits == 1).all() and len(set(rows)) >= 0.9 * 400


def test_span_distance():
    a = np.arange(1, 13, dtype=np.uint64)[None]
    span = lambda *x: np.array([x], np.uint64)
    d = lambda b: int(edit_distance(a, b, 1)[0])
    assert d(span(*range(1, 13), 99)) == 0 and d(span(*range(1, 7), 50, *range(7, 13))) == 1
    assert d(span(*range(1, 7), *range(8, 13), 98, 99)) == 1 and d(span(*range(1, 7), *range(8, 13), 0, 0)) == 1
    assert d(span(*range(1, 6), *range(8, 13), 97, 98, 99)) == 2
