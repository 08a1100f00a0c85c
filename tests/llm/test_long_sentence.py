"""A sentence of more distinct words than the table holds counts as a whole."""

import numpy as np

from seqloom.llm import languages as G


def test_long_sentence_is_judged_whole(monkeypatch):
    d = G.Discriminator.__new__(G.Discriminator)
    pairs = [(a, b) for k, a in enumerate(G.LANGUAGES) for b in G.LANGUAGES[k + 1 :]]
    d.pairs = pairs
    d.weights = np.random.default_rng(0).normal(size=(G.DIMENSIONS + 1, len(pairs) + 1)).astype(np.float32)
    d._rows = G._WordRows(d.weights)
    long = [f"first{chr(97 + k % 26)}{k}" for k in range(40)] + [f"other{chr(97 + k % 26)}{k}" for k in range(90)]
    want, sure = d.judge([long, long[:3]])
    d._rows.clear()
    monkeypatch.setattr(G, "WORDS_KEPT", 16)
    got, still = d.judge([long, long[:3]])
    assert got.tolist() == want.tolist() and np.allclose(sure, still, atol=1e-4)
    assert not np.allclose(sure[0], d.judge([long[:8]])[1], atol=1e-4)
