"""Leaked passages, mixes and languages."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import languages as G
from seqloom.llm import leaks as L
from seqloom.llm import mixing as M

DOCS = "doc_id long, text string, lang string, source string, item_id long, edits int, label string, tokens long"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, *more, *[None] * (6 - len(more))) for k, t, *more in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(k, t, "clash") for k, t in rows], "item_id long, text string, doc_id string")


def brute_leaks(documents, held_out, n=12):
    out = set()
    for i, t in held_out:
        w = L.words(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, text, *_ in documents:
            x = L.words(text)
            if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                out.add((d, i))
    return out


def leak_case(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    held = [(k, " ".join(rng.choices(words, k=rng.randint(5, 60)))) for k in range(30)]
    rows = []
    for k in range(200):
        text = rng.choices(words, k=rng.randint(0, 80))
        if k % 3 == 0:
            src = rng.choice(held)[1].split()
            a = rng.randrange(max(1, len(src) - 8))
            text[len(text) // 2 : len(text) // 2] = src[a : a + rng.randint(8, 30)]
        if k % 7 == 0:
            text = [w.upper() + ",\n" for w in text]
        rows.append((k, " ".join(text)))
    return rows + [(900, None), (901, ""), (902, " ".join(words) * 40), (903, held[3][1].replace("w", "w​")), (903, held[3][1])], held


@pytest.mark.parametrize("block", [L.BLOCK_WINDOWS, 60])
def test_verbatim_passages(spark, block):
    rows, held = leak_case()
    got = L.find_leaks(docs(spark, rows), items(spark, held), block_windows=block).filter("edits = 0")
    want = brute_leaks(rows, held)
    assert len(want) > 20
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_edited_passages_reach_the_recall(spark):
    rng = random.Random(4)
    words = [f"v{k}" for k in range(5000)]
    held = [(k, " ".join(rng.choices(words, k=12))) for k in range(200)]
    rows = []
    for k, t in held:
        w = t.split()
        w[rng.randrange(12)] = "changed"
        rows.append((k, "before it " + " ".join(w) + " behind it"))
    got = {(r.doc_id, r.item_id): r.edits for r in L.find_leaks(docs(spark, rows), items(spark, held)).collect()}
    assert all(d == i and e == 1 for (d, i), e in got.items())
    assert len(got) >= 0.9 * len(held)
    assert L.expected_recall(1, L.tables_for(1)) >= L.RECALL


def test_an_unreachable_recall_is_refused():
    with pytest.raises(ValueError, match="tables"):
        L.tables_for(6, 0.999)


@pytest.mark.parametrize("edits", [1, 2])
def test_recall_on_real_windows(spark, sf, edits):
    """Windows of the held-out items themselves, edited: most of them are found again."""
    held = [(r.item_id, L.words(r.text)) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()]
    rng = random.Random(5)
    vocabulary = [w for _, t in held for w in t]
    cut = [(k, w[at : at + 12]) for k, w in held if len(w) >= 14 for at in (rng.randrange(len(w) - 12),)]
    texts = []
    for _, window in cut:
        w = list(window)
        for _ in range(edits):
            at, what = rng.randrange(1, len(w) - 1), rng.randrange(3)
            w[at : at + (what != 1)] = [] if what == 2 else [rng.choice(vocabulary)]
        texts.append(" ".join([*rng.choices(vocabulary, k=5), *w, *rng.choices(vocabulary, k=5)]))
    index = L.ItemIndex([k for k, _ in cut], [" ".join(w) for _, w in cut], L.Embedding(repetitions=L.tables_for(edits)))
    rows, window, _ = index.matches(texts, L._Hasher(), edits)
    found = {int(r) for r, i in zip(rows, index.item[window]) if i == cut[r][0]}
    assert len(cut) > 100 and len(found) >= 0.9 * len(cut)


def test_joined_items_agree_with_broadcast_ones(spark):
    rows, held = leak_case()
    rows = [r for r in rows if r[0] != 903] + [(None, held[4][1])]
    with_ = lambda b: {tuple(r) for r in L.find_leaks(docs(spark, rows), items(spark, held), block_windows=b).collect()}
    got = with_(60)
    assert got == with_(L.BLOCK_WINDOWS) and any(r[2] for r in got)


def test_edit_distance():
    a = np.array([[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]])
    b = np.array([[1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6, 7], [1, 9, 3, 8, 5, 7]])
    assert L.edit_distance(a, b, 2).tolist() == [0, 2, 3]
    assert L.edit_distance(a, b, 3).tolist() == [0, 2, 3]


def test_no_leaks_in_nothing(spark):
    rows, held = leak_case()
    assert L.find_leaks(docs(spark, []), items(spark, held)).count() == 0
    assert L.find_leaks(docs(spark, rows), items(spark, [])).count() == 0
    assert L.find_leaks(docs(spark, rows), items(spark, [(1, None), (2, "too short"), (None, held[0][1])])).count() == 0


def test_words():
    assert L.words("A​b, c_d-É2 İx") == ["ab", "c", "d", "é2", "i̇x"] and L.words(None) == []


@pytest.mark.parametrize("seed", range(6))
def test_budgets_are_filled_best(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(np.arange(3, 60), 6, replace=False)
    counts = rng.integers(1, 5, 6)
    total = int((lengths * counts).sum())
    reach = {0}
    for l, c in zip(lengths, counts):
        reach = {s + int(l) * k for s in reach for k in range(c + 1)}
    for budget in (0, 2, total // 3, total // 2, total, total + 5):
        take = M.fill_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * lengths).sum())
        assert got == max(s for s in reach if s <= budget)


def test_many_small_budgets_against_brute_force():
    rng = np.random.default_rng(9)
    assert int((M.fill_budget([4, 51], [2, 3], 102) * [4, 51]).sum()) == 102
    for _ in range(3000):
        n = int(rng.integers(1, 6))
        lengths, counts = rng.choice(np.arange(1, 70), n, replace=False), rng.integers(0, 7, n)
        reach = {0}
        for l, c in zip(lengths, counts):
            reach = {s + int(l) * k for s in reach for k in range(c + 1)}
        budget = int(rng.integers(0, max(1, int((lengths * counts).sum())) + 3))
        take = M.fill_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * lengths).sum()) == max(s for s in reach if s <= budget)


def test_large_budgets_are_exact():
    lengths = np.arange(20, 900)
    counts = np.full(len(lengths), 50)
    budget = int((lengths * counts).sum()) // 3 + 17
    assert int((M.fill_budget(lengths, counts, budget) * lengths).sum()) == budget


def test_mix(spark):
    rng = random.Random(8)
    rows = []
    for k in range(900):
        source = ["Alpha", " alpha", "be-ta", "BE_TA", "gamma", None, "other"][rng.choices(range(7), [40, 10, 10, 10, 2, 4, 4])[0]]
        rows.append((k if k % 50 else None, " ".join(["word"] * rng.randint(1, 40)), "en", source))
    rows += [(5000, None, "en", "alpha"), (5001, "", "en", "alpha")]
    targets = spark.createDataFrame([("alpha", 0.3, 1), ("be_ta", 0.25, 3), ("gamma", 0.2, 2), ("none", 0.2, 4), ("other", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = M.Mix(docs(spark, rows), targets)
    chosen = mix.documents.collect()
    shares = {r.source: r for r in mix.shares().collect()}
    used = defaultdict(int)
    for r in chosen:
        used[r.source] += r.tokens * r.copies
        assert 1 <= r.copies <= {"alpha": 1, "be_ta": 3, "gamma": 2}[r.source]
    assert len({r.doc_id for r in chosen if r.doc_id is not None}) == len([r for r in chosen if r.doc_id is not None])
    for source, row in shares.items():
        assert row.used_tokens == used.get(source, 0)
        assert abs(row.actual_share - row.used_tokens / mix.total) < 1e-12
    assert shares["alpha"].met and shares["be_ta"].met and not shares["gamma"].met and not shares["none"].met
    assert shares["be_ta"].documents and any(r.copies > 1 for r in chosen)
    again = {(r.doc_id, r.copies) for r in M.Mix(docs(spark, rows[::-1]), targets).documents.collect() if r.doc_id is not None}
    assert again == {(r.doc_id, r.copies) for r in chosen if r.doc_id is not None}


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 2)], "source string, target_share double, max_repeats int")
    mix = M.Mix(docs(spark, []), targets)
    assert mix.total == 0 and mix.documents.count() == 0
    assert [r.used_tokens for r in mix.shares().collect()] == [0]


@pytest.fixture(scope="module")
def samples(spark):
    return [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").collect()]


def test_held_out_accuracy(samples):
    rng = np.random.default_rng(0)
    order = rng.permutation(len(samples))
    train, test = [samples[k] for k in order[:140]], [samples[k] for k in order[140:]]
    model = G.Discriminator([(a, G.prose_words(b)) for a, b in train])
    lang, sure = model.judge([G.prose_words(t) for _, t in test])
    right = np.array([G.LANGUAGES[k] == a for k, (a, _) in zip(lang, test)])
    assert right.mean() >= 0.9 and sure[right].mean() > 0.6


def test_case_and_accents_do_not_matter(samples):
    model = G.Discriminator([(a, G.prose_words(b)) for a, b in samples])
    for change in (str.upper, str.lower, G.plain):
        lang, _ = model.judge([G.prose_words(change(t)) for _, t in samples])
        assert np.mean([G.LANGUAGES[k] == a for k, (a, _) in zip(lang, samples)]) > 0.97


def test_stretches_of_documents(spark, samples):
    by = defaultdict(list)
    for a, t in samples:
        by[a].append(t)
    fasta = ">clone1\n" + "ACGT" * 15 + "\nACGTACG\n\n"
    rows = [
        (1, " ".join(by["de"][:3]) + "\n" + " ".join(by["fr"][:2]) + " " + " ".join(by["de"][3:5]), "de"),
        (2, " ".join(by["en"][:3]), "EN_us"), (3, " ".join(by["en"][:3]), "de"), (4, " ".join(by["sv"][:2]), None), (5, " ".join(by["nl"][:2]), "nld"),
        (6, fasta, None), (7, "Too short here.", None), (8, None, None), (9, "", ""), (10, fasta + " ".join(by["it"][:3]) + "\n" + fasta, "??"),
        (11, " ".join(by["pt"]) * 300, "por"), (12, by["es"][0][:-1] + ' ("germline call of the trace viewer"). ' + by["es"][1], "es"),
    ]
    found = G.label_languages(docs(spark, rows), spark.createDataFrame(samples, "lang string, text string"))
    got = defaultdict(list)
    for r in found.orderBy("doc_id", "seg_no").collect():
        assert 0.5 <= r.confidence <= 1 and r.start < r.end
        got[r.doc_id].append(r.lang)
    assert got == {1: ["de", "fr", "de"], 2: ["en"], 3: ["en"], 4: ["sv"], 5: ["nl"], 10: ["it"], 11: ["pt"], 12: ["es"]}
    assert {(r.doc_id) for r in G.wrong_labels(found).collect()} == {1, 3, 4, 10}


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("de", "DE", "de_AT", "deu", "xx", "", None, "ger-x", " pt-BR ")], "l string")
    assert [r[0] for r in df.select(G.named_language(F.col("l"))).collect()] == ["de", "de", "de", "de", None, None, None, "de", "pt"]


def test_languages_of_nothing(spark, samples):
    s = spark.createDataFrame(samples, "lang string, text string")
    assert G.label_languages(docs(spark, []), s).count() == 0


def test_texts_that_repeat_one_word(spark):
    same = " ".join(["again"] * 3000)
    got = L.find_leaks(docs(spark, [(1, same), (2, "again and again")]), items(spark, [(7, same), (8, " ".join(["again"] * 12)), (9, "again")])).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(1, 7, 0), (1, 8, 0)}
