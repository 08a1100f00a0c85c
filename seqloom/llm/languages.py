"""The language of every stretch of a document, by hierarchical linear discrimination.

A first linear SVM tells the language family, then one-versus-one linear SVMs separate the
languages within it.  Features are letter n-grams (1 to 4, with word edges) and whole words,
lower-cased and without accents, so that case and missing accents do not matter.  A
sentence's score is the mean over its words, and words repeat: each distinct word is scored
once per task and kept, sentences are sums over rows of that table.

The classifiers are fitted on at most ``MAX_SAMPLES`` labelled samples.  A second fit adds
sentences of at most ``MAX_LABELLED`` labelled documents (a sample by hash) whose label the
first fit confirms, up to ``MAX_SENTENCES`` distinct ones a language, the least certain
first; so it learns the corpus's own phrases.  Everything else runs over all documents, each on its own in one map stage: sequence blocks, tokens with
digits and quoted terms are set aside, sentences are judged, sentences too short or too
uncertain join their neighbours, and equal neighbours form a stretch.

Defined results: a text with fewer than ``MIN_WORDS`` words of prose (null and empty ones
too) has no stretch; a label in another spelling (case, region, three-letter code) still
names its language; an unknown, empty or null label names none.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The languages by family, and their three-letter codes.
FAMILIES = {"germanic": ("en", "de", "nl", "sv"), "romance": ("fr", "es", "pt", "it")}
CODES = {"eng": "en", "deu": "de", "ger": "de", "nld": "nl", "dut": "nl", "swe": "sv", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it"}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)

MAX_SAMPLES, DIMENSIONS, MIN_WORDS = 20_000, 1 << 15, 8
#: Labelled documents that a second fit may draw on, and distinct sentences of each language that it takes from them.
MAX_LABELLED, MAX_SENTENCES = 6_000, 200
#: Longest text, in characters, that either fit draws on (judging reads all texts whole).
MAX_SAMPLE_CHARS = 10_000
#: A sentence below this many words or this confidence takes its neighbour's language.
SURE_WORDS, SURE = 3, 0.55
WORDS_KEPT = 300_000
STRETCHES = "doc_id bigint, label string, seg_no int, lang string, confidence double, start int, `end` int, segments int"

_SEQUENCE_LINE = re.compile(r"^>[^\n]*(?:\n[A-Za-z*.\-]+[ \t\r]*$)*|^[A-Z*.\-]{25,}[ \t\r]*$", re.M)
_QUOTED = re.compile(r"[\"“”«»„][^\"“”«»„\n]{1,60}[\"“”«»„]|`[^`\n]{1,80}`")
_NO_PROSE = re.compile(r"(?<!\S)[^\s\d_*|>@/\\]*+[\d_*|>@/\\]\S*+|\b(?:[A-Z]{30,}|[A-Za-z]{40,})\b")
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?](?!\s|$)[^.!?\n]*)*[.!?\n]*")
_WORD = re.compile(r"[^\W\d_]+")


class _Plain(dict):
    """What each character turns into without accents."""

    def __missing__(self, code: int) -> str:
        text = unicodedata.normalize("NFD", chr(code).replace("ß", "ss"))
        out = self[code] = "".join(c for c in text if not unicodedata.combining(c))
        return out


_PLAIN = _Plain()


def plain(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else text.translate(_PLAIN)


def word_features(word: str) -> np.ndarray:
    """Hashed n-grams of one word."""
    w = f"^{word}$"
    grams = [w[i : i + n] for n in range(1, 5) for i in range(len(w) - n + 1)] + [w + "#"]
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % DIMENSIONS for g in grams])


def sample_features(words: list[str], known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a sample; ``known`` keeps the features of words."""
    found = []
    for w in words:
        f = known.get(w)
        if f is None:
            f = known[w] = word_features(w)
        found.append(f)
    size = np.array([len(f) for f in found])
    feature, place = np.unique(np.concatenate(found), return_inverse=True)
    return feature, np.bincount(place, weights=np.repeat(1 / (np.sqrt(size) * len(words)), size))


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, c: float = 100.0, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM, by dual coordinate descent."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(DIMENSIONS + 1), np.zeros(len(rows))
    rows = [(np.append(i, DIMENSIONS), np.append(v, 0.3)) for i, v in rows]
    norm = np.array([float(v @ v) for _, v in rows])
    for _ in range(rounds):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            g = sign[k] * float(w[i] @ v) - 1
            new = min(max(alpha[k] - g / norm[k], 0.0), c)
            step = new - alpha[k]
            if step:
                w[i] += step * sign[k] * v
                alpha[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    w[DIMENSIONS] *= 0.3
    return w


class _WordRows(dict):
    """The place in ``table`` of each word's row: its features' weights, added up."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.table = weights, np.zeros((1024, weights.shape[1]), np.float32)

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            raise OverflowError
        at = self[word] = len(self)
        if at >= len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        f = word_features(word)
        self.table[at] = self.weights[f].sum(axis=0) / np.sqrt(len(f))
        return at

    def __reduce__(self):
        return _WordRows, (self.weights,)


class Discriminator:
    """Family first, then pairs within it.  ``weights[:, 0]`` is the family, the rest are the pairs."""

    def __init__(self, samples: list[tuple[str, list[str]]]):
        rows, labels, known = [], [], {}
        for lang, words in samples:
            half = len(words) // 2
            for part in (words, words[:half], words[half:]):
                if len(part) >= 3:
                    rows.append(sample_features(part, known))
                    labels.append(lang)
        labels = np.array(labels)
        first, second = FAMILIES.values()
        self.pairs = [pair for family in FAMILIES.values() for pair in combinations(family, 2)]
        fitted = [fit_svm(rows, np.where(np.isin(labels, first), 1.0, -1.0))]
        for a, b in self.pairs:
            at = np.flatnonzero(np.isin(labels, (a, b)))
            fitted.append(fit_svm([rows[i] for i in at], np.where(labels[at] == a, 1.0, -1.0)))
        self.weights = np.stack(fitted, axis=1).astype(np.float32)
        self._rows = _WordRows(self.weights)

    def _sums(self, sentences: list[list[str]]) -> np.ndarray:
        """The words' rows of every sentence, added up."""
        if len(self._rows) + sum(map(len, sentences)) > WORDS_KEPT:
            self._rows.clear()
        try:
            at = list(map(self._rows.__getitem__, chain.from_iterable(sentences)))
        except OverflowError:  # more distinct words in one call than the table holds: halves
            if len(sentences) == 1:
                n = len(sentences[0]) // 2
                return self._sums([sentences[0][:n]]) + self._sums([sentences[0][n:]])
            half = len(sentences) // 2
            return np.concatenate((self._sums(sentences[:half]), self._sums(sentences[half:])))
        size = np.array([len(s) for s in sentences])
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        return np.add.reduceat(self._rows.table[at], first, axis=0)

    def judge(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(language index, confidence) of every sentence, given as plain words."""
        if not sentences:
            return np.zeros(0, np.int64), np.zeros(0)
        size = np.array([len(s) for s in sentences])
        f = self._sums(sentences) / size[:, None] + self.weights[DIMENSIONS]
        votes = np.zeros((len(sentences), len(LANGUAGES)))
        margin = np.full((len(sentences), len(LANGUAGES)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            i, j, m = LANGUAGES.index(a), LANGUAGES.index(b), f[:, k + 1]
            votes[:, i] += np.tanh(m) + (m > 0)
            votes[:, j] += np.tanh(-m) + (m <= 0)
            margin[:, i] = np.minimum(margin[:, i], m)
            margin[:, j] = np.minimum(margin[:, j], -m)
        n = len(FAMILIES["germanic"])
        germanic = f[:, 0] > 0
        votes[germanic, n:] = -np.inf
        votes[~germanic, :n] = -np.inf
        best = votes.argmax(axis=1)
        least = np.minimum(margin[np.arange(len(best)), best], np.abs(f[:, 0]))
        return best, 1 / (1 + np.exp(-3 * least))


def prose_words(text: str) -> list[str]:
    """Plain words without sequence blocks, tokens with digits and quoted terms."""
    return _WORD.findall(plain(_NO_PROSE.sub(" ", _QUOTED.sub(" ", _SEQUENCE_LINE.sub(" ", text)))))


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def sentences_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, plain words) of every sentence with prose."""
    clean = _NO_PROSE.sub(_blank, _QUOTED.sub(_blank, _SEQUENCE_LINE.sub(_blank, text)))
    out = []
    for m in _SENTENCE.finditer(clean):
        words = _WORD.findall(plain(m.group()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def stretches(sentences: list[tuple[int, int, list[str]]], lang: np.ndarray, sure: np.ndarray) -> list[tuple[str, float, int, int]]:
    """Runs of sentences in one language; unsure sentences join the run before them (the first ones the run after)."""
    size = np.array([len(w) for _, _, w in sentences])
    firm = (size >= SURE_WORDS) & (sure >= SURE)
    if not firm.any():
        firm[int((size * sure).argmax())] = True
    at = np.maximum.accumulate(np.where(firm, np.arange(len(firm)), -1))
    at[at < 0] = int(np.flatnonzero(firm)[0])
    lang = lang[at]
    cut = np.flatnonzero(np.concatenate(([True], lang[1:] != lang[:-1])))
    out = []
    for lo, hi in zip(cut, [*cut[1:], len(lang)]):
        own = firm[lo:hi]
        weight = size[lo:hi] * own
        out.append((LANGUAGES[lang[lo]], float((sure[lo:hi] * weight).sum() / weight.sum()), sentences[lo][0], sentences[hi - 1][1]))
    return out


def adapted(samples: list[tuple[str, str]], labelled: list[tuple[str, str]], max_sentences: int = MAX_SENTENCES) -> Discriminator:
    """Fit on the samples, then again with sentences of labelled documents that the first fit confirms."""
    base = [(lang, prose_words(text)) for lang, text in samples]
    first = Discriminator(base)
    found: dict[str, dict[tuple, float]] = {x: {} for x in LANGUAGES}
    for label, text in labelled:
        parts = sentences_of(text)
        if sum(len(w) for *_, w in parts) < MIN_WORDS:
            continue
        lang, sure = first.judge([w for *_, w in parts])
        runs = stretches(parts, lang, sure)
        if len(runs) == 1 and runs[0][0] == label:
            for (*_, w), s, g in zip(parts, sure, lang):
                if len(w) >= 5:
                    found[label].setdefault(tuple(w), float(s) if LANGUAGES[g] == label else -1.0)
    more = [(x, list(w)) for x, d in found.items() for w, _ in sorted(d.items(), key=lambda i: (i[1], i[0]))[:max_sentences]]
    return Discriminator(base + more) if more else first


def _run(model):
    def run(batches) -> Iterator[pa.RecordBatch]:
        judge = model.value
        for batch in batches:
            out = [[] for _ in range(8)]
            for at in range(0, batch.num_rows, 500):
                ids, texts, labels = (batch.column(k).slice(at, 500).to_pylist() for k in range(3))
                parts = [sentences_of(t) for t in texts]
                keep = [k for k, p in enumerate(parts) if sum(len(w) for *_, w in p) >= MIN_WORDS]
                lang, sure = judge.judge([w for k in keep for *_, w in parts[k]])
                pos = 0
                for k in keep:
                    n = len(parts[k])
                    found = stretches(parts[k], lang[pos : pos + n], sure[pos : pos + n])
                    pos += n
                    for seg, (name, conf, lo, hi) in enumerate(found):
                        for col, v in zip(out, (ids[k], labels[k], seg, name, conf, lo, hi, len(found))):
                            col.append(v)
            if out[0]:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "label", "seg_no", "lang", "confidence", "start", "end", "segments"])

    return run


def named_language(label: Column) -> Column:
    """The two-letter code that a label names, or null."""
    head = F.lower(F.regexp_extract(F.trim(label), "^([A-Za-z]+)(?:[-_].*)?$", 1))
    codes = F.create_map(*[F.lit(x) for pair in (CODES | {x: x for x in LANGUAGES}).items() for x in pair])
    return F.try_element_at(codes, head)


def label_languages(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", max_samples: int = MAX_SAMPLES, max_labelled: int = MAX_LABELLED, max_sentences: int = MAX_SENTENCES, max_sample_chars: int = MAX_SAMPLE_CHARS) -> DataFrame:
    """Every stretch of every document with language, confidence, character span and the document's label.

    The four bounds are about the samples that the classifiers are fitted on; all documents are judged whole.
    """
    spark = docs.sparkSession
    labelled = docs.select(named_language(F.col(label)).alias("lang"), F.col(text).alias("text"), F.col(key).alias("k")).filter("lang is not null and text is not null").filter(F.length("text") <= max_sample_chars)
    labelled = labelled.orderBy(F.xxhash64("k"), "k").limit(max_labelled).select("lang", "text").collect()
    rows = samples.select(named_language(F.col("lang")).alias("lang"), "text").filter("lang is not null and text is not null").filter(F.length("text") <= max_sample_chars).orderBy(F.xxhash64("text"), "text").limit(max_samples)
    model = spark.sparkContext.broadcast(adapted([tuple(r) for r in rows.collect()], [tuple(r) for r in labelled], max_sentences))
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter("text is not null")
    return texts.mapInArrow(_run(model), STRETCHES)


def wrong_labels(found: DataFrame) -> DataFrame:
    """Stretches of documents in several languages, or whose label does not name their only one."""
    return found.filter((F.col("segments") > 1) | ~F.coalesce(named_language(F.col("label")) == F.col("lang"), F.lit(False)))
