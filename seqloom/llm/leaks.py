"""Passages of held-out items inside a corpus: CGK embedding, bit-sampling LSH, exact verification.

Texts become sequences of word hashes.  Every window of ``window`` words, of items and of
documents alike, is embedded by a random walk (CGK: step j emits the current symbol and
moves on if a random bit of (j, symbol) says so), which turns edit distance between
windows into Hamming distance between walks.  Each table has a walk of its own and hashes a few
sampled positions of it; windows that meet in a table are verified exactly: word by
word for equality, then by the least edit distance, up to ``max_edits`` words, between the item's window and
the spans from the document window's start that are up to ``max_edits`` words shorter or longer.  Equal windows have
equal walks, so they meet in every table and are found with certainty; windows with edits
are found with at least the target recall, for which the number of tables is chosen.

The item windows are the stated query set; documents are cut, embedded and looked up in one
map stage.  Up to ``block_windows`` item windows travel to the tasks as a broadcast.  More of
them stay distributed: a filter of fixed size over their LSH keys is broadcast instead, and only
document windows that pass it are joined with the item windows by (table, key).

Defined results: null or short texts (fewer words than the window) match nothing; repeated
documents are reported one by one; texts of any length are read whole; a null item key or
document key is carried as null; empty tables give no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

WINDOW, MAX_EDITS = 12, 1
#: LSH: sampled walk positions of a table, steps of the walk per word, and the recall that the
#: number of tables is chosen for (at ``max_edits``; verbatim windows always meet).
SAMPLES, WALK, RECALL, MOST_TABLES = 3, 2, 0.93, 64
#: Item windows that are broadcast (each takes (window + 2 * repetitions) * 8 bytes); more are joined by their LSH keys.
BLOCK_WINDOWS = 100_000
#: Bits of the filter over the LSH keys of items that are joined.
FILTER_BITS = 27
#: Document windows that are embedded at a time.
STEP = 16_384

_WORD = re.compile(r"[^\W_]+")
MATCHES = "doc_id bigint, item_id bigint, edits int, windows bigint"


#: Invisible format characters.
_FORMAT = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased, after invisible format characters are dropped."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    if not _FORMAT.isdisjoint(text):
        text = "".join(c for c in text if c not in _FORMAT)
    if "İ" in text:  # its lower case holds a combining mark, which would split the word
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


class _Hasher(dict):
    """Hash of each word, kept while there are at most ``most`` of them; a call gives those of a text."""

    def __init__(self, most: int = 500_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        return h

    def __call__(self, text: str | None) -> list[int]:
        if len(self) > self.most:
            self.clear()
        return list(map(self.__getitem__, words(text)))


class Embedding:
    """One random walk a table, and the walk's sampled positions; all from one seed."""

    def __init__(self, window: int = WINDOW, repetitions: int = 1, samples: int = SAMPLES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.window, self.repetitions, steps = window, repetitions, WALK * window
        odd = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.moves = [odd(steps) for _ in range(repetitions)]
        self.factors = [dict(zip(sorted(rng.choice(steps, samples, replace=False).tolist()), odd(samples))) for _ in range(repetitions)]

    def keys(self, w: np.ndarray) -> np.ndarray:
        """LSH keys [n, repetitions] of windows [n, window] of word hashes."""
        n = len(w)
        flat = np.zeros((n, self.window + 1), np.uint64)
        flat[:, : self.window] = w
        flat = flat.ravel()
        begin = np.arange(n, dtype=np.int64) * (self.window + 1)
        out = np.zeros((self.repetitions, n), np.uint64)
        symbol, moved, shift = np.empty(n, np.uint64), np.empty(n, np.uint64), np.uint64(63)
        for r in range(self.repetitions):
            at = begin.copy()
            last = max(self.factors[r])
            for j in range(last + 1):
                np.take(flat, at, out=symbol)
                if j in self.factors[r]:
                    np.multiply(symbol, self.factors[r][j], out=moved)
                    out[r] += moved ^ (moved >> np.uint64(29))
                # the zero behind each window never moves on, so no walk leaves its window
                np.multiply(symbol, self.moves[r][j], out=moved)
                np.right_shift(moved, shift, out=moved)
                at += moved.view(np.int64)
        return out.T


def expected_recall(edits: int, repetitions: int, trials: int = 2000, window: int = WINDOW, samples: int = SAMPLES) -> float:
    """Measured share of pairs of random windows, so many words apart, that meet in a table."""
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, (trials, window), dtype=np.uint64)
    b = np.empty_like(a)
    for k in range(trials):
        text = a[k].tolist()
        for _ in range(edits):
            what, at, word = rng.integers(3), int(rng.integers(len(text))), int(rng.integers(1, 2**63))
            if what == 0:
                text[at] = word
            elif what == 1:
                text = [*text[:at], *text[at + 1 :], word]  # the window takes in the next word instead
            else:
                text = [*text[:at], word, *text[at:]][:window]
        b[k] = text
    e = Embedding(window, repetitions, samples)
    return float((e.keys(a) == e.keys(b)).any(axis=1).mean())


@lru_cache(16)
def tables_for(edits: int, recall: float = RECALL, window: int = WINDOW, samples: int = SAMPLES) -> int:
    """Least number of tables with this recall; a target that ``MOST_TABLES`` do not reach is refused."""
    if not edits:
        return 1
    for r in range(1, MOST_TABLES + 1):
        if expected_recall(edits, r, window=window, samples=samples) >= recall:
            return r
    raise ValueError(f"recall {recall} at {edits} edits takes more than {MOST_TABLES} tables of {samples} samples; fewer samples a table reach it")


def _windows(texts: list, hasher: _Hasher, window: int, edits: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all word hashes, start of every window, row of every window).

    With ``edits``, zeros (no word) follow each text, and up to so many windows run into them.
    """
    lists = [hasher(t) for t in texts]
    size = np.array([len(x) for x in lists], np.int64)
    count = np.where(size >= window, size - window + 1 + edits, 0)
    if edits:
        lists, size = [x + [0] * (2 * edits) for x in lists], size + 2 * edits
    flat = np.fromiter((h for x in lists for h in x), np.uint64, int(size.sum()))
    first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    rows = np.repeat(np.arange(len(lists)), count)
    starts = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum())) if len(count) else count
    return flat, starts, rows


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distance of window pairs [n, w], exact up to ``most`` and more than ``most`` beyond.

    If ``b`` has more words, the least distance to its first w - most to w + most words counts.
    """
    (n, w), m = a.shape, b.shape[1]
    prev = np.tile(np.arange(m + 1, dtype=np.int16), (n, 1))
    for i in range(1, w + 1):
        cur = np.full((n, m + 1), most + 1, np.int16)
        if i <= most:
            cur[:, 0] = i
        for j in range(max(1, i - most), min(m, i + most) + 1):
            cost = (a[:, i - 1] != b[:, j - 1]).astype(np.int16)
            best = np.minimum(prev[:, j - 1] + cost, cur[:, j - 1] + 1)
            cur[:, j] = np.minimum(best, prev[:, j] + 1) if j < i + most else best
        prev = cur
    return np.minimum(prev[:, w] if m == w else prev[:, max(0, w - most) :].min(axis=1), most + 1)


class ItemIndex:
    """LSH tables over the item windows of one block."""

    def __init__(self, ids: list, texts: list, embedding: Embedding):
        self.embedding = embedding
        flat, starts, rows = _windows(texts, _Hasher(), embedding.window)
        every = np.lib.stride_tricks.sliding_window_view(flat, embedding.window)[starts] if len(starts) else np.zeros((0, embedding.window), np.uint64)
        # an item that repeats a window holds it once
        once = np.unique(np.column_stack((rows.astype(np.uint64), every)), axis=0)
        self.item = np.array(ids, np.int64)[once[:, 0].astype(np.int64)]
        self.words = once[:, 1:].copy()
        keys = embedding.keys(self.words)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=0)
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.words)) * 32))))
        self.seen = np.zeros((embedding.repetitions, 1 << self.bits), bool)
        for r in range(embedding.repetitions):
            self.seen[r, keys[:, r] >> np.uint64(64 - self.bits)] = True

    def candidates(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row into ``keys``, item window) that meet in some table."""
        left, right = [], []
        for r in range(keys.shape[1]):
            k = keys[:, r]
            may = np.flatnonzero(self.seen[r, k >> np.uint64(64 - self.bits)])
            lo = np.searchsorted(self.keys[:, r], k[may], "left")
            n = np.searchsorted(self.keys[:, r], k[may], "right") - lo
            hit = np.flatnonzero(n)
            may, lo, n = may[hit], lo[hit], n[hit]
            where = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(n) else lo
            left.append(np.repeat(may, n))
            right.append(self.order[where, r])
        pair = np.unique(np.concatenate(left) * max(1, len(self.words)) + np.concatenate(right))
        return pair // max(1, len(self.words)), pair % max(1, len(self.words))

    def matches(self, texts: list, hasher: _Hasher, max_edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item window, edits) of every verified pair of windows."""
        w = self.embedding.window
        flat, starts, rows = _windows(texts, hasher, w, max_edits)
        out = ([], [], [])
        if not len(starts) or not len(self.words):
            return tuple(np.zeros(0, np.int64) for _ in out)
        view = np.lib.stride_tricks.sliding_window_view(flat, w + max_edits)
        for at in range(0, len(starts), STEP):
            part = view[starts[at : at + STEP]]
            left, right = self.candidates(self.embedding.keys(part[:, :w]))
            for k in range(0, len(left), STEP):
                a, b = part[left[k : k + STEP]], self.words[right[k : k + STEP]]
                edits = np.where((a[:, :w] == b).all(axis=1), 0, max_edits + 1)
                near = np.flatnonzero(edits)
                if max_edits and len(near):
                    edits[near] = edit_distance(b[near], a[near], max_edits)
                ok = np.flatnonzero(edits <= max_edits)
                out[0].append(rows[at + left[k : k + STEP][ok]])
                out[1].append(right[k : k + STEP][ok])
                out[2].append(edits[ok])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _search(index, max_edits: int):
    def run(batches):
        hasher = _Hasher()
        for batch in batches:
            ids = batch.column(0)
            row, window, edits = index.value.matches(batch.column(1).to_pylist(), hasher, max_edits)
            if not len(row):
                continue
            items, code = np.unique(index.value.item, return_inverse=True)
            item = code[window]
            pair = row * len(items) + item
            uniq, where, count = np.unique(pair, return_inverse=True, return_counts=True)
            least = np.full(len(uniq), 99, np.int32)
            np.minimum.at(least, where, edits.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(uniq // len(items))), pa.array(items[uniq % len(items)]), pa.array(least), pa.array(count)], names=["doc_id", "item_id", "edits", "windows"]
            )

    return run


# -- items beyond a broadcast ---------------------------------------------------------------------

KEYED = "lsh bigint, owner bigint, at bigint, words binary"


def _keyed(embedding: Embedding, edits: int, seen=None):
    """``KEYED`` rows of every window: its LSH key in each table, its text and place, and its words; ``seen`` filters them."""

    def run(batches):
        hasher, w = _Hasher(), embedding.window
        for batch in batches:
            flat, starts, rows = _windows(batch.column(1).to_pylist(), hasher, w, edits)
            view = np.lib.stride_tricks.sliding_window_view(flat, w + edits) if len(flat) >= w + edits else None
            ids, own = batch.column(0), np.arange(len(starts)) - np.searchsorted(rows, rows)
            for k in range(0, len(starts), STEP):
                part = np.ascontiguousarray(view[starts[k : k + STEP]])
                # the table is part of the key
                keys = embedding.keys(part[:, :w]) + np.arange(embedding.repetitions, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                live = seen.value[keys >> np.uint64(64 - FILTER_BITS + 3)] >> ((keys >> np.uint64(64 - FILTER_BITS)) & np.uint64(7)).astype(np.uint8) & 1 if seen else np.ones(keys.shape, np.uint8)
                at, table = np.nonzero(live)
                if len(at):
                    text = pa.array([part[i].tobytes() for i in at], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at, table].view(np.int64)), ids.take(pa.array(rows[k + at])), pa.array(own[k + at]), text], names=[c.split()[0] for c in KEYED.split(", ")])

    return run


def _filter(batches):
    """The LSH keys of a task's item windows as a bitmap, in pieces of 64 kB."""
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        np.bitwise_or.at(bits, (key >> np.uint64(64 - FILTER_BITS + 3)).astype(np.int64), np.uint8(1) << ((key >> np.uint64(64 - FILTER_BITS)) & np.uint64(7)).astype(np.uint8))
    pieces = bits.reshape(-1, 1 << 16)
    used = np.flatnonzero(pieces.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pieces[k].tobytes() for k in used], pa.binary())], names=["piece", "bits"])


def _merged(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[k] = held.get(k, np.uint8(0)) | np.frombuffer(raw, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["piece", "bits"])


def _joined(texts: DataFrame, queries: DataFrame, embedding: Embedding, max_edits: int) -> DataFrame:
    """The same from item windows that stay distributed: keyed, filtered, joined, verified."""
    spark = texts.sparkSession
    scratch = Scratch(spark, "leaks")
    every = scratch.table(queries.mapInArrow(_keyed(embedding, 0), KEYED).dropDuplicates(["lsh", "owner", "words"]), "items")
    pieces = every.select("lsh").mapInArrow(_filter, "piece int, bits binary").repartition(16, "piece").mapInArrow(_merged, "piece int, bits binary")
    bits = np.zeros((1 << (FILTER_BITS - 3)) >> 16 << 16, np.uint8).reshape(-1, 1 << 16)
    for r in pieces.toLocalIterator():
        bits[r[0]] = np.frombuffer(r[1], np.uint8)
    seen = spark.sparkContext.broadcast(bits.ravel())
    docs = texts.mapInArrow(_keyed(embedding, max_edits, seen), KEYED).select("lsh", F.col("owner").alias("doc_id"), F.col("at").alias("doc_at"), F.col("words").alias("doc_words"))
    met = docs.join(every.select("lsh", F.col("owner").alias("item_id"), F.col("words").alias("item_words")), "lsh")
    w = embedding.window

    def verify(batches):
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(n, -1) for k in (2, 4))
            edits = np.where((a[:, :w] == b).all(axis=1), 0, max_edits + 1)
            near = np.flatnonzero(edits)
            if max_edits and len(near):
                edits[near] = edit_distance(b[near], a[near], max_edits)
            ok = pa.array(np.flatnonzero(edits <= max_edits))
            if len(ok):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok), batch.column(3).take(ok), batch.column(4).take(ok), pa.array(edits.astype(np.int32)).take(ok)], names=["doc_id", "doc_at", "item_id", "item_words", "edits"])

    pairs = met.select("doc_id", "doc_at", "doc_words", "item_id", "item_words").mapInArrow(verify, "doc_id bigint, doc_at bigint, item_id bigint, item_words binary, edits int")
    # a pair of windows may meet in several tables
    once = pairs.groupBy("doc_id", "item_id", "doc_at", F.xxhash64("item_words").alias("w")).agg(F.min("edits").alias("edits"))
    return once.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.count("*").alias("windows")).select("doc_id", "item_id", "edits", "windows")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_edits: int = MAX_EDITS,
    block_windows: int = BLOCK_WINDOWS,
    recall: float = RECALL,
) -> DataFrame:
    """``doc_id, item_id, edits, windows``: documents that hold a passage of an item.

    ``edits`` is the least word edit distance of a matching window (0: verbatim) and
    ``windows`` the number of matching window pairs, a window that an item repeats counting once
    (beyond ``block_windows`` document keys must be unique for the windows to be told apart).
    """
    spark = docs.sparkSession
    embedding = Embedding(window, tables_for(max_edits, recall, window))
    queries = items.select(F.col(item_key).cast("bigint").alias("k"), F.col(item_text).alias("t")).filter("k is not null and t is not null")
    # half the characters bound the number of words, and so of windows
    size = queries.agg(F.sum(F.length("t")) / 2).first()[0] or 0
    texts = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(doc_text).alias("t")).filter("t is not null")
    if size > block_windows:
        return _joined(texts, queries, embedding, max_edits)
    held = queries.toArrow()
    index = spark.sparkContext.broadcast(ItemIndex(held.column(0).to_pylist(), held.column(1).to_pylist(), embedding))
    return texts.mapInArrow(_search(index, max_edits), MATCHES)
