"""Records whose sequences share most of their substrings: a set-similarity join.

A record is the set of its distinct ``q``-letter substrings (grams).  Equal texts are one
set: their answers are taken over from each other, never searched twice.  The join runs on
an inverted index whose lists are cut into blocks of equal set size, sorted by position:

* grams are ordered by how often they occur (counts over all records, in a bounded table
  of 2^20 hash buckets); a set's rarest grams form its prefix, and sets that reach the threshold
  share a prefix gram;
* a probe skips every block whose size cannot reach the threshold, every block whose needed
  overlap no longer fits behind the probe's position, and in each block all entries behind
  the last position that still can; what is left is verified exactly.

Nucleotide sets draw on only 4^q grams, so each of their lists would hold a tenth of all
sets and no position rules anything out.  For them the lists are keyed by bands of
minwise hashes instead (``BANDS`` bands of ``ROWS``): a pair at the threshold 0.5 meets in
two or more bands with probability above 0.9995 and unrelated pairs practically never.  At 0.5, a set
of which more than two thirds of the grams are nucleotide goes to the bands only, one of less
than one third to the prefix lists only, others to both; by counting grams, a pair split
between the two routes cannot reach the threshold.  With ``exact`` nucleotide sets take the
prefix lists as well: nothing is missed, at a cost that grows with the square of their number.

Each text carries a 64-bit mask of its genes (all ones without genes); pairs whose masks do
not meet cannot be compatible and are dropped in the lists.  Index blocks travel as packed binary rows, one shuffle; texts travel only to verified
candidates.  Lists are joined block by block and candidates leave the task as they are found.

Defined results: null sequences and those with fewer than ``min_length`` kept letters take
no part; a null key takes no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, maybe_broadcast

Q, THRESHOLD, MIN_LENGTH = 6, 0.5, 20
BANDS, ROWS, MEETINGS = 160, 4, 2
BUCKET_BITS, RANGES = 20, 8
#: Index entries that one task joins at best, and that a map task packs at a time.
PART_ENTRIES, PACK_ENTRIES = 1_500_000, 2_000_000
#: Candidates that a list join expands at a time.
EXPAND = 4_000_000
#: Entries of one gram's list that a task joins; longer lists are cut into shards, joined pair by pair.
LIST_ENTRIES = 1_000_000
#: Parts that a map task packs for directly; more of them are reached in two steps.
ONE_STEP = 4096
LEVEL_STEPS = 1600

_LETTER = np.full(256, 31, np.uint64)
_LETTER[65:91] = np.arange(26)
_LETTER[ord("*")] = 26


def miss_probability(similarity: float, bands: int = BANDS, rows: int = ROWS, meetings: int = MEETINGS) -> float:
    """Chance that a pair of nucleotide sets meets in too few bands to be verified."""
    from math import comb

    p = similarity**rows
    return sum(comb(bands, k) * p**k * (1 - p) ** (bands - k) for k in range(meetings))


def kept_letters(sequence: Column) -> Column:
    return F.regexp_replace(F.upper(sequence), "[^A-Z*]", "")


def base_genes(names: Column) -> Column:
    """Distinct gene names up to ``*``, in upper case and without blanks; null if there are none."""
    plain = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.upper(F.substring_index(F.coalesce(x, F.lit("")), "*", 1)), r"\s+", ""))
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


# -- sets ---------------------------------------------------------------------------------------


class Sets:
    """The distinct grams of a batch of texts: ``gram`` grouped by text, ``start``/``size`` of each text."""

    def __init__(self, texts: pa.Array, q: int, level: np.ndarray | None = None):
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if len(texts) else np.zeros(0, np.uint8)
        off = off - off[0] if len(off) else off
        code = _LETTER[raw]
        n = len(raw)
        gram = np.zeros(max(0, n - q + 1), np.uint64)
        for k in range(q):
            gram = (gram << np.uint64(5)) | code[k : n - q + 1 + k]
        length = np.diff(off)
        count = np.maximum(length - q + 1, 0)
        row = np.repeat(np.arange(len(length)), count)
        at = np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum())) if len(count) else count
        gram = gram[at]
        # one 64-bit key: text (16 bits), level of the gram's bucket (16), gram
        high = level[bucket(gram)].astype(np.uint64) << np.uint64(5 * q) if level is not None else np.uint64(0)
        key = np.sort((row.astype(np.uint64) << np.uint64(5 * q + 16)) | high | gram)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        self.row = (key >> np.uint64(5 * q + 16)).astype(np.int64)
        self.gram = key & np.uint64((1 << (5 * q)) - 1)
        self.plain = _plain(self.gram, q)
        self.size = np.bincount(self.row, minlength=len(length))
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])) if len(length) else self.size
        self.plain_size = np.bincount(self.row[self.plain], minlength=len(length))

    def routes(self, t: float, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Which texts go to the prefix lists and which to the bands; with ``exact`` all go to the lists.

        Sets of overlap o reach ``t`` if o >= s (a + b), s = t / (1 + t).  One with less than a share s of
        nucleotide grams and one with less than a share s of others stay below that, so of such a
        pair each needs one route only; at a share of exactly s a set takes both.
        """
        if exact:
            return np.ones(len(self.size), bool), np.zeros(len(self.size), bool)
        least = t / (1 + t) * self.size - 1e-6
        return self.size - self.plain_size >= least, self.plain_size >= least


_PLAIN_CODE = np.isin(np.arange(32), _LETTER[np.frombuffer(b"ACGTU", np.uint8)].astype(np.int64))


def _plain(gram: np.ndarray, q: int) -> np.ndarray:
    out = np.ones(len(gram), bool)
    for k in range(q):
        out &= _PLAIN_CODE[((gram >> np.uint64(5 * k)) & np.uint64(31)).astype(np.int64)]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket(gram: np.ndarray) -> np.ndarray:
    return (mix(gram) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a fine logarithmic scale of 16 bits; their order is the order of the grams."""
    return (np.log2(counts + 1.0) * LEVEL_STEPS).astype(np.uint16)


def pieces(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` letters and fewer than 2^16 rows."""
    size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    at, run = 0, 0
    for k, s in enumerate(size):
        if k > at and (run + s > most or k - at >= 60_000):
            yield batch.slice(at, k - at)
            at, run = k, 0
        run += int(s)
    if at < batch.num_rows:
        yield batch.slice(at)


def signatures(s: Sets, rows: np.ndarray, bands: int = BANDS, per_band: int = ROWS) -> np.ndarray:
    """Band keys [len(rows), bands] of the chosen texts, 40 bits each."""
    rng = np.random.default_rng(11)
    flip = rng.integers(0, 2**32, bands * per_band, dtype=np.uint64).astype(np.uint32)
    factor = rng.integers(0, 2**31, bands * per_band, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(rows), bands), np.uint64)
    base = (mix(s.gram) >> np.uint64(32)).astype(np.uint32)
    step = 128  # texts at a time, so that their grams stay in the cache
    for at in range(0, len(rows), step):
        mine = rows[at : at + step]
        size = s.size[mine]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        g = base[np.repeat(s.start[mine] - first, size) + np.arange(int(size.sum()))]
        hashed, least = np.empty_like(g), np.empty((bands * per_band, len(mine)), np.uint32)
        for k in range(bands * per_band):
            np.bitwise_xor(g, flip[k], out=hashed)
            np.multiply(hashed, factor[k], out=hashed)
            np.minimum.reduceat(hashed, first, out=least[k])
        least = least.reshape(bands, per_band, len(mine))
        key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(mine), axis=1)
        for k in range(per_band):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
        out[at : at + len(mine)] = (key >> np.uint64(24)).T
    return out


# -- index --------------------------------------------------------------------------------------


def _needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of sets of these sizes that reach similarity ``t``."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def _entries(batch: pa.RecordBatch, q: int, t: float, level: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
    """(token, text, position, kind) of the batch's index entries.

    Kind 2: band, 1: index and probe, 0: probe only; +4: list of two shards, of which only pairs across count; +8: its second shard.
    """
    s = Sets(batch.column(1), q, level)
    by_prefix, by_band = s.routes(t, exact)
    own = np.arange(len(s.row)) - s.start[s.row]
    size = s.size[s.row]
    probe = by_prefix[s.row] & (own < size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)
    token, row, pos = s.gram[probe], s.row[probe], own[probe]
    kind = (pos < size[probe] - _needed(size[probe], size[probe], t) + 1).astype(np.uint8)
    token, row, pos, kind = _sharded(token, row, pos, kind, level, batch.column(0).to_numpy(zero_copy_only=False))
    dense = np.flatnonzero(by_band & (s.size > 0))
    keys = signatures(s, dense).ravel() | np.uint64(1 << 40)
    n = len(keys)
    return (
        np.concatenate((token, keys)),
        np.concatenate((row, np.repeat(dense, BANDS))),
        np.concatenate((pos, np.zeros(n, np.int64))),
        np.concatenate((kind, np.full(n, 2, np.uint8))),
        s.size,
    )


def _sharded(token, row, pos, kind, level: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """The entries, those of long lists once for every pair of shards that holds theirs.

    The number of shards comes from the gram's count over all texts, a bound on its list's length.
    """
    ways = np.ceil(np.exp2(level[bucket(token)] / LEVEL_STEPS) / LIST_ENTRIES).astype(np.int64)
    hot = np.flatnonzero(ways > 1)
    if not len(hot):
        return token, row, pos, kind
    n = ways[hot]
    own = np.repeat((mix(ids[row[hot]].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64), n)
    at, other = np.repeat(hot, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first, second = np.minimum(own, other), np.maximum(own, other)
    pair = (first * np.repeat(n, n) + second + 1).astype(np.uint64)
    shard = (mix(token[at] + pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(23)) | np.uint64(1 << 41)
    side = (kind[at] + 4 * (first != second) + 8 * ((first != second) & (own == second))).astype(np.uint8)
    cold = np.flatnonzero(ways <= 1)
    return tuple(np.concatenate((x[cold], y)) for x, y in ((token, shard), (row, row[at]), (pos, pos[at]), (kind, side)))


def by_token(token: np.ndarray) -> np.ndarray:
    """Order of the tokens: where token and place fit one word, sorting the words is many times faster than an argsort."""
    n = len(token)
    if n < 1 << 21 and n and int(token.max()) < 1 << 42:
        return (np.sort((token.astype(np.uint64) << np.uint64(21)) | np.arange(n, dtype=np.uint64)) & np.uint64((1 << 21) - 1)).astype(np.int64)
    return np.argsort(token, kind="stable")


def _pack(ids: np.ndarray, mask: np.ndarray, size: np.ndarray, token, row, pos, kind) -> bytes:
    """One index block: its texts once, then entries sorted by token, column by column."""
    order = by_token(token)
    token, row, pos, kind = token[order], row[order], pos[order], kind[order]
    seen = np.bincount(row) > 0
    used, local = np.flatnonzero(seen), (np.cumsum(seen) - 1)[row]
    head = np.array([len(used), len(token)], np.int64)
    gap = np.diff(token, prepend=np.uint64(0))
    planes = gap.view(np.uint8).reshape(-1, 8)[:, :6].T
    local = local.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3].T
    raw = b"".join(x.tobytes() for x in (head, ids[used], mask[used], size[used].astype(np.uint32), planes, local, pos.astype(np.uint32), kind))
    return zstandard.compress(raw, 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(blob)
    n_ids, n = np.frombuffer(raw, np.int64, 2)
    at = 16

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    ids, mask, size = take(np.int64, n_ids), take(np.int64, n_ids), take(np.uint32, n_ids).astype(np.int64)
    gap = np.zeros((n, 8), np.uint8)
    gap[:, :6] = take(np.uint8, 6 * n).reshape(6, n).T
    local = np.zeros((n, 4), np.uint8)
    local[:, :3] = take(np.uint8, 3 * n).reshape(3, n).T
    local = local.view(np.uint32).ravel()
    pos, kind = take(np.uint32, n).astype(np.int64), take(np.uint8, n)
    return np.cumsum(gap.view(np.uint64).ravel(), dtype=np.uint64), ids[local], size[local], pos, kind, mask[local]


def _part(token: np.ndarray, parts: int) -> np.ndarray:
    return (mix(token.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _blocks(ids, mask, size, token, row, pos, kind, where: np.ndarray) -> pa.RecordBatch:
    """One packed block for every value of ``where`` among the entries."""
    where = where.astype(np.uint16) if len(where) and where.max() < 1 << 16 else where  # 16 bits are sorted by counting
    order = np.argsort(where, kind="stable")
    used, cut = np.unique(where[order], return_index=True)
    blobs = [_pack(ids, mask, size, *(x[mine] for x in (token, row, pos, kind))) for mine in np.split(order, cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "block"])


def _index(q: int, t: float, level, parts: int, step: int, exact: bool):
    """Blocks of the index entries, by runs of ``step`` parts."""

    def run(batches):
        held, count = [], 0

        def flush():
            ids = np.concatenate([h[0] for h in held])
            mask = np.concatenate([h[2] for h in held])
            shift = np.concatenate(([0], np.cumsum([len(h[0]) for h in held])[:-1]))
            token, row, pos, kind, size = (np.concatenate([h[1][k] + (shift[j] if k == 1 else 0) for j, h in enumerate(held)]) for k in range(5))
            return _blocks(ids, mask, size, token, row, pos, kind.astype(np.uint8), _part(token, parts) // step)

        for batch in batches:
            for piece in pieces(batch, 1):
                e = _entries(piece, q, t, level.value, exact)
                held.append((piece.column(0).to_numpy(zero_copy_only=False), e, piece.column(2).to_numpy(zero_copy_only=False)))
                count += len(e[0])
                if count >= PACK_ENTRIES:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return run


def _repack(parts: int):
    """Blocks of a run of parts, packed anew part by part."""

    def run(batches):
        held, count = [], 0

        def flush():
            token, ids, size, pos, kind, mask = (np.concatenate([h[k] for h in held]) for k in range(6))
            texts, first, row = np.unique(ids, return_index=True, return_inverse=True)
            return _blocks(texts, mask[first], size[first], token, row, pos, kind, _part(token, parts))

        for batch in batches:
            for blob in batch.column(1):
                held.append(_unpack(blob.as_py()))
                count += len(held[-1][0])
                if count >= PACK_ENTRIES:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return run


def join_lists(token, ids, size, pos, kind, mask, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text a, text b, weight) of the candidates of one part, in chunks."""
    for band in (False, True):
        mine = np.flatnonzero(((kind & 3) == 2) == band)
        if not len(mine):
            continue
        # a list of one text answers nothing; most grams are such, so they go before the full sort
        mine = mine[by_token(token[mine])]
        edge = np.flatnonzero(np.concatenate(([True], token[mine][1:] != token[mine][:-1], [True])))
        length = np.diff(edge)
        mine, list_no = mine[np.repeat(length > 1, length)], np.repeat(np.arange(len(length)), length)[np.repeat(length > 1, length)]
        if not len(mine):
            continue
        if len(length) < 1 << 23 and size[mine].max() < 1 << 20:
            order = mine[np.argsort((list_no << 40) | (size[mine] << 20) | pos[mine])]
        else:
            order = mine[np.lexsort((pos[mine], size[mine], list_no))]
        tk, sz, ps, iv, kd, mk = (x[order] for x in (token, size, pos, ids, kind, mask))
        stored = np.flatnonzero(kd & 3)
        if not len(stored):
            continue
        # blocks of the stored entries: runs of equal token and size, sorted by position
        key_new = np.concatenate(([True], (tk[stored][1:] != tk[stored][:-1]) | (sz[stored][1:] != sz[stored][:-1])))
        head = np.flatnonzero(key_new)
        b_token, b_size = tk[stored][head], sz[stored][head]
        b_end = np.concatenate((head[1:], [len(stored)]))
        _, list_of = np.unique(np.concatenate((b_token, tk)), return_inverse=True)
        wide = int(sz.max()) + 2
        b_key = list_of[: len(head)] * wide + b_size
        p_list = list_of[len(head) :]
        low = np.ceil(t * sz - 1e-9).astype(np.int64)
        first = np.searchsorted(b_key, p_list * wide + low, "left")
        last = np.searchsorted(b_key, p_list * wide + sz, "right")
        spans = np.maximum(last - first, 0)
        block_of = np.cumsum(key_new) - 1
        pos_key = block_of * wide + ps[stored]
        total = np.concatenate(([0], np.cumsum(spans)))
        at = 0
        while at < len(spans):
            to = max(at + 1, int(np.searchsorted(total, total[at] + EXPAND, "right")) - 1)
            n = spans[at:to]
            probe = np.repeat(np.arange(at, to), n)
            blk = np.repeat(first[at:to] - (total[at:to] - total[at]), n) + np.arange(int(n.sum()))
            if band:
                stop = b_end[blk]
            else:
                need = _needed(b_size[blk], sz[probe], t)
                fits = sz[probe] - ps[probe] >= need
                probe, blk, need = probe[fits], blk[fits], need[fits]
                stop = np.searchsorted(pos_key, blk * wide + (b_size[blk] - need), "right")
            count = np.maximum(stop - head[blk], 0)
            yield from _pairs(probe, head[blk], count, stored, iv, sz, mk, kd, 1 if band else MEETINGS)
            at = to


def _pairs(probe, start, count, stored, ids, size, mask, kind, weight) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    total = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, total[at] + EXPAND, "right")) - 1)
        n = count[at:to]
        left = np.repeat(probe[at:to], n)
        right = stored[np.repeat(start[at:to] - (total[at:to] - total[at]), n) + np.arange(int(n.sum()))]
        a, b = ids[left], ids[right]
        # each pair once: the stored set is the smaller one, ties by id
        keep = ((size[right] < size[left]) | (b < a)) & ((mask[left] & mask[right]) != 0)
        keep &= ((kind[left] & 4) == 0) | (((kind[left] ^ kind[right]) & 8) != 0)
        a, b = a[keep], b[keep]
        yield np.minimum(a, b), np.maximum(a, b), weight
        at = to


def _join(t: float):
    def run(batches):
        blobs = [_unpack(x.as_py()) for batch in batches for x in batch.column(1)]
        if not blobs:
            return
        columns = [np.concatenate([b[k] for b in blobs]) for k in range(6)]
        del blobs
        for a, b, weight in join_lists(*columns, t):
            if not len(a):
                continue
            order = np.argsort(mix(a.view(np.uint64) + mix(b.view(np.uint64))))  # equal pairs lie side by side
            a, b = a[order], b[order]
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            met = np.diff(np.concatenate((new, [len(a)]))) * (1 if weight == 1 else 0) + (0 if weight == 1 else weight)
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(met.astype(np.int32))], names=["a", "b", "met"])

    return run


# -- verification -------------------------------------------------------------------------------


def _spread(texts: pa.Array, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair and gram as one ascending key, set size of each pair); every distinct text is cut once."""
    coded = texts.dictionary_encode()
    sets, row = Sets(coded.dictionary, q), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = sets.size[row]
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.repeat(sets.start[row] - first, size) + np.arange(int(size.sum()))
    return (np.repeat(np.arange(len(row)), size).astype(np.uint64) << np.uint64(5 * q)) | sets.gram[at], size


def _verify(q: int, t: float):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 4, 1_000_000):
                (ka, na), (kb, nb) = _spread(piece.column(4), q), _spread(piece.column(5), q)
                both = np.concatenate((ka, kb))
                both.sort(kind="stable")  # two ascending runs: one merge
                same = both[1:][both[1:] == both[:-1]]
                overlap = np.bincount((same >> np.uint64(5 * q)).astype(np.int64), minlength=piece.num_rows)
                ok = np.flatnonzero((overlap >= _needed(na, nb, t)) & (overlap > 0))
                if len(ok):
                    sim = overlap[ok] / (na[ok] + nb[ok] - overlap[ok])
                    yield pa.RecordBatch.from_arrays([*[piece.column(k).take(pa.array(ok)) for k in range(4)], pa.array(sim)], names=["a", "a2", "b", "b2", "similarity"])

    return run


def _bit(gene: Column) -> Column:
    """One of 64 bits for a gene."""
    return F.element_at(F.array(*[F.lit((1 << k) if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)]), F.pmod(F.xxhash64(gene), F.lit(64)).cast("int") + 1)


class NearPairs:
    """The join over ``df``; ``members`` holds every record's class, ``links`` the pairs of classes."""

    def __init__(self, df: DataFrame, key: str, sequence: str, gene_names: Column, q: int = Q, t: float = THRESHOLD, min_length: int = MIN_LENGTH, part_entries: int = PART_ENTRIES, exact: bool = False):
        spark = df.sparkSession
        self.scratch = scratch = Scratch(spark, "near")
        kept = df.select(F.col(key).cast("bigint").alias("k"), kept_letters(F.col(sequence)).alias("s"), base_genes(gene_names).alias("genes"))
        kept = kept.filter(F.col("k").isNotNull() & (F.length("s") >= max(q, min_length)))
        kept = kept.withColumns({"c": F.xxhash64("s"), "c2": F.xxhash64(F.lit(1), F.reverse("s"))})
        self.members = kept.select("k", "c", "c2", "genes")
        bits = F.aggregate("genes", F.lit(0).cast("bigint"), lambda acc, g: acc.bitwiseOR(_bit(g)))
        texts = scratch.table(kept.withColumn("mask", F.when(F.size("genes") > 0, bits).otherwise(F.lit(-1).cast("bigint"))).groupBy("c", "c2", "s").agg(F.bit_or("mask").alias("mask")), "texts")

        counted, grams, dense = self._levels(texts, q, t, exact)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(grams // 2 + dense * BANDS) // part_entries))
        level = spark.sparkContext.broadcast(counted)
        step = -(-parts // max(1, min(parts, ONE_STEP)))
        schema = "part int, block binary"
        blocks = texts.select("c", "s", "mask").mapInArrow(_index(q, t, level, parts, step, exact), schema).repartitionById(-(-parts // step), "part")
        if step > 1:
            blocks = blocks.mapInArrow(_repack(parts), schema).repartitionById(parts, "part")
        met = blocks.mapInArrow(_join(t), "a bigint, b bigint, met int").groupBy("a", "b").agg(F.sum("met").alias("met"))
        candidates = scratch.table(met.filter(F.col("met") >= MEETINGS).select("a", "b"), "candidates")
        self.links = self._verified(candidates, texts, q, t)

    def _levels(self, texts: DataFrame, q: int, t: float, exact: bool) -> tuple[np.ndarray, int, int]:
        """Level of every bucket by the number of its grams over all texts, the grams, and the texts that go to bands."""
        width = (1 << BUCKET_BITS) // RANGES

        def count(batches):
            total, dense = np.zeros(1 << BUCKET_BITS, np.int64), 0
            for batch in batches:
                for piece in pieces(batch, 0):
                    s = Sets(piece.column(0), q)
                    by_prefix, by_band = s.routes(t, exact)
                    total += np.bincount(bucket(s.gram[by_prefix[s.row]]), minlength=len(total))
                    dense += int(by_band.sum())
            packed = [zstandard.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in range(RANGES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(packed, pa.binary()), pa.array([int(total.sum())] + [0] * (RANGES - 1)), pa.array([dense] + [0] * (RANGES - 1))], names=["part", "counts", "grams", "dense"])

        def merge(batches):
            total, part, grams, dense = np.zeros(width, np.int64), None, 0, 0
            for batch in batches:
                for k, blob, g, d in zip(*(c.to_pylist() for c in batch.columns)):
                    part, grams, dense = k, grams + g, dense + d
                    total += np.frombuffer(zstandard.decompress(blob), np.int64)
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels(total).tobytes()], pa.binary()), pa.array([grams]), pa.array([dense])], names=["part", "counts", "grams", "dense"])

        schema = "part int, counts binary, grams bigint, dense bigint"
        rows = texts.select("s").mapInArrow(count, schema).repartitionById(RANGES, "part").mapInArrow(merge, schema).collect()
        out = np.zeros(1 << BUCKET_BITS, np.uint16)
        for r in rows:
            out[r[0] * width : (r[0] + 1) * width] = np.frombuffer(r[1], np.uint16)
        return out, sum(r[2] for r in rows), sum(r[3] for r in rows)

    def _verified(self, candidates: DataFrame, texts: DataFrame, q: int, t: float) -> DataFrame:
        n = candidates.count()
        asked = candidates.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        some = texts.join(maybe_broadcast(asked, 2 * n, 16), "c", "left_semi")
        left, right = some.select(F.col("c").alias("a"), F.col("c2").alias("a2"), F.col("s").alias("sa")), some.select(F.col("c").alias("b"), F.col("c2").alias("b2"), F.col("s").alias("sb"))
        pairs = candidates.join(left, "a").join(right, "b").select("a", "a2", "b", "b2", "sa", "sb")
        return self.scratch.table(pairs.mapInArrow(_verify(q, t), "a bigint, a2 bigint, b bigint, b2 bigint, similarity double"), "links")

    def pairs(self) -> DataFrame:
        """``result_a, result_b`` of all records that are near and whose genes agree."""
        m = self.members
        n = self.links.count()
        linked = self.links.select(F.explode(F.array(F.struct("a", "a2"), F.struct(F.col("b").alias("a"), F.col("b2").alias("a2")))).alias("x")).select("x.a", "x.a2").distinct()
        mine = m.join(maybe_broadcast(linked.toDF("c", "c2"), 2 * n, 32), ["c", "c2"], "left_semi")
        a = mine.select(F.col("c").alias("a"), F.col("c2").alias("a2"), F.col("k").alias("ka"), F.col("genes").alias("ga"))
        b = mine.select(F.col("c").alias("b"), F.col("c2").alias("b2"), F.col("k").alias("kb"), F.col("genes").alias("gb"))
        across = self.links.join(a, ["a", "a2"]).join(b, ["b", "b2"]).select("ka", "ga", "kb", "gb")
        copies = m.groupBy("c", "c2").agg(F.count("*").alias("n")).filter("n > 1").select("c", "c2")
        again = m.join(copies, ["c", "c2"], "left_semi")
        same = again.select("c", "c2", F.col("k").alias("ka"), F.col("genes").alias("ga")).join(again.select("c", "c2", F.col("k").alias("kb"), F.col("genes").alias("gb")), ["c", "c2"]).filter("ka < kb")
        agree = F.expr("size(ga) = 0 or size(gb) = 0 or arrays_overlap(ga, gb)")
        every = across.unionByName(same.select("ka", "ga", "kb", "gb")).filter(agree)
        return every.select(F.least("ka", "kb").alias("result_a"), F.greatest("ka", "kb").alias("result_b"))

    def classes(self) -> DataFrame:
        """One row per record: its class (of equal texts, named by its least key) and the number of records it is paired with.

        Records of one class and one set of genes are one group; groups are counted against each other, so
        copies are never expanded into pairs.
        """
        group = ["c", "c2", "g"]
        m = self.members.withColumn("g", F.array_sort("genes"))
        sizes = self.scratch.table(m.groupBy(*group).agg(F.count("*").alias("n"), F.min("k").alias("least")), "groups")
        named = sizes.groupBy("c", "c2").agg(F.min("least").alias("class_id"))
        left, right = (sizes.select(F.col("c").alias(x), F.col("c2").alias(f"{x}2"), F.col("g").alias(f"g{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        agree = F.expr("size(ga) = 0 or size(gb) = 0 or arrays_overlap(ga, gb)")
        across = self.links.select("a", "a2", "b", "b2").join(left, ["a", "a2"]).join(right, ["b", "b2"]).filter(agree)
        own = left.join(right.withColumnsRenamed({"b": "a", "b2": "a2"}), ["a", "a2"]).filter(agree)
        count = lambda x, gx, n: F.struct(F.col(x).alias("c"), F.col(f"{x}2").alias("c2"), F.col(gx).alias("g"), n.alias("n"))
        both = across.select(F.explode(F.array(count("a", "ga", F.col("nb")), count("b", "gb", F.col("na")))).alias("x")).select("x.*")
        # a record is not its own partner
        inner = own.select("a", "a2", "ga", (F.col("nb") - (F.col("ga") == F.col("gb")).cast("bigint")).alias("n")).toDF(*group, "n")
        links = both.unionByName(inner).groupBy(*group).agg(F.sum("n").alias("links"))
        rows = m.join(links, group, "left").join(named, ["c", "c2"])
        return rows.select(F.col("k").alias("result_no"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))

    def close(self) -> None:
        """Remove the written tables; nothing of the join can be read afterwards."""
        self.scratch.close()
