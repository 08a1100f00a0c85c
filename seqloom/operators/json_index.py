"""Structural index of JSON texts, built with numpy over a whole batch of documents.

One pass over the bytes finds the quotes, brackets and delimiters; prefix parity of
the quotes tells text from structure, and the running sum of brackets gives the depth
of every token.  From these come the spans of all values and, per document, whether the
text is valid JSON (RFC 8259: strict strings, numbers and literals, no trailing text).
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from .spans import equals, expand, ranks

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR = range(1, 9)
_QUOTE, _ESC, _WS, _CTRL = 9, 10, 11, 12
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")

_CLASS = np.zeros(256, np.uint8)
_CLASS[:32] = _CTRL
for _b, _k in zip(b"{}[]:,", range(1, 7)):
    _CLASS[_b] = _k
_CLASS[ord('"')], _CLASS[ord("\\")] = _QUOTE, _ESC
for _b in b" \t\r\n":
    _CLASS[_b] = _WS
_STRUCT = np.isin(np.arange(256), np.frombuffer(b'{}[]:,"', np.uint8))
_NONWS = _CLASS != _WS


def _of(*kinds: int) -> np.ndarray:
    return np.isin(np.arange(16), kinds)


_OPENS, _CLOSES = _of(OPEN_OBJ, OPEN_ARR), _of(CLOSE_OBJ, CLOSE_ARR)
_STARTS, _ENDS = _of(STRING, SCALAR, OPEN_OBJ, OPEN_ARR), _of(SCALAR, CLOSE_OBJ, CLOSE_ARR)
#: Nesting beyond this many levels is indexed by the slow path, level by level costs grow with depth.
MAX_LEVELS = 64


class JsonIndex:
    """Tokens of a batch: ``pos``/``end`` byte span, ``kind``, ``doc``, ``level``, ``parent`` token (-1 at the top)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n_docs = len(offsets) - 1
        self.valid = offsets[1:] > offsets[:-1]
        cls = _CLASS[buf]
        self._escapes(cls)
        marks = np.flatnonzero(_STRUCT[buf])
        if len(self.escaped):
            marks = marks[~np.isin(marks, self.escaped, assume_unique=True)]
        first = np.searchsorted(marks, offsets)
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        first = first[:-1]
        kind = cls[marks]
        quote = kind == _QUOTE
        # parity of the quotes before each mark, counted afresh in every document
        before = np.cumsum(quote) - quote
        base = np.concatenate((before, [int(quote.sum())]))[first]
        inside = ((before - base[doc]) & 1).astype(bool)
        odd = np.bincount(doc[quote], minlength=n_docs) & 1
        self.valid &= odd == 0
        self._text_checks(cls, marks, quote, doc)
        keep = ~inside | quote
        marks, kind, doc, inside = marks[keep], kind[keep], doc[keep], inside[keep]
        shut = inside & (kind == _QUOTE)
        head = ~shut
        end = marks + 1
        opens_text = (kind == _QUOTE) & head
        at = np.flatnonzero(opens_text)
        nxt = np.minimum(at + 1, len(marks) - 1)
        paired = shut[nxt] & (doc[nxt] == doc[at])
        end[at[paired]] = marks[nxt[paired]] + 1
        kind = np.where(opens_text, STRING, kind)
        pos, end, kind, doc = marks[head], end[head], kind[head], doc[head]
        self._with_scalars(pos, end, kind, doc)
        self._levels()
        self._grammar()

    def _escapes(self, cls: np.ndarray) -> None:
        slash = np.flatnonzero(cls == _ESC)
        if not len(slash):
            self.escaped = slash
            return
        starts = np.isin(slash, self.offsets)
        starts[0] = True
        starts[1:] |= np.diff(slash) != 1
        run = np.cumsum(starts) - 1
        odd = ranks(run) & 1
        esc = slash[odd == 0] + 1
        esc = esc[esc < len(cls)]
        self.escaped = esc[~np.isin(esc, self.offsets)]

    def _text_checks(self, cls, marks, quote, doc) -> None:
        """Escape sequences and raw control characters; both are only about text inside quotes."""
        buf, offsets = self.buf, self.offsets
        qpos = marks[quote]

        def within(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            d = np.searchsorted(offsets, p, side="right") - 1
            return d, ((np.searchsorted(qpos, p) - np.searchsorted(qpos, offsets[d])) & 1).astype(bool)

        slash = np.flatnonzero(cls == _ESC)
        if len(slash):
            d, inner = within(slash)
            self.valid[d[~inner]] = False
            e = self.escaped
            d = np.searchsorted(offsets, e, side="right") - 1
            ok = np.isin(buf[e], np.frombuffer(b'"\\/bfnrtu', np.uint8))
            self.valid[d[~ok]] = False
            u = e[buf[e] == ord("u")]
            ud = np.searchsorted(offsets, u, side="right") - 1
            good = u + 4 < offsets[ud + 1]
            self.valid[ud[~good]] = False
            u, ud = u[good], ud[good]
            hexa = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefABCDEF", np.uint8))
            for k in range(1, 5):
                self.valid[ud[~hexa[buf[u + k]]]] = False
        ctrl = np.flatnonzero(buf < 32)
        if len(ctrl):
            d, inner = within(ctrl)
            self.valid[d[inner | (cls[ctrl] == _CTRL)]] = False

    def _with_scalars(self, pos, end, kind, doc) -> None:
        """Add the numbers and literals, which stand in the gaps between the other tokens."""
        buf, offsets, n_docs = self.buf, self.offsets, len(self.offsets) - 1
        filled = _NONWS[buf]
        solid = np.flatnonzero(filled)
        count = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(filled, out=count[1:])
        # gaps: from each token's end to the next token of the same document (or its end), and before the first token
        first = np.searchsorted(doc, np.arange(n_docs))
        has = np.bincount(doc, minlength=n_docs) > 0
        nxt = np.concatenate((pos[1:], [0]))
        last = np.concatenate((doc[1:] != doc[:-1], [True])) if len(doc) else np.zeros(0, bool)
        stop = np.where(last, offsets[doc + 1], nxt) if len(doc) else pos
        lead_stop = offsets[1:].copy()
        lead_stop[has] = pos[first[has]]
        g0 = np.concatenate((end, offsets[:-1]))
        g1 = np.concatenate((stop, lead_stop))
        gd = np.concatenate((doc, np.arange(n_docs)))
        g1 = np.maximum(g0, g1)
        full = count[g1] - count[g0]
        at = np.flatnonzero(full)
        s0, s1 = solid[count[g0[at]]], solid[count[g1[at]] - 1] + 1
        self.valid[gd[at][s1 - s0 != full[at]]] = False
        self._check_scalars(s0, s1, gd[at])
        # both token lists ascend, so each scalar's place in the merged list is known
        order = np.argsort(s0, kind="stable")
        s0, s1, gd = s0[order], s1[order], gd[at][order]
        place = np.searchsorted(pos, s0) + np.arange(len(s0))
        old = np.ones(len(pos) + len(s0), bool)
        old[place] = False

        def merged(a: np.ndarray, b) -> np.ndarray:
            out = np.empty(len(old), a.dtype)
            out[old], out[place] = a, b
            return out

        self.pos, self.end, self.kind, self.doc = merged(pos, s0), merged(end, s1), merged(kind, SCALAR), merged(doc, gd)

    def _check_scalars(self, s0, s1, doc) -> None:
        buf, length = self.buf, s1 - s0
        short = np.flatnonzero((length <= 7) & (length > 0))
        code = length[short].astype(np.uint64)
        for k in range(7):
            byte = np.where(k < length[short], buf[np.minimum(s0[short] + k, len(buf) - 1)], 0)
            code = code * np.uint64(256) + byte.astype(np.uint64)
        uniq, where = np.unique(code, return_inverse=True)
        ok = np.zeros(len(uniq), bool)
        for i, c in enumerate(uniq.tolist()):
            raw = c.to_bytes(8, "big")
            text = raw[1 : 1 + raw[0]]
            ok[i] = text in (b"null", b"true", b"false") or _NUMBER.match(text) is not None
        self.valid[doc[short][~ok[where]]] = False
        for i in np.flatnonzero(length > 7):
            if not _NUMBER.match(buf[s0[i] : s1[i]].tobytes()):
                self.valid[doc[i]] = False

    def _levels(self) -> None:
        kind, doc, n_docs = self.kind, self.doc, len(self.offsets) - 1
        opens, closes = _OPENS[kind], _CLOSES[kind]
        step = opens.astype(np.int32) - closes
        run = np.cumsum(step)
        first = np.searchsorted(doc, np.arange(n_docs))
        before = np.concatenate(([0], run))
        base = before[first]
        total = np.bincount(doc, weights=step, minlength=n_docs)
        self.valid &= total == 0
        level = run - base[doc]
        level = np.where(opens, level - 1, level)
        self.valid[doc[level < 0]] = False
        deep = np.zeros(n_docs, bool)
        deep[doc[level >= MAX_LEVELS]] = True
        self.deep = deep & self.valid
        self.valid &= ~deep
        self.parent = np.full(len(kind), -1)
        self.match = np.full(len(kind), -1)
        use = self.valid[doc]
        # tokens level by level: a token's holder, and a closing bracket's opener, is the last opener before it one level up
        usable = np.flatnonzero(use)
        rank = np.clip(level[usable], 0, MAX_LEVELS + 1).astype(np.uint8)
        order = usable[np.argsort(rank, kind="stable")]
        cut = np.concatenate((np.searchsorted(level[order], np.arange(int(rank.max(initial=0)) + 1)), [len(order)]))
        above = np.zeros(0, np.int64)
        for k in range(len(cut) - 1):
            mine = order[cut[k] : cut[k + 1]]
            if len(above):
                at = np.searchsorted(above, mine) - 1
                self.parent[mine] = np.where(at >= 0, above[np.maximum(at, 0)], -1)
            own, shut = mine[opens[mine]], mine[closes[mine]]
            if len(own) and len(shut):
                at = np.searchsorted(own, shut) - 1
                self.match[shut] = np.where(at >= 0, own[np.maximum(at, 0)], -1)
            above = own
        self.level = level
        stray = use & (((level > 0) & (self.parent < 0)) | (closes & (self.match < 0)))
        self.valid[doc[stray]] = False
        linked = np.flatnonzero(use & (self.parent >= 0))
        self.valid[doc[linked][doc[self.parent[linked]] != doc[linked]]] = False

    def _grammar(self) -> None:
        kind, doc, n = self.kind, self.doc, len(self.kind)
        if not n:
            self.valid[:] = False
            self.is_key = np.zeros(0, bool)
            return
        prev = np.concatenate(([0], kind[:-1]))
        prev[np.concatenate(([True], doc[1:] != doc[:-1]))] = 0
        holder = np.where(self.parent >= 0, kind[np.maximum(self.parent, 0)], 0)
        comma_in = lambda k: (prev == COMMA) & (holder == k)
        self.is_key = (kind == STRING) & ((prev == OPEN_OBJ) | comma_in(OPEN_OBJ))
        prev_key = np.concatenate(([False], self.is_key[:-1])) & (prev != 0)
        ended = _ENDS[prev] | ((prev == STRING) & ~prev_key)
        starts = _STARTS[kind]
        ok = np.zeros(n, bool)
        ok |= starts & ((prev == 0) | (prev == COLON) | (prev == OPEN_ARR) | comma_in(OPEN_ARR))
        ok |= self.is_key
        ok |= (kind == COLON) & prev_key
        ok |= (kind == COMMA) & ended & (holder != 0)
        opener = np.where(self.match >= 0, kind[np.maximum(self.match, 0)], 0)
        ok |= (kind == CLOSE_OBJ) & (opener == OPEN_OBJ) & (ended | (prev == OPEN_OBJ))
        ok |= (kind == CLOSE_ARR) & (opener == OPEN_ARR) & (ended | (prev == OPEN_ARR))
        self.valid[doc[~ok]] = False
        seen = np.bincount(doc, minlength=len(self.valid)) > 0
        self.valid &= seen
        self.starts = starts

    # -- navigation -------------------------------------------------------------------------

    def text(self, token: int) -> str:
        """The decoded text of one token (strings without their quotes)."""
        raw = self.buf[self.pos[token] : self.end[token]].tobytes()
        return json.loads(raw) if self.kind[token] == STRING else raw.decode()

    def is_null(self, tokens: np.ndarray) -> np.ndarray:
        return (self.kind[tokens] == SCALAR) & equals(self.buf, self.pos[tokens], self.end[tokens] - self.pos[tokens], b"null")

    def values(self, tokens: np.ndarray) -> pa.Array:
        """The text of each value: strings decoded, numbers and literals as they stand, nested values as JSON; null for null and for token -1."""
        known = tokens >= 0
        at = np.where(known, tokens, 0)
        if not len(self.kind):
            return pa.nulls(len(tokens), pa.string())
        known &= ~self.is_null(at)
        start, stop = self.pos[at], self.end[at]
        opener = np.isin(self.kind[at], (OPEN_OBJ, OPEN_ARR))
        if (opener & known).any():
            closer = np.full(len(self.kind), -1)
            shut = np.flatnonzero(self.match >= 0)
            closer[self.match[shut]] = shut
            stop = np.where(opener & (closer[at] >= 0), self.end[np.maximum(closer[at], 0)], stop)
        text = self.kind[at] == STRING
        start, stop = start + text, stop - text
        length = np.where(known, stop - start, 0)
        raw = self.buf[expand(start, length)]
        off = np.concatenate(([0], np.cumsum(length)))
        mask = pa.py_buffer(np.packbits(known, bitorder="little"))
        out = pa.LargeStringArray.from_buffers(len(tokens), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)), mask).cast(pa.string())
        if len(self.escaped):
            odd = np.flatnonzero(known & text & (np.searchsorted(self.escaped, start) < np.searchsorted(self.escaped, start + length)))
            if len(odd):
                as_list = out.to_pylist()
                for i in odd:
                    as_list[i] = self.text(at[i]).encode("utf-8", "replace").decode()
                out = pa.array(as_list, pa.string())
        return out

    def members(self, holders: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray]:
        """(row into ``holders``, value token) of ``key`` in each object; the last one wins if it is repeated."""
        slot = np.full(len(self.kind), -1)
        slot[holders] = np.arange(len(holders))
        keys = np.flatnonzero(self.is_key)
        keys = keys[slot[self.parent[keys]] >= 0]
        start, length = self.pos[keys] + 1, self.end[keys] - self.pos[keys] - 2
        hit = equals(self.buf, start, length, key.encode())
        if len(self.escaped):
            for i in np.flatnonzero(np.searchsorted(self.escaped, start) < np.searchsorted(self.escaped, start + length)):
                hit[i] = self.text(keys[i]) == key
        keys = keys[hit]
        rows = slot[self.parent[keys]]
        final = np.full(len(holders), -1)
        final[rows] = keys  # keys ascend, so the last assignment is the last occurrence
        rows = np.flatnonzero(final >= 0)
        return rows, final[rows] + 2

    def elements(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row into ``values``, element token, 0-based place); a lone value is an array of one, null is none."""
        kind = self.kind[values]
        arrays = np.flatnonzero(kind == OPEN_ARR)
        lone = np.flatnonzero((kind != OPEN_ARR) & ~self.is_null(values))
        slot = np.full(len(self.kind), -1)
        slot[values[arrays]] = arrays
        inner = np.flatnonzero(self.starts & (self.parent >= 0))
        inner = inner[slot[self.parent[inner]] >= 0]
        row = slot[self.parent[inner]]
        order = np.argsort(row, kind="stable")
        row, inner = row[order], inner[order]
        return (
            np.concatenate((row, lone)),
            np.concatenate((inner, values[lone])),
            np.concatenate((ranks(row), np.zeros(len(lone), np.int64))),
        )

    def roots(self) -> np.ndarray:
        """First token of every valid document."""
        n_docs = len(self.valid)
        first = np.searchsorted(self.doc, np.arange(n_docs))
        return first[self.valid]
