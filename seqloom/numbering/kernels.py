"""From an aligned domain to numbered residues.

A *state vector* is a list of (state 1..128, kind ``m``/``i``/``d``, sequence index or None).
``number`` walks it through a scheme's regions and relabels the loops by the scheme's rules.
One interpreter serves all schemes; what differs is in :mod:`.tables`.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import groupby

import numpy as np

from .tables import LETTERS, NONE, WOLF_L1, WOLF_L1_OTHER, Canonical, Fill, FrontLetters, FrontStretch, Scheme, Symmetric, blosum62, scheme_for

State = tuple[int, str, int | None]
Label = tuple[int, str]


class TooManyInsertions(Exception):
    """A region has no letters left."""


def reach(domain_index, n_domains, seq_start, seq_end, hmm_start, hmm_end, model_length, seq_len) -> tuple[np.ndarray, np.ndarray]:
    """How many residues in front of each alignment and behind it belong to the domain.

    The first domain takes in up to four residues in front; a single domain takes in the
    residues behind if its alignment stops within the model's last states.
    """
    lack = hmm_start - 1
    front = np.where(lack > seq_start, np.minimum(seq_start, lack - seq_start), lack)
    front = np.where((domain_index == 0) & (hmm_start >= 2) & (hmm_start <= 5), np.maximum(front, 0), 0)
    behind = np.where((n_domains == 1) & (hmm_end > 123) & (hmm_end < model_length), np.minimum(seq_len - seq_end, model_length - hmm_end), 0)
    return front, np.maximum(behind, 0)


def state_vector(
    path: list[tuple[int, str]], seq_start: int, seq_end: int, hmm_start: int, hmm_end: int, seq_len: int, domain_index: int = 0, n_domains: int = 1, model_length: int = 128
) -> list[State]:
    """Attach sequence indexes to a path and :func:`reach` out to ends the alignment just missed."""
    n, behind = (int(x) for x in reach(*map(np.asarray, (domain_index, n_domains, seq_start, seq_end, hmm_start, hmm_end, model_length, seq_len))))
    out: list[State] = [(hmm_start - k, "m", seq_start - k) for k in range(n, 0, -1)]
    at = seq_start
    for state, kind in path:
        if kind == "d":
            out.append((state, "d", None))
        elif kind in ("m", "i"):
            out.append((state, kind, at))
            at += 1
    return out + [(hmm_end + 1 + k, "m", seq_end + k) for k in range(behind)]


# Boundary zones in which insertions are moved into the loop: (first, last state, loop follows the zone).
_ZONES = ((25, 27, True), (38, 40, False), (54, 56, True), (65, 67, False), (103, 105, True), (117, 119, False))


def _zone(state: int) -> int | None:
    if state < 23:
        return -1
    for k, (a, b, _) in enumerate(_ZONES):
        if a <= state <= b:
            return k
    return None


def _smooth_zone(zone: int, buffer: list[State]) -> list[State]:
    kept = [s for s in buffer if s[1] != "d"]
    inserted = sum(s[1] == "i" for s in buffer)
    if not inserted:
        return buffer
    if zone < 0:
        lead = next((k for k, s in enumerate(buffer) if s[2] is not None), len(buffer))
        if buffer[0][0] - 1 + lead < inserted:
            return buffer
        matched = [s[0] for s in kept if s[1] == "m"]
        first = matched[0] if matched else 1
        front = range(max(0, first - (len(kept) - len(matched))), first)
        return [(state, "m", s[2]) for state, s in zip([*front, *matched], kept)]
    a, b, loop_after = _ZONES[zone]
    extra = max(0, len(kept) - 3)
    if loop_after:
        states = [(a, "m"), (a + 1, "m"), (b, "m")] + [(b, "m")] * extra
    else:
        states = [(a, "i")] * extra + [(a, "m"), (a + 1, "m"), (b, "m")][max(0, 3 - len(kept)) :]
    return [(state, kind, s[2]) for (state, kind), s in zip(states, kept)]


def smooth(vector: list[State]) -> list[State]:
    """Rewrite insertions at framework edges, where the alignment places them by accident."""
    out: list[State] = []
    runs = [(inside, list(part)) for inside, part in groupby(vector, key=lambda s: _zone(s[0]) is not None)]
    for k, (inside, part) in enumerate(runs):
        # a zone at the very end stays as aligned
        out += _smooth_zone(_zone(part[-1][0]), part) if inside and k + 1 < len(runs) else part
    return out


def split_regions(scheme: Scheme, vector: list[State], sequence: str) -> tuple[list[list[tuple[Label, str]]], int | None, int | None]:
    """Labelled residues of each region, and the first and last sequence index used.

    Raises :class:`TooManyInsertions` with those indexes if a framework runs out of letters.
    """
    starts = [s for s, _ in scheme.layout]
    offset = [o for _, o in scheme.layout]
    regions: list[list[tuple[Label, str]]] = [[] for _ in starts]
    region, letter, before, last_state = None, -1, "d", 1
    used: list[int] = []
    for state, kind, at in smooth(vector):
        if not 1 <= state <= 128:
            continue
        if kind != "i" or region is None:
            region = bisect_right(starts, state) - 1
        dropped = state in scheme.drop
        if kind == "d":
            before = "d"
            if dropped:
                offset[region] -= 1
                continue
            letter, last_state = -1, state
        else:
            if kind == "i":
                letter += 1
            elif dropped:
                letter += before != "d"
                offset[region] -= 1
            else:
                letter = -1
            if kind == "m":
                last_state = state
            if at is not None:
                code = LETTERS[letter] if 0 <= letter < len(LETTERS) else NONE
                regions[region].append(((last_state + offset[region], code), sequence[at]))
                used.append(at)
            before = kind
        if letter >= 25:
            if region not in scheme.wrap:
                raise TooManyInsertions(*(used[:1] + used[-1:]))
            letter = 0
    return regions, used[0] if used else None, used[-1] if used else None


def _letters(on: int, n: int) -> list[Label]:
    if n > len(LETTERS):
        raise TooManyInsertions
    return [(on, x) for x in LETTERS[: max(0, n)]]


def _fill(rule: Fill, n: int) -> list[Label]:
    if rule.most is not None and n > rule.most:
        raise TooManyInsertions
    if n == 1 and rule.single is not None:
        return [(rule.single, NONE)]
    labels = [(p, NONE) for p in rule.order[:n]]
    labels += _letters(rule.letters_on, n - len(rule.order)) if rule.letters_on is not None else []
    return sorted(labels, key=lambda x: (x[0], x[1] != NONE, len(x[1]), x[1]))


def symmetric_labels(rule: Symmetric, n: int) -> list[tuple[Label, bool]]:
    """(label, holds a residue) of a loop filled from both ends."""
    if n > rule.most:
        raise TooManyInsertions
    size = rule.last - rule.first + 1
    front, back = (min(n, size) + 1) // 2, min(n, size) // 2
    labels = [((rule.first + k, NONE), True) for k in range(front)]
    if n < size:
        labels += [((rule.first + k, NONE), False) for k in range(front, size - back)]
    else:
        mirrored = (n - size + 1) // 2
        labels += [(x, True) for x in _letters(rule.first + front - 1, n - size - mirrored)]
        labels += [(x, True) for x in reversed(_letters(rule.last - back + 1, mirrored))]
    return labels + [((rule.last - back + 1 + k, NONE), True) for k in range(back)]


def _canonical(residues: str) -> list[Label]:
    forms = WOLF_L1.get(len(residues))
    if forms is None:
        if len(residues) > len(WOLF_L1_OTHER):
            raise TooManyInsertions
        return [(p, NONE) for p in sorted(WOLF_L1_OTHER[: len(residues)])]
    scores = [sum(blosum62(a.upper(), b) for a, b in zip(residues, form)) for form, _ in forms]
    return [(p, NONE) for p in forms[scores.index(max(scores))][1]]


def _front(rule: FrontLetters | FrontStretch, part: list[tuple[Label, str]]) -> list[Label] | None:
    n, start = len(part), part[0][0][0]
    plain = lambda a, b: [(p, NONE) for p in range(a, b + 1)]
    if isinstance(rule, FrontLetters):
        extra = sum(code != NONE for (_, code), _ in part)
        if not extra:
            return None
        return plain(start, rule.on) + _letters(rule.on, extra) + plain(rule.on + 1, rule.tail)
    room = rule.end - start + 1
    if n > room:
        return plain(start, rule.on) + _letters(rule.on, n - room) + plain(rule.on + 1, rule.end)
    order = [rule.on] + [p for p in range(start, rule.end + 1) if p != rule.on]
    return [(p, NONE) for p in sorted(order[max(0, room - n) :])]


def _relabel(rule, part: list[tuple[Label, str]]) -> list[tuple[Label, str]]:
    n = len(part)
    residues = "".join(aa for _, aa in part)
    if isinstance(rule, Symmetric):
        letters = iter(residues)
        return [(label, next(letters) if filled else "-") for label, filled in symmetric_labels(rule, n)]
    if not n:
        return part
    if isinstance(rule, Fill):
        if rule.applies and not rule.applies(n):
            return part
        labels = _fill(rule, n)
    elif isinstance(rule, Canonical):
        labels = _canonical(residues)
    else:
        labels = _front(rule, part)
        if labels is None:
            return part
    if len(labels) < n:
        raise TooManyInsertions
    return list(zip(labels[:n], residues))


def fill_gaps(labelled: list[tuple[Label, str]]) -> list[tuple[Label, str]]:
    """Add ``-`` for skipped positions from 1 up to the last one seen."""
    out, last = [], 0
    for (pos, code), aa in labelled:
        out += [((p, NONE), "-") for p in range(last + 1, pos)]
        out.append(((pos, code), aa))
        last = pos
    return out


def number(scheme_name: str, chain: str, vector: list[State], sequence: str) -> tuple[list[tuple[Label, str]], int | None, int | None] | None:
    """(numbering, first and last sequence index), or None if the scheme does not cover the chain.

    A domain with too many insertions keeps its indexes and gets an empty numbering.
    """
    scheme = scheme_for(scheme_name, chain)
    if scheme is None:
        return None
    try:
        regions, first, last = split_regions(scheme, vector, sequence)
    except TooManyInsertions as e:
        return [], *(e.args or (None, None))
    try:
        out: list[tuple[Label, str]] = []
        for k, part in enumerate(regions):
            rule = scheme.rules.get(k)
            guard = scheme.only_if.get(k)
            out += part if rule is None or (guard and len(regions[guard[0]]) <= guard[1]) else _relabel(rule, part)
    except TooManyInsertions:
        return [], first, last
    if scheme.gaps:
        out = fill_gaps(out)
    if scheme.tail_position and out and out[-1][0] == (scheme.tail_position[0], NONE) and out[-1][1] != "-" and last is not None and last + 1 < len(sequence):
        last += 1
        out.append(((scheme.tail_position[1], NONE), sequence[last]))
    return out, first, last


def stitch(vector: list[State], j_region: list[State]) -> list[State]:
    """Join a domain cut off after its second cysteine (state 104) with a J region found behind it."""
    at = next((k for k, s in enumerate(vector) if s[:2] == (104, "m") and s[2] is not None), None)
    if at is None or not j_region or j_region[0][2] is None:
        return vector
    between = range(vector[at][2] + 1, j_region[0][2])
    return vector[: at + 1] + [(min(105 + k, 116), "m" if k < 11 else "i", i) for k, i in enumerate(between)] + j_region


def state_sequence(vector: list[State], sequence: str) -> str:
    """The 128 matched states as a string, ``-`` where nothing matched."""
    out = ["-"] * 128
    for state, kind, at in vector:
        if kind == "m" and at is not None and 1 <= state <= 128:
            out[state - 1] = sequence[at].upper()
    return "".join(out)
