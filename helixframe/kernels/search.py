"""Inexact search over all texts of a batch at once (numpy, no Spark).

The texts stand one behind the other with a *fence* between them, letters that match nothing, so
a pattern laid over the end of a text meets mismatches and never the next text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from helixframe import alphabets as A
from helixframe.kernels.arrow import pieces

FENCE = 0
CODE = np.zeros(256, np.uint8)
for _l, _c in A.LETTER_CODE.items():
    CODE[ord(_l)] = _c
CODE[ord("U")] = CODE[ord("T")]


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8)


def match_table(pattern: np.ndarray, subject: np.ndarray, fixed: tuple[bool, bool] = (True, True)) -> np.ndarray:
    """Boolean matrix: pattern letter by subject letter."""
    if fixed == (True, True):
        return pattern[:, None] == subject[None, :]
    p, s = CODE[pattern].astype(np.int16)[:, None], CODE[subject].astype(np.int16)[None, :]
    if fixed == (True, False):
        return (p & ~s) == 0
    if fixed == (False, True):
        return (~p & s) == 0
    return (p & s) != 0


def one_byte_letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte to a letter; letters beyond Latin-1 become ``?``."""
    if not len(data) or data.max() < 128:
        return data, offsets
    texts = [data[a:z].tobytes().decode("utf-8", "replace").encode("latin-1", "replace") for a, z in zip(offsets[:-1], offsets[1:])]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


class Fenced:
    """Texts with a fence of ``width`` letters before the first and behind each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        data, offsets = one_byte_letters(data, offsets)
        n = len(offsets) - 1
        self.sizes = np.diff(offsets)
        self.low = offsets[:-1] + width * np.arange(1, n + 1)
        self.high = self.low + self.sizes
        self.text = np.full(len(data) + width * (n + 1), FENCE, np.uint8)
        self.text[np.arange(len(data)) + np.repeat(self.low - offsets[:-1], self.sizes)] = data

    def row(self, at: np.ndarray) -> np.ndarray:
        """The text a position belongs to; the fence before a text is its own."""
        return np.searchsorted(self.high, at, side="right")

    def hits(self, pattern: np.ndarray, fixed: tuple[bool, bool]) -> dict[int, np.ndarray]:
        """For each letter of the pattern, where it matches."""
        letters = np.unique(pattern)
        table = match_table(letters, np.arange(256, dtype=np.uint8), fixed)
        table[:, FENCE] = False
        return {int(c): table[i][self.text] for i, c in enumerate(letters)}


def hamming(data: np.ndarray, offsets: np.ndarray, pattern: str, max_mismatch: int = 0, min_mismatch: int = 0, fixed=(True, True)) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of all places with a number of mismatches in the range; places may hang off both ends of a text."""
    p = as_bytes(pattern)
    m = len(p)
    x = Fenced(data, offsets, m)
    hang = m - 1 if m <= max_mismatch else max_mismatch
    hits = x.hits(p, fixed)
    n = len(x.text) - m + 1
    good = np.zeros(max(n, 0), np.uint8 if m < 256 else np.int32)
    for j, c in enumerate(p.tolist()):
        good += hits[c][j:j + n]
    at = np.flatnonzero((good >= max(m - max_mismatch, 0)) & (good <= m - min_mismatch)) if min_mismatch <= m else np.zeros(0, np.int64)
    at = at[at < x.high[-1]] if len(x.high) else at
    row = x.row(at)
    start, size = at - x.low[row] + 1, x.sizes[row]
    ok = (start >= 1 - hang) & (start <= size - m + 1 + hang) & (size >= m - max_mismatch)
    return row[ok], start[ok]


def stretch_edits(text: np.ndarray, hits: dict[int, np.ndarray], pattern: np.ndarray, limit: int) -> np.ndarray:
    """Edits between the pattern and the stretches that begin at each position, ``len(pattern) - limit`` to ``+ limit`` letters wide.

    One row for a width.  A band of 2 * limit + 1 diagonals, all positions at a time; more than ``limit`` edits count as limit + 1.
    """
    m, n = len(pattern), len(text)
    far = np.uint8(min(limit + 1, 255))
    wide = 2 * limit + 1
    band = np.full((wide, n), far, np.uint8)  # band[limit + d]: i letters of the pattern against i + d of the text
    for d in range(limit + 1):
        band[limit + d] = d
    for i, c in enumerate(pattern.tolist(), 1):
        new = np.full((wide, n), far, np.uint8)
        for b in range(wide):
            last = i + b - limit - 1  # the letter of the text that is used up last, counted from the position
            row = new[b]
            if last >= 0:
                size = n - last
                if size > 0:
                    np.minimum(row[:size], band[b][:size] + ~hits[c][last:], out=row[:size])
                if b:
                    np.minimum(row, new[b - 1] + np.uint8(1), out=row)
            elif last == -1:  # nothing of the text is used: i letters are missing
                row[:] = min(i, far)
            if b + 1 < wide and last >= -1:
                np.minimum(row, band[b + 1] + np.uint8(1), out=row)
            np.minimum(row, far, out=row)
        band = new
    return band


def edits_from(texts: np.ndarray, pattern: np.ndarray, fixed=(True, True)) -> np.ndarray:
    """For each row of letters, the fewest edits between the pattern and one of its beginnings; fences match nothing."""
    n, wide = texts.shape
    ramp = np.arange(wide + 1)
    cost = np.broadcast_to(ramp, (n, wide + 1))
    for i, c in enumerate(pattern, 1):
        same = match_table(pattern[i - 1:i], np.arange(256, dtype=np.uint8), fixed)[0]
        same[FENCE] = False
        new = np.empty((n, wide + 1), np.int64)
        new[:, 0] = i
        new[:, 1:] = np.minimum(cost[:, 1:] + 1, cost[:, :-1] + ~same[texts])
        cost = np.minimum.accumulate(new - ramp, axis=1) + ramp  # further letters of the text, one edit each
    return cost.min(axis=1)


def nearest_stretches(text: np.ndarray, hits: dict[int, np.ndarray], pattern: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, width) of the nearest stretch that begins at each position with a letter of the pattern, the shortest of equal ones.

    The letter stands for its first occurrence in the pattern, the letters before that one are missing; more than ``limit`` edits count as limit + 1.
    """
    n = len(text)
    cost, width, free = np.full(n, limit + 1, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for skipped, c in enumerate(pattern[:limit + 1].tolist()):
        here = free & hits[c]
        free &= ~hits[c]
        if not here.any():
            continue
        rest = stretch_edits(text, hits, pattern[skipped + 1:], limit - skipped)
        best = rest.argmin(axis=0)
        at = np.flatnonzero(here[:-1])
        b = best[at + 1]
        cost[at] = rest[b, at + 1].astype(np.int64) + skipped
        width[at] = 1 + len(pattern) - skipped - 1 + b - (limit - skipped)
    return cost, width


def indels(data: np.ndarray, offsets: np.ndarray, pattern: str, max_edits: int, fixed=(True, True)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the best local matches.

    At each place the nearest stretch competes.  It gives way to a later one that ends no later and is no farther away, if no
    stretch that ends behind it lies between; and it is passed over if an earlier one is nearer than it and all between, and
    ends behind none of them.  All pairs of neighbours are compared at a time, by their distance in the list.
    """
    p = as_bytes(pattern)
    reach = len(p) + max_edits
    x = Fenced(data, offsets, reach + 1)
    cost, width = nearest_stretches(x.text, x.hits(p, fixed), p, max_edits)
    at = np.flatnonzero(cost <= max_edits)
    cost, end = cost[at], at + width[at] - 1
    keep = np.ones(len(at), bool)
    least, last = cost.copy(), end.copy()  # over the stretches behind each one, up to the step
    first = True
    for step in range(1, len(at)):
        n = len(at) - step
        if not (at[step:] <= end[:n]).any():
            break
        c, e = cost[step:], end[step:]
        least, last = (c, e) if first else (np.minimum(least[:n], c), np.maximum(last[:n], e))
        first = False
        before = last <= end[:n]  # none of those up to this one ends behind it
        keep[:n] &= ~(before & (c <= cost[:n]))
        keep[step:] &= ~(before & (least > cost[:n]))
    at, end = at[keep], end[keep]
    row = x.row(at)
    return row, at - x.low[row] + 1, end - x.low[row] + 1


# ---- palindromes -----------------------------------------------------------

# Which letters pair.
PAIRS = {"A": "T", "T": "A", "U": "A", "C": "G", "G": "C", "-": "-"}


def pairing(kind: str, wobble: bool) -> np.ndarray:
    """256 x 256: whether a left and a right letter pair."""
    table = np.zeros((256, 256), bool)
    if kind == "B":
        np.fill_diagonal(table, True)
    else:
        for a, b in PAIRS.items():
            table[ord(a), ord(b)] = True
        table[ord("A"), ord("U")] = True
        if wobble:
            for u in "TU":
                table[ord("G"), ord(u)] = table[ord(u), ord("G")] = True
    table[FENCE, :] = table[:, FENCE] = False
    return table


def palindromes(data: np.ndarray, offsets: np.ndarray, min_arm: int = 4, max_loop: int = 1, min_loop: int = 0, max_mismatch: int = 0, wobble: bool = False, kind: str = "DNA") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of maximal palindromes around every centre, loop included, by row, centre and width.

    From a centre pairs of letters are met outwards.  A pair is *counted* if it matches or is one of the
    first ``max_mismatch`` that don't.  At every further mismatch, and where the text ends, an arm ends; it
    reaches back to the mismatch ``max_mismatch`` + 1 before it, and is reported if at least ``min_arm`` pairs
    were counted since then.  A centre is left where no arm is open and the loop would be too wide.
    All centres of the batch move outwards together.
    """
    data, offsets = one_byte_letters(data, offsets)
    n, back = len(data), max_mismatch + 1
    pair = pairing(kind, wobble)
    centre = np.arange(n)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first, last = offsets[row], offsets[row + 1] if n else row
    found = []
    for parity, half in ((0, min_loop // 2), (1, (min_loop + 1) // 2)):
        left, right = centre - half - 1 + parity, centre + 1 + half
        live = np.flatnonzero((left >= first) & (right < last) & (right - left <= max_loop + 1))
        c, left, right = live, left[live], right[live]
        counted, misses = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        at_miss = np.zeros((back, len(c)), np.int64)  # pairs counted before the last mismatches, the oldest first
        while len(c):
            same = pair[data[left], data[right]]
            ends = ~same & (misses >= max_mismatch)
            hit = ends & (counted - at_miss[0] >= min_arm)
            found.append((2 * c[hit] + parity, left[hit] + 1, right[hit] - 1))
            at_miss[:, ~same] = np.concatenate([at_miss[1:, ~same], counted[None, ~same]])
            # until max_mismatch + 1 mismatches are met, the arm reaches back to its beginning
            early = ~same & (misses < max_mismatch)
            misses += ~same
            counted += same | early
            left, right = left - 1, right + 1
            inside = (left >= first[c]) & (right < last[c])
            open_ = counted - at_miss[0]
            hit = ~inside & (open_ >= min_arm)
            found.append((2 * c[hit] + parity, left[hit] + 1, right[hit] - 1))
            go = inside & ((right - left <= max_loop + 1) | (open_ > 0))
            c, left, right, counted, misses, at_miss = c[go], left[go], right[go], counted[go], misses[go], at_miss[:, go]
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e
    key, a, z = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((z, key))
    a, z = a[order], z[order]
    r = row[key[order] // 2]
    return r, a - offsets[r] + 1, z - offsets[r] + 1


def arm_lengths(data: np.ndarray, offsets: np.ndarray, max_mismatch: int = 0, wobble: bool = False, kind: str = "DNA") -> np.ndarray:
    """Letters of the left arm of each text that pairs with itself from both ends inwards, with at most so many mismatches."""
    data, offsets = one_byte_letters(data, offsets)
    half = np.diff(offsets) // 2
    row = np.repeat(np.arange(len(half)), half)
    i = np.arange(len(row)) - np.repeat(np.cumsum(half) - half, half)
    bad = ~pairing(kind, wobble)[data[offsets[row] + i], data[offsets[row + 1] - 1 - i]] if len(row) else np.zeros(0, bool)
    sums = np.concatenate([[0], np.cumsum(bad)])
    begin = np.cumsum(half) - half
    # pairs before the one that is a mismatch too many
    return np.bincount(row, weights=sums[1:] - sums[begin[row]] <= max_mismatch, minlength=len(half)).astype(np.int64) if len(row) else np.zeros(len(half), np.int64)


# ---- trimming ---------------------------------------------------------------

def budgets(mismatch, length: int) -> list[int]:
    """Allowed edits for each flank length 1..length; -1 never matches.

    A rate in [0, 1) is taken of the flank's length; a list is right-aligned, missing entries are -1.
    """
    if isinstance(mismatch, (list, tuple)):
        return ([-1] * length + [int(x) for x in mismatch])[-length:] if length else []
    if 0 <= mismatch < 1:
        return [int(mismatch * k) for k in range(1, length + 1)]
    return ([-1] * length + [int(mismatch)])[-length:]


def _flank(ends: np.ndarray, pattern: np.ndarray, allowed: list[int], with_indels: bool, fixed) -> np.ndarray:
    """Letters cut from each text: the longest last part of the pattern that lies on the text's first letters within its budget."""
    m, cut = len(pattern), np.zeros(len(ends), np.int64)
    table = match_table(pattern, np.arange(256, dtype=np.uint8), fixed)
    table[:, FENCE] = False
    todo = np.arange(len(ends))
    for k in range(m, 0, -1):
        if allowed[k - 1] < 0 or not len(todo):
            continue
        if with_indels:
            edits = edits_from(ends[todo, :k + allowed[k - 1]], pattern[m - k:], fixed)
        else:
            edits = np.zeros(len(todo), np.int64)
            for j in range(k):
                edits += ~table[m - k + j][ends[todo, j]]
        hit = edits <= allowed[k - 1]
        cut[todo[hit]] = k
        todo = todo[~hit]
    return cut


def trim(data: np.ndarray, offsets: np.ndarray, left: str = "", right: str = "", left_mismatch=0, right_mismatch=0, left_indels=False, right_indels=False, fixed=(True, True)) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of what is left of each text once flanking patterns are cut: the longest suffix of ``left`` on its
    beginning and the longest prefix of ``right`` on its end, each within its budget."""
    data, offsets = one_byte_letters(data, offsets)
    n = np.diff(offsets)
    cuts = []
    for pattern, mismatch, with_indels, back in ((left, left_mismatch, left_indels, False), (right, right_mismatch, right_indels, True)):
        allowed = budgets(mismatch, len(pattern))
        i = np.arange(len(pattern) + max([0, *allowed]))[None, :]
        inside = i < n[:, None]
        at = np.where(inside, offsets[1:, None] - 1 - i if back else offsets[:-1, None] + i, 0)
        ends = np.where(inside, data[at] if len(data) else 0, FENCE).astype(np.uint8)
        cuts.append(_flank(ends, as_bytes(pattern[::-1] if back else pattern), allowed, with_indels, fixed))
    start, end = np.minimum(cuts[0] + 1, n + 1), np.maximum(n - cuts[1], 0)
    return np.minimum(start, end + 1), end


# ---- weight matrices ---------------------------------------------------------

def pwm(data: np.ndarray, offsets: np.ndarray, matrix: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, score) of the places inside the texts whose score reaches ``least``; letters other than A, C, G, T weigh 0."""
    data, offsets = one_byte_letters(data, offsets)
    k = matrix.shape[1]
    n = len(data) - k + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0)
    weights = np.zeros((k, 256))
    for b, letter in enumerate("ACGT"):
        weights[:, ord(letter)] = matrix[b]
    score = np.zeros(n)
    for j in range(k):
        score += weights[j][data[j:j + n]]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.flatnonzero((score >= least) & (np.arange(n) + k <= offsets[1:][row]))
    return row[at], at - offsets[row[at]] + 1, score[at]


# ---- partial matches ----------------------------------------------------------

def partial(data: np.ndarray, offsets: np.ndarray, pattern: str, max_out: int = 1) -> tuple[np.ndarray, ...]:
    """(row, pattern start, pattern end, text start, text end) of the longest stretches that pattern and text share.

    Of each text the first ``max_out`` maximal stretches by width descending, then text start.
    """
    p = as_bytes(pattern)
    x = Fenced(data, offsets, 1)
    hits = x.hits(p, (True, True)) if len(p) else {}
    found = []
    run = np.zeros(len(x.text), np.int64)
    for i, c in enumerate(p.tolist()):
        run = np.where(hits[c], np.concatenate([[0], run[:-1]]) + 1, 0)
        on = np.zeros(len(x.text), bool)
        if i + 1 < len(p):
            on[:-1] = hits[int(p[i + 1])][1:]
        z = np.flatnonzero((run > 0) & ~on)
        w = run[z]
        found.append((x.row(z), i - w + 2, np.full(len(z), i + 1), z - w + 1, z))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    row, pa_, pz, a, z = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((pa_, a, a - z, row))
    row, pa_, pz, a, z = (v[order] for v in (row, pa_, pz, a, z))
    begin = np.searchsorted(row, row)
    first = np.arange(len(row)) - begin < max_out
    row, pa_, pz, a, z = (v[first] for v in (row, pa_, pz, a, z))
    return row, pa_, pz, a - x.low[row] + 1, z - x.low[row] + 1


def over(find, names: list[str], types: list[pa.DataType]):
    """A mapInArrow function over (id, text): ``find(data, offsets)`` gives the row numbers and the other columns."""
    def run(batches):
        for b in batches:
            for first, data, offsets in pieces(b.column(1)):
                valid = np.asarray(b.column(1).slice(first, len(offsets) - 1).is_valid())
                row, *cols = find(data, offsets)
                ok = valid[row]
                if not ok.all():
                    row, cols = row[ok], [c[ok] for c in cols]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + first)), *(pa.array(c).cast(t) for c, t in zip(cols, types))], names)

    return run
