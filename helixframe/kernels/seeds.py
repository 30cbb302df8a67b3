"""Dictionary matching: look up the seeds of all patterns, then compare the rest in place."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from helixframe.kernels import search
from helixframe.kernels.arrow import code_of_word, pieces, window_codes

MAX_SEED = 31   # letters of a seed; what a band has beyond them is compared with the rest
_PLAIN = re.compile("[ACGT]+")


class AmbiguousBand(ValueError):
    """A trusted band may hold plain bases only."""


def seeds_of(pattern: str, max_mismatch: int, band: tuple[int, int] | None) -> list[tuple[int, str]] | None:
    """(place, letters) of the seeds, one of which every match has unchanged; null if the pattern has none.

    With a band (start, width) that is its seed.  Otherwise the pattern is cut in ``max_mismatch`` + 1 parts, at least one of which is
    free of mismatches, and the longest plain stretch of each is a seed.
    """
    if band is not None:
        start, width = band
        letters = pattern[start - 1:start - 1 + width]
        if not _PLAIN.fullmatch(letters):
            raise AmbiguousBand(f"trusted band {letters} holds other letters than A, C, G, T")
        return [(start, letters[:MAX_SEED])]
    n, parts = len(pattern), max_mismatch + 1
    out = []
    for i in range(parts):
        a, z = n * i // parts, n * (i + 1) // parts
        plain = max(_PLAIN.finditer(pattern, a, z), key=lambda m: m.end() - m.start(), default=None)
        if plain is None:
            return None
        out.append((plain.start() + 1, plain.group()[:MAX_SEED]))
    return out


class SeedIndex:
    """The seeds of a dictionary, by width: sorted codes with the patterns and places they stand for."""

    def __init__(self, patterns: list[tuple[int, str, tuple[int, int] | None]], max_mismatch: int = 0, fixed: tuple[bool, bool] = (True, True), with_indels: bool = False):
        """``patterns``: (pattern id, pattern, trusted band or null)."""
        self.ids = np.array([pid for pid, _, _ in patterns], np.int64)
        self.lengths = np.array([len(p) for _, p, _ in patterns], np.int64)
        self.max_mismatch, self.fixed, self.with_indels = max_mismatch, fixed, with_indels
        self.letters = np.zeros((len(patterns), int(self.lengths.max(initial=1))), np.uint8)
        self.band = np.zeros((len(patterns), 2), np.int64)
        self.direct: list[tuple[int, str]] = []   # patterns that are laid on every place
        by_width: dict[int, list[tuple[int, int, int]]] = {}
        for no, (_, p, band) in enumerate(patterns):
            self.letters[no, :len(p)] = search.as_bytes(p)
            seeds = seeds_of(p, max_mismatch, band)
            if band is not None:
                self.band[no] = band[0] - 1, band[0] - 1 + band[1]
            if with_indels or seeds is None or not fixed[1]:
                self.direct.append((no, p))
            else:
                for at, letters in seeds:
                    by_width.setdefault(len(letters), []).append((code_of_word(letters), no, at))
        self.seeds = {}
        for w, rows in by_width.items():
            a = np.array(sorted(rows), np.int64)
            codes, first, n = np.unique(a[:, 0], return_index=True, return_counts=True)
            self.seeds[w] = (codes, first, n, a[:, 1], a[:, 2])

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, pattern number, start, end) of the patterns within the mismatches; letters off the subject are mismatches."""
        data, offsets = search.one_byte_letters(data, offsets)
        out = []
        for w, (codes, first, n, owner, place) in self.seeds.items():
            rows, at, code = window_codes(data, offsets, w)
            k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = np.flatnonzero(codes[k] == code)
            k, rows, at = k[hit], rows[hit], at[hit]
            times = n[k]
            which = np.repeat(first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            no, begin = owner[which], np.repeat(at, times) - place[which] + 1
            row = np.repeat(rows, times)
            ok = self._matches(data, offsets, row, no, begin)
            out.append((row[ok], no[ok], begin[ok] - offsets[row[ok]] + 1, begin[ok] - offsets[row[ok]] + self.lengths[no[ok]]))
        for no, p in self.direct:
            if self.with_indels:
                row, start, end = search.indels(data, offsets, p, self.max_mismatch, self.fixed)
            else:
                row, start = search.hamming(data, offsets, p, self.max_mismatch, 0, self.fixed)
                number = np.full(len(row), no)
                ok = self._matches(data, offsets, row, number, offsets[row] + start - 1)
                row, start = row[ok], start[ok]
                end = start + len(p) - 1
            out.append((row, np.full(len(row), no), start, end))
        if not out:
            e = np.zeros(0, np.int64)
            return e, e, e, e
        row, no, start, end = (np.concatenate(x) for x in zip(*out))
        if len(row):  # a place may be found through several seeds
            order = np.lexsort((end, start, no, row))
            row, no, start, end = row[order], no[order], start[order], end[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (no[1:] != no[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
            row, no, start, end = row[new], no[new], start[new], end[new]
        return row, no, start, end

    def _matches(self, data, offsets, row, no, begin) -> np.ndarray:
        """Within the mismatches, and none of them in the band."""
        low, high = offsets[row], offsets[row + 1]
        bad, in_band = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
        for j in range(int(self.lengths[no].max(initial=0))):
            p = begin + j
            inside = (p >= low) & (p < high)
            text, letter = (data[np.where(inside, p, 0)] if len(data) else np.zeros(len(p), np.uint8)), self.letters[no, j]
            if self.fixed == (True, True):
                same = text == letter
            else:
                a, b = search.CODE[letter].astype(np.int16), search.CODE[text].astype(np.int16)
                same = (a & ~b) == 0 if self.fixed == (True, False) else (~a & b) == 0 if self.fixed == (False, True) else (a & b) != 0
            miss = (j < self.lengths[no]) & ~(inside & same)
            bad += miss
            in_band |= miss & (j >= self.band[no, 0]) & (j < self.band[no, 1])
        return (bad <= self.max_mismatch) & ~in_band


def look_up(index):
    """A mapInArrow function over (subject_id, part, shift, low, high)."""
    def run(batches):
        ix = index.value
        for b in batches:
            shift, low, high = (np.asarray(b.column(i)).astype(np.int64) for i in (2, 3, 4))
            for first, data, offsets in pieces(b.column(1)):
                row, no, start, end = ix.find(data, offsets)
                row = row + first
                ok = (start >= low[row]) & (start <= high[row])
                row, no, start, end = row[ok], no[ok], start[ok] + shift[row[ok]], end[ok] + shift[row[ok]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ix.ids[no]), b.column(0).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["pattern_id", "subject_id", "start", "end"]
                )

    return run


def seed_windows(widths: list[int]):
    """``(w, code, part_id, pos)``: the code of every window of the given widths, without any text."""
    def run(batches):
        for b in batches:
            for first, data, offsets in pieces(b.column(1)):
                data, offsets = search.one_byte_letters(data, offsets)
                for w in widths:
                    rows, at, code = window_codes(data, offsets, w)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(code), w, np.int32)), pa.array(code), b.column(0).take(pa.array(rows + first)), pa.array((at - offsets[rows] + 1).astype(np.int32))], ["w", "code", "part_id", "pos"]
                    )

    return run


def verify_rows(max_mismatch: int, fixed: tuple[bool, bool]):
    """Keep the candidates ``(pattern_id, pattern, band_start, band_width, subject_id, start, text, before)`` that match; ``before`` letters of the pattern lie before the text."""
    def run(batches):
        for b in batches:
            patterns, texts = b.column("pattern").to_pylist(), b.column("text").to_pylist()
            bands = [None if s is None else (s, w) for s, w in zip(b.column("band_start").to_pylist(), b.column("band_width").to_pylist())]
            keys = list(zip(patterns, bands))
            numbers = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            ix = SeedIndex([(i, p, band) for (p, band), i in numbers.items()], max_mismatch, fixed)
            blocks = [search.as_bytes(t or "") for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype(np.int64)
            data = np.concatenate(blocks) if blocks else np.zeros(0, np.uint8)
            rows = np.arange(len(texts))
            begin = offsets[:-1] - np.asarray(b.column("before")).astype(np.int64)  # the text begins where the pattern does, or behind
            ok = ix._matches(data, offsets, rows, np.array([numbers[k] for k in keys], np.int64), begin) if len(rows) else np.zeros(0, bool)
            yield b.filter(pa.array(ok)).select(["pattern_id", "subject_id", "start", "end"])

    return run
