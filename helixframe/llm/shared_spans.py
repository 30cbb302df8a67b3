"""Long exact spans shared between records: level-wise doubling.

A span of ``min_length`` letters (a *window*) has one *anchor* inside it, the short
window of the first level's length with the smallest hash.  From there a chain of sub-windows, each
twice as long as the one before, leads to the window: to the right while that fits, else as far to
the left as needed.  The chain depends on the window's letters alone, so equal windows have equal chains, and
a window one of whose sub-windows occurs in one record alone is shared with none.

The first level has 16 to 31 letters.  The neighbouring windows with one anchor are a *stretch*; its anchor is asked about
together with a hash of the whole stretch.  If all records that have the anchor have the same stretch around it, all its windows are
shared, and no more is asked about it: that is the inside of long spans.  At every further level the sub-windows of the windows still alive are
hashed (a hash of twice the length comes from two hashes of the level below), the
repeated ones found by :mod:`helixframe.llm.repeats`, and only the windows above those are extended to
twice the length, until the length asked for is reached or no candidate survives.  Many neighbouring
windows have one anchor, so the first levels send few hashes.

At the last level, whole windows are compared by 96 bits of hash (up to 31 letters by their code, without collision).

Letters are stored once, two bits each, and after every level only the records
with candidates go on.  A window that a third of all records have is one entry for each task.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.kernels.arrow import pieces
from helixframe.llm.arrow import BASE, letters_only
from helixframe.llm.near_dup import mix
from helixframe.llm.repeats import ONE, SEVERAL, Replies, by_task, numbered, repeated
from helixframe.session import stored

_ROWS = "id long, n int, codes binary, others binary, live binary, found binary"
PIECE = 1 << 17  # letters that are worked on at a time; a longer record is one piece
_GOLD = np.uint64(0x9E3779B97F4A7C15)


#: byte -> its four letters
_FOUR = ((np.arange(256, dtype=np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).astype(np.uint8)


def levels(length: int) -> list[int]:
    """The lengths of the levels: halves of ``length`` down to below 32 letters, doubled again."""
    first = length
    while first > 31:
        first = (first + 1) // 2 if first % 2 == 0 else first // 2
    out = [first]
    while 2 * out[-1] < length:
        out.append(2 * out[-1])
    return out + [length] if out[-1] != length else out


def _runs(on: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of a mask, end excluded, as one flat array."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return edge.astype("<i4")


class Text:
    """The records of a batch as one row of letters, each closed by a letter that no window crosses."""

    def __init__(self, batch: pa.RecordBatch, rows: np.ndarray, length: int):
        self.length, self.rows = length, rows
        take = batch.take(pa.array(rows))
        sizes = np.asarray(take.column("n")).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        total = int(self.offsets[-1])
        self.base = np.full(total, 4, np.uint8)
        self.live, self.found = np.ones(total, bool), np.zeros(total, bool)
        for k, (n, codes, others, live, found) in enumerate(zip(sizes.tolist(), *(take.column(c) for c in ("codes", "others", "live", "found")))):
            x = np.frombuffer(codes.as_buffer(), np.uint8)
            at = int(self.offsets[k])
            here = self.base[at:at + n]
            here[:] = _FOUR[x].ravel()[:n]
            for mask, value, spans in ((here, 4, others), (self.live[at:at + n], True, live), (self.found[at:at + n], True, found)):
                if spans.is_valid:
                    if mask is not here:
                        mask[:] = False
                    for a, z in np.frombuffer(spans.as_buffer(), "<i4").reshape(-1, 2).tolist():
                        mask[a:z] = value
        self.live &= self.clean(length)
        self.row = np.repeat(np.arange(len(rows)), sizes + 1)
        self.hashes: dict[int, np.ndarray] = {}

    def clean(self, length: int) -> np.ndarray:
        """Where a window of A, C, G, T alone begins."""
        bad = np.concatenate([[0], np.cumsum(self.base > 3)])
        ok = np.zeros(len(self.base), bool)
        n = len(self.base) - length + 1
        if n > 0:
            ok[:n] = bad[length:] == bad[:n]
        return ok

    def hash_of(self, length: int) -> np.ndarray:
        """Hash of the ``length`` letters that begin at each position; up to 31 letters without collision."""
        if length not in self.hashes:
            n = max(len(self.base) - length + 1, 0)
            if length <= 31:
                part, size, code, done, bits = self.base.astype(np.uint64) & np.uint64(3), 1, None, 0, length
                while bits and n:
                    if bits & 1:
                        code = part[:n] if code is None else (code << np.uint64(2 * size)) | part[done:done + n]
                        done += size
                    bits >>= 1
                    if bits:
                        part = (part[:-size] << np.uint64(2 * size)) | part[size:]
                        size *= 2
                h = mix(code + _GOLD) if n else np.zeros(0, np.uint64)
            else:  # two windows of a level below, which may overlap
                half = next(x for x in levels(length)[::-1] if x < length)
                h = self.hash_of(half)
                h = mix(mix(h[:n] + _GOLD) * _GOLD + h[length - half:length - half + n])
            self.hashes[length] = h
        return self.hashes[length]

    def anchors(self, first: int) -> np.ndarray:
        """Start of the anchor in each window: the first of the smallest hashes."""
        h = self.hash_of(first)
        w, size, at = self.length - first + 1, 1, np.arange(len(h))
        while 2 * size <= w:
            a, b = at[:-size], at[size:]
            at = np.where(h[a] <= h[b], a, b)
            size *= 2
        if rest := w - size:
            a, b = at[:len(at) - rest], at[rest:]
            at = np.where(h[a] <= h[b], a, b)
        return at

    def chain(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows alive, start of their sub-window of level ``upto``)."""
        ls = levels(self.length)
        at = np.flatnonzero(self.live)
        s = self.anchors(ls[0])[at] if len(at) else at
        for x in ls[1:upto + 1]:
            s = np.minimum(s, at + self.length - x)
        return at, s

    def state(self, mask: np.ndarray) -> list[bytes]:
        """The runs of a mask of windows, by record."""
        return [_runs(mask[a:z - 1]).tobytes() for a, z in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]


def _second(h: np.ndarray) -> np.ndarray:
    return np.zeros(len(h), np.uint32)


def _wide(text: Text, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for whole windows: the second hash takes the parts in another way."""
    ls = levels(text.length)
    h = text.hash_of(text.length)[at]
    if len(ls) == 1:
        return h, _second(h)  # the first hash has no collision
    x, k = text.hash_of(ls[0]), ls[0]
    g = np.zeros(len(at), np.uint64)
    for j in [*range(0, text.length - k, k), text.length - k]:
        g = mix(g * np.uint64(0xD6E8FEB86659FD93) + x[at + j])
    return h, (g >> np.uint64(32)).astype(np.uint32)


def _pick(text: Text, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows alive, starts of their distinct sub-windows, which of these each has, their hashes h and g)."""
    ls = levels(text.length)
    if level == len(ls) - 1:
        at = np.flatnonzero(text.live)
        return at, at, np.arange(len(at)), *_wide(text, at)
    at, s = text.chain(level)
    starts, index = np.unique(s, return_inverse=True)
    h = text.hash_of(ls[level])[starts] if len(starts) else np.zeros(0, np.uint64)
    return at, starts, index, h, _second(h) if level or not len(at) else _stretch(text, at, starts, index)


def _stretch(text: Text, at: np.ndarray, starts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A hash of all letters of the windows that have one anchor, and of the anchor's place among them."""
    k = levels(text.length)[0]
    x = text.hash_of(k)
    first = np.full(len(starts), len(text.base))
    last = np.zeros(len(starts), np.int64)
    np.minimum.at(first, index, at)
    np.maximum.at(last, index, at)
    size = last + text.length - first
    g = mix(((starts - first) * 65_536 + size).astype(np.uint64))
    for j in range(0, int(size.max()) - k + 1, k):
        g = np.where(j + k <= size, mix(g * _GOLD + x[np.minimum(first + j, len(x) - 1)]), g)
    return (mix(g * _GOLD + x[first + size - k]) >> np.uint64(32)).astype(np.uint32)


def _by_piece(batch: pa.RecordBatch):
    """(p, row numbers) of a batch, in pieces whose arrays stay in the processor's cache."""
    sizes = np.asarray(batch.column("n")).astype(np.int64)
    for p, rows in by_task(batch):
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // PIECE)) + 1):
            yield p, part


def _ask(length: int, level: int):
    def hashes(batch):
        for p, rows in _by_piece(batch):
            text = Text(batch, rows, length)
            _, starts, _, h, g = _pick(text, level)
            yield p, h, g, text.row[starts]

    return hashes


def _apply(length: int, level: int, folder: str):
    """The records in which windows stay alive or are found to be shared, with these."""
    last = len(levels(length)) - 1

    def run(batches):
        replies = Replies(folder)
        for b in batches:
            for p, rows in _by_piece(b):
                text = Text(b, rows, length)
                at, _, index, h, g = _pick(text, level)
                if level == last:
                    text.found[at] = replies.has(p, h, g)
                    text.live[:] = False
                elif level == 0:
                    kind = replies.kind(p, h)[index]
                    text.found[at] = kind == ONE
                    text.live[at] = kind == SEVERAL
                else:
                    text.live[at] = replies.has(p, h, g)[index]
                live, found = text.state(text.live), text.state(text.found)
                out = b.take(pa.array(rows))
                for name, value in (("live", live), ("found", found)):
                    out = out.set_column(out.schema.get_field_index(name), name, pa.array(value, pa.binary()))
                yield out.filter(pa.array([bool(x or y) for x, y in zip(live, found)]))

    return run


def _packed(length: int):
    """The letters of each text long enough, two bits each, and the runs of letters other than A, C, G, T."""
    def run(batches):
        for b in batches:
            keep, codes, others, sizes = [], [], [], []
            for first, data, offsets in pieces(b.column(1), PIECE):
                data, offsets = letters_only(data, offsets)
                base = BASE[data]
                for k, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()), first):
                    if z - a >= length:
                        x = np.zeros(-(z - a) % 4 + z - a, np.uint8)
                        x[:z - a] = base[a:z] & 3
                        keep.append(k)
                        sizes.append(z - a)
                        codes.append(((x[0::4] << 6) | (x[1::4] << 4) | (x[2::4] << 2) | x[3::4]).tobytes())
                        others.append(_runs(base[a:z] > 3).tobytes())
            none = pa.nulls(len(keep), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int32()), pa.array(codes, pa.binary()), pa.array(others, pa.binary()), none, none], ["id", "n", "codes", "others", "live", "found"]
            )

    return run


def _covered(length: int):
    def run(batches):
        for b in batches:
            rows, starts, ends = [], [], []
            for k, found in enumerate(b.column("found")):
                at = np.frombuffer(found.as_buffer(), "<i4").reshape(-1, 2)  # runs of window starts
                if not len(at):
                    continue
                cut = np.flatnonzero(at[1:, 0] > at[:-1, 1] - 1 + length)
                a, z = at[np.concatenate([[0], cut + 1]), 0] + 1, at[np.append(cut, len(at) - 1), 1] - 1 + length
                rows += [k] * len(a)
                starts += a.tolist()
                ends += z.tolist()
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "start_pos", "end_pos"])

    return run


def shared_spans(df: DataFrame, id_col: str, text_col: str, min_length: int = 50) -> DataFrame:
    """``(id, start_pos, end_pos)``: the maximal runs of positions covered by windows of ``min_length`` letters that also occur in another row.

    Windows are of A, C, G, T only; positions count the ASCII letters of the text.

    Defined results: null, empty and short texts give no run; a repeated row
    shares all its windows with its copy, and each gives its runs; rows with a null id are left out; other
    columns are not carried, so none clash; an empty table gives an empty result.
    """
    if min_length < 1:
        raise ValueError("min_length must be at least 1")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where((F.length("t") >= min_length) & F.col("id").isNotNull())
    rows = stored(numbered(rows.mapInArrow(_packed(min_length), _ROWS)), "letters")
    schema = f"{_ROWS}, p int"
    last = len(levels(min_length)) - 1
    for level in range(last + 1):
        folder = repeated(rows, _ask(min_length, level), by_first=level == 0 < last)
        rows = rows.mapInArrow(_apply(min_length, level, folder), f"{_ROWS}, p int")
        if level < last:
            rows = stored(rows, "candidates")
            if rows.isEmpty():  # no candidate survives
                return rows.selectExpr("id", "n as start_pos", "n as end_pos")
    return rows.mapInArrow(_covered(min_length), "id long, start_pos int, end_pos int")
