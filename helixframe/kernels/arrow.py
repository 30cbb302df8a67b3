"""Arrow string columns as one byte buffer with offsets; windows of letters as packed codes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes that a kernel takes at a time; a longer sequence is one piece

#: byte -> 0..3 for A, C, G, T, 4 for anything else
BASE = np.full(256, 4, np.uint8)
for _k, _c in enumerate(b"ACGT"):
    BASE[_c] = _k


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets has one entry more than rows, nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, count=len(col) + 1 + col.offset)[col.offset:]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(col: pa.Array, size: int = PIECE):
    """(first row, bytes, offsets) of slices of about ``size`` bytes, whole rows only."""
    data, offsets = buffer_of(col)
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1, a + 1)
        yield a, data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]
        a = z


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each position of the buffer, the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))


def window_codes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the buffer, code) of the windows of k letters that are all A, C, G or T; k is 1 to 31."""
    base = BASE[data]
    n = len(base) - k + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    part, size, code, done = base.astype(np.int64) & 3, 1, None, 0
    bits = k
    while bits:  # the code of k letters from codes of 1, 2, 4, ... letters
        if bits & 1:
            code = part[:n] if code is None else (code << (2 * size)) | part[done:done + n]
            done += size
        bits >>= 1
        if bits:
            part = (part[:-size] << (2 * size)) | part[size:]
            size *= 2
    bad = np.concatenate([[0], np.cumsum(base > 3)])
    rows = row_of(offsets)[:n]
    at = np.flatnonzero((bad[k:] == bad[:n]) & (np.arange(n) + k <= offsets[1:][rows]))
    return rows[at], at, code[at]


def code_of_word(word: str) -> int:
    """The code that ``window_codes`` gives a word."""
    w = np.frombuffer(word.encode(), np.uint8)
    return int(window_codes(w, np.array([0, len(w)]), len(w))[2][0])


def word_of_code(code: int, k: int) -> str:
    """The word of a code: the pieces of 1, 2, 4, ... letters stand in the order in which ``window_codes`` joins them."""
    return "".join("ACGT"[(code >> (2 * (k - 1 - i))) & 3] for i in range(k))
