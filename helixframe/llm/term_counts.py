"""Frequency of every distinct word: heavy-light aggregation.

Words are overlapping ``k``-letter windows, packed in one 64-bit code (two bits a
letter).  A first pass finds the heavy words; their list is broadcast (its
length is bounded, see HEAVY).  In the second pass each task counts heavy words in exact local
arrays and sends these once, as one row; the other words it pre-aggregates.  The result of that pass is stored, as both
kinds are read from it: only light words are shuffled word by word, the arrays of the
heavy ones are summed place by place, and the two tables are put together.  Both counts are exact, so which words are
heavy changes only the cost.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm.arrow import BASE, buffer_of, letters_only, row_of
from helixframe.session import stored

HEAVY = 4096         # words in the broadcast list at most, 32 KB
HEAVY_SHARE = 1e-4   # a word above this share of a task's words is heavy there
FLUSH = 4_000_000    # light words that a task holds before it sends them


def word_codes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every window of k letters that are all A, C, G or T."""
    data, offsets = letters_only(*buffer_of(texts))
    base = BASE[data]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for j in range(k):
        code = (code << 2) | base[j:j + n].astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(base > 3)])
    rows = row_of(offsets)[:n]
    ok = (bad[k:] == bad[:n]) & (np.arange(n) + k <= offsets[1:][rows])
    return rows[ok], code[ok]


def _heavy(k: int):
    def run(batches):
        held: dict[int, int] = {}
        total = 0
        for b in batches:
            codes, n = np.unique(word_codes(b.column(0), k)[1], return_counts=True)
            total += int(n.sum())
            big = np.argsort(-n, kind="stable")[:HEAVY]
            for c, x in zip(codes[big].tolist(), n[big].tolist()):
                held[c] = held.get(c, 0) + x
            if len(held) > 4 * HEAVY:
                held = dict(sorted(held.items(), key=lambda x: -x[1])[:HEAVY])
        keep = [(c, x) for c, x in held.items() if x > HEAVY_SHARE * total]
        yield pa.RecordBatch.from_pydict({"code": pa.array([c for c, _ in keep], pa.int64()), "n": pa.array([x for _, x in keep], pa.int64())})

    return run


def heavy_words(texts: DataFrame, k: int) -> np.ndarray:
    """At most HEAVY codes of frequent words, sorted."""
    found = texts.mapInArrow(_heavy(k), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return np.array(sorted(r[0] for r in found.orderBy(F.desc("n"), "code").limit(HEAVY).select("code").collect()), np.int64)


def _sorted_counts(rows: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, occurrences, rows) of one batch."""
    bits = int(rows.max(initial=0)).bit_length()
    if 2 * k + bits <= 63:
        key = np.sort((codes << bits) | rows)
        codes, new = key >> bits, np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    else:
        order = np.lexsort((rows, codes))
        rows, codes = rows[order], codes[order]
        new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])])[:len(codes)]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[:len(codes)])
    if not len(at):
        return codes, codes, codes
    return codes[at], np.diff(np.append(at, len(codes))), np.add.reduceat(new.astype(np.int64), at)


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, tf, df = (np.concatenate(x) for x in zip(*parts))
    words, at = np.unique(codes, return_inverse=True)
    return words, np.bincount(at, tf, len(words)).astype(np.int64), np.bincount(at, df, len(words)).astype(np.int64)


_PART = "code long, tf long, df long, heavy binary"


def _counts(k: int, heavy: np.ndarray):
    """Light words with their counts, and at the end of a task one row with the arrays of the heavy ones."""
    def emit(codes, tf, df, arrays=None):
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (codes, tf, df)), pa.array([arrays] * len(codes), pa.binary())], ["code", "tf", "df", "heavy"])

    def run(batches):
        counters = np.zeros((2, len(heavy)), np.int64)
        held, size = [], 0
        for b in batches:
            words, tf, df = _sorted_counts(*word_codes(b.column(0), k), k)
            if len(heavy) and len(words):
                place = np.minimum(np.searchsorted(heavy, words), len(heavy) - 1)
                hit = heavy[place] == words
                counters[0, place[hit]] += tf[hit]
                counters[1, place[hit]] += df[hit]
                words, tf, df = words[~hit], tf[~hit], df[~hit]
            held.append((words, tf, df))
            size += len(words)
            if size > FLUSH:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield emit(*held[0])
                    held, size = [], 0
        if size:
            yield emit(*_summed(held))
        if counters.any():
            yield emit([-1], [0], [0], counters.astype("<i8").tobytes())

    return run


def _heavy_sums(heavy: np.ndarray):
    def run(batches):
        total = np.zeros((2, len(heavy)), np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1)
        at = np.flatnonzero(total[0])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(heavy[at]), pa.array(total[0, at]), pa.array(total[1, at])], ["code", "tf", "df"])

    return run


def term_counts(texts: DataFrame, text_col: str, k: int = 8) -> DataFrame:
    """``(word, tf, df)``: how often each word occurs, and in how many rows.

    Defined results: only ASCII letters count, upper-cased, and words of A, C, G,
    T; null and short texts have no word; a repeated row counts each time; an
    empty table gives an empty result.  ``k`` is 1 to 31.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")
    src = texts.select(F.col(text_col).alias("t"))
    heavy = heavy_words(src, k)
    parts = stored(src.mapInArrow(_counts(k, heavy), _PART), "word-counts")
    light = parts.where("code >= 0").groupBy("code").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    # one row for each task that read them, of at most 64 KB, so few rows meet in the second step
    sums = parts.where("code < 0").select("heavy").mapInArrow(_heavy_sums(heavy), "code long, tf long, df long")
    both = light.unionByName(sums.groupBy("code").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")))
    letters = [F.substring(F.lit("ACGT"), (F.shiftright("code", 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)]
    return both.select(F.concat(*letters).alias("word"), "tf", "df")


def marked_terms(texts: DataFrame, text_col: str, k: int = 8, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """``term_counts`` with the mark ``rare``, ``common`` or null; the share is of all rows, null and empty ones too."""
    counts = term_counts(texts, text_col, k)
    most = texts.count() * common_above
    return counts.withColumn("mark", F.when(F.col("df") < rare_below, "rare").when(F.col("df") > most, "common"))
