"""Pattern matching over many subjects.

``choose`` is the planner: exact counts stay in the JVM's regular expressions; exact places,
mismatches, ambiguity letters and indels go to Arrow kernels that search all texts of a batch together.
Subjects longer than ``TILE`` letters are cut into tiles first, so one chromosome does not become one task, and
views or the unmasked parts of subjects are searched as the separate texts they are.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.functions.counting import count_pattern
from helixframe.kernels import matching as M, search
from helixframe.kernels.arrow import pieces
from helixframe.session import spread

TILE = 4_000_000  # letters of a subject that one task searches
MATCHES = "subject_id long, start int, end int"
_ALL = 2**31 - 1


def choose(max_mismatch: int, min_mismatch: int, indels: bool, fixed: tuple[bool, bool]) -> str:
    if indels:
        if min_mismatch:
            raise ValueError("min_mismatch goes only without indels")
        return "indels"
    return "exact" if max_mismatch == min_mismatch == 0 and fixed == (True, True) else "hamming"


def parts_of(df: DataFrame, id_col: str, seq_col: str, ranges: DataFrame | None = None, overlap: int = 0, core: int | None = None) -> DataFrame:
    """``(subject_id, part, shift, low, high)``: what is searched as one text.

    ``shift`` letters of the subject stand before the part; a hit counts if its start in the part is from ``low`` to ``high``, so a hit
    in the overlap of two tiles comes once.  ``ranges(subject_id, start, end)``, clipped to their subject, are parts of their own.
    """
    x = df.where(F.col(seq_col).isNotNull()).select(F.col(id_col).cast("long").alias("subject_id"), F.col(seq_col).alias("part"))
    if ranges is not None:
        r = ranges.select(F.col("subject_id").cast("long"), F.greatest(F.col("start"), F.lit(1)).alias("a"), F.col("end").alias("z"))
        x = x.join(r, "subject_id").withColumn("z", F.least("z", F.length("part"))).where("z >= a")
        x = x.select("subject_id", F.col("part").substr(F.col("a"), F.col("z") - F.col("a") + 1).alias("part"), (F.col("a") - 1).cast("int").alias("shift"))
    else:
        x = x.withColumn("shift", F.lit(0))
    if core is None:
        return x.select("subject_id", "part", "shift", F.lit(-_ALL).alias("low"), F.lit(_ALL).alias("high"))
    n = F.greatest(F.ceil(F.length("part") / core), F.lit(1)).cast("int")
    x = x.select("subject_id", "part", "shift", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("t"))
    at = F.col("t") * core
    part = F.when(F.col("n") == 1, F.col("part")).otherwise(F.col("part").substr(at + 1, F.lit(core + overlap)))
    return x.select(
        "subject_id", part.alias("part"), (F.col("shift") + at).cast("int").alias("shift"),
        F.when(F.col("t") == 0, F.lit(-_ALL)).otherwise(F.lit(1)).alias("low"), F.when(F.col("t") == F.col("n") - 1, F.lit(_ALL)).otherwise(F.lit(core)).alias("high"),
    )


def _search(parts: DataFrame, find, more: dict[str, pa.DataType] | None = None) -> DataFrame:
    """``find(data, offsets) -> (row, start, end, ...)`` over the parts; places are counted in the subject."""
    more = more or {}
    names = ["subject_id", "start", "end", *more]

    def run(batches):
        for b in batches:
            shift, low, high = (np.asarray(b.column(i)).astype(np.int64) for i in (2, 3, 4))
            for first, data, offsets in pieces(b.column(1)):
                row, start, end, *rest = find(data, offsets)
                row = row + first
                ok = (start >= low[row]) & (start <= high[row])
                row, start, end, rest = row[ok], start[ok], end[ok], [x[ok] for x in rest]
                cols = [b.column(0).take(pa.array(row)), pa.array((start + shift[row]).astype(np.int32)), pa.array((end + shift[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x).cast(t) for x, t in zip(rest, more.values()))], names)

    schema = MATCHES + "".join(f", {k} {'double' if pa.types.is_floating(t) else 'int'}" for k, t in more.items())
    return spread(parts).mapInArrow(run, schema)


def _find_exact(pattern: str):
    """All overlapping occurrences, by searching the buffer of a batch as one text."""
    wanted = pattern.encode()

    def places(text: bytes):
        at = text.find(wanted)
        while at >= 0:
            yield at
            at = text.find(wanted, at + 1)

    def find(data, offsets):
        at = np.fromiter(places(data.tobytes()), np.int64)
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + len(wanted) <= offsets[row + 1] if len(at) else np.zeros(0, bool)
        at, row = at[inside], row[inside]
        start = at - offsets[row] + 1
        if len(data) and data.max() > 127:  # places count characters, not bytes
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            start = chars[at] - chars[offsets[row]] + 1
        return row, start, start + len(pattern) - 1

    return find


def _finder(pattern: str, kind: str, max_mismatch: int, min_mismatch: int, fixed):
    if kind == "exact":
        return _find_exact(pattern)
    if kind == "indels":
        return lambda data, offsets: search.indels(data, offsets, pattern, max_mismatch, fixed)

    def find(data, offsets):
        row, start = search.hamming(data, offsets, pattern, max_mismatch, min_mismatch, fixed)
        return row, start, start + len(pattern) - 1

    return find


def match_pattern(df: DataFrame, id_col: str, seq_col: str, pattern: str, max_mismatch: int = 0, min_mismatch: int = 0, indels: bool = False, fixed=(True, True), ranges: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """``(subject_id, start, end)``: all occurrences, overlapping ones too; inexact hits may hang off the ends.

    With ``ranges(subject_id, start, end)`` only these parts of the subjects are searched, each for itself: views, or what a
    mask leaves (``intervals.gaps``).  Places are those of the subject.  Subjects longer than ``tile`` letters (``TILE`` if not given) are cut into tiles, but not for indels, where what is the best
    match depends on its surroundings.

    Null subjects give no row, empty ones only hits that hang off; an empty pattern is an error.
    """
    if not pattern:
        raise ValueError("the pattern is empty")
    kind = choose(max_mismatch, min_mismatch, indels, fixed)
    parts = parts_of(df, id_col, seq_col, ranges, len(pattern) - 1 + max_mismatch, None if kind == "indels" else tile or TILE)
    return _search(parts, _finder(pattern, kind, max_mismatch, min_mismatch, fixed))


def count_matches(df: DataFrame, id_col: str, seq_col: str, pattern: str, max_mismatch: int = 0, min_mismatch: int = 0, indels: bool = False, fixed=(True, True)) -> DataFrame:
    """``(subject_id, n)`` for every subject, zeros included; null for null subjects."""
    kind = choose(max_mismatch, min_mismatch, indels, fixed)
    if kind == "exact":
        return df.select(F.col(id_col).cast("long").alias("subject_id"), count_pattern(pattern, seq_col).cast("long").alias("n"))
    find = _finder(pattern, kind, max_mismatch, min_mismatch, fixed)

    def run(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for first, data, offsets in pieces(b.column(1)):
                row = find(data, offsets)[0]
                n[first:first + len(offsets) - 1] = np.bincount(row, minlength=len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, mask=~np.asarray(b.column(1).is_valid()))], ["subject_id", "n"])

    return spread(df.select(F.col(id_col).cast("long"), seq_col)).mapInArrow(run, "subject_id long, n long")


def edits_at(df: DataFrame, id_col: str, seq_col: str, pattern: str, places: list[int], ending: bool = False, fixed=(True, True)) -> DataFrame:
    """``(subject_id, at, edits)``: edit distance of the pattern to the best stretch that begins (``ending``: ends) at each place.

    Places may lie off the subject.  Null subjects give no row; an empty pattern has distance 0.
    """
    p = search.as_bytes(pattern[::-1] if ending else pattern)
    m = len(p)

    def run(batches):
        for b in batches:
            for first, data, offsets in pieces(b.column(1)):
                data, offsets = search.one_byte_letters(data, offsets)
                rows, n = np.arange(len(offsets) - 1), np.diff(offsets)
                for at in places:
                    start = n - at + 1 if ending else np.full(len(n), at)
                    i = np.maximum(start, 1)[:, None] - 1 + np.arange(2 * m)[None, :]
                    inside = i < n[:, None]
                    i = np.where(inside, (offsets[1:, None] - 1 - i) if ending else (offsets[:-1, None] + i), 0)
                    text = np.where(inside, data[i] if len(data) else 0, search.FENCE).astype(np.uint8)
                    d = search.edits_from(text, p, fixed)
                    d = np.where(start < 1, np.minimum(m, d + 1 - start), d)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows + first)), pa.array(np.full(len(rows), at, np.int32)), pa.array(d.astype(np.int32))], ["subject_id", "at", "edits"])

    x = df.where(F.col(seq_col).isNotNull()).select(F.col(id_col).cast("long"), seq_col)
    return spread(x).mapInArrow(run, "subject_id long, at int, edits int")


def palindromes(df: DataFrame, id_col: str, seq_col: str, ranges: DataFrame | None = None, **options) -> DataFrame:
    """``(subject_id, start, end)`` of maximal palindromes; options as in the kernel.  Null and empty subjects give no row."""
    return _search(parts_of(df, id_col, seq_col, ranges), lambda data, offsets: search.palindromes(data, offsets, **options))


def trim_patterns(df: DataFrame, id_col: str, seq_col: str, left: str = "", right: str = "", **options) -> DataFrame:
    """``(subject_id, start, end)`` of what is left of each subject once flanking patterns are cut; null subjects give no row."""
    def find(data, offsets):
        return (np.arange(len(offsets) - 1), *search.trim(data, offsets, left, right, **options))

    return _search(parts_of(df, id_col, seq_col), find)


def match_pwm(df: DataFrame, id_col: str, seq_col: str, pwm, min_score: float | str = "80%", with_score: bool = False, ranges: DataFrame | None = None) -> DataFrame:
    """``(subject_id, start, end[, score])``: places whose score reaches the threshold (a number, or a share of the best score)."""
    pwm = np.asarray(pwm, float)
    least = float(min_score[:-1]) / 100 * M.max_score(pwm) if isinstance(min_score, str) else float(min_score)
    k = pwm.shape[1]

    def find(data, offsets):
        row, start, score = search.pwm(data, offsets, pwm, least)
        return (row, start, start + k - 1) + ((score,) if with_score else ())

    return _search(parts_of(df, id_col, seq_col, ranges, k - 1, TILE), find, {"score": pa.float64()} if with_score else None)


def count_pwm(df: DataFrame, id_col: str, seq_col: str, pwm, min_score: float | str = "80%") -> DataFrame:
    """``(subject_id, n)`` of the subjects with a hit."""
    return match_pwm(df, id_col, seq_col, pwm, min_score).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


def pwm_score_at(df: DataFrame, id_col: str, seq_col: str, pwm, starts: list[int]) -> DataFrame:
    """``(subject_id, start, score)``: null where the matrix doesn't fit inside the subject."""
    pwm = np.asarray(pwm, float)
    s, k = F.col(seq_col), pwm.shape[1]
    weight = lambda j, x: F.when(x == "A", float(pwm[0, j])).when(x == "C", float(pwm[1, j])).when(x == "G", float(pwm[2, j])).when(x == "T", float(pwm[3, j])).otherwise(0.0)
    rows = []
    for a in starts:
        total = F.lit(0.0)
        for j in range(k):
            total = total + weight(j, F.substring(s, a + j, 1))
        rows.append(F.struct(F.lit(a).alias("start"), F.when((F.lit(a) >= 1) & (F.lit(a + k - 1) <= F.length(s)), total).alias("score")))
    return df.select(F.col(id_col).cast("long").alias("subject_id"), F.inline(F.array(*rows)))


def partial_matches(df: DataFrame, id_col: str, seq_col: str, pattern: str, max_out: int = 1) -> DataFrame:
    """``(subject_id, p_start, p_end, s_start, s_end)``: the longest exact stretches that pattern and subject share."""
    names = ["p_start", "p_end", "s_start", "s_end"]
    run = search.over(lambda data, offsets: search.partial(data, offsets, pattern, max_out), ["subject_id", *names], [pa.int32()] * 4)
    return spread(df.select(F.col(id_col).cast("long"), seq_col)).mapInArrow(run, "subject_id long, p_start int, p_end int, s_start int, s_end int")


def lr_pairs(left_hits: DataFrame, right_hits: DataFrame, max_gap: int) -> DataFrame:
    """``(subject_id, start, end)``: every left hit with every right hit that begins 0..max_gap letters behind it.

    A range join by hand: both sides are put in bins of the gap's width, so the join is an
    equi-join on (subject, bin) with the exact condition behind it.
    """
    width = max(max_gap + 1, 1)
    left = left_hits.select("subject_id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    left = left.withColumn("bin", F.explode(F.array(F.floor((F.col("l_end") + 1) / width), F.floor((F.col("l_end") + 1) / width) + 1)))
    right = right_hits.select("subject_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")).withColumn("bin", F.floor(F.col("r_start") / width))
    gap = F.col("r_start") - F.col("l_end") - 1
    return left.join(right, ["subject_id", "bin"]).where(gap.between(0, max_gap)).select("subject_id", F.col("l_start").alias("start"), F.col("r_end").alias("end"))


def probe_pairs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """``(subject_id, start, end)``: minimal amplicons - each end with the last start before it, if no other end lies between.

    ``starts(subject_id, start)`` and ``ends(subject_id, end)``; an as-of join as a window over both sides.
    """
    from pyspark.sql import Window

    events = starts.select("subject_id", F.col("start").alias("pos"), F.lit(0).alias("kind")).unionByName(ends.select("subject_id", F.col("end").alias("pos"), F.lit(1).alias("kind"))).distinct()
    w = Window.partitionBy("subject_id").orderBy("pos", "kind")
    prev = events.withColumn("prev_kind", F.lag("kind").over(w)).withColumn("prev_pos", F.lag("pos").over(w))
    return prev.where("kind = 1 and prev_kind = 0").select("subject_id", F.col("prev_pos").alias("start"), F.col("pos").alias("end"))
