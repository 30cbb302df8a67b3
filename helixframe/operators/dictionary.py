"""Dictionaries of patterns against sets of subjects: seed and verify.

A dictionary row has a *trusted band*, which must match exactly and may hold plain bases only; the mismatches
allowed go to the flanks.  With ``max_mismatch = k`` and no given band, each
pattern is cut into k + 1 parts, one of which must match exactly if at most k
letters differ.  The windows of the subjects are looked up among these seeds (up to 31 letters of each), and the
whole pattern, of any width, is compared at the place found.

While a dictionary has at most ``BROADCAST_ROWS`` patterns (some tens of MB), its index is broadcast to an Arrow kernel:
no shuffle and no row for each window.  A larger one is joined on the codes of its seeds with the codes of the
windows; the subjects' letters are joined to the candidates only.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.kernels.arrow import code_of_word
from helixframe.kernels.seeds import SeedIndex, look_up, seed_windows, seeds_of, verify_rows
from helixframe.operators.matching import TILE, parts_of
from helixframe.operators.skew import join_groups
from helixframe.session import spread, stored

BROADCAST_ROWS = 200_000
_FOUND = "pattern_id long, subject_id long, start int, end int"


def dedup_patterns(d: DataFrame, id_col: str, pattern_col: str) -> tuple[DataFrame, DataFrame]:
    """``distinct(pattern_id, pattern)`` with the smallest id of each pattern, and ``members(pattern_id, member_id)``."""
    rows = d.where(F.col(pattern_col).isNotNull() & (F.col(pattern_col) != "")).select(F.col(id_col).cast("long").alias("member_id"), F.col(pattern_col).alias("pattern"))
    groups = rows.groupBy("pattern").agg(F.min("member_id").alias("pattern_id"), F.count(F.lit(1)).alias("n"))
    members = join_groups(rows.select("member_id", F.xxhash64("pattern").alias("h"), "pattern"), groups.withColumn("h", F.xxhash64("pattern")), ["h", "pattern"], "n")
    return groups.select("pattern", "pattern_id"), members.select("pattern_id", "member_id")


def pattern_frequency(d: DataFrame, id_col: str, pattern_col: str) -> DataFrame:
    """``(pattern_id, n)``: the size of the group of equal patterns each row is in; null patterns drop out."""
    rows = d.select(F.col(id_col).alias("pattern_id"), F.col(pattern_col).alias("p")).where("p is not null")
    return join_groups(rows, rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")), ["p"], "n").select("pattern_id", "n")


def match_dictionary(
    dictionary: DataFrame, subjects: DataFrame, id_col: str, seq_col: str, max_mismatch: int = 0, tb_start: str | None = None, tb_width: str | None = None,
    fixed: tuple[bool, bool] = (True, True), indels: bool = False, ranges: DataFrame | None = None,
) -> DataFrame:
    """``(pattern_id, subject_id, start, end)`` of ``dictionary(pattern_id, pattern[, band columns])`` in the subjects.

    Flanks may hang off the subject if their letters are within the mismatches allowed.  ``fixed`` says whether ambiguity letters of
    patterns and subjects stand for themselves; ``indels`` counts edits instead of mismatches (best local matches, without bands).
    ``ranges(subject_id, start, end)`` are searched instead of whole subjects: views, or what a mask leaves.

    Null subjects and patterns, empty patterns and rows whose band lies outside the pattern give no row; an ambiguity letter in a
    trusted band is an error.
    """
    if indels and tb_start is not None:
        raise ValueError("a trusted band goes only without indels")
    spark = subjects.sparkSession
    d = dictionary.where("pattern is not null and pattern <> ''")
    if tb_start is not None:
        start, width = F.col(tb_start).cast("int"), F.col(tb_width).cast("int")
        d = d.where((start >= 1) & (width >= 1) & (start + width - 1 <= F.length("pattern"))).select("pattern_id", "pattern", start.alias("band_start"), width.alias("band_width"))
    else:
        d = d.select("pattern_id", "pattern", F.lit(None).cast("int").alias("band_start"), F.lit(None).cast("int").alias("band_width"))
    listed = d.limit(BROADCAST_ROWS + 1).collect()
    reach = max((len(r["pattern"]) for r in listed), default=1) + max_mismatch - 1
    if len(listed) > BROADCAST_ROWS:
        return _join_seeds(d, subjects, id_col, seq_col, max_mismatch, fixed, indels, ranges)
    index = SeedIndex([(r["pattern_id"], r["pattern"], None if r["band_start"] is None else (r["band_start"], r["band_width"])) for r in listed], max_mismatch, fixed, indels)
    parts = parts_of(subjects, id_col, seq_col, ranges, reach, None if indels else max(TILE, reach))
    return spread(parts).mapInArrow(look_up(spark.sparkContext.broadcast(index)), _FOUND)


def _seed_rows(max_mismatch: int):
    """One row for each seed of a pattern; width 0 for a pattern that has none."""
    def run(batches):
        for b in batches:
            rows, widths, codes, places = [], [], [], []
            for i, (p, start, width) in enumerate(zip(*(b.column(c).to_pylist() for c in ("pattern", "band_start", "band_width")))):
                seeds = seeds_of(p, max_mismatch, None if start is None else (start, width))
                for at, x in [(0, "")] if seeds is None else seeds:
                    rows.append(i)
                    widths.append(len(x))
                    codes.append(code_of_word(x) if x else 0)
                    places.append(at)
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(widths, pa.int32()), pa.array(codes, pa.int64()), pa.array(places, pa.int32())], [*kept.schema.names, "w", "code", "at"])

    return run


def _join_seeds(d: DataFrame, subjects: DataFrame, id_col: str, seq_col: str, max_mismatch: int, fixed, indels: bool, ranges: DataFrame | None) -> DataFrame:
    """The way for dictionaries that aren't broadcast; patterns without a seed, and indels, need the other one."""
    if indels or not fixed[1]:
        raise ValueError(f"indels and subjects that aren't fixed take dictionaries of at most {BROADCAST_ROWS} patterns")
    parts = stored(parts_of(subjects, id_col, seq_col, ranges).withColumn("part_id", F.monotonically_increasing_id()), "parts")
    seeds = d.mapInArrow(_seed_rows(max_mismatch), "pattern_id long, pattern string, band_start int, band_width int, w int, code long, at int")
    widths = sorted(r[0] for r in seeds.select("w").distinct().collect())  # 31 at most
    if 0 in widths:
        raise ValueError(f"patterns without a plain seed take dictionaries of at most {BROADCAST_ROWS} patterns")
    windows = spread(parts.select("part_id", "part")).mapInArrow(seed_windows(widths), "w int, code long, part_id long, pos int")
    near = windows.join(seeds, ["w", "code"]).select("pattern_id", "pattern", "band_start", "band_width", "part_id", (F.col("pos") - F.col("at") + 1).alias("at")).distinct()
    with_text = near.join(parts, "part_id")
    first = F.greatest("at", F.lit(1))
    rows = with_text.select(
        "pattern_id", "pattern", "band_start", "band_width", "subject_id", (F.col("at") + F.col("shift")).cast("int").alias("start"), (F.col("at") + F.col("shift") + F.length("pattern") - 1).cast("int").alias("end"),
        F.col("part").substr(first, F.least(F.length("pattern"), F.length("part") - first + 1)).alias("text"), (first - F.col("at")).alias("before"),
    )
    return rows.mapInArrow(verify_rows(max_mismatch, fixed), _FOUND)


def count_dictionary(matches: DataFrame) -> DataFrame:
    """``(pattern_id, subject_id, n)`` of the pairs with a hit."""
    return matches.groupBy("pattern_id", "subject_id").agg(F.count(F.lit(1)).alias("n"))


def collapse_by_pattern(matches: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(pattern_id, n)``: hits over all subjects, each weighted by ``weights(subject_id, weight)``."""
    if weights is None:
        return matches.groupBy("pattern_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return count_dictionary(matches).join(weights, "subject_id").groupBy("pattern_id").agg(F.sum(F.col("n") * F.col("weight")).alias("n"))


def collapse_by_subject(matches: DataFrame) -> DataFrame:
    """``(subject_id, n)``: hits of all patterns."""
    return matches.groupBy("subject_id").agg(F.count(F.lit(1)).cast("double").alias("n"))


def which_patterns(matches: DataFrame) -> DataFrame:
    """``(subject_id, pattern_ids)``: the sorted patterns with a hit; as many as the dictionary has at most."""
    return matches.select("subject_id", "pattern_id").distinct().groupBy("subject_id").agg(F.sort_array(F.collect_list("pattern_id")).alias("pattern_ids"))


def extract_matches(matches: DataFrame, subjects: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """``(pattern_id, subject_id, start, text)``: the letters of each hit (its part inside the subject)."""
    s = subjects.select(F.col(id_col).cast("long").alias("subject_id"), F.col(seq_col).alias("s"))
    a = F.greatest("start", F.lit(1))
    return matches.join(s, "subject_id").select("pattern_id", "subject_id", "start", F.col("s").substr(a, F.greatest(F.col("end") - a + 1, F.lit(0))).alias("text"))
