"""Multiple alignments with masked rows and columns.

Frames: ``alignment(row_id, name, seq)`` with sequences of one length, ``rowmask(row_id)`` and ``colmask(start, end)`` of merged ranges.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.operators.intervals import gaps, merge_ranges
from helixframe.operators.kmers import consensus_matrix, consensus_string

ALIGNMENT_ALPHABET = "ACGTMRWSYKVHDBN-+."


def unmasked_rows(alignment: DataFrame, rowmask: DataFrame | None) -> DataFrame:
    return alignment if rowmask is None else alignment.join(rowmask.select("row_id"), "row_id", "left_anti")


def _in_mask(cells: DataFrame, colmask: DataFrame | None, how: str) -> DataFrame:
    """Cells ``(pos, ...)`` that lie under the column mask (left_semi) or beside it (left_anti)."""
    if colmask is None:
        return cells if how == "left_anti" else cells.limit(0)
    masked = colmask.select(F.explode(F.sequence("start", "end")).alias("pos"))  # columns of one alignment
    return cells.join(masked, "pos", how)


def masked_matrix(alignment: DataFrame, rowmask: DataFrame | None = None, colmask: DataFrame | None = None) -> DataFrame:
    """``(pos, letter, n)`` over rows and columns that aren't masked."""
    return _in_mask(consensus_matrix(unmasked_rows(alignment, rowmask), "seq", alphabet=ALIGNMENT_ALPHABET), colmask, "left_anti")


def masked_consensus(alignment: DataFrame, rowmask: DataFrame | None = None, colmask: DataFrame | None = None, threshold: float = 0.25) -> DataFrame:
    """``(pos, letter)`` for every column: ``#`` if it is masked or has no data, ``-`` if gaps outnumber letters, else the consensus."""
    width = alignment.agg(F.max(F.length("seq")).alias("w"))
    places = width.where("w >= 1").select(F.explode(F.sequence(F.lit(1), F.col("w"))).alias("pos"))
    matrix = masked_matrix(alignment, rowmask, colmask)
    gap = matrix.groupBy("pos").agg(
        (F.sum(F.when(F.col("letter") == "-", F.col("n")).otherwise(0)) > F.sum(F.when(F.col("letter") == "-", 0).otherwise(F.col("n")))).alias("gappy")
    )
    letters = consensus_string(matrix, threshold)
    joined = places.join(gap, "pos", "left").join(letters, "pos", "left")
    return joined.select("pos", F.when(F.col("gappy").isNull(), "#").when(F.col("gappy"), "-").otherwise(F.coalesce("letter", F.lit("#"))).alias("letter"))


def mask_gaps(alignment: DataFrame, min_fraction: float = 0.5, min_block: int = 3) -> DataFrame:
    """``(start, end)``: runs of at least ``min_block`` columns whose share of gaps is at least ``min_fraction``."""
    matrix = consensus_matrix(alignment, "seq", alphabet=ALIGNMENT_ALPHABET)
    cols = matrix.groupBy("pos").agg((F.sum(F.when(F.col("letter") == "-", F.col("n")).otherwise(0)) / F.sum("n")).alias("share")).where(F.col("share") >= min_fraction)
    runs = merge_ranges(cols.select(F.lit(1).alias("k"), F.col("pos").alias("start"), F.col("pos").alias("end")), "k")
    return runs.where(F.col("end") - F.col("start") + 1 >= min_block).select("start", "end")


def unmasked_columns(alignment: DataFrame, colmask: DataFrame) -> DataFrame:
    """``(start, end)``: the columns between masked ones, the views of the consensus."""
    width = alignment.agg(F.max(F.length("seq")).alias("length")).select(F.lit(1).alias("k"), "length")
    return gaps(colmask.select(F.lit(1).alias("k"), "start", "end"), width, "k").select("start", "end")
