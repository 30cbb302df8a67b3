"""Ranges on sequences: merging, gaps, coverage, masks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge_ranges(ranges: DataFrame, key: str, min_gap: int = 1) -> DataFrame:
    """``(key, start, end)``: overlapping and adjacent ranges united, by sequence.

    Ranges closer than ``min_gap`` are joined.  Empty ranges (end < start) are left out.
    """
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(key).orderBy("start", "end")
    # of ranges with one start only the longest counts: combined before the shuffle, so a sequence that holds
    # a third of all ranges sends at most one for each of its places
    r = ranges.where(F.col("end") >= F.col("start")).groupBy(key, "start").agg(F.max("end").alias("end"))
    new = F.coalesce(F.col("start") > F.max("end").over(w) + min_gap, F.lit(True)).cast("int")
    islands = r.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(merged: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """``(key, start, end)``: what merged ranges leave of each sequence; ``lengths(key, length)``."""
    w = Window.partitionBy(key).orderBy("start")
    cuts = merged.select(key, "start", "end").unionByName(lengths.select(key, (F.col("length") + 1).cast("int").alias("start"), (F.col("length") + 1).cast("int").alias("end")))
    before = F.coalesce(F.lag("end").over(w), F.lit(0))
    return cuts.select(key, (before + 1).alias("s"), (F.col("start") - 1).alias("e")).where("e >= s").select(key, F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"))


def coverage(ranges: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """``(key, start, end, depth)``: runs of constant depth above zero; only the ends of ranges are shuffled."""
    wt = weight if weight is not None else F.lit(1)
    ends = ranges.where(F.col("end") >= F.col("start")).select(key, F.inline(F.array(F.struct(F.col("start").alias("pos"), wt.alias("d")), F.struct((F.col("end") + 1).alias("pos"), (-wt).alias("d")))))
    steps = ends.groupBy(key, "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    w = Window.partitionBy(key).orderBy("pos")
    runs = steps.withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("pos").over(w) - 1)
    return runs.where("depth <> 0 and end is not null").select(key, F.col("pos").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("depth").cast("long").alias("depth"))


def restrict(ranges: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Ranges clipped to [1, length]; what lies outside as a whole drops out."""
    r = ranges.join(lengths, key)
    return r.select(key, F.greatest("start", F.lit(1)).alias("start"), F.least("end", F.col("length")).cast("int").alias("end")).where("end >= start")


def letter_runs(df: DataFrame, id_col: str, seq_col: str, regex: str) -> DataFrame:
    """``(id, start, end)`` of the runs of a character class, e.g. ``N+``: no UDF, no shuffle.

    The pieces between runs and the runs alternate, so their summed lengths give the places.
    """
    s = F.col(seq_col)
    runs = F.regexp_extract_all(s, F.lit(f"({regex})"), F.lit(1))
    parts = F.split(s, regex)
    zipped = F.transform(F.sequence(F.lit(1), F.size(runs)), lambda i: F.struct(F.length(F.element_at(parts, i)).alias("gap"), F.length(F.element_at(runs, i)).alias("run")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, z):
        a = acc["pos"] + z["gap"] + 1
        return F.struct((acc["pos"] + z["gap"] + z["run"]).cast("int").alias("pos"), F.concat(acc["out"], F.array(F.struct(a.cast("int").alias("start"), (a + z["run"] - 1).cast("int").alias("end")))).alias("out"))

    found = F.when(F.size(runs) > 0, F.aggregate(zipped, start, step, lambda a: a["out"]))
    return df.where(s.isNotNull()).select(F.col(id_col), F.inline(found))


def masked_width(mask: DataFrame, key: str) -> DataFrame:
    """``(key, masked)``: letters under merged ranges."""
    return mask.groupBy(key).agg(F.sum(F.col("end") - F.col("start") + 1).alias("masked"))


def masked_ratio(mask: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """``(key, ratio)``: the masked share of every sequence; null for empty ones."""
    found = lengths.select(key, "length").join(masked_width(mask, key), key, "left")
    return found.select(key, (F.coalesce("masked", F.lit(0)) / F.when(F.col("length") > 0, F.col("length"))).alias("ratio"))


def invert_mask(mask: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """``(key, start, end)``: what was unmasked is masked, and the other way round."""
    return gaps(mask, lengths, key)


def mask_motif(hits: DataFrame, min_block: int = 1) -> DataFrame:
    """``(subject_id, start, end)``: the united hits of a motif, blocks of at least ``min_block`` letters."""
    return merge_ranges(hits, "subject_id").where(F.col("end") - F.col("start") + 1 >= min_block)


def combine_masks(a: DataFrame, b: DataFrame, key: str, how: str = "union") -> DataFrame:
    """``union``, ``replace`` (b) or ``intersect`` of two masks of merged ranges."""
    if how == "replace":
        return b.select(key, "start", "end")
    if how == "union":
        return merge_ranges(a.select(key, "start", "end").unionByName(b.select(key, "start", "end")), key)
    return coverage(a.select(key, "start", "end").unionByName(b.select(key, "start", "end")), key).where("depth = 2").select(key, "start", "end")
