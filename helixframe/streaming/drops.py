"""Streams over drop folders of sequence files and tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions.counting import count_letters
from helixframe.operators.kmers import kmers


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``(desc, seq, filepath)`` of FASTA files as they arrive; one row for a record."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder).select("value", F.col("_metadata.file_path").alias("filepath"))
    body = F.regexp_replace("value", "^>", "")
    rest = F.when(F.instr(body, "\n") > 0, F.regexp_replace(body, "^[^\\n]*\\n", "")).otherwise("")
    letters = F.upper(F.regexp_replace(F.regexp_replace(rest, "(?m)^;.*$", ""), "\\s", ""))
    return raw.select(F.regexp_replace(F.substring_index(body, "\n", 1), "\\r$", "").alias("desc"), letters.alias("seq"), "filepath")


def running_kmers(stream: DataFrame, seq_col: str, k: int) -> DataFrame:
    """``(kmer, n)`` so far; for output mode update or complete.  The state has one row for a k-mer."""
    return kmers(stream.withColumn("_row", F.lit(1)), "_row", seq_col, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def windowed_composition(stream: DataFrame, time_col: str, seq_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(window_start, reads, letters, gc)`` by event time; rows later than the watermark are dropped, so state is bounded."""
    w = stream.where(F.col(seq_col).isNotNull()).withWatermark(time_col, late)
    g = w.groupBy(F.window(time_col, window).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length(seq_col)).alias("letters"), F.sum(count_letters(F.upper(seq_col), "GC")).alias("gc")).select(F.col("w.start").alias("window_start"), "reads", "letters", "gc")
