"""The frames that the queries start from, and the same as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.functions.transforms import LOWER, UPPER, ascii_upper, letters_only
from helixframe.session import spread, table


def dna(spark, d) -> DataFrame:
    """``(seq_id, s)``: letters of the DNA records."""
    return spread(table(spark, d, "fasta_seqs").where("seqtype = 'DNA' and seq_data is not null").select("seq_id", letters_only("seq_data").alias("s")))


def records(spark, d) -> DataFrame:
    """``(seq_id, seqtype, s)``: letters of all records."""
    return spread(table(spark, d, "fasta_seqs").where("seq_data is not null").select("seq_id", "seqtype", letters_only("seq_data").alias("s")))


def reads(spark, d) -> DataFrame:
    """``(seq_id, s, q, qscale)``: reads with their quality."""
    return spread(table(spark, d, "fastq_reads").where("seq_data is not null").select("seq_id", ascii_upper("seq_data").alias("s"), F.col("qual_data").alias("q"), "qscale"))


def patterns(spark, d) -> DataFrame:
    """``(pattern_id, p, tb_start, tb_width)``: all patterns; ambiguity letters stand for themselves unless an operator is told otherwise."""
    return table(spark, d, "motif_dict").where("pattern is not null").select("pattern_id", ascii_upper("pattern").alias("p"), "tb_start", "tb_width")


_UP = f"'{LOWER}', '{UPPER}'"
DNA = f"dna as (select seq_id, translate(regexp_replace(seq_data, '[^A-Za-z]', '', 'g'), {_UP}) as s from fasta_seqs where seqtype = 'DNA' and seq_data is not null)"
RECORDS = f"records as (select seq_id, seqtype, translate(regexp_replace(seq_data, '[^A-Za-z]', '', 'g'), {_UP}) as s from fasta_seqs where seq_data is not null)"
READS = f"reads as (select seq_id, translate(seq_data, {_UP}) as s, qual_data as q, qscale from fastq_reads where seq_data is not null)"
PATTERNS = f"patterns as (select pattern_id, translate(pattern, {_UP}) as p, tb_start, tb_width from motif_dict where pattern is not null)"


def sql(body: str, *ctes: str) -> str:
    """``with`` the given frames, then the body (which may go on with further frames after a comma)."""
    return "with " + ", ".join(ctes) + " " + body
