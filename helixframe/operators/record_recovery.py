"""Rows that fail to parse: load the valid records, set the broken ones apart.

The records go through the recursive-descent grammar in
:mod:`helixframe.kernels.record_grammar` batch by batch (Arrow in, Arrow out);
there is no shuffle, so the cost is one pass over the text.  After an error the parser resumes at the next validated record start.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.kernels.record_grammar import RecordSchema
from helixframe.session import spread

RECORD_SCHEMA = (
    "record_no int, fmt string, ok boolean, recovered boolean, name string, seq string, qual string, "
    "fields array<string>, reason string, error_line int, error_col int, error_detail string"
)
_TYPES = [pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string()]


def _row(no: int, fmt: str | None, item, recovered: bool) -> tuple:
    from helixframe.kernels.record_grammar import Record

    if isinstance(item, Record):
        return (no, fmt, True, recovered, item.name, item.seq, item.qual, item.fields or None, None, None, None, None)
    return (no, fmt, False, False, None, None, None, None, item.reason, item.line, item.col, item.detail or None)


def parse_records(df: DataFrame, schema: RecordSchema, id_col: str = "raw_id", fmt_col: str = "fmt", text_col: str = "raw_text", many: bool = False) -> DataFrame:
    """One row per record: typed fields where it is valid, reason and place of the error where not.

    ``many=False``: each text should hold one record.  A broken text gives the first error as one row, and then a row with ``recovered`` for each valid
    record that starts at a validated anchor inside it.  ``many=True``: a text may hold
    any number; after a broken one the parser goes on at the next validated record
    start, and every broken block has a row.  Result columns: the id column, then ``RECORD_SCHEMA``; other
    columns of ``df`` are not carried, so none can clash.

    Defined results: a null or empty text is a broken record (``line_count`` for
    FASTQ, ``markup`` for FASTA) in single mode and no record in many mode; a
    null or unknown format gives ``ok`` false with the reason ``format``; a
    repeated row is parsed each time; an empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def run(batches):
        from helixframe.kernels.record_grammar import Broken, _RULES, parse_frame, parse_stream

        rules = schema.compiled()
        for b in batches:
            keys, rows = [], []
            for i, (fmt, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if fmt not in _RULES:
                    items = [Broken("format", 1, 1, str(fmt))]
                else:
                    items = (parse_stream if many else parse_frame)(fmt, text, rules)
                for no, item in enumerate(items, 1):
                    keys.append(i)
                    rows.append(_row(no, fmt, item, not many and no > 1))
            cols = zip(*rows) if rows else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, _TYPES))], ["k", *names])

    src = df.select(F.col(id_col).alias("k"), F.col(fmt_col).alias("f"), F.col(text_col).alias("t"))
    return spread(src).mapInArrow(run, f"k {id_type}, {RECORD_SCHEMA}").withColumnRenamed("k", id_col)


def broken_records(df: DataFrame, schema: RecordSchema, id_col: str = "raw_id", fmt_col: str = "fmt", text_col: str = "raw_text") -> DataFrame:
    """The id and the reason of each broken record; rows with an unknown format are left out."""
    parsed = parse_records(df, schema, id_col, fmt_col, text_col)
    return parsed.where(~F.col("ok") & (F.col("reason") != "format")).select(id_col, "reason")


def valid_records(df: DataFrame, schema: RecordSchema, id_col: str = "raw_id", fmt_col: str = "fmt", text_col: str = "raw_text", recovered: bool = False) -> DataFrame:
    """The valid records with their typed fields; with ``recovered`` those found inside broken texts instead."""
    kept = F.col("ok") & (F.col("recovered") == F.lit(recovered))
    return parse_records(df, schema, id_col, fmt_col, text_col).where(kept).select(id_col, "fmt", "name", "seq", "qual", "fields")
