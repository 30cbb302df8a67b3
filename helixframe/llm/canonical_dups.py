"""Duplicates hidden by formatting: canonical keys, Bloom filters, exact grouping.

Each record's canonical form (letters of the sequence; the words of each field of
its description, fields sorted) is hashed once, and the hashes are stored.  Each task notes its hashes
in filters of what it saw once and what it saw repeatedly; the filters of all tasks are merged
range by range, and each task learns which of its own hashes are repeated
(:mod:`helixframe.llm.repeats`).  Only these possible repeats are shuffled with their full keys and
grouped exactly; all others are emitted as singletons where they lie.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm.repeats import Replies, by_task, numbered, repeated
from helixframe.operators.skew import join_groups
from helixframe.session import stored


def canonical_letters(c: Column) -> Column:
    """The ASCII letters, upper-cased (by letter, so that no other character turns into one)."""
    return F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def canonical_fields(c: Column) -> Column:
    """The fields (divided by , ; |) as their words in lower case, without those that have none, sorted."""
    low = F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9,;|]+", " "), " ?[,;|] ?", ",")
    return F.array_sort(F.filter(F.split(F.trim(words), ","), lambda x: x != ""))


def _hashes(batch: pa.RecordBatch):
    h = np.asarray(batch.column("h")).view(np.uint64)
    for p, rows in by_task(batch):
        yield p, h[rows], np.zeros(len(rows), np.uint32), rows


def _tested(folder: str):
    """(id, h, key) with the key of possible repeats only; of the others it stays null."""
    def run(batches):
        replies = Replies(folder)
        for b in batches:
            h = np.asarray(b.column("h"))
            maybe = np.zeros(b.num_rows, bool)
            for p, rows in by_task(b):
                maybe[rows] = replies.has(p, h.view(np.uint64)[rows], np.zeros(len(rows), np.uint32))
            key = pc.if_else(pa.array(maybe), b.column("key"), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("id"), key], ["id", "key"])

    return run


def canonical_groups(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``(id, first_id, n_copies)`` for every row: the smallest id of its group and the group's size.

    Defined results: rows whose key is null are left out (the caller makes the
    key null for rows that don't take part); rows with a null id are left out; a repeated row is a copy; an
    empty table gives an empty result; other columns are not carried, so none clash.
    """
    keyed = df.select(F.col(id_col).cast("long").alias("id"), key.alias("key")).where("id is not null and key is not null")
    # 48 bytes a row; the texts are read and made canonical once
    keyed = stored(numbered(keyed.select("id", F.xxhash64("key").alias("h"), F.unhex(F.sha2("key", 256)).alias("key"))), "keys")
    tested = keyed.mapInArrow(_tested(repeated(keyed.select("h", "p"), _hashes)), "id long, key binary")
    repeats = tested.where("key is not null")
    groups = repeats.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    grouped = join_groups(repeats, groups, ["key"], "n_copies").select("id", "first_id", "n_copies")
    singles = tested.where("key is null").select("id", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("n_copies"))
    return grouped.unionByName(singles)


def record_key(desc_col: str, seq_col: str) -> Column:
    """The canonical text of a sequence record; null for one without a letter."""
    letters = canonical_letters(F.col(seq_col))
    return F.when(letters != "", F.concat(letters, F.lit("\n"), F.array_join(canonical_fields(F.col(desc_col)), "|")))
