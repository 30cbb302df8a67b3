"""Order, duplicates, lookup and set operations on sequences."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from helixframe.functions.counting import order_key
from helixframe.operators.skew import join_groups
from helixframe.session import ensure_checkpoint_dir


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint: range bounds are sampled, so partition numbers hold only for one evaluation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def order(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """``(id, place)``: place of each row in the order of letter codes, ties by id.

    A global row number without one task that holds all rows: the rows are
    range-partitioned and sorted, each partition numbers its own, and the counts of the
    partitions before (one row each) are added.
    """
    keyed = df.select(F.col(id_col).alias("id"), order_key(seq_col).alias("key"))
    parts = _cut(keyed.repartitionByRange("key", "id").withColumn("part", F.spark_partition_id()))
    local = parts.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("key", "id")))
    sizes = local.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    return local.join(F.broadcast(before), "part").select(F.col("id").alias(id_col), (F.col("n") + F.col("before")).cast("int").alias("place"))


def rank(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """``(id, rnk)``: one more than the number of smaller sequences; copies share it.

    Distinct sequences are ranked by their counts, so copies cost nothing.
    """
    keyed = df.select(F.col(id_col).alias("id"), order_key(seq_col).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    parts = _cut(counts.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    running = F.sum("n").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    local = parts.withColumn("inside", running)
    sizes = local.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    ranks = local.join(F.broadcast(before), "part").select("key", (F.col("inside") + F.col("before") + 1).alias("rnk"))
    return keyed.join(ranks, "key").select(F.col("id").alias(id_col), "rnk")


def duplicated(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """``(id, duplicated)``: whether a smaller id has the same sequence.

    An aggregation and a join, not a window over each group: a group may hold a third of all rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("s"))
    first = rows.where("s is not null").groupBy("s").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return join_groups(rows, first, ["s"], "n").select(F.col("id").alias(id_col), (F.col("id") != F.col("first")).alias("duplicated"))


def is_unsorted(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """``(is_unsorted)``: one row; whether some sequence is smaller than the one with the id before it.

    The rows are range-partitioned by id; each partition looks at its own neighbours and sends its first and last key.
    """
    keyed = df.select(F.col(id_col).alias("id"), order_key(seq_col).alias("key")).where("id is not null and key is not null")
    parts = _cut(keyed.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy("id")
    local = parts.withColumn("bad", F.coalesce(F.col("key") < F.lag("key").over(w), F.lit(False)))
    ends = local.groupBy("part").agg(F.bool_or("bad").alias("bad"), F.min_by("key", "id").alias("first"), F.max_by("key", "id").alias("last"))
    seams = ends.withColumn("bad", F.col("bad") | F.coalesce(F.col("first") < F.lag("last").over(Window.orderBy("part")), F.lit(False)))  # one row for a partition
    return seams.agg(F.coalesce(F.bool_or("bad"), F.lit(False)).alias("is_unsorted"))


def unique(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """The first row of each sequence."""
    return df.groupBy(seq_col).agg(F.min(id_col).alias(id_col)).select(id_col, seq_col)


def match(x: DataFrame, table: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """``(id, first_id)``: the smallest id in ``table`` with the same sequence, else null."""
    first = table.groupBy(F.col(seq_col).alias("_s")).agg(F.min(id_col).alias("first_id"))
    return x.join(first, F.col(seq_col) == F.col("_s"), "left").select(id_col, "first_id")


def is_in(x: DataFrame, table: DataFrame, seq_col: str) -> DataFrame:
    """The rows of ``x`` whose sequence is in ``table``."""
    return x.join(table.select(seq_col), seq_col, "left_semi")


def union(x: DataFrame, y: DataFrame, seq_col: str) -> DataFrame:
    return x.select(seq_col).union(y.select(seq_col)).distinct()


def intersect(x: DataFrame, y: DataFrame, seq_col: str) -> DataFrame:
    return x.select(seq_col).intersect(y.select(seq_col))


def setdiff(x: DataFrame, y: DataFrame, seq_col: str) -> DataFrame:
    return x.select(seq_col).subtract(y.select(seq_col))


def setequal(x: DataFrame, y: DataFrame, seq_col: str) -> DataFrame:
    """``(equal)``: one row."""
    sides = x.select(seq_col, F.lit(1).alias("side")).unionByName(y.select(seq_col, F.lit(2).alias("side")))
    seen = sides.groupBy(seq_col).agg(F.min("side").alias("a"), F.max("side").alias("b"))
    return seen.agg(F.coalesce(F.bool_and(F.col("a") != F.col("b")), F.lit(True)).alias("equal"))
