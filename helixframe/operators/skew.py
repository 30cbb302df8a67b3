"""Joins of rows with one row for each group, where one group may hold a third of all rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.session import stored

HOT_SHARE = 1e-3  # a group with more than this share of all rows is hot: there are at most 1 / HOT_SHARE of them


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row for each key, ``size_col`` rows of it).

    Hot groups, at most 1 / HOT_SHARE by construction, are broadcast, so their rows
    aren't shuffled; all others go through an ordinary join.  Rows with a null key drop out.  The groups are stored, as they are read three times.
    """
    groups = stored(groups, "groups")
    total = groups.agg(F.coalesce(F.sum(size_col), F.lit(0))).first()[0]
    hot = groups.where(F.col(size_col) > max(total * HOT_SHARE, 1))
    cold = groups.where(F.col(size_col) <= max(total * HOT_SHARE, 1))
    if hot.isEmpty():
        return rows.join(cold, keys)
    near = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(rest)
