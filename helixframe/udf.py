"""Registers the operators as SQL functions.

Plain expressions become SQL functions, which Catalyst inlines; kernels become Arrow-vectorised UDFs.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from helixframe import alphabets as A
from helixframe.kernels import matching as M

_COMP = f"'{''.join(A.COMPLEMENT)}', '{''.join(A.COMPLEMENT.values())}'"
SQL_FUNCTIONS = {
    "seq_letters(s STRING)": ("STRING", "translate(regexp_replace(s, '[^A-Za-z]', ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"),
    "seq_complement(s STRING)": ("STRING", f"translate(s, {_COMP})"),
    "seq_revcomp(s STRING)": ("STRING", f"reverse(translate(s, {_COMP}))"),
    "seq_to_rna(s STRING)": ("STRING", "translate(s, 'T', 'U')"),
    "seq_gc(s STRING)": ("DOUBLE", "(length(s) - length(translate(s, 'GC', ''))) / nullif(length(s), 0)"),
    "seq_count(s STRING, letters STRING)": ("INT", "length(s) - length(translate(s, letters, ''))"),
    "seq_order_key(s STRING)": ("STRING", f"translate(s, '{A.ORDER_BY_CODE}', '{'abcdefghijklmnopqrstuv'[:len(A.ORDER_BY_CODE)]}')"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql``; gives their names."""
    names = []
    for head, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
        names.append(head.split("(")[0])

    def over(f):
        return lambda p, s, k: pd.Series([None if a is None or b is None or c is None or pd.isna(c) else f(a, b, int(c)) for a, b, c in zip(p, s, k)])

    kernels = {
        "seq_count_mismatch": (over(lambda p, s, k: len(M.match_hamming(p, s, k))), "bigint"),
        "seq_match_mismatch": (over(lambda p, s, k: M.match_hamming(p, s, k)), "array<int>"),
        "seq_count_indels": (over(lambda p, s, k: len(M.match_indels(p, s, k))), "bigint"),
        "seq_edits_at": (over(lambda p, s, k: M.edits_at(p, s, k)), "bigint"),
    }
    for name, (f, kind) in kernels.items():
        spark.udf.register(name, F.pandas_udf(f, kind, F.PandasUDFType.SCALAR))
        names.append(name)
    return names
