"""Independence of the letters at two places: chi-square and G tests."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from helixframe.operators.kmers import nucleotide_frequency_at


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def independence_test(table: np.ndarray, test: str = "chisq", simulate: int = 0, seed: int = 1) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p) of a table; empty rows and columns are dropped.

    ``test``: chisq, G, or adjG (with Williams' correction).  ``simulate``: p from so many random tables with the same margins.
    """
    x = np.asarray(table, float)
    x = x[x.sum(axis=1) > 0][:, x.sum(axis=0) > 0] if x.size else x
    if min(x.shape or (0,)) < 2:
        return 0.0, 0, 1.0
    n, rows, cols = x.sum(), x.sum(axis=1), x.sum(axis=0)
    expected = np.outer(rows, cols) / n
    df = int((x.shape[0] - 1) * (x.shape[1] - 1))

    def statistic(t):
        if test == "chisq":
            return ((t - expected) ** 2 / expected).sum()
        g = 2 * float((t[t > 0] * np.log(t[t > 0] / expected[t > 0])).sum())
        if test == "adjG":
            g /= 1 + (n * (1 / rows).sum() - 1) * (n * (1 / cols).sum() - 1) / (6 * n * df)
        return g

    value = float(statistic(x))
    if not simulate:
        return value, df, upper_gamma(df / 2, value / 2)
    rng = np.random.default_rng(seed)
    left, right = np.repeat(np.arange(len(rows)), rows.astype(int)), np.repeat(np.arange(len(cols)), cols.astype(int))
    hits = 0
    for _ in range(simulate):
        t = np.zeros_like(x)
        np.add.at(t, (left, rng.permutation(right)), 1)
        hits += statistic(t) >= value * (1 - 1e-12)
    return value, df, float((1 + hits) / (simulate + 1))


def dinucleotide_test(df: DataFrame, seq_col: str, i: int, j: int, test: str = "chisq", simulate: int = 0) -> tuple[float, int, float]:
    """The test on the letters at places i and j of all sequences; the table has 16 cells."""
    table = np.zeros((4, 4))
    for r in nucleotide_frequency_at(df, seq_col, [i, j]).collect():
        table["ACGT".index(r["l1"]), "ACGT".index(r["l2"])] = r["n"]
    return independence_test(table, test, simulate)
