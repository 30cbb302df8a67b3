"""Quality strings: characters, scores and error probabilities."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from helixframe.functions.transforms import col

# Fixed values: (offset, lowest score, highest score) of the scales.
SCALES = {"phred": (33, 0, 93), "solexa": (64, -5, 99), "illumina": (64, 0, 99)}


def _chars(c) -> Column:
    s = col(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def scores(c, scale: str = "phred") -> Column:
    """array<int> of scores."""
    return F.transform(_chars(c), lambda x: F.ascii(x) - SCALES[scale][0])


def scores_by_scale(c, scale_col) -> Column:
    """Scores where the scale stands in a column; null for an unknown scale."""
    out = F.lit(None).cast("array<int>")
    for name in SCALES:
        out = F.when(col(scale_col) == name, scores(c, name)).otherwise(out)
    return out


def error_probabilities(c, scale: str = "phred") -> Column:
    """array<double>: 10^(-q/10); on the solexa scale 1 - 1 / (1 + 10^(-q/10))."""
    odds = lambda q: F.pow(F.lit(10.0), -q / 10.0)
    return F.transform(scores(c, scale), (lambda q: 1 - 1 / (1 + odds(q))) if scale == "solexa" else odds)


def encode_scores(c, scale: str = "phred") -> Column:
    """Quality string of array<int>; scores outside the scale are clamped."""
    off, low, high = SCALES[scale]
    return F.array_join(F.transform(col(c), lambda q: F.char(F.least(F.greatest(q, F.lit(low)), F.lit(high)) + off)), "")


def encode_probabilities(c, scale: str = "phred") -> Column:
    """Quality string of error probabilities, which are clamped to [1e-16, 1 - 1e-16] first."""
    def q(p):
        p = F.least(F.greatest(p, F.lit(1e-16)), F.lit(1 - 1e-16))
        return F.round(-10 * F.log10(p / (1 - p) if scale == "solexa" else p)).cast("int")

    return encode_scores(F.transform(col(c), q), scale)


def default_quality(c) -> Column:
    """The quality of a sequence that has none: ``;`` for each letter."""
    return F.repeat(F.lit(";"), F.length(col(c)))
