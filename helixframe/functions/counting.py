"""Counting, predicates and position-wise matching as Column expressions (null in, null out)."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from helixframe import alphabets as A
from helixframe.functions.transforms import code_of, col


def count_letters(c, letters: str) -> Column:
    """How many letters of the sequence are among the given ones."""
    s = col(c)
    return F.length(s) - F.length(F.translate(s, letters, ""))


def alphabet_frequency(c, alphabet: str = A.DNA_ALPHABET, base_only: bool = False, as_prob: bool = False, bases: str = A.DNA_BASES) -> list[Column]:
    """One column for each letter (aliased ``n_<letter>``); with ``base_only`` the bases and ``n_other``."""
    s = col(c)
    names = {"-": "gap", "+": "plus", ".": "dot", "*": "stop"}
    letters = bases if base_only else alphabet
    out = [(f"n_{names.get(x, x)}", count_letters(s, x)) for x in letters]
    if base_only:
        out.append(("n_other", F.length(s) - count_letters(s, bases)))
    if as_prob:
        out = [(n, v / F.when(F.length(s) > 0, F.length(s))) for n, v in out]
    return [v.alias(n) for n, v in out]


def letter_frequency(c, groups: list[str], as_prob: bool = False) -> list[Column]:
    """Counts of groups of letters, e.g. ["A", "GC"] gives ``A`` and ``G|C``."""
    s = col(c)
    return [((count_letters(s, g) / F.when(F.length(s) > 0, F.length(s))) if as_prob else count_letters(s, g)).alias("|".join(g)) for g in groups]


def unique_letters(c, alphabet: str = A.DNA_ALPHABET) -> Column:
    """The letters that occur, in the order of the alphabet."""
    s = col(c)
    return F.concat(*[F.when(F.instr(s, x) > 0, F.lit(x)).otherwise(F.lit("")) for x in alphabet])


def has_only_bases(c, bases: str = A.DNA_BASES) -> Column:
    return F.translate(col(c), bases, "") == ""


def order_key(c) -> Column:
    """A text that sorts like the sequence's letter codes (A < C < M < G < ...)."""
    return F.translate(col(c), A.ORDER_BY_CODE, "abcdefghijklmnopqr"[:len(A.ORDER_BY_CODE)])


def letter_matches(p: Column, s: Column, fixed_pattern: bool = True, fixed_subject: bool = True) -> Column:
    """Whether two letters match; a side that isn't fixed has its ambiguity letters read as sets of bases."""
    if fixed_pattern and fixed_subject:
        return p == s
    a, b = code_of(p), code_of(s)
    if fixed_pattern:
        return a.bitwiseAND(F.bitwise_not(b)) == 0
    if fixed_subject:
        return F.bitwise_not(a).bitwiseAND(b) == 0
    return a.bitwiseAND(b) != 0


def has_letter_at(c, letter: str, at: int, fixed: bool = True) -> Column:
    """Whether the sequence has the letter at the place; null outside."""
    s = col(c)
    here = F.substring(s, at, 1)
    hit = here == letter if fixed else letter_matches(F.lit(letter), here, False, False)
    return F.when((F.lit(at) >= 1) & (F.lit(at) <= F.length(s)), hit)


def n_mismatch_at(pattern, c, at: Column, fixed: tuple[bool, bool] = (True, True)) -> Column:
    """Mismatches of the pattern laid at a place; letters off the subject count as mismatches."""
    p, s = (F.lit(pattern) if isinstance(pattern, str) else pattern), col(c)
    n = F.length(p)

    def bad(i):
        q = at + i - 1
        hit = letter_matches(p.substr(i, F.lit(1)), s.substr(F.greatest(q, F.lit(1)), F.lit(1)), *fixed)
        return F.when((q >= 1) & (q <= F.length(s)) & F.coalesce(hit, F.lit(False)), 0).otherwise(1)

    return F.when(p.isNotNull() & s.isNotNull() & at.isNotNull(), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + bad(i)))


def is_matching_at(pattern, c, at: Column, max_mismatch: int = 0, min_mismatch: int = 0, fixed=(True, True)) -> Column:
    return n_mismatch_at(pattern, c, at, fixed).between(min_mismatch, max_mismatch)


def which_matching_at(pattern, c, places: list[int], max_mismatch: int = 0, fixed=(True, True)) -> Column:
    """The number of the first place where the pattern matches, 1 for the first; null if none does."""
    tests = F.array(*[is_matching_at(pattern, c, F.lit(p), max_mismatch, 0, fixed) for p in places])
    at = F.array_position(tests, True)
    return F.when(at > 0, at)


def n_mismatch_ending_at(pattern, c, at: Column, fixed=(True, True)) -> Column:
    n = F.length(F.lit(pattern) if isinstance(pattern, str) else pattern)
    return n_mismatch_at(pattern, c, at - n + 1, fixed)


def mismatch_places(pattern, c, at: Column, fixed=(True, True)) -> Column:
    """array of the pattern's places that don't match at ``at``."""
    p, s = (F.lit(pattern) if isinstance(pattern, str) else pattern), col(c)

    def bad(i):
        q = at + i - 1
        hit = letter_matches(p.substr(i, F.lit(1)), s.substr(F.greatest(q, F.lit(1)), F.lit(1)), *fixed)
        return ~((q >= 1) & (q <= F.length(s)) & F.coalesce(hit, F.lit(False)))

    return F.filter(F.sequence(F.lit(1), F.length(p)), bad)


def ambiguity_regex(pattern: str) -> str:
    """A regular expression whose letters stand for every letter that shares a base with them."""
    out = []
    for ch in pattern:
        code = A.LETTER_CODE[ch]
        out.append("[" + "".join(x for x in A.DNA_ALPHABET if A.LETTER_CODE[x] & code).replace("-", r"\-") + "]")
    return "".join(out)


def count_pattern(pattern: str, c, fixed: bool = True) -> Column:
    """Overlapping occurrences, counted inside the JVM's regular expressions."""
    if pattern == "":
        raise ValueError("the pattern is empty")
    return F.regexp_count(col(c), F.lit(f"(?={re.escape(pattern) if fixed else ambiguity_regex(pattern)})"))


def _places(texts, pattern: str, fixed: bool):
    """Lists of the starts of all overlapping occurrences, from one pass over the buffer of a batch."""
    import numpy as np
    import pyarrow as pa

    from helixframe.kernels import search
    from helixframe.kernels.arrow import pieces

    counts, starts = [], []
    for _, data, offsets in pieces(texts):
        row, start = search.hamming(data, offsets, pattern, 0, 0, (True, True) if fixed else (False, False))
        counts.append(np.bincount(row, minlength=len(offsets) - 1))
        starts.append(start)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = np.concatenate(starts).astype(np.int32) if starts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=texts.is_null())


def match_starts(pattern: str, c, fixed: bool = True) -> Column:
    """array of the starts of all overlapping occurrences; an Arrow kernel, linear in the text."""
    if pattern == "":
        raise ValueError("the pattern is empty")
    return F.arrow_udf(lambda texts: _places(texts, pattern, fixed), "array<int>")(col(c))


def _common(a, b):
    """Length of the common prefix of each pair of texts, in letters."""
    import numpy as np
    import pyarrow as pa

    from helixframe.kernels.arrow import buffer_of

    none = np.asarray(a.is_null()) | np.asarray(b.is_null())
    out = np.zeros(len(a), np.int64)
    (x, xo), (y, yo) = buffer_of(a), buffer_of(b)
    size = np.minimum(np.diff(xo), np.diff(yo))
    at, todo, step = np.zeros(len(a), np.int64), np.flatnonzero(size > 0), 64
    while len(todo):  # blocks of growing size, of the texts that are still equal
        n = np.minimum(size[todo] - at[todo], step)
        begin = np.cumsum(n) - n
        i = np.arange(int(n.sum())) + np.repeat(at[todo] - begin, n)
        own = np.repeat(todo, n)
        differ = np.flatnonzero(x[xo[own] + i] != y[yo[own] + i])
        first = np.full(len(a), -1, np.int64)
        first[own[differ][::-1]] = i[differ][::-1]
        hit = first[todo] >= 0
        at[todo] = np.where(hit, first[todo], at[todo] + n)
        todo = todo[~hit & (at[todo] < size[todo])]
        step *= 4
    out[:] = at
    if len(x) and x.max() > 127:  # letters, not bytes; a letter that differs in a later byte isn't common
        whole = [len(x[o:o + n].tobytes().decode("utf-8", "ignore")) for o, n in zip(xo[:-1].tolist(), at.tolist())]
        out[:] = whole
    return pa.array(out.astype(np.int32), mask=none)


def common_prefix(a, b) -> Column:
    """Length of the common prefix; an Arrow kernel, linear in the text."""
    return F.arrow_udf(_common, "int")(col(a), col(b))


def common_suffix(a, b) -> Column:
    return common_prefix(F.reverse(col(a)), F.reverse(col(b)))


def palindrome_arm_length(c, max_mismatch: int = 0, wobble: bool = False, kind: str = "DNA") -> Column:
    """Letters of the left arm of a sequence that pairs with itself reversed (A-T, C-G) from both ends inwards.

    The arm ends before the mismatch that is one too many.  ``kind`` B compares letters literally; ``wobble`` lets G pair with T and U.
    """
    def run(texts):
        import numpy as np
        import pyarrow as pa

        from helixframe.kernels import search
        from helixframe.kernels.arrow import buffer_of

        return pa.array(search.arm_lengths(*buffer_of(texts), max_mismatch, wobble, kind).astype(np.int32), mask=np.asarray(texts.is_null()))

    return F.arrow_udf(run, "int")(col(c))


def palindrome_arms(c, **options) -> tuple[Column, Column]:
    """(left arm, right arm) of a palindrome; options as for its length."""
    s, n = col(c), palindrome_arm_length(c, **options)
    return s.substr(F.lit(1), n), s.substr(F.length(s) - n + 1, n)
