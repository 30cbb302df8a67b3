"""Per-letter transforms and slicing, as Column expressions (null in, null out)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from helixframe import alphabets as A

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an outer expression is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_upper(c) -> Column:
    """Upper case of ASCII letters only; ``upper`` may turn other characters into letters."""
    return F.translate(col(c), LOWER, UPPER)


def letters_only(c) -> Column:
    """The ASCII letters, upper-cased."""
    return ascii_upper(F.regexp_replace(col(c), "[^A-Za-z]", ""))


def validated(c, alphabet: str = A.DNA_ALPHABET) -> Column:
    """The upper-cased sequence; a letter outside the alphabet raises an error."""
    s = ascii_upper(c)
    bad = F.translate(s, alphabet, "") != ""
    return F.when(bad, F.raise_error(F.concat(F.lit("letter outside the alphabet: "), s))).otherwise(s)


def is_valid(c, alphabet: str = A.DNA_ALPHABET) -> Column:
    return F.translate(ascii_upper(c), alphabet, "") == ""


def complement(c) -> Column:
    """Complement with ambiguity letters; gaps stay."""
    return F.translate(col(c), "".join(A.COMPLEMENT), "".join(A.COMPLEMENT.values()))


def reverse(c) -> Column:
    return F.reverse(col(c))


def reverse_complement(c) -> Column:
    return F.reverse(complement(c))


def dna_to_rna(c) -> Column:
    return F.translate(col(c), "T", "U")


def rna_to_dna(c) -> Column:
    return F.translate(col(c), "U", "T")


def chartr(c, old: str, new: str) -> Column:
    """Letter by letter substitution; of a letter that comes twice in ``old`` the last counts."""
    if len(old) != len(new):
        raise ValueError("old and new must have the same length")
    pairs = dict(zip(old, new))
    return F.translate(col(c), "".join(pairs), "".join(pairs.values()))


def replace_ambiguities(c, new: str = "N") -> Column:
    amb = "".join(x for x in A.IUPAC_CODE_MAP if x not in A.DNA_BASES)
    return F.translate(col(c), amb, new * len(amb))


def solve_sew(length: Column, start=None, end=None, width=None) -> tuple[Column, Column]:
    """(start, width) from two of start, end and width; negative places count from the end."""
    given = [x is not None for x in (start, end, width)]
    if sum(given) == 3:
        raise ValueError("give at most two of start, end and width")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    place = lambda x: F.when(lit(x) < 0, length + lit(x) + 1).otherwise(lit(x))
    if width is None:
        s = place(start) if start is not None else F.lit(1)
        e = place(end) if end is not None else length
        return s, e - s + 1
    if end is not None:
        return place(end) - lit(width) + 1, lit(width)
    return (place(start) if start is not None else F.lit(1)), lit(width)


def subseq(c, start=None, end=None, width=None, strict: bool = True) -> Column:
    """Part of a sequence.  Outside the limits: an error, or null with ``strict=False``."""
    s = col(c)
    n = F.length(s)
    a, w = solve_sew(n, start, end, width)
    ok = (a >= 1) & (w >= 0) & (a + w - 1 <= n)
    part = F.substring(s, a.cast("int"), w.cast("int"))
    return F.when(ok, part).otherwise(F.when(s.isNotNull(), F.raise_error(F.lit("range outside the sequence"))) if strict else F.lit(None).cast("string"))


def three_bands(c, start=None, end=None, width=None) -> Column:
    """struct(left, middle, right); null outside the limits."""
    s = col(c)
    n = F.length(s)
    a, w = solve_sew(n, start, end, width)
    ok = (a >= 1) & (w >= 0) & (a + w - 1 <= n)
    return F.when(ok, F.struct(
        F.substring(s, F.lit(1), (a - 1).cast("int")).alias("left"),
        F.substring(s, a.cast("int"), w.cast("int")).alias("middle"),
        F.substring(s, (a + w).cast("int"), (n - a - w + 1).cast("int")).alias("right"),
    ))


def xscat(*cols) -> Column:
    return F.concat(*(col(c) for c in cols))


def letter(c, places) -> Column:
    """The letters at the given places, joined; null if one is outside."""
    s = col(c)
    parts = [F.when((F.lit(p) >= 1) & (F.lit(p) <= F.length(s)), F.substring(s, p, 1)) for p in places]
    return F.concat(*parts)


def extract_at(c, ranges) -> Column:
    """array of the parts given by array<struct<start, width>>; a range outside the sequence gives null."""
    s = col(c)
    inside = lambda r: (r["start"] >= 1) & (r["width"] >= 0) & (r["start"] + r["width"] - 1 <= F.length(s))
    return F.transform(col(ranges), lambda r: F.when(inside(r), s.substr(r["start"], r["width"])))


def replace_at(c, edits) -> Column:
    """Replace ranges by values: array<struct<start, width, value>>; width 0 inserts before start.

    Ranges are taken by start and width; overlapping ones, or one outside the sequence, raise an error.
    """
    s = col(c)
    e = F.array_sort(col(edits))
    start = F.struct(F.lit(1).alias("pos"), F.lit("").alias("out"))

    def step(acc, r):
        bad = (r["start"] < acc["pos"]) | (r["start"] + r["width"] - 1 > F.length(s)) | (r["width"] < 0)
        text = F.concat(acc["out"], s.substr(acc["pos"], r["start"] - acc["pos"]), r["value"])
        return F.struct((r["start"] + r["width"]).cast("int").alias("pos"), F.when(bad, F.raise_error(F.lit("ranges overlap or lie outside the sequence"))).otherwise(text).alias("out"))

    return F.aggregate(e, start, step, lambda a: F.concat(a["out"], s.substr(a["pos"], F.length(s) - a["pos"] + 1)))


def code_of(letter_col: Column) -> Column:
    """The code of one letter (null for any other character)."""
    m = F.create_map(*[x for k, v in A.LETTER_CODE.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, letter_col)


def letter_of(code: Column) -> Column:
    return F.substring(F.lit(A.LETTERS_BY_CODE), code.cast("int"), F.lit(1))


def replace_letter_at(c, at, letters, if_not_extending: str = "replace") -> Column:
    """Replace single letters: arrays of places and letters.  A letter *extends* the old one if its bases include it.

    ``if_not_extending``: replace, skip, merge (the letter for both) or error.  Of repeated places the last counts for replace.
    """
    s, at, new = col(c), col(at), col(letters)
    chars = F.split(s, "")

    def one(old, i):
        hits = F.filter(F.arrays_zip(at.alias("p"), new.alias("l")), lambda z: z["p"] == i + 1)

        def step(acc, z):
            a, b = code_of(acc), code_of(z["l"])
            extends = (a.bitwiseAND(F.bitwise_not(b)) == 0) & (a < 16) & (b < 16)
            other = {
                "replace": z["l"], "skip": acc,
                "merge": F.when((a < 16) & (b < 16), letter_of(a.bitwiseOR(b))).otherwise(F.raise_error(F.lit("cannot merge"))),
                "error": F.raise_error(F.lit("letter does not extend the old one")),
            }[if_not_extending]
            return z["l"] if if_not_extending == "replace" else F.when(extends, z["l"]).otherwise(other)

        return F.aggregate(hits, old, step)

    return F.when(s == "", s).otherwise(F.array_join(F.transform(chars, one), ""))


def inject_hard_mask(c, ranges, fill: str = "+") -> Column:
    """Overwrite the ranges (sorted, not overlapping, inside the sequence) with one letter."""
    return replace_at(c, F.transform(col(ranges), lambda r: F.struct(r["start"].alias("start"), r["width"].alias("width"), F.repeat(F.lit(fill), r["width"]).alias("value"))))


def pad_and_clip(c, start, width, left: str = " ", right: str = " ") -> Column:
    """The sequence seen through a window [start, start + width - 1], padded where the window lies outside."""
    s, a, w = col(c), (start if isinstance(start, Column) else F.lit(start)), (width if isinstance(width, Column) else F.lit(width))
    n = F.length(s)
    lpad = F.least(F.greatest(F.lit(1) - a, F.lit(0)), w)
    rpad = F.least(F.greatest(a + w - 1 - n, F.lit(0)), w)
    first = F.greatest(a, F.lit(1))
    middle = F.greatest(w - lpad - rpad, F.lit(0))
    return F.concat(F.repeat(F.lit(left), lpad.cast("int")), s.substr(first.cast("int"), middle.cast("int")), F.repeat(F.lit(right), (w - lpad - middle).cast("int")))


def stack_strings(c, start, end, shift=0, left: str = " ", right: str = " ") -> Column:
    """Rectangular view [start, end] of sequences that are each shifted to the right."""
    shift = shift if isinstance(shift, Column) else F.lit(shift)
    return pad_and_clip(c, F.lit(start) - shift, F.lit(end - start + 1), left, right)


def codons(c) -> Column:
    """array of whole codons; one or two letters at the end are left out."""
    return F.regexp_extract_all(col(c), F.lit("(?s).{3}"), F.lit(0))


def translate_codons(c, code: str = "1", no_init_codon: bool = False, if_fuzzy: str = "error") -> Column:
    """Protein sequence.  An alternative start codon in the first place gives M; gaps ``+`` are skipped.

    ``if_fuzzy``: error, solve, error.if.X or X.  A codon without reading raises an error.
    """
    table, starts = A.genetic_code(code)
    full = A.fuzzy_code(table, if_fuzzy)
    order = A.LETTERS_BY_CODE  # an array by place, so a codon costs no search
    amino_acids = F.split(F.lit("".join(full[x + y + z] or "?" for x in order for y in order for z in order)), "")  # folded to a literal
    place = lambda x, i: F.instr(F.lit(order), F.substring(x, i, 1))

    def amino(x):
        a, b, c3 = place(x, 1), place(x, 2), place(x, 3)
        found = F.when((a > 0) & (b > 0) & (c3 > 0), F.get(amino_acids, (a - 1) * 225 + (b - 1) * 15 + c3 - 1))
        return F.coalesce(F.nullif(found, F.lit("?")), F.raise_error(F.concat(F.lit("no amino acid for codon "), x)))

    def first(x, i):
        return F.when((i == 0) & x.isin(starts), F.lit("M")).otherwise(amino(x))

    step = (lambda x: amino(x)) if no_init_codon or not starts else first
    return let(F.translate(rna_to_dna(c), "+", ""), lambda s: F.array_join(F.transform(codons(s), step), ""))


def strsplit(c, pattern: str) -> Column:
    """Pieces between the occurrences of a literal pattern, empty ones left out."""
    import re

    return F.filter(F.split(col(c), re.escape(pattern)), lambda x: x != "")


def unstrsplit(c, sep: str = "") -> Column:
    return F.array_join(col(c), sep)


def longest_consecutive(c, letter_: str) -> Column:
    """Length of the longest run of one letter."""
    runs = F.split(F.regexp_replace(col(c), f"[^{letter_}]+", " "), " ")
    return F.array_max(F.transform(runs, lambda x: F.length(x)))


def to_complex(c, values: dict[str, tuple[float, float]]) -> Column:
    """array<struct<re, im>>, one for each letter; null for letters without a value."""
    m = F.create_map(*[x for k, (a, b) in values.items() for x in (F.lit(k), F.struct(F.lit(float(a)).alias("re"), F.lit(float(b)).alias("im")))])
    return F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.element_at(m, x))


def all_words(spark, alphabet: str, width: int, fast_right: bool = True):
    """Every word of the given width as (word_no, word), the last letter moving fastest, or the first."""
    n = len(alphabet)
    df = spark.range(n ** width)
    digits = [F.substring(F.lit(alphabet), (F.floor(F.col("id") / n ** i) % n + 1).cast("int"), F.lit(1)) for i in range(width)]
    return df.select((F.col("id") + 1).alias("word_no"), F.concat(*(reversed(digits) if fast_right else digits)).alias("word"))
