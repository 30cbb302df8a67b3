"""k-mer counts, transitions and tables by place."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.alphabets import DNA_ALPHABET, DNA_BASES
from helixframe.functions.transforms import all_words
from helixframe.kernels.arrow import pieces, row_of, window_codes


def kmers(df: DataFrame, id_col: str, seq_col: str, k: int, step: int = 1, bases: str = DNA_BASES) -> DataFrame:
    """``(id, kmer)``: one row for each window of k bases, starts 1, 1 + step, ...; windows with another letter are skipped.

    Null and short sequences give no row.  1 <= k <= 15.
    """
    if not 1 <= k <= 15 or step < 1:
        raise ValueError("k must be 1 to 15, step at least 1")
    good = np.zeros(256, np.int64)
    good[np.frombuffer(bases.encode(), np.uint8)] = 1

    def run(batches):
        for b in batches:
            for first, data, offsets in pieces(b.column(1)):
                n = max(len(data) - k + 1, 0)
                sums, rows = np.concatenate([[0], np.cumsum(good[data])]), row_of(offsets)[:n]
                at = np.arange(n)
                at = at[(sums[k:k + n] - sums[:n] == k) & (at + k <= offsets[1:][rows]) & ((at - offsets[rows]) % step == 0)]
                text = np.lib.stride_tricks.sliding_window_view(data, k)[at].tobytes() if len(at) else b""
                words = pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(text))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[at] + first)), words], ["id", "kmer"])

    id_type = df.schema[id_col].dataType.simpleString()
    src = df.where(F.length(seq_col) >= k).select(F.col(id_col).alias("id"), F.col(seq_col).alias("s"))
    return src.mapInArrow(run, f"id {id_type}, kmer string").withColumnRenamed("id", id_col)


def _counts(k: int, step: int, by_row: bool, zeros: bool = False):
    """k-mer counts of each batch, by row or over the whole task (up to k = 10 in one array that is sent once)."""
    def run(batches):
        whole = np.zeros(4 ** k, np.int64) if k <= 10 and not by_row else None
        for b in batches:
            for first, data, offsets in pieces(b.column(b.num_columns - 1)):
                rows, at, code = window_codes(data, offsets, k)
                if step > 1:
                    on = (at - offsets[rows]) % step == 0
                    rows, code = rows[on], code[on]
                if whole is not None:
                    whole += np.bincount(code, minlength=4 ** k)
                    continue
                if zeros:  # a table of all words for some rows at a time
                    every, few = 4 ** k, max((1 << 20) // 4 ** k, 1)
                    for a in range(0, len(offsets) - 1, few):
                        z = min(a + few, len(offsets) - 1)
                        on = (rows >= a) & (rows < z)
                        n = np.bincount((rows[on] - a) * every + code[on], minlength=(z - a) * every)
                        ids = b.column(0).take(pa.array(np.repeat(np.arange(a, z) + first, every)))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(every), z - a)), pa.array(n)], ["id", "code", "n"])
                elif by_row:
                    order = np.lexsort((code, rows))
                    rows, code = rows[order], code[order]
                    new = np.ones(len(code), bool)
                    new[1:] = (code[1:] != code[:-1]) | (rows[1:] != rows[:-1])
                    cut = np.flatnonzero(new)
                    n = np.diff(np.append(cut, len(code)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[cut] + first)), pa.array(code[cut]), pa.array(n)], ["id", "code", "n"])
                else:
                    codes, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])
        if whole is not None:
            codes = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(whole[codes])], ["code", "n"])

    return run


def _word(k: int):
    """The word of a code, as a Column."""
    letters = [F.substring(F.lit("ACGT"), (F.shiftright("code", 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)]
    return F.concat(*letters)


def oligo_frequency(df: DataFrame, id_col: str, seq_col: str, k: int, step: int = 1, zeros: bool = False) -> DataFrame:
    """``(id, kmer, n)``, counted where the sequence is; no shuffle.  With ``zeros`` a row for every k-mer and sequence.

    Rows with the same id count one by one.  Null and short sequences give no row (zeros with ``zeros``).
    """
    if not 1 <= k <= 15 or step < 1:
        raise ValueError("k must be 1 to 15, step at least 1")
    id_type = df.schema[id_col].dataType.simpleString()
    counts = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("s")).mapInArrow(_counts(k, step, True, zeros), f"id {id_type}, code long, n long")
    return counts.select(F.col("id").alias(id_col), _word(k).alias("kmer"), "n")


def oligo_frequency_collapsed(df: DataFrame, id_col: str, seq_col: str, k: int, step: int = 1, zeros: bool = True, as_prob: bool = False) -> DataFrame:
    """``(kmer, n)`` over all sequences; each task sends one row for a k-mer.  With ``as_prob`` ``n`` is the share of all k-mers."""
    if not 1 <= k <= 15 or step < 1:
        raise ValueError("k must be 1 to 15, step at least 1")
    counts = df.select(F.col(seq_col).alias("s")).mapInArrow(_counts(k, step, False), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = counts.select(_word(k).alias("kmer"), "n")
    if as_prob:
        counts = counts.join(F.broadcast(counts.agg(F.sum("n").alias("all"))), how="inner", on=F.lit(True)).select("kmer", (F.col("n") / F.col("all")).alias("n"))  # one row
    if not zeros:
        return counts
    words = all_words(df.sparkSession, DNA_BASES, k).select(F.col("word").alias("kmer"))
    return words.join(counts, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


def oligo_transitions(df: DataFrame, id_col: str, seq_col: str, left: int = 1, right: int = 1) -> DataFrame:
    """``(left_word, right_word, n, prob)``: how often a left word is followed by a right word."""
    counts = oligo_frequency_collapsed(df, id_col, seq_col, left + right)
    t = counts.select(F.substring("kmer", 1, left).alias("left_word"), F.substring("kmer", left + 1, right).alias("right_word"), "n")
    total = F.sum("n").over(Window.partitionBy("left_word"))
    return t.withColumn("prob", F.col("n") / F.when(total > 0, total))


def nucleotide_frequency_at(df: DataFrame, seq_col: str, at: list[int], bases: str = DNA_BASES) -> DataFrame:
    """``(l1, l2, ..., n)``: joint table of the bases at the given places; other letters and short sequences drop out."""
    s = F.col(seq_col)
    cols = [F.substring(s, p, 1).alias(f"l{i}") for i, p in enumerate(at, 1)]
    names = [f"l{i}" for i in range(1, len(at) + 1)]
    picked = df.where(F.length(s) >= max(at)).select(*cols)
    for n in names:
        picked = picked.where(F.col(n).isin(*bases))
    return picked.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def consensus_matrix(df: DataFrame, seq_col: str, shift_col: str | None = None, width: int | None = None, alphabet: str = DNA_ALPHABET, base_only: bool = False, as_prob: bool = False) -> DataFrame:
    """``(pos, letter, n)``: letters by column of the stacked sequences, each shifted to the right.

    Columns from 1 to ``width`` (the end of the longest without it).  Counts are combined before the shuffle.
    With ``base_only`` all letters but the bases count as ``other``; with ``as_prob`` ``n`` is the share of its column.
    """
    shift = F.coalesce(F.col(shift_col), F.lit(0)) if shift_col else F.lit(0)
    src = df.where(F.col(seq_col).isNotNull()).select(shift.cast("long").alias("shift"), F.col(seq_col).alias("s"))
    cells = src.mapInArrow(_letter_cells(width), "pos long, code int, n long").groupBy("pos", "code").agg(F.sum("n").alias("n"))
    matrix = cells.select(F.col("pos").cast("int").alias("pos"), F.char("code").alias("letter"), "n").where(F.col("letter").isin(*alphabet))
    if base_only:
        matrix = matrix.groupBy("pos", F.when(F.col("letter").isin(*DNA_BASES), F.col("letter")).otherwise("other").alias("letter")).agg(F.sum("n").alias("n"))
    return matrix.withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy("pos"))) if as_prob else matrix


def _letter_cells(width: int | None):
    """Letters by column of each piece of a batch: one row for a column and letter."""
    def run(batches):
        for b in batches:
            shifts = np.asarray(b.column(0))
            for first, data, offsets in pieces(b.column(1)):
                rows = row_of(offsets)
                pos = np.arange(len(data)) - offsets[rows] + 1 + shifts[rows + first]
                ok = (data < 128) & (pos >= 1) & (pos <= (width if width is not None else pos.max(initial=0)))
                cell = pos[ok] * 128 + data[ok]
                if len(cell) and cell.max() < 8 * len(cell) + 1_000_000:
                    n = np.bincount(cell)
                    cells = np.flatnonzero(n)
                    n = n[cells]
                else:
                    cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((cells // 128).astype(np.int64)), pa.array((cells % 128).astype(np.int32)), pa.array(n.astype(np.int64))], ["pos", "code", "n"])

    return run


def weight_matrices(df: DataFrame, seq_col: str, kind: str = "log2probratio", prior: dict[str, float] | None = None) -> DataFrame:
    """``(width, pos, base, weight)``: unit-scaled weight matrices of the sequences, one for each width.

    The counts of a place are smoothed by the prior (0.25 a base without one); ``kind`` is ``prob`` or ``log2probratio``.  Sequences with
    other letters than bases aren't wanted: their columns would not sum up.  Null and empty sequences have no matrix.
    """
    prior = prior or dict.fromkeys(DNA_BASES, 0.25)
    s, far = F.col(seq_col), 1 << 20
    src = df.where(s != "").select(F.length(s).cast("long").alias("width"), s.alias("s"))
    # the width stands in the upper bits of the place, so one matrix of counts holds all widths
    cells = src.select((F.col("width") * far).alias("shift"), "s").mapInArrow(_letter_cells(None), "pos long, code int, n long").groupBy("pos", "code").agg(F.sum("n").alias("n"))
    by_place = cells.groupBy("pos").agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("code") == ord(b), F.col("n"))), F.lit(0)).alias(b) for b in DNA_BASES])
    weights, every = F.create_map(*[x for b in DNA_BASES for x in (F.lit(b), F.lit(float(prior[b])))]), float(sum(prior.values()))
    rows = by_place.select(F.floor(F.col("pos") / far).cast("int").alias("width"), (F.col("pos") % far).cast("int").alias("pos"), "total", F.inline(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in DNA_BASES])))
    post = (F.col("n") + weights[F.col("base")]) / (F.col("total") + every)
    w = rows.withColumn("w", post if kind == "prob" else F.log2(post / (weights[F.col("base")] / every)))
    ends = w.groupBy("width", "pos").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).groupBy("width").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    return w.join(ends, "width").select("width", "pos", "base", ((F.col("w") - F.col("lo") / F.col("width")) / (F.col("hi") - F.col("lo"))).alias("weight"))


def consensus_string(matrix: DataFrame, threshold: float = 0.25, ambiguity: bool = True) -> DataFrame:
    """``(pos, letter)`` of a consensus matrix.

    With ``ambiguity`` every letter is spread evenly over its bases, the bases that reach the
    threshold are taken, and the letter that stands for them all; without it, the one
    letter that reaches the threshold, else ``?``.
    """
    from helixframe.alphabets import IUPAC_CODE_MAP

    total = F.sum("n").over(Window.partitionBy("pos"))
    probs = matrix.withColumn("p", F.col("n") / total)
    if not ambiguity:
        return probs.groupBy("pos").agg(
            F.when(F.sum((F.col("p") >= threshold).cast("int")) == 1, F.max(F.when(F.col("p") >= threshold, F.col("letter")))).otherwise("?").alias("letter")
        )
    spread = F.create_map(*[x for k, v in IUPAC_CODE_MAP.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    by_base = probs.withColumn("bases", F.element_at(spread, F.col("letter"))).where("bases is not null")
    by_base = by_base.select("pos", F.explode("bases").alias("base"), (F.col("p") / F.size("bases")).alias("p")).groupBy("pos", "base").agg(F.sum("p").alias("p"))
    names = F.create_map(*[F.lit(x) for k, v in IUPAC_CODE_MAP.items() for x in (v, k)])
    kept = F.array_join(F.array_sort(F.collect_list(F.when(F.col("p") >= threshold - 1e-12, F.col("base")))), "")
    return by_base.groupBy("pos").agg(F.coalesce(F.element_at(names, kept), F.lit("?")).alias("letter"))


def two_way_frequency(df: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """``(x, y, n)``: pairs of letters at the same place of two sequences of the same length."""
    a, b = F.col(a_col), F.col(b_col)
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return df.where((F.length(a) == F.length(b)) & (a != "")).select(F.explode(pairs).alias("z")).groupBy(F.col("z.x").alias("x"), F.col("z.y").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def sliding_letter_frequency(df: DataFrame, id_col: str, seq_col: str, view_width: int, letters: str) -> DataFrame:
    """``(id, start, n)``: letters among the given ones in every window of the given width.

    Differences of running counts over the Arrow buffer; no shuffle.
    """
    table = np.zeros(256, np.int64)
    table[np.frombuffer(letters.encode(), np.uint8)] = 1
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for first, data, offsets in pieces(b.column(1)):
                n = len(data) - view_width + 1
                if n <= 0:
                    continue
                sums = np.concatenate([[0], np.cumsum(table[data])])
                rows = row_of(offsets)[:n]
                at = np.flatnonzero(np.arange(n) + view_width <= offsets[1:][rows])
                rows = rows[at]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows + first)), pa.array((at - offsets[rows] + 1).astype(np.int32)), pa.array((sums[at + view_width] - sums[at]).astype(np.int32))], ["id", "start", "n"]
                )

    src = df.where(F.length(seq_col) >= view_width).select(F.col(id_col).alias("id"), F.col(seq_col).alias("s"))
    return src.mapInArrow(run, f"id {id_type}, start int, n int").withColumnRenamed("id", id_col)


def n50(df: DataFrame, size_col: str) -> DataFrame:
    """``(n50)``: the size at which the running sum of descending sizes reaches half of the total.

    Sizes are counted first, so the ordered window runs over distinct sizes only.
    """
    by_size = df.where(F.col(size_col).isNotNull()).groupBy(F.col(size_col).alias("size")).agg(F.sum(F.col(size_col)).alias("part"))
    every = Window.partitionBy(F.lit(1))  # the window holds one row for a distinct size
    running = F.sum("part").over(every.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    sums = by_size.withColumn("running", running).withColumn("total", F.sum("part").over(every))
    return sums.where(F.col("running") * 2 >= F.col("total")).agg(F.max("size").alias("n50"))
