"""Near-duplicate records with small edits.

The method named for this problem, anchor-point covering with a covering code, can't reach a similarity of 0.5 over 8-letter
windows (see the README for the figures), so this is a sketch join: each record's *fingerprint* is the ``sketch`` smallest hash
values of its distinct long windows (``PROBE`` letters each), the *anchors* are these hash values, and records that
meet at an anchor are compared by the exact similarity of their distinct ``window``-letter windows.
Two records are found if their fingerprints agree anywhere.

A pair meets at most where it has to: each replica carries a mark of the letter that stands before it in its own
fingerprint, and two records with the same mark have met at that letter already.  In a family of nearly equal records most pairs
meet only where their fingerprints come together again behind a difference, not at each of their common anchors.

Skew.  Exact copies are collapsed first.  Windows that occur in more than
``HOT_SHARE`` of all records (adapters, a family that holds a third of the rows)
are *hot*; there are at most windows-per-record / HOT_SHARE of them, so their
list is broadcast.  They are found by counters, whose number grows with the length of the records (2^22 up to 400 letters on average), so
that unrelated records don't fill them.  Every record is replicated to anchors of its windows that
aren't hot, and an adapter does not bring all records that carry it to one anchor.
Two records may have no other long window in common, as the parts between hot ones
can be moved in pieces shorter than a window.  So a record with any hot window has
two more routes, and since a hot window is hot in both, so have both records:

* a second fingerprint of its short windows (``SHORT`` letters) that aren't hot
  themselves, with ``2 * sketch`` letters.  At the similarity 0.5 moved parts
  are 21 letters long on average, and about 0.47 of the short windows are common;
* the anchors of its hot windows, if these make up more than ``HOT_PART`` of its long
  or ``SHORT_PART`` of its short windows.  What has a smaller part keeps some common short
  windows that aren't hot, and two records that have nothing else in common are both above it.

What remains is the chance that two fingerprints agree nowhere though their windows do.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm.arrow import buffer_of, row_of
from helixframe.operators.skew import join_groups

PROBE = 16        # letters of a fingerprint window
SHORT = 12        # letters of a window of the second fingerprint
SKETCH = 28       # letters of a fingerprint
HOT_SHARE = 2e-4  # a window in more than this share of the records is hot
HOT_PART = 0.25   # records with a larger share of hot windows are replicated to hot anchors too
SHORT_PART = 0.4  # the same for short windows
COUNTERS = (22, 27)  # bits of the counters that find hot windows, at least and at most

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each position, as one word (positions up to len - 8)."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def _code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like buffer_of, for a batch with characters beyond ASCII: one code point to a character."""
    parts = [np.frombuffer((x or "").encode("utf-32-le"), np.uint32) for x in col.to_pylist()]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffer_of(col)
    return _code_points(col) if len(data) and data.max() > 127 else (data, offsets)


def window_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-letter window, k = 8, 12 or 16; eight letters are hashed without collision.

    Letters beyond ASCII are hashed by code point and place in the window, to all
    64 bits; a window without any has the same hash in every batch.
    """
    p = packed(data.astype(np.uint8, copy=False))
    lens = np.diff(offsets)
    if k > 8:
        p = mix(p[:8 - k]) * _GOLD + p[k - 8:] if len(p) > k - 8 else p[:0]
    rows = row_of(offsets)[:len(p)]
    ok = np.arange(len(p)) + k <= offsets[1:][rows] if len(p) else np.zeros(0, bool)
    assert k in (8, 12, 16) and len(lens) == len(offsets) - 1
    h = mix(p)
    if data.dtype != np.uint8:
        cp = np.where(data > 127, data, 0).astype(np.uint64)
        for j in range(k):
            c = cp[j:j + len(h)]
            h = h + np.where(c > 0, mix(((c << np.uint64(8)) + np.uint64(j + 1)) * _GOLD), np.uint64(0))
    return rows[ok], h[ok]


def distinct_by_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 44-bit hashes by row: (row, hash, rank in the row).  A batch has under 2^20 rows."""
    key = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    r = (key >> np.uint64(44)).astype(np.int64)
    first = np.searchsorted(r, r) if len(r) else r
    return r, key & np.uint64((1 << 44) - 1), np.arange(len(r)) - first


def counter_bits(n: int, letters: int) -> int:
    """A text of unrelated letters fills each counter by its length / 2^bits, which has to stay well below HOT_SHARE."""
    least, most = COUNTERS
    bits = least
    while bits < most and letters > n * 400 * 2 ** (bits - least):
        bits += 1
    return bits


def _counter(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def _hot_counts(bits: int):
    def run(batches):
        counts, n = {k: np.zeros(1 << bits, np.int32) for k in (PROBE, SHORT)}, 0
        for b in batches:
            text = text_bytes(b.column(0))
            for k, c in counts.items():
                at = _counter(window_hashes(*text, k)[1] >> np.uint64(20), bits)
                if bits == COUNTERS[0]:
                    c += np.bincount(at, minlength=1 << bits).astype(np.int32)
                else:
                    u, m = np.unique(at, return_counts=True)
                    c[u] += m.astype(np.int32)
            n += b.num_rows
        for k, c in counts.items():
            hot = np.flatnonzero(c > max(HOT_SHARE * n, 8)) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"k": pa.array([k] * len(hot), pa.int32()), "counter": pa.array(hot, pa.int64()), "n": pa.array(c[hot], pa.int64())})

    return run


def hot_windows(seqs: DataFrame) -> tuple[int, dict[int, np.ndarray]]:
    """(bits, the counters of hot windows of either length); a window that one record repeats counts each time.

    Each task gives those above the share in its own part: a window above it
    overall is above it somewhere.  Of their sums, half the share of all records
    is kept, so the list has at most 2 * windows / HOT_SHARE entries.
    """
    rows, letters = seqs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()
    bits = counter_bits(rows, letters)
    found = seqs.mapInArrow(_hot_counts(bits), "k int, counter long, n long").groupBy("k", "counter").agg(F.sum("n").alias("n"))
    kept = found.where(F.col("n") > rows * HOT_SHARE / 2).select("k", "counter").collect()
    return bits, {k: np.array(sorted(c for x, c in kept if x == k), np.int64) for k in (PROBE, SHORT)}


def _planes(x: np.ndarray, n: int) -> bytes:
    """The lower ``n`` bytes of each number, byte by byte."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T[:n]).tobytes()


def _from_planes(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = data.reshape(n, -1).T
    return out.view("<i8").ravel()


def _marks(sym: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """8 bits of the letter before each one in its record's fingerprint; 0 for the first.

    Two different letters have equal marks once in 255 times.  A pair is lost by that only if it happens at each anchor where it
    should meet, which adds less than a hundredth to the chance that it has no anchor at all.
    """
    out = np.zeros(len(sym), np.int64)
    before = (mix(sym[:-1] * _GOLD) >> np.uint64(56)).astype(np.int64)
    same = rows[1:] == rows[:-1]
    out[1:][same] = np.maximum(before[same], 1)
    return out


def _anchors(buckets: int, least: int, bits: int, hot: dict[int, np.ndarray], sketch: int):
    """The replicas of each fingerprint, gathered by bucket of anchors: one row for a bucket and chunk.

    ``entries`` holds 3 bytes of the anchor and one of the mark for each replica, then the record's
    id as difference to the one before, all split in byte planes (ids ascend in a
    chunk, so most of their planes are zeros and cost nothing once compressed).
    """
    def flush(syms, marks, ids):
        sym, mark, rid = np.concatenate(syms), np.concatenate(marks), np.concatenate(ids)
        bucket = (sym % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((rid, bucket))
        sym, mark, rid, bucket = sym[order], mark[order], rid[order], bucket[order]
        key = ((sym // np.uint64(buckets)) & np.uint64(0xFFFFFF)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        out_b, out_e = [], []
        for a, z in zip(cuts[:-1], cuts[1:]):
            out_b.append(int(bucket[a]))
            out_e.append(_planes(key[a:z], 3) + _planes(mark[a:z], 1) + _planes(np.diff(rid[a:z], prepend=0), 8))
        return pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_e, pa.binary())], ["bucket", "entries"])

    def first(at, r, most):
        return at[np.arange(len(at)) - np.searchsorted(r[at], r[at]) < most]

    def run(batches):
        tables = {k: np.zeros(1 << bits, bool) for k in hot}
        for k, t in tables.items():
            t[hot[k]] = True
        syms, marks, ids, held = [], [], [], 0
        for b in batches:
            rid = np.asarray(b.column(0))
            text = text_bytes(b.column(1))
            r, sym, rank = distinct_by_row(*window_hashes(*text, PROBE))
            n = np.bincount(r, minlength=b.num_rows)
            rich = n[r] >= least
            if len(hot[PROBE]):
                is_hot = tables[PROBE][_counter(sym, bits)]
                n_hot = np.bincount(r, weights=is_hot, minlength=b.num_rows)
                carries = (n >= least) & (n_hot > 0)
                rows, h = window_hashes(*text, SHORT)
                rows, h = rows[carries[rows]], h[carries[rows]]
                short_r, short, _ = distinct_by_row(rows, h)
                short_hot = tables[SHORT][_counter(short, bits)]
                n_short = np.bincount(short_r, minlength=b.num_rows)
                n_short_hot = np.bincount(short_r, weights=short_hot, minlength=b.num_rows)
                full = (n_hot > HOT_PART * n) | (n_short_hot > SHORT_PART * n_short)
                second = first(np.flatnonzero(~short_hot), short_r, 2 * sketch)
                routes = [(sym, r, first(np.flatnonzero(~is_hot & rich), r, sketch)), (sym, r, first(np.flatnonzero(is_hot & rich & full[r]), r, sketch))]
                routes.append((mix(short + _GOLD) >> np.uint64(20), short_r, second))  # apart from the anchors of long windows
            else:
                routes = [(sym, r, np.flatnonzero(rich & (rank < sketch)))]
            for letters, rows, at in routes:
                if len(at):
                    syms.append(letters[at])
                    marks.append(_marks(letters[at], rows[at]))
                    ids.append(rid[rows[at]])
                    held += len(at)
            if held > 4_000_000:
                yield flush(syms, marks, ids)
                syms, marks, ids, held = [], [], [], 0
        if held:
            yield flush(syms, marks, ids)

    return run


def _meet(batches):
    """The pairs that meet at the anchors of each bucket; the batches come sorted by bucket."""
    def pairs(parts):
        columns = [[], [], []]
        for e in parts:
            x = np.frombuffer(e, np.uint8)
            n = len(x) // 12
            for c, v in zip(columns, (_from_planes(x[:3 * n], 3), _from_planes(x[3 * n:4 * n], 1), np.cumsum(_from_planes(x[4 * n:], 8)))):
                c.append(v)
        key, mark, rid = (np.concatenate(c) for c in columns)
        order = np.lexsort((rid, key))
        key, mark, rid = key[order], mark[order], rid[order]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.diff(np.append(np.flatnonzero(start), len(key)))
        left = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(np.flatnonzero(start), size)) - 1  # records behind this one at its anchor
        at, step = np.flatnonzero(left >= 1), 1
        held, n = [], 0
        while len(at):
            a, b, m = rid[at], rid[at + step], mark[at]
            keep = (a != b) & ((m != mark[at + step]) | (m == 0))
            held.append((a[keep], b[keep]))
            n += len(held[-1][0])
            step += 1
            at = at[left[at] >= step]
            if n > 2_000_000 or not len(at):
                a, b = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[:len(a)]
                yield pa.RecordBatch.from_arrays([pa.array(a[new], pa.int64()), pa.array(b[new], pa.int64())], ["a", "b"])
                held, n = [], 0

    now, parts = None, []
    for batch in batches:
        for bucket, e in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now and parts:
                yield from pairs(parts)
                parts = []
            now = bucket
            parts.append(e.as_buffer())
    if parts:
        yield from pairs(parts)


def _verify(window: int, threshold: float, least: int):
    """Keep the pairs whose exact similarity reaches the threshold.

    Most pairs met by chance: they go by 44 bits of each window, with room for
    three windows taken for one another; the rest is compared in full.
    """
    def near(batch):
        keys = []
        for c in ("seq_a", "seq_b"):
            rows, h = window_hashes(*text_bytes(batch.column(c)), window)
            key = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
            keys.append(key[np.append(True, key[1:] != key[:-1])[:len(key)]])
        key = np.sort(np.concatenate(keys))
        n_all, n_both = (np.bincount((k >> np.uint64(44)).astype(np.int64), minlength=batch.num_rows) for k in (key, key[1:][key[1:] == key[:-1]]))
        return pa.array(n_both + 3 >= threshold * (n_all - n_both))

    def run(batches):
        for batch in batches:
            batch = batch.filter(near(batch))
            n = batch.num_rows
            sets = []
            for c in ("seq_a", "seq_b"):
                rows, h = window_hashes(*text_bytes(batch.column(c)), window)
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
                sets.append((rows[new], h[new]))
            (ra, ha), (rb, hb) = sets
            na, nb = np.bincount(ra, minlength=n), np.bincount(rb, minlength=n)
            r, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            both = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n)
            union = na + nb - both
            ok = (na >= least) & (nb >= least) & (both >= threshold * union)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array(both[ok] / np.maximum(union[ok], 1), pa.float64())], ["a", "b", "similarity"]
            )

    return run


def _rich(window: int, least: int):
    """Rows with at least so many distinct windows."""
    def run(batches):
        for b in batches:
            rows, h = window_hashes(*text_bytes(b.column(1)), window)
            order = np.lexsort((h, rows))
            rows, h = rows[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
            n = np.bincount(rows[new], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(n >= least))], ["rep"])

    return run


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, window: int = 8, least: int = 30, sketch: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of representatives, and the members of each group of exact copies.

    ``pairs(a, b, similarity)``: a < b are the smallest ids of two different
    texts whose distinct windows have at least ``threshold`` in common.
    ``members(rep, id)``: every row of a text that occurs more than once and has
    at least ``least`` distinct windows, with the smallest id of that text.

    Defined results: letter case is ignored; null, empty and short texts (fewer
    than ``least`` distinct windows) are in neither; a repeated row is a copy;
    rows with a null id are left out; other columns are ignored, so none clash;
    an empty table gives two empty results.
    """
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shortest = least + window - 1
    reads = (
        df.select(F.col(id_col).cast("long").alias("id"), F.upper(F.col(text_col)).alias("seq"))
        .where(F.col("id").isNotNull() & (F.length("seq") >= shortest))
    )
    bits, hot = hot_windows(reads.select("seq"))

    keys = reads.select("id", F.xxhash64("seq").alias("h1"), F.hash("seq").alias("h2"))
    groups = keys.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = join_groups(keys, groups, ["h1", "h2"], "n").select("rep", "id")

    by_id = reads.repartition(n_parts, "id")
    reps = by_id.join(members.where("id <> rep").select("id"), "id", "left_anti")
    entries = reps.mapInArrow(_anchors(8 * n_parts, max(least - (PROBE - window), 1), bits, hot, sketch), "bucket int, entries binary")
    met = entries.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a long, b long").distinct()
    texts_a, texts_b = (by_id.select(F.col("id").alias(k), F.col("seq").alias(f"seq_{k}")) for k in "ab")
    pairs = met.join(texts_a, "a").join(texts_b, "b").select("a", "b", "seq_a", "seq_b").mapInArrow(_verify(window, threshold, least), "a long, b long, similarity double").dropDuplicates(["a", "b"])

    rich = members.where("id = rep").select("rep").join(by_id.withColumnRenamed("id", "rep"), "rep").select("rep", "seq").mapInArrow(_rich(window, least), "rep long")
    return pairs, members.join(rich, "rep")


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of rows, smaller id first: the links of representatives for each of their copies, and the copies among themselves."""
    ends = pairs.select("a", "b")
    for end in "ab":
        m = members.select(F.col("rep").alias(end), F.col("id").alias("row"))
        ends = ends.join(m.distinct(), end, "left").withColumn(end, F.coalesce("row", end)).drop("row")
    left, right = (members.select("rep", F.col("id").alias(k)) for k in "ab")
    same = left.join(right, "rep").where("a < b").select("a", "b")
    return ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same.distinct())
