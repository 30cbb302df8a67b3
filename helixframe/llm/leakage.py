"""Evaluation texts inside training texts: size-partitioned MinHash containment search.

A short item inside a long document has a tiny resemblance to it, so both are partitioned into passages of one
size: ``n_words`` words in a row, each a set of ``n_words - K_WORDS + 1`` word shingles.  Passages
of one size are alike or not: where a document contains a passage of an item, the containment of the two
passages is 1 and so is their resemblance, and their MinHash is equal for certain.  So one minimum
is sketch enough for a passage, and the search loses nothing.  Neighbouring passages mostly have
the same minimum, so an item's sketch has about one value for each (n_words - K_WORDS + 2) / 2 words.

The sketches of all items are gathered in a filter of at most ``GATE_BITS`` bits.  Each document is read once; only
passages whose MinHash is in the filter are candidates.  They are shuffled
to the items' passages and verified word by word, and the containment of an item is
counted exactly over its distinct passages of ``n_words`` words.  A filter that is full lets more candidates
through and changes no result.

The items go through the same shuffle; nothing but the filter is collected or broadcast.
A passage that a third of all documents have is spread over ``SALT`` keys.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.kernels.arrow import pieces
from helixframe.llm.near_dup import mix

N_WORDS = 12
K_WORDS = 5
GATE_BITS = 1 << 27  # 16 MB, the bound of what is broadcast
SALT = 8
_CHUNK = 1 << 20  # bytes of text hashed at a time; a longer text is one chunk
_LOW = np.zeros(256, np.uint8)
for _c in range(26):
    _LOW[65 + _c] = _LOW[97 + _c] = 97 + _c
for _c in range(48, 58):
    _LOW[_c] = _c
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_C = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, starts, ends, rows) of the words of a buffer; no word crosses a row."""
    low = _LOW[data]
    on = low != 0
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    begin = on.copy()
    begin[1:] &= ~on[:-1] | edge[1:len(low)]
    stop = on.copy()
    stop[:-1] &= ~on[1:] | edge[1:len(low)]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class Passages:
    """The passages of ``n_words`` words of a buffer, with their MinHash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n_words: int, powers: tuple[np.ndarray, np.ndarray]):
        self.low, self.starts, self.ends, rows = word_spans(data, offsets)
        self.n_words = n_words
        n = len(self.starts) - n_words + 1
        if n <= 0:
            self.at, self.row, self.sketch = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.low.astype(np.uint64) * powers[0][:len(self.low)], dtype=np.uint64)])
        words = mix((sums[self.ends] - sums[self.starts]) * powers[1][self.starts])
        k = min(K_WORDS, n_words)
        h = words[:len(words) - k + 1].copy()
        for j in range(1, k):
            h *= _C
            h += words[j:j + len(h)]
        low, size, wide = mix(h), 1, n_words - k + 1
        while 2 * size <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if rest := wide - size:
            low = np.minimum(low[:len(low) - rest], low[rest:])
        self.at = np.flatnonzero(rows[:n] == rows[n_words - 1:])
        self.row, self.sketch = rows[self.at], low[self.at]

    def text(self, i: int) -> str:
        """The words of the i-th passage, one blank apart."""
        a = self.at[i]
        piece = self.low[self.starts[a]:self.ends[a + self.n_words - 1]].tobytes()
        return b" ".join(piece.replace(b"\0", b" ").split()).decode()


def _places(sketch: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bits of the filter for each value."""
    m = np.uint64(bits - 1)
    return [(sketch & m).astype(np.int64), ((sketch >> np.uint64(32)) * np.uint64(3) & m).astype(np.int64)]


def _passages(n_words: int, gate=None):
    """``(id, sketch, passage)`` of each row ``(id, text)``; with a gate only of sketches that are in it."""
    def run(batches):
        powers = (_powers(_B, 2 * _CHUNK), _powers(_B_INV, 2 * _CHUNK))
        bits = None if gate is None else np.unpackbits(np.frombuffer(gate.value, np.uint8)).astype(bool)
        for b in batches:
            for first, data, offsets in pieces(b.column(1), _CHUNK):
                if len(data) > len(powers[0]):
                    powers = (_powers(_B, len(data)), _powers(_B_INV, len(data)))
                x = Passages(data, offsets, n_words, powers)
                on = np.arange(len(x.at))
                if bits is not None:
                    one, two = _places(x.sketch, len(bits))
                    on = np.flatnonzero(bits[one] & bits[two])
                rows = x.row[on]
                seen, keep, texts = set(), [], []
                for j, i in enumerate(on.tolist()):
                    t = (rows[j], x.text(i))
                    if t not in seen:  # a passage that a text repeats is sent once
                        seen.add(t)
                        keep.append(j)
                        texts.append(t[1])
                keep = np.array(keep, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows[keep] + first)), pa.array(x.sketch[on[keep]].view(np.int64)), pa.array(texts, pa.string())], ["id", "sketch", "passage"]
                )

    return run


def _gate_bits(bits: int):
    def run(batches):
        on = np.zeros(bits, bool)
        for b in batches:
            for at in _places(np.asarray(b.column(0)).view(np.uint64), bits):
                on[at] = True
        if on.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    return run


def _merged(batches):
    whole = None
    for b in batches:
        for x in b.column(0):
            x = np.frombuffer(x.as_buffer(), np.uint8)
            whole = x.copy() if whole is None else whole | x
    if whole is not None:
        yield pa.RecordBatch.from_pydict({"bits": pa.array([whole.tobytes()], pa.binary())})


def sketch_filter(passages: DataFrame) -> bytes:
    """A filter of the items' sketches, merged by the executors: 16 bits for each, at most GATE_BITS."""
    n = passages.select(F.approx_count_distinct("sketch")).first()[0]
    bits = 1 << 10
    while bits < 16 * n and bits < GATE_BITS:
        bits *= 2
    parts = passages.select("sketch").mapInArrow(_gate_bits(bits), "bits binary")
    while parts.rdd.getNumPartitions() > 8:  # a tree of merges, as each part has up to GATE_BITS
        parts = parts.repartition(max(parts.rdd.getNumPartitions() // 8, 1)).mapInArrow(_merged, "bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        whole |= np.frombuffer(bytes(r[0]), np.uint8)
    return whole.tobytes()


def leaked_items(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, n_words: int = N_WORDS) -> DataFrame:
    """``(doc, item, shared, containment)``: documents that hold at least one passage of an item, how many of its distinct passages, and which part of it.

    Defined results: null and short texts on either side give no row; rows with the same id are one
    document, or one item, with the passages of all of them; rows with a null id are left out; other
    columns are not carried, so none clash; empty tables give an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("t")).where("id is not null and t is not null")
    wanted = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("t")).where("id is not null and t is not null")
    schema = "id long, sketch long, passage string"
    of_items = wanted.mapInArrow(_passages(n_words), schema).distinct()
    gate = spark.sparkContext.broadcast(sketch_filter(of_items))
    of_docs = src.mapInArrow(_passages(n_words, gate), schema)
    salted = of_docs.select(F.col("id").alias("doc"), "sketch", "passage", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt"))
    targets = of_items.select(F.col("id").alias("item"), "sketch", "passage", F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
    sizes = of_items.groupBy("id").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("id", "item")
    # one row for a passage of a document; several if the document came in several rows
    both = salted.join(targets, ["sketch", "passage", "salt"]).select("doc", "item", "passage").distinct()
    found = both.groupBy("doc", "item").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    return found.join(sizes, "item").select("doc", "item", "shared", (F.col("shared") / F.col("size")).alias("containment"))
