"""Encoding of a corpus with a public byte-level BPE: corpus-level merge replay.

A text is cut before single spaces into *chunks* that encode independently.  One pass counts the chunks of the whole
corpus, and the merges are replayed over its vocabulary once: chunks are split into words
by the tokenizer's pattern, an inverted
index leads from each token pair to its positions in the words, the merges are
applied in rank order to all positions of a pair at once, and only the neighbours
of a merged pair are touched.  The encoded vocabulary, the ``TABLE_ROWS`` most frequent
chunks in at most ``TABLE_BYTES`` bytes, is broadcast; in the second pass it encodes most of every text by lookup.
What isn't in it (chunks so rare that sending them back to their documents would cost more than encoding them there) goes through the
same replay where it stands, all new words of a batch together.  What the table holds changes only the cost.

The vocabulary of the tokenizer is read from a rank file; its path is a parameter, and it is
never copied.
"""
from __future__ import annotations

import base64
import heapq
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TABLE_ROWS = 30_000      # chunks of the broadcast table at most
TABLE_BYTES = 2 << 20    # bytes of their texts at most
CHUNK_BYTES = 256        # longer chunks are in no table and no cache
CACHE_BYTES = 16 << 20   # texts and ids of rare chunks that a task keeps; beyond it starts anew, which changes only the cost


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def replay_merges(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Encode all words together by applying every merge in rank order over an inverted index."""
    out: list[list[int] | None] = [None] * len(words)
    sym: list[bytes] = []       # token that begins at a position; positions of all words in a row
    after: list[int] = []       # position of the next token, -1 at a word's end
    before: list[int] = []
    starts: list[tuple[int, int]] = []
    index: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for w, word in enumerate(words):
        whole = ranks.get(word)
        if whole is not None:
            out[w] = [whole]
            continue
        base, n = len(sym), len(word)
        starts.append((w, base))
        for i in range(n):
            sym.append(word[i:i + 1])
            before.append(base + i - 1 if i else -1)
            after.append(base + i + 1 if i + 1 < n else -1)
        for i in range(n - 1):
            r = ranks.get(word[i:i + 2])
            if r is not None:
                index.setdefault(r, []).append((base + i, word[i:i + 1], word[i + 1:i + 2]))
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        for p, left, right in sorted(index.pop(r)):
            q = after[p]
            # the place is stale if either token was merged away since
            if q < 0 or sym[p] != left or sym[q] != right:
                continue
            merged = left + right
            sym[p], sym[q] = merged, b""
            nxt = after[p] = after[q]
            if nxt >= 0:
                before[nxt] = p
            for a, b in ((before[p], p), (p, nxt)):
                if a >= 0 and b >= 0 and (rank := ranks.get(sym[a] + sym[b])) is not None:
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
                    index[rank].append((a, sym[a], sym[b]))
    for w, p in starts:
        ids = []
        while p >= 0:
            ids.append(ranks[sym[p]])
            p = after[p]
        out[w] = ids
    return out


_unsafe = re.compile(r"\s \s").search  # a space inside a run of white space


def chunks(text: str) -> list[str] | None:
    """The parts before single spaces, the first with a NUL before it; null if the text can't be cut."""
    if "\0" in text or _unsafe(text):
        return None
    head, *rest = text.split(" ")
    return ["\0" + head, *rest] if head else rest


def _chunk_counts(batches):
    """(chunk, n) of the task: what was counted is sent whenever it grows too large."""
    def emit(count):
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["chunk", "n"])

    count: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text and (parts := chunks(text)) is not None:
                count.update(parts)
        if len(count) > 200_000:
            # chunks seen once here stay out: one that is frequent in the corpus is repeated in some task
            yield emit({c: n for c, n in count.items() if n > 1 and len(c) <= CHUNK_BYTES})
            count = Counter()
    yield emit({c: n for c, n in count.items() if n > 1 and len(c) <= CHUNK_BYTES})


class Encoder:
    """Encodes batches of texts with a table of chunks; what isn't in it is learnt in bounds."""

    def __init__(self, path: str, table: tuple[list[str], np.ndarray, np.ndarray] | None = None):
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(PATTERN).findall
        self.table = table or ([], np.zeros(0, np.int32), np.zeros(1, np.int64))
        self._reset()

    def _reset(self) -> None:
        """Back to the table."""
        names, flat, starts = self.table
        self.chunk_no = {c: i for i, c in enumerate(names)}
        self.flat, self.starts, self.used = flat, starts, 0
        self.words: dict[str, list[int]] = {}

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, whose new words are encoded together, in one replay."""
        split = [self.split(c) for c in texts]
        new = list({w for ws in split for w in ws if w not in self.words})
        words = dict(zip(new, replay_merges([w.encode() for w in new], self.ranks)))
        out = [[i for w in ws for i in (self.words.get(w) or words[w])] for ws in split]
        for w, ids in words.items():
            if len(w) <= CHUNK_BYTES:
                self.words[w] = ids
                self.used += 200 + 8 * len(ids) + len(w)
        return out

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if self.used > CACHE_BYTES:
            self._reset()
        known, fresh, order, per_text, alone, n_known = self.chunk_no, [], [], [], [], len(self.chunk_no)
        passing: dict[str, int] = {}  # long chunks and uncut texts: known for this batch only

        def learn(key, cached):
            """The number of a chunk."""
            if not cached or len(key) > CHUNK_BYTES:
                if key not in passing:
                    passing[key] = -1 - len(alone)
                    alone.append(key if not cached else key[1:] if key[:1] == "\0" else " " + key)
                return passing[key]
            no = known.get(key)
            if no is None:
                no = known[key] = n_known + len(fresh)
                fresh.append(key[1:] if key[:1] == "\0" else " " + key)
                self.used += 100 + len(key)
            return no

        for text in texts:
            if not text:
                per_text.append(0)
            elif (parts := chunks(text)) is None:
                order.append(learn(text, False))
                per_text.append(1)
            else:
                nos = list(map(known.get, parts))
                if None in nos:
                    nos = [learn(c, True) if no is None else no for no, c in zip(nos, parts)]
                order += nos
                per_text.append(len(nos))
        flat, starts = self.flat, self.starts
        if fresh or alone:
            learnt = self.ids_of(fresh + alone)
            runs = [np.fromiter(chain.from_iterable(x), np.int32) for x in (learnt[:len(fresh)], learnt[len(fresh):])]
            ends = [np.cumsum([len(x) for x in part], dtype=np.int64) for part in (learnt[:len(fresh)], learnt[len(fresh):])]
            if fresh:
                self.flat = flat = np.concatenate([flat, runs[0]])  # at most the table and CACHE_BYTES
                self.starts = starts = np.concatenate([starts, starts[-1] + ends[0]])
                self.used += 4 * len(runs[0])
            if alone:
                flat = np.concatenate([flat, runs[1]])
                starts = np.concatenate([starts, starts[-1] + ends[1]])
        no = np.array(order, np.int64)
        no = np.where(no < 0, n_known + len(fresh) - 1 - no, no)
        lens = np.diff(starts)[no]
        total = int(lens.sum())
        ends = np.cumsum(lens)
        values = flat[np.arange(total) + np.repeat(starts[no] - (ends - lens), lens)]
        ends = np.concatenate([[0], ends])
        offsets = ends[np.concatenate([[0], np.cumsum(per_text)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def corpus_table(texts: DataFrame, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The most frequent chunks of the corpus with their ids: encoded by the executors, each once, and bounded by TABLE_ROWS and TABLE_BYTES."""
    counts = texts.mapInArrow(_chunk_counts, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    frequent = counts.orderBy(F.desc("n"), "chunk").limit(TABLE_ROWS)

    def encoded(batches):
        encoder = Encoder(path)
        for b in batches:
            names = b.column(0).to_pylist()
            ids = encoder.ids_of([c[1:] if c[:1] == "\0" else " " + c for c in names])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["chunk", "n", "ids"])

    rows = sorted(frequent.repartition(texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(encoded, "chunk string, n long, ids array<int>").collect(), key=lambda r: (-r["n"], r["chunk"]))
    sizes = np.cumsum([len(r["chunk"].encode()) + 4 * len(r["ids"]) for r in rows])
    rows = rows[:int(np.searchsorted(sizes, TABLE_BYTES, side="right"))] if rows else rows
    flat = np.array([i for r in rows for i in r["ids"]], np.int32)
    return [r["chunk"] for r in rows], flat, np.concatenate([[0], np.cumsum([len(r["ids"]) for r in rows])]).astype(np.int64)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARY) -> DataFrame:
    """``(id, ids array<int>)``: one row for each row of ``df``, without special tokens, the text taken unchanged.

    Defined results: null and empty texts give an empty list; a repeated row is
    encoded each time; other columns are not carried, so none clash; an empty
    table gives an empty result.
    """
    path = os.path.join(folder, vocabulary)
    id_type = df.schema[id_col].dataType.simpleString()
    table = df.sparkSession.sparkContext.broadcast(corpus_table(df.select(F.col(text_col).alias("t")), path))

    def run(batches):
        encoder = Encoder(path, table.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), encoder.encode(b.column(1).to_pylist())], ["k", "ids"])

    return df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {id_type}, ids array<int>").withColumnRenamed("k", id_col)
