"""Which hashes occur in more than one record: partition-merged once / repeatedly seen filters.

The rows lie in a stored table whose column ``p`` numbers the task that wrote
them.  Each task sends its distinct hashes once, with a bit for those that more than one of its own records have:
one packed block for each range of the hash space.  A block is a Bloom filter of
one probe in a bitmap of 2^64 places (2^96 with the second hash), kept as the sorted places
of its bits; as differences in byte planes they take two to five bytes each once compressed.
The blocks of a range are merged where they meet: a place that is set in two of them, or marked in one,
is *repeated*.  For every task that holds one, the repeated places of its own blocks are written to the shared folder,
and a later pass over the rows of ``p`` reads those and no others.

Asked ``by_first``, the blocks tell besides, for each first hash that is repeated, whether all its
records have the same second hash.

Nothing is broadcast or collected, no filter has a size limit, and a hash that a third of all
records have is one entry for each task.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.session import shared_folder

FLUSH = 8_000_000  # entries that a task holds before it sends them (96 MB)
ONE, SEVERAL = 1, 2
_ENTRIES = "part int, p int, n int, entries binary"


def pack(h: np.ndarray, g: np.ndarray, many: np.ndarray) -> bytes:
    """Sorted places as differences in byte planes, the second hash in planes, then the marks as bits."""
    d = np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    s = g.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return np.ascontiguousarray(d).tobytes() + np.ascontiguousarray(s).tobytes() + np.packbits(many).tobytes()


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8)
    h = np.cumsum(np.ascontiguousarray(x[:8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    g = np.ascontiguousarray(x[8 * n:12 * n].reshape(4, n).T).view("<u4").ravel()
    return h, g, np.unpackbits(x[12 * n:], count=n).astype(bool)


def distinct(h: np.ndarray, g: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h, g), sorted, and whether more than one of the owners has it."""
    order = np.lexsort((g, h))
    h, g, own = h[order], g[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    many = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at) if len(at) else np.zeros(0, bool)
    return h[at], g[at], many


def _blocks(hashes: Callable, parts: int):
    """``hashes(batch)`` yields (p, h, g, owner) arrays; owners are numbers of the batch's rows."""
    cuts = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)

    def send(p, held):
        h, g, many = held
        at = np.concatenate([[0], np.searchsorted(h, cuts), [len(h)]])
        full = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([p] * len(full), pa.int32()), pa.array(np.diff(at)[full], pa.int32()),
             pa.array([pack(h[a:z], g[a:z], many[a:z]) for a, z in zip(at[full], at[full + 1])], pa.binary())],
            ["part", "p", "n", "entries"],
        )

    def merged(runs):
        if len(runs) == 1:
            return runs[0]
        h, g, many = (np.concatenate(x) for x in zip(*runs))
        run = np.repeat(np.arange(len(runs)), [len(r[0]) for r in runs])
        own = np.where(many, -1 - run, run)  # a mark survives: it differs from all owners below
        a, b, both = distinct(h, g, own)
        marks = distinct(h[many], g[many], run[many])
        both[np.isin(a, marks[0]) & _in_pairs(a, b, *marks[:2])] = True
        return a, b, both

    def run(batches):
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            for p, h, g, own in hashes(batch):
                if not len(h):
                    continue
                held.setdefault(p, []).append(distinct(h, g, own))
                sizes[p] = sizes.get(p, 0) + len(held[p][-1][0])
                if sizes[p] > FLUSH:
                    yield send(p, merged(held.pop(p)))
                    sizes[p] = 0
        for p, runs in held.items():
            yield send(p, merged(runs))

    return run


def _in_pairs(h: np.ndarray, g: np.ndarray, hs: np.ndarray, gs: np.ndarray) -> np.ndarray:
    """Whether each (h, g) is among the pairs, which are sorted; few pairs share their first hash."""
    found = np.zeros(len(h), bool)
    if not len(hs):
        return found
    at = np.searchsorted(hs, h)
    live = np.flatnonzero(at < len(hs))
    live = live[hs[at[live]] == h[live]]
    while len(live):
        hit = gs[at[live]] == g[live]
        found[live[hit]] = True
        live = live[~hit]
        at[live] += 1
        live = live[at[live] < len(hs)]
        live = live[hs[at[live]] == h[live]]
    return found


def _merge(by_first: bool):
    """Blocks come sorted by range; for each task of the range, its repeated places."""
    def done(held):
        parts = [unpack(e, n) for _, n, e in held]
        h, g, many = (np.concatenate(x) for x in zip(*parts))
        block = np.repeat(np.arange(len(held)), [n for _, n, _ in held])
        order = np.lexsort((g, h))
        h, g, many, block = h[order], g[order], many[order], block[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(h)))
        hit = (size > 1) | np.logical_or.reduceat(many, at)
        if by_first:  # pairs of one first hash lie side by side
            first = np.flatnonzero(np.concatenate([[True], h[at[1:]] != h[at[:-1]]]))
            kinds = np.repeat(np.diff(np.append(first, len(at))), np.diff(np.append(first, len(at))))
            hit |= kinds > 1
            g = np.repeat(np.where(kinds > 1, SEVERAL, ONE), size).astype(np.uint32)
        hit = np.repeat(hit, size)
        h, g, block = h[hit], g[hit], block[hit]
        back = np.argsort(block, kind="stable")
        h, g, block = h[back], g[back], block[back]
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
        ends = np.append(cut[1:], len(block))
        return pa.RecordBatch.from_arrays(
            [pa.array([held[block[a]][0] for a in cut], pa.int32()), pa.array(ends - cut, pa.int32()), pa.array([pack(h[a:z], g[a:z], np.zeros(0, bool)) for a, z in zip(cut, ends)], pa.binary())],
            ["p", "n", "entries"],
        )

    def run(batches):
        now, held = None, []
        for b in batches:
            for part, p, n, e in zip(*(b.column(i).to_pylist() for i in range(4))):
                if part != now and held:
                    yield done(held)
                    held = []
                now = part
                held.append((p, n, e))
        if held:
            yield done(held)

    return run


def repeated(rows: DataFrame, hashes: Callable, by_first: bool = False) -> str:
    """The folder that holds, for each ``p`` of the stored ``rows``, its hashes that more than one record has.

    With ``by_first`` these are the first hashes that more than one record (or one record with several second hashes) has, and in
    place of the second hash stands ONE or SEVERAL, for the number of second hashes they come with.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.mapInArrow(_blocks(hashes, parts), _ENTRIES)
    replies = blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge(by_first), "p int, n int, entries binary")
    folder = shared_folder(spark, "repeats")
    replies.repartition(parts, "p").write.mode("append").partitionBy("p").parquet(folder)
    return folder


class Replies:
    """Reads what :func:`repeated` wrote, for the partitions that a task meets."""

    def __init__(self, folder: str):
        self.folder, self.known = folder, {}

    def of(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        if p not in self.known:
            self.known = {p: self._read(p)}  # one at a time: the rows of a file have one p
        return self.known[p]

    def _read(self, p: int):
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        found = system.get_file_info(fs.FileSelector(f"{path}/p={p}", allow_not_found=True))
        runs = []
        for f in found:
            if f.path.endswith(".parquet"):
                t = pq.ParquetFile(system.open_input_file(f.path)).read(columns=["n", "entries"])
                runs += [unpack(e, n)[:2] for n, e in zip(t["n"].to_pylist(), t["entries"].to_pylist())]
        if not runs:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        h, g = (np.concatenate(x) for x in zip(*runs))
        order = np.lexsort((g, h))
        return h[order], g[order]

    def kind(self, p: int, h: np.ndarray) -> np.ndarray:
        """0, ONE or SEVERAL for each first hash, of what was asked ``by_first``."""
        hs, kinds = self.of(p)
        if not len(hs):
            return np.zeros(len(h), np.uint32)
        at = np.minimum(np.searchsorted(hs, h), len(hs) - 1)
        return np.where(hs[at] == h, kinds[at], 0)

    def has(self, p: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        return _in_pairs(h, g, *self.of(p))


def numbered(df: DataFrame) -> DataFrame:
    """The rows with the number of the task that holds them, ready to be stored."""
    return df.withColumn("p", F.spark_partition_id())


def by_task(batch: pa.RecordBatch, col: str = "p") -> Iterator[tuple[int, np.ndarray]]:
    """(p, row numbers) of a batch; as a rule there is one p."""
    p = np.asarray(batch.column(batch.schema.get_field_index(col)))
    for x in np.unique(p):
        yield int(x), np.flatnonzero(p == x)
