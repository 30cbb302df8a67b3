"""FASTQ files as a Spark data source with byte-range partitions, and back.

``spark.dataSource.register(FastqSource)``, then ``spark.read.format("fastq").load(path)``.
A partition begins reading at the first validated record start in its range (a quality line may
begin with ``@`` too, so the mark alone is no proof) and ends with the record that begins last in it.
Files have to lie in a folder that all executors see.  Options: ``with_qualities`` (default true), ``on_error`` (``fail`` or ``skip``),
``range_bytes``, ``alphabet`` (DNA, RNA, AA or B).
"""
from __future__ import annotations

import glob
import gzip
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe import alphabets as A

SCHEMA = "fileno int, byte_offset bigint, name string, seq string, qual string, filepath string"
_ALPHABETS = {"DNA": A.DNA_ALPHABET, "RNA": A.RNA_ALPHABET, "AA": A.AA_ALPHABET}
MAX_LETTERS = 200_001  # fixed value: longer sequences aren't written


BLOCK = 8 << 20      # bytes that are cut into records at a time
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


class ByteRange(InputPartition):
    def __init__(self, fileno: int, path: str, start: int, end: int):
        self.fileno, self.path, self.start, self.end = fileno, path, start, end


def files_of(path: str) -> list[str]:
    out: list[str] = []
    for p in path.split(","):
        p = p.removeprefix("file://").removeprefix("file:")
        out += sorted(x for x in glob.glob(os.path.join(p, "*")) if os.path.isfile(x) and os.path.basename(x)[0] not in "._") if os.path.isdir(p) else sorted(glob.glob(p))
    return out


class _Lines:
    """Lines of a file with their offsets; blank lines are left out, and single lines can be put back."""

    def __init__(self, f, at: int):
        self.f, self.at, self.held = f, at, []

    def next(self) -> tuple[int, str] | None:
        if self.held:
            return self.held.pop()
        while raw := self.f.readline():
            at, self.at = self.at, self.at + len(raw)
            line = raw.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
            if line:
                return at, line
        return None

    def put_back(self, *lines) -> None:
        self.held += [x for x in reversed(lines) if x is not None]


def _allowed(alphabet: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer((alphabet + alphabet.lower()).encode(), np.uint8)] = True
    return table


def _texts(x: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray | None = None) -> pa.Array:
    """The stretches of a buffer as strings."""
    sizes = stops - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    letters = x[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], sizes)]
    if table is not None:
        letters = table[letters]
    elif len(letters) and letters.max() > 127:  # bytes that may not be UTF-8
        raw = letters.tobytes()
        return pa.array([raw[a:z].decode("utf-8", "replace") for a, z in zip(offsets[:-1], offsets[1:])], pa.string())
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters.tobytes()))


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["fileno", "byte_offset", "name", "seq", "qual", "filepath"])


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.paths = files_of(options["path"])
        self.size = int(options.get("range_bytes", 64 << 20))
        self.skip_errors = options.get("on_error", "fail") == "skip"
        self.alphabet = _ALPHABETS.get(options.get("alphabet", "DNA"))
        self.qualities = options.get("with_qualities", "true").lower() == "true"

    def partitions(self):
        out = []
        for no, p in enumerate(self.paths, 1):
            n = os.path.getsize(p)
            if p.endswith(".gz"):
                out.append(ByteRange(no, p, 0, -1))
            else:
                out += [ByteRange(no, p, a, min(a + self.size, n)) for a in range(0, n, self.size)]
        return out or [ByteRange(0, "", 0, 0)]

    def _error(self, part, at, what):
        return ValueError(f"{part.path}, byte {at}: {what}")

    def read(self, part):
        """Arrow batches: blocks of bytes are cut into lines and fields as arrays; only a block with an error is read line by line."""
        if not part.path:
            return
        f = gzip.open(part.path, "rb") if part.path.endswith(".gz") else open(part.path, "rb")
        with f:
            at = 0
            if part.start:
                f.seek(part.start - 1)
                lines = _Lines(f, 0)
                lines.at = part.start - 1 + len(f.readline())
                self._resync(lines)
                first = lines.next()
                if first is None:
                    return
                at = first[0]
                f.seek(at)
            rest, last = b"", False
            while not last:
                block = f.read(BLOCK)
                last = not block
                data = rest + block
                batch, used, done = self._batch(part, np.frombuffer(data, np.uint8), at, last)
                if batch is None:  # something is wrong in this block
                    f.seek(at)
                    yield from self._slow(part, f, at)
                    return
                if batch.num_rows:
                    yield batch
                if done:
                    return
                rest, at = data[used:], at + used

    def _batch(self, part, x: np.ndarray, at: int, last: bool):
        """(batch of the whole records, bytes used, whether the range ends here); no batch if a record is broken."""
        ends = np.flatnonzero(x == 10)
        starts = np.concatenate([[0], ends + 1])
        if last and starts[-1] < len(x):
            ends = np.append(ends, len(x))
        starts = starts[:len(ends)]
        stops = ends - ((ends > starts) & (x[np.maximum(ends - 1, 0)] == 13))
        full = np.flatnonzero(stops > starts)
        starts, stops, nexts = starts[full], stops[full], ends[full] + 1
        n = len(starts) // 4
        if last and len(starts) % 4 and not (part.end >= 0 and at + starts[4 * n] >= part.end):
            return None, 0, False
        begin = starts[:4 * n:4]
        done = False
        if part.end >= 0 and (over := np.flatnonzero(at + begin >= part.end)).size:
            n, done = int(over[0]), True
            begin = begin[:n]
        head, seq, plus, qual = ((starts[k:4 * n:4], stops[k:4 * n:4]) for k in range(4))
        size = seq[1] - seq[0]
        ok = (x[head[0]] == 64).all() and (x[plus[0]] == 43).all() and (qual[1] - qual[0] == size).all() if n else True
        up = None
        if ok and self.alphabet and n:
            bad = np.concatenate([[0], np.cumsum(~_allowed(self.alphabet)[x])])
            ok, up = (bad[seq[1]] == bad[seq[0]]).all(), _UPPER
        if not ok:
            return None, 0, False
        cols = [pa.array(np.full(n, part.fileno, np.int32)), pa.array(at + begin), _texts(x, head[0] + 1, head[1]), _texts(x, *seq, up), _texts(x, *qual) if self.qualities else pa.nulls(n, pa.string()), pa.array([part.path] * n, pa.string())]
        used = int(nexts[4 * n - 1]) if n else 0
        return pa.RecordBatch.from_arrays(cols, ["fileno", "byte_offset", "name", "seq", "qual", "filepath"]), used, done

    def _slow(self, part, f, at: int):
        rows = []
        for row in self._records(part, _Lines(f, at)):
            rows.append(row)
            if len(rows) == 10_000:
                yield _as_batch(rows)
                rows = []
        if rows:
            yield _as_batch(rows)

    def _records(self, part, lines):
        """Record by record, with the place of an error."""
        while True:
            head = lines.next()
            if head is None or 0 <= part.end <= head[0]:
                return
            seq, plus, qual = lines.next(), lines.next(), lines.next()
            what = None
            if not head[1].startswith("@"):
                what = "a record begins with @"
            elif seq is None or plus is None:
                what = "the record isn't complete"
            elif not plus[1].startswith("+"):
                what = "the third line begins with +"
            elif len(qual[1] if qual else "") != len(seq[1]):
                what = "quality and sequence differ in length"
            elif self.alphabet and set(seq[1].upper()) - set(self.alphabet):
                what = "a letter is outside the alphabet"
            if what is None:
                s = seq[1].upper() if self.alphabet else seq[1]
                yield part.fileno, head[0], head[1][1:], s, qual[1] if self.qualities else None, part.path
            elif not self.skip_errors:
                raise self._error(part, head[0], what)
            else:
                lines.put_back(seq, plus, qual)
                self._resync(lines)

    def _resync(self, lines: _Lines) -> None:
        """Go on to a line that begins with @, with a + line two lines behind it and as many qualities as letters."""
        window = [lines.next() for _ in range(4)]
        while window[0] is not None:
            a, s, p, q = window
            if p is not None and a[1].startswith("@") and p[1].startswith("+") and q is not None and len(q[1]) == len(s[1]):
                break
            window = [*window[1:], lines.next()]
        lines.put_back(*window)


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(dict(self.options))


def read_fastq(spark: SparkSession, path: str, qscale: str = "phred", **options) -> DataFrame:
    """Records of FASTQ files, the quality column marked with its scale."""
    spark.dataSource.register(FastqSource)
    r = spark.read.format("fastq")
    for k, v in options.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return r.load(path).withMetadata("seq", {"seqtype": options.get("alphabet", "DNA")}).withMetadata("qual", {"qscale": qscale})


def fastq_geometry(df: DataFrame, seq_col: str = "seq") -> DataFrame:
    """``(n_reads, width)``: one row; width is null if reads differ in it."""
    n = F.length(seq_col)
    return df.agg(F.count(F.lit(1)).alias("n_reads"), F.when(F.min(n) == F.max(n), F.min(n)).alias("width"))


def fastq_text(name, seq, qual=None):
    """One FASTQ record as a Column; a missing quality is ``;`` throughout, one of another length an error."""
    name, seq = (F.col(x) if isinstance(x, str) else x for x in (name, seq))
    q = F.repeat(F.lit(";"), F.length(seq)) if qual is None else F.coalesce(F.col(qual) if isinstance(qual, str) else qual, F.repeat(F.lit(";"), F.length(seq)))
    text = F.concat(F.lit("@"), F.coalesce(name, F.lit("")), F.lit("\n"), seq, F.lit("\n+\n"), q)
    return F.when(F.length(q) != F.length(seq), F.raise_error(F.lit("quality and sequence differ in length"))).when(F.length(seq) > MAX_LETTERS, F.raise_error(F.lit("the sequence is too long"))).otherwise(text)


def write_fastq(df: DataFrame, path: str, name_col: str = "name", seq_col: str = "seq", qual_col: str | None = "qual", append: bool = False, compress: bool = False) -> None:
    """A folder of FASTQ files, one for a partition.  Rows without a sequence are left out."""
    w = df.where(F.col(seq_col).isNotNull()).select(fastq_text(name_col, seq_col, qual_col).alias("value")).write.mode("append" if append else "errorifexists")
    (w.option("compression", "gzip") if compress else w).text(path)


def save_sequences(df: DataFrame, path: str) -> None:
    """Parquet; its dictionary encoding stores repeated sequences once in a row group."""
    df.write.parquet(path)
