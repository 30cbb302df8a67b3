"""FASTA files as DataFrames, and back.

The scan is Spark's text source with ``\\n>`` as record separator: files are split by
bytes, records that cross a split belong to the split they begin in, gzip works.
A first scan counts the records and bytes of each split, one small row for a split; the second numbers the
records where they are read.  No record is shuffled or sorted.
"""
from __future__ import annotations

import io
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe import alphabets as A
from helixframe.functions.transforms import ascii_upper

ALPHABETS = {"DNA": A.DNA_ALPHABET, "RNA": A.RNA_ALPHABET, "AA": A.AA_ALPHABET, "B": None}
SEPARATOR = "\n>"


def _first_record(value: str) -> int:
    """Where the first chunk of a file has its first '>' at a line's begin: 0 or more; -1 if there is only blank and comment lines, -2 if other text comes first."""
    if value.startswith(">"):
        return 0
    at = 0
    while at < len(value):
        if value[at] == ">":
            return at
        end = value.find("\n", at)
        line = value[at:end if end >= 0 else len(value)]
        if line.rstrip("\r") and not line.startswith(";"):
            return -2
        at = len(value) if end < 0 else end + 1
    return -1


def _scan(splits: dict | None):
    """Without ``splits``: (split, n, bytes, lead) of every split.  With them: (filepath, recno, byte_offset, body) of every record.

    ``lead`` tells of the first split of a file whether its first chunk is a record (``_first_record``).
    """
    def run(batches):
        seen: dict[int, list[int]] = {}
        for b in batches:
            path, start = b.column(0), b.column(1).to_pylist()
            keys = b.column(2).to_pylist()
            sizes = pc.binary_length(b.column(3)).to_pylist()
            keep, recno, offset, bodies = [], [], [], []
            for i, (key, size) in enumerate(zip(keys, sizes)):
                x = seen.get(key)
                if x is None:
                    lead = _first_record(b.column(3)[i].as_py()) if start[i] == 0 else 0
                    x = seen[key] = [0, 0, lead, start[i] == 0]
                n, before, lead, first = x
                x[0] += 1
                x[1] += size + len(SEPARATOR)
                if splits is None:
                    continue
                rows_before, size_before, shift = splits[key]
                head = first and n == 0
                if head and lead < 0:
                    if lead == -2:
                        keep.append(i)
                        recno.append(0)
                        offset.append(0)
                    continue
                keep.append(i)
                recno.append(rows_before + n + 1 - shift)
                offset.append(lead if head else size_before + before - 1)
            if splits is not None:
                chunk = b.column(3).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([path.take(pa.array(keep, pa.int64())), pa.array(recno, pa.int32()), pa.array(offset, pa.int64()), chunk], ["filepath", "recno", "byte_offset", "value"])
        if splits is None:
            yield pa.RecordBatch.from_arrays([pa.array([f(k, x) for k, x in seen.items()], t) for f, t in (
                (lambda k, x: k, pa.int64()), (lambda k, x: x[0], pa.int64()), (lambda k, x: x[1], pa.int64()), (lambda k, x: x[2] if x[3] else 0, pa.int32()))], ["split", "n", "bytes", "lead"])

    return run


def _chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.option("lineSep", SEPARATOR).text(paths)
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return raw.select(path.alias("filepath"), start.alias("start"), F.xxhash64(path, start).alias("split"), "value")


def read_fasta(spark: SparkSession, paths, seqtype: str = "B", nrec: int = -1, skip: int = 0, seek_first_rec: bool = False, drop_invalid: bool = True, validate: bool = True) -> DataFrame:
    """``(fileno, recno, byte_offset, desc, seq, n_invalid, filepath)`` of FASTA files.

    Lines that begin with ``;`` and blank lines are ignored, CR is stripped, sequence lines are joined and upper-cased
    (not for seqtype B).  Letters outside the alphabet are dropped and counted in ``n_invalid``.
    ``skip`` and ``nrec`` count records across the files in the order given (those of a folder by name); ``recno`` counts within a file.
    Text before the first ``>`` is an error, or ignored with ``seek_first_rec``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if seqtype not in ALPHABETS:
        raise ValueError(f"unknown seqtype {seqtype}")
    chunks = _chunks(spark, paths)
    names = chunks.select("filepath", "start", "split").distinct()
    counts = names.join(chunks.mapInArrow(_scan(None), "split long, n long, bytes long, lead int"), "split")
    # one row for a split of the scan (maxPartitionBytes), some 50 bytes each on the driver: 40 MB for 100 TB
    order = {p: i for i, p in enumerate(paths)}

    def given(path: str) -> tuple:
        return min((i for p, i in order.items() if path.endswith(p.rstrip("/").removeprefix("file:").lstrip("/")) or p.rstrip("/").removeprefix("file:").lstrip("/") + "/" in path), default=0), path

    splits, files, total = {}, {}, 0
    by_file: dict[str, list] = {}
    for r in counts.collect():
        by_file.setdefault(r["filepath"], []).append(r)
    for no, path in enumerate(sorted(by_file, key=given), 1):
        rows = size = 0
        first = min(by_file[path], key=lambda r: r["start"])
        shift = int(first["lead"] < 0)
        files[path] = (no, total)
        for r in sorted(by_file[path], key=lambda r: r["start"]):
            splits[r["split"]] = (rows, size, shift)
            rows, size = rows + r["n"], size + r["bytes"]
        total += rows - shift
    shared = spark.sparkContext.broadcast(splits)
    rows = chunks.mapInArrow(lambda batches: _scan(shared.value)(batches), "filepath string, recno int, byte_offset long, value string")
    if seek_first_rec:
        rows = rows.where("recno > 0")
    else:
        rows = rows.withColumn("value", F.when(F.col("recno") == 0, F.raise_error(F.lit("text before the first record"))).otherwise(F.col("value")))
    if not files:
        return spark.createDataFrame([], "fileno int, recno int, byte_offset long, desc string, seq string, n_invalid int, filepath string")
    numbers = F.create_map(*[x for p, (no, _) in files.items() for x in (F.lit(p), F.lit(no))]) if len(files) <= 100 else None
    table = spark.createDataFrame([(p, no, before) for p, (no, before) in files.items()], "filepath string, fileno int, before long")
    rows = rows.withColumn("fileno", numbers[F.col("filepath")]) if numbers is not None and not (skip or nrec >= 0) else rows.join(F.broadcast(table), "filepath")  # one row for a file

    # the first record of a file keeps its mark, and what stands before it is no record
    first = (F.col("recno") == 1) & F.substring("value", 1, 1).isin(">", ";", "\n", "\r")
    body = F.when(first, F.expr("substring(value, instr(concat('\n', value), '\n>') + 1)")).otherwise(F.col("value"))
    rows = rows.withColumn("body", body)
    desc = F.regexp_replace(F.substring_index("body", "\n", 1), "\\r$", "")
    rest = F.when(F.instr("body", "\n") > 0, F.expr("substring(body, instr(body, '\n') + 1)")).otherwise(F.lit(""))
    letters = F.regexp_replace(F.regexp_replace(rest, "(?m)^;.*$", ""), "[\\r\\n]", "")
    alphabet = ALPHABETS[seqtype] if validate else None
    if alphabet:
        up = ascii_upper(letters)
        invalid = F.translate(up, alphabet, "")
        unknown = "[^" + alphabet.replace("-", "").replace("*", "\\*").replace("+", "\\+").replace(".", "\\.") + "-]"
        seq = F.regexp_replace(up, unknown, "") if drop_invalid else F.when(invalid != "", F.raise_error(F.concat(F.lit("invalid letters in "), desc))).otherwise(up)
        n_invalid = F.length(invalid)
    else:
        seq, n_invalid = letters, F.lit(0)
    if skip or nrec >= 0:
        place = F.col("recno") + F.col("before")
        rows = rows.where((place > skip) & (place <= skip + nrec if nrec >= 0 else F.lit(True)))
    out = rows.select("fileno", "recno", "byte_offset", desc.alias("desc"), seq.alias("seq"), n_invalid.alias("n_invalid"), "filepath")
    return out.withMetadata("seq", {"seqtype": seqtype})


def fasta_index(spark: SparkSession, paths, seqtype: str = "B", **options) -> DataFrame:
    """``(recno, fileno, byte_offset, desc, seqlength, filepath)``; sequences aren't kept."""
    r = read_fasta(spark, paths, seqtype, **options)
    return r.select("recno", "fileno", "byte_offset", "desc", F.length("seq").alias("seqlength"), "filepath")


def fasta_seqlengths(spark: SparkSession, paths, seqtype: str = "B", **options) -> DataFrame:
    return fasta_index(spark, paths, seqtype, **options).select("fileno", "recno", "desc", "seqlength")


def _seek(alphabet: str | None):
    """Records at byte offsets: each file is opened once for a batch, and only the records asked for are read."""
    def record(f, at: int) -> tuple[str, str]:
        f.seek(at)
        desc = f.readline().decode("utf-8", "replace").rstrip("\r\n")
        if not desc.startswith(">"):
            raise ValueError(f"no record begins at byte {at}")
        parts = []
        while line := f.readline():
            if line.startswith(b">"):
                break
            if not line.startswith(b";"):
                parts.append(line.rstrip(b"\r\n"))
        seq = b"".join(parts).decode("utf-8", "replace")
        if alphabet:
            seq = re.sub(f"[^{re.escape(alphabet)}]", "", seq.upper())
        return desc[1:], seq

    def run(batches):
        from pyarrow import fs

        for b in batches:
            names = b.schema.names
            paths, offsets = (b.column(names.index(c)).to_pylist() for c in ("filepath", "byte_offset"))
            desc, seqs = [None] * len(paths), [None] * len(paths)
            for path in dict.fromkeys(paths):
                system, place = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
                with io.BufferedReader(system.open_input_file(place), 1 << 16) as f:
                    at = sorted((o, i) for i, (p, o) in enumerate(zip(paths, offsets)) if p == path)
                    for o, i in at:
                        desc[i], seqs[i] = record(f, o)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(desc, pa.string()), pa.array(seqs, pa.string())], [*names, "found_desc", "seq"])

    return run


def read_fasta_at(spark: SparkSession, index: DataFrame, seqtype: str = "B") -> DataFrame:
    """The index with ``found_desc`` and ``seq`` of the records at its (filepath, byte_offset), by seeking; a record asked for twice comes twice.

    Files have to be uncompressed and lie where all executors see them.  Rows with a null path or offset drop out.
    """
    wanted = index.where("filepath is not null and byte_offset is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = wanted.repartitionByRange(n, "filepath", "byte_offset").sortWithinPartitions("filepath", "byte_offset")  # index rows only
    return near.mapInArrow(_seek(ALPHABETS[seqtype]), f"{schema}, found_desc string, seq string")


def fasta_text(name, seq, width: int = 80):
    """One FASTA record as a Column, wrapped at ``width``."""
    if not 1 <= width <= 200001:
        raise ValueError("width must be 1 to 200001")
    name, seq = (F.col(x) if isinstance(x, str) else x for x in (name, seq))
    return F.concat(F.lit(">"), F.coalesce(name, F.lit("")), F.when(seq == "", F.lit("")).otherwise(F.concat(F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))))


def write_fasta(df: DataFrame, path: str, name_col: str = "name", seq_col: str = "seq", width: int = 80, append: bool = False, compress: bool = False) -> None:
    """A folder of FASTA files, one for a partition.  Rows without a sequence are left out."""
    w = df.where(F.col(seq_col).isNotNull()).select(fasta_text(name_col, seq_col, width).alias("value")).write.mode("append" if append else "errorifexists")
    (w.option("compression", "gzip") if compress else w).text(path)
