"""Alignment files (FASTA, Clustal, Stockholm, Phylip) and a Phylip writer.

An alignment is read whole, one file per task: ``(filepath, row_id, name, seq, colmask)``.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "filepath string, row_id int, name string, seq string, colmask array<struct<start:int,end:int>>"


def format_of(path: str) -> str:
    """By the file's ending: .sto stockholm, .aln clustal, anything else FASTA."""
    return {"sto": "stockholm", "aln": "clustal"}.get(path.rsplit(".", 1)[-1].lower(), "fasta")


def _blocks(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rows of interleaved blocks, put together; every block has to have the same rows in the same order."""
    names: list[str] = []
    for name, _ in pairs:
        if name in names:
            break
        names.append(name)
    if not names:
        return []
    if len(pairs) % len(names):
        raise ValueError("missing alignment rows")
    parts: list[list[str]] = [[] for _ in names]
    for i, (name, text) in enumerate(pairs):
        if name != names[i % len(names)]:
            raise ValueError("alignment rows out of order")
        parts[i % len(names)].append(text)
    return [(n, "".join(p)) for n, p in zip(names, parts)]


def parse_clustal(text: str) -> list[tuple[str, str]]:
    pairs = []
    for line in text.splitlines()[1:]:
        m = re.fullmatch(r"(\S+)\s+(\S+)(?:\s+\d+)?\s*", line)
        if m:
            pairs.append((m[1], m[2]))
    return _blocks(pairs)


def parse_stockholm(text: str) -> list[tuple[str, str]]:
    pairs = []
    for line in text.splitlines():
        if line.strip() and not line.startswith(("#", "//")):
            name, seq = line.split(None, 1)
            pairs.append((name, seq.strip().replace(".", "-")))
    return _blocks(pairs)


def parse_fasta_rows(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    for line in text.splitlines():
        if line.startswith(">"):
            out.append((line[1:], []))
        elif line and not line.startswith(";") and out:
            out[-1][1].append(line.strip())
    return [(n, "".join(p)) for n, p in out]


def parse_phylip(text: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """Rows of an interleaved file, and the masked columns of its ``Mask`` row (0 = masked)."""
    lines = [x for x in text.splitlines()]
    per = int(lines[0].split()[0])  # the Mask row counts
    body = [x for x in lines[1:] if x.strip()]
    names, parts = [], [[] for _ in range(per)]
    if len(body) % per:
        raise ValueError("missing alignment rows")
    for i, line in enumerate(body):
        if i < per:
            name, _, rest = line.strip().partition(" ")
            names.append(name)
            line = rest
        parts[i % per].append(re.sub(r"\s", "", line))
    rows = [(n_, "".join(p)) for n_, p in zip(names, parts)]
    mask = next((s for n_, s in rows if n_ == "Mask"), "")
    return [(n_, s) for n_, s in rows if n_ != "Mask"], [(m.start() + 1, m.end()) for m in re.finditer("0+", mask)]


def parse_alignment(text: str, fmt: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    if fmt == "phylip":
        rows, mask = parse_phylip(text)
    else:
        rows, mask = {"clustal": parse_clustal, "stockholm": parse_stockholm, "fasta": parse_fasta_rows}[fmt](text), []
    if len({len(s) for _, s in rows}) > 1:
        raise ValueError("alignment rows differ in length")
    return rows, mask


def read_alignment(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The rows of alignment files; without ``fmt`` each file's ending tells the format."""
    def run(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                rows, mask = parse_alignment(bytes(content).decode(), fmt or format_of(p))
                out += [(p, i, n, s.upper(), [{"start": a, "end": z} for a, z in mask]) for i, (n, s) in enumerate(rows, 1)]
            yield pd.DataFrame(out, columns=["filepath", "row_id", "name", "seq", "colmask"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def phylip_text(rows: list[tuple[str, str]], colmask: list[tuple[int, int]] = ()) -> str:
    """Interleaved Phylip: groups of 10 letters, five to a line, a ``Mask`` row if columns are masked."""
    width = len(rows[0][1]) if rows else 0
    shown = [(n, s) for n, s in rows]
    if colmask:
        bits = ["1"] * width
        for a, z in colmask:
            bits[a - 1:z] = "0" * (z - a + 1)
        shown.insert(0, ("Mask", "".join(bits)))
    pad = max([len(n) for n, _ in shown], default=0)
    lines = [f" {len(shown)} {width}" + (" W" if colmask else "")]
    for at in range(0, width, 50):
        for n, s in shown:
            groups = " ".join(s[i:i + 10] for i in range(at, min(at + 50, width), 10))
            lines.append((n.ljust(pad) if at == 0 else " " * pad) + " " + groups)
        lines.append("")
    return "\n".join(lines) + "\n"


def write_phylip(alignment: DataFrame, path: str, colmask: list[tuple[int, int]] = ()) -> None:
    """One alignment ``(row_id, name, seq)`` to one file; alignments are small by nature, so it is written by the driver."""
    rows = [(r["name"] or "", r["seq"]) for r in alignment.select("row_id", "name", "seq").orderBy("row_id").toLocalIterator()]
    with open(path, "w") as f:
        f.write(phylip_text(rows, colmask))


def alignment_of(df: DataFrame, name_col: str, seq_col: str) -> DataFrame:
    """``(row_id, name, seq)`` of any frame; rows of unequal length are an error at use."""
    return df.select(F.monotonically_increasing_id().alias("row_id"), F.col(name_col).alias("name"), F.col(seq_col).alias("seq"))
