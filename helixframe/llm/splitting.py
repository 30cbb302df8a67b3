"""Splitting oversized sequences at natural boundaries: structure-tree packing.

The assembly gaps of a record are its markup.  ``gap_levels`` names how long the gaps of each level are, longest
first: with (100, 10) a record holds scaffolds, closed by gaps of at least 100 N, and these hold
contigs, closed by gaps of at least 10; with one level there are contigs only.  Each node ends with the last letter of its closing gap.

The tree is packed from its leaves: siblings that fit together are merged into one
piece, and a node that fits no piece by itself is descended into, where its own
children are merged in the same way; the rest of it is then merged with what follows.  A contig that is too long itself is cut at the limit.
Each piece repeats the last ``overlap`` letters of the one before.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_OTHER = re.compile("[^A-Za-z]+")


@dataclass
class Node:
    """A span of letters, first and last position included; ``parts`` are its children in order."""
    start: int
    end: int
    parts: list["Node"] = field(default_factory=list)


def structure_tree(letters: str, gap_levels: tuple[int, ...] = (10,)) -> Node:
    """The record, divided at its longest gaps first, and each part at the shorter ones."""
    gaps = [(m.end(), m.end() - m.start()) for m in re.finditer("N{%d,}" % min(gap_levels), letters)]

    def divide(start: int, end: int, inside: list[tuple[int, int]], depth: int) -> Node:
        node = Node(start, end)
        if depth == len(gap_levels) or not inside:
            return node
        cuts = [(e, n) for e, n in inside if n >= gap_levels[depth] and e < end]
        if not cuts:
            return divide(start, end, inside, depth + 1)
        at, rest = start, iter(inside)
        own: list[tuple[int, int]] = []
        for e, _ in [*cuts, (end, 0)]:
            own = []
            for g in rest:
                if g[0] < e:
                    own.append(g)
                else:
                    break
            node.parts.append(divide(at, e, own, depth + 1))
            at = e + 1
        return node

    return divide(1, len(letters), gaps, 0)


def pack(tree: Node, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of at most ``limit`` letters.

    A piece grows by whole siblings while they fit.  If the next one doesn't, the piece is closed
    before it, unless that node would not fit a piece of its own either: then its children go on in the
    same piece.  A piece ends at least ``overlap`` letters behind its start.
    """
    out: list[tuple[int, int]] = []
    start, end = tree.start, 0  # of the piece that grows; end 0: no boundary taken yet

    def close(at: int) -> None:
        nonlocal start, end
        out.append((start, at))
        start, end = at - overlap + 1, 0

    def fits(node: Node) -> bool:
        return node.end <= start + limit - 1

    def add(node: Node) -> None:
        nonlocal end
        if fits(node):
            if node.end >= start + overlap:
                end = node.end
            return
        alone = node.end - node.start + 1 + (overlap if node.start > tree.start else 0) <= limit
        if node.parts and not (alone and end):
            for part in node.parts:
                add(part)
            return
        while not fits(node):
            close(end or start + limit - 1)
            if node.parts and not fits(node):  # closed before it, and still too long
                add(node)
                return
        if node.end >= start + overlap:
            end = node.end

    add(tree)
    if not out or out[-1][1] < tree.end:
        out.append((start, tree.end))
    return out


def split_sequences(df: DataFrame, id_col: str, text_col: str, limit: int = 1500, overlap: int = 60, gap: int = 10, gap_levels: tuple[int, ...] | None = None, with_text: bool = False) -> DataFrame:
    """The pieces of every sequence longer than ``limit`` letters: (id, piece_no, start_pos, end_pos[, piece]).

    Only ASCII letters count, upper-cased; positions count them from 1.  ``gap_levels`` (longest first) replaces ``gap`` where
    gaps of several lengths mean different things.

    Defined results: null, empty and short texts give no piece; a repeated row
    gives its pieces again; other columns are not carried, so none clash; an
    empty table gives an empty result.  ``overlap`` must be below ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    levels = tuple(gap_levels or (gap,))
    if list(levels) != sorted(set(levels), reverse=True) or levels[-1] < 1:
        raise ValueError("gap_levels must fall, the last at least 1")
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"k {id_type}, piece_no int, start_pos int, end_pos int" + (", piece string" if with_text else "")

    def run(batches):
        for b in batches:
            rows, nos, starts, ends, texts = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                letters = _OTHER.sub("", text.as_py()).upper()
                if len(letters) > limit:
                    found = pack(structure_tree(letters, levels), limit, overlap)
                    rows += [i] * len(found)
                    nos += range(1, len(found) + 1)
                    starts += [a for a, _ in found]
                    ends += [z for _, z in found]
                    if with_text:
                        texts += [letters[a - 1:z] for a, z in found]
            cols = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int32()) for x in (nos, starts, ends))] + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, ["k", "piece_no", "start_pos", "end_pos"] + ["piece"] * with_text)

    src = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where(F.length("t") > limit)
    return src.mapInArrow(run, schema).withColumnRenamed("k", id_col)
