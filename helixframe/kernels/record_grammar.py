"""Recursive-descent grammar for FASTQ and FASTA records with error recovery.

Pure Python, no Spark.  A rule either returns what it read or raises
:class:`Broken`, which carries the reason and the place (1-based line and
column in the text as delivered).  What fields look like is given by a :class:`RecordSchema`.
:func:`parse_record` reads a text that holds one record, :func:`parse_frame` the same with
recovery of valid records inside a broken text, :func:`parse_stream` a text of many records.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

BLANK = " \t"
_NOT_QUALITY = re.compile(r"[^!-~]")
_SEQUENCE = re.compile(r"[A-Za-z*.+-]+")


@dataclass(frozen=True)
class RecordSchema:
    """What the fields of a record have to look like; patterns match a whole field, null takes anything.

    ``letters`` is the alphabet of FASTQ reads, in the cases that are allowed.
    """
    letters: str
    seqid_parts: tuple[str | None, ...]
    desc_fields: tuple[str | None, ...]

    def compiled(self) -> "_Rules":
        return _Rules(re.compile("[^" + re.escape("".join(sorted(set(self.letters)))) + "]"), *([p and re.compile(p) for p in x] for x in (self.seqid_parts, self.desc_fields)))


@dataclass(frozen=True)
class _Rules:
    not_letter: re.Pattern
    seqid: list
    desc: list


class Broken(Exception):
    """A located syntax error; ``reason`` is one of the names in the README."""

    def __init__(self, reason: str, line: int, col: int, detail: str = ""):
        super().__init__(reason)
        self.reason, self.line, self.col, self.detail = reason, line, col, detail


@dataclass
class Record:
    fmt: str
    name: str
    seq: str
    qual: str | None = None
    fields: list[str] = field(default_factory=list)
    line: int = 1


def logical_lines(text: str) -> list[tuple[int, str]]:
    """(line number, content) of the non-empty lines; LF ends a line and takes one CR before it."""
    parts = text.split("\n")
    last = len(parts) - 1
    out = []
    for i, part in enumerate(parts):
        if i < last and part.endswith("\r"):
            part = part[:-1]
        if part:
            out.append((i + 1, part))
    return out


# ---- FASTQ -------------------------------------------------------------

def seqid(line: tuple[int, str], rules: _Rules) -> str:
    """seqid := part ( ':' part )*, up to the first blank."""
    no, text = line
    body = text[1:]
    end = next((i for i, c in enumerate(body) if c in BLANK), len(body))
    name = body[:end]
    parts = name.split(":")
    if len(parts) != len(rules.seqid):
        raise Broken("seqid_fields", no, 2, f"{len(parts)} parts")
    at = 2
    for k, (part, rule) in enumerate(zip(parts, rules.seqid)):
        if rule and not rule.fullmatch(part):
            raise Broken("seqid_value", no, at, f"part {k + 1}")
        at += len(part) + 1
    return name


def letters(line: tuple[int, str], rules: _Rules) -> str:
    no, text = line
    if bad := rules.not_letter.search(text):
        raise Broken("seq_letters", no, bad.start() + 1)
    return text


def quality(line: tuple[int, str], width: int) -> str:
    no, text = line
    if len(text) != width:
        raise Broken("qual_length", no, min(len(text), width) + 1, f"{len(text)} for {width}")
    if bad := _NOT_QUALITY.search(text):
        raise Broken("qual_value", no, bad.start() + 1)
    return text


def fastq_record(lines: list[tuple[int, str]], rules: _Rules) -> Record:
    """record := '@' seqid rest / letters / '+' rest / quality"""
    if len(lines) != 4:
        raise Broken("line_count", lines[-1][0] if lines else 1, 1, f"{len(lines)} lines")
    for k, mark in ((0, "@"), (2, "+")):
        if not lines[k][1].startswith(mark):
            raise Broken("markup", lines[k][0], 1, f"expected {mark}")
    name = seqid(lines[0], rules)
    seq = letters(lines[1], rules)
    return Record("fastq", name, seq, quality(lines[3], len(seq)), line=lines[0][0])


# ---- FASTA -------------------------------------------------------------

class _Cursor:
    __slots__ = ("text", "at", "line", "shift")

    def __init__(self, text: str, line: int, shift: int):
        self.text, self.at, self.line, self.shift = text, 0, line, shift

    def blanks(self) -> None:
        text, n = self.text, len(self.text)
        while self.at < n and text[self.at] in BLANK:
            self.at += 1

    def broken(self, reason: str, at: int) -> Broken:
        return Broken(reason, self.line, at + self.shift)


def quoted(c: _Cursor) -> str:
    """quoted := '"' ( any | '""' )* '"'; only blanks may follow it."""
    start = c.at
    c.at += 1
    while True:
        close = c.text.find('"', c.at)
        if close < 0:
            raise c.broken("quoting", start)
        if c.text.startswith('""', close):
            c.at = close + 2
            continue
        c.at = close + 1
        break
    value = c.text[start:c.at]
    c.blanks()
    if c.at < len(c.text) and c.text[c.at] != ",":
        raise c.broken("quoting", c.at)
    return value


def plain(c: _Cursor) -> str:
    start, end = c.at, c.text.find(",", c.at)
    end = len(c.text) if end < 0 else end
    quote = c.text.find('"', start, end)
    if quote >= 0:
        raise c.broken("quoting", quote)
    c.at = end
    return c.text[start:end].strip(BLANK)


def desc_fields(text: str, line: int = 1, shift: int = 2) -> list[tuple[str, int]]:
    """desc := field ( ',' field )*; gives each field with its column."""
    c, out = _Cursor(text, line, shift), []
    while True:
        c.blanks()
        at = c.at
        out.append((quoted(c) if c.text.startswith('"', c.at) else plain(c), at + shift))
        if c.at >= len(c.text):
            return out
        c.at += 1  # the comma


def fasta_head(line: tuple[int, str], rules: _Rules) -> list[str]:
    no, text = line
    if not text.startswith(">"):
        raise Broken("markup", no, 1, "expected >")
    fields = desc_fields(text[1:], no)
    if len(fields) != len(rules.desc):
        raise Broken("desc_fields", no, fields[-1][1], f"{len(fields)} fields")
    for k, ((value, col), rule) in enumerate(zip(fields, rules.desc), 1):
        if rule and not rule.fullmatch(value):
            raise Broken("desc_value", no, col, f"field {k}")
    return [f for f, _ in fields]


def fasta_record(lines: list[tuple[int, str]], rules: _Rules) -> Record:
    """record := '>' desc / sequence line*; lines that begin with ';' are comments."""
    lines = [x for x in lines if not x[1].startswith(";")]
    if not lines:
        raise Broken("markup", 1, 1, "no line")
    fields = fasta_head(lines[0], rules)
    return Record("fasta", lines[0][1][1:], "".join(t for _, t in lines[1:]), fields=fields, line=lines[0][0])


_RULES = {"fastq": fastq_record, "fasta": fasta_record}


def parse_record(fmt: str, text: str | None, rules: _Rules) -> Record | Broken:
    """One record, or the located error that breaks it.  A null text counts as an empty one."""
    try:
        return _RULES[fmt](logical_lines(text or ""), rules)
    except Broken as e:
        return e


# ---- recovery -----------------------------------------------------------

def _starts(fmt: str, lines: list[tuple[int, str]], i: int) -> bool:
    """Whether line i is a validated record start: its mark, and behind it what a record has there.

    FASTA: a '>' line, and the next line holds letters only, or is a '>' line, or there is none.  FASTQ: an '@' line whose
    next-but-one begins with '+' (a quality line may begin with '@' too, so the mark alone is no proof).
    """
    if fmt == "fasta":
        return lines[i][1].startswith(">") and (i + 1 == len(lines) or lines[i + 1][1].startswith(">") or bool(_SEQUENCE.fullmatch(lines[i + 1][1])))
    return lines[i][1].startswith("@") and i + 2 < len(lines) and lines[i + 2][1].startswith("+")


def _record_end(fmt: str, lines: list[tuple[int, str]], i: int) -> int:
    """Where a record that starts at i should end."""
    if fmt == "fastq":
        return min(i + 4, len(lines))
    j = i + 1
    while j < len(lines) and not lines[j][1].startswith(">"):
        j += 1
    return j


def _block_end(fmt: str, lines: list[tuple[int, str]], i: int) -> int:
    """Where the broken block at i ends: at the next validated record start; in FASTQ also behind
    four lines if the block has its marks, else at an '@' line behind them."""
    whole = _starts(fmt, lines, i)
    j = i + 1
    while j < len(lines):
        if _starts(fmt, lines, j) or fmt == "fastq" and j - i >= 4 and (whole or lines[j][1].startswith("@")):
            break
        j += 1
    return j


def _stream(fmt: str, lines: list[tuple[int, str]], rules: _Rules):
    i = 0
    while i < len(lines):
        j = _record_end(fmt, lines, i)
        try:
            yield _RULES[fmt](lines[i:j], rules)
        except Broken as e:
            yield e
            j = _block_end(fmt, lines, i)
        i = j


def _content(fmt: str, text: str | None) -> list[tuple[int, str]]:
    lines = logical_lines(text or "")
    return [x for x in lines if not x[1].startswith(";")] if fmt == "fasta" else lines


def parse_stream(fmt: str, text: str | None, rules: _Rules):
    """Yield a Record or a Broken for each record of a longer text; every line belongs to one of them.

    After an error the parser goes on at the next validated record start, so a quote that is never closed costs one
    record and not the rest of the file.  In FASTQ a new block begins also behind four lines that have their
    marks, and at an '@' line behind four others.
    """
    return _stream(fmt, _content(fmt, text), rules)


def parse_frame(fmt: str, text: str | None, rules: _Rules):
    """Yield what a text that should hold one record gives: the record, or first the error that breaks it and
    then the valid records that start at validated anchors behind or at the place where it broke.
    """
    whole = parse_record(fmt, text, rules)
    yield whole
    if isinstance(whole, Broken):
        lines = _content(fmt, text)
        first = next((i for i in range(len(lines)) if _starts(fmt, lines, i)), len(lines))
        for item in _stream(fmt, lines[first:], rules):
            if isinstance(item, Record):
                yield item
