import pytest

from helixframe.kernels.record_grammar import Broken, desc_fields, parse_frame, parse_record as _record, parse_stream as _stream
from helixframe.operators.record_recovery import broken_records, parse_records, valid_records
from helixframe.plans.records import SCHEMA

RULES = SCHEMA.compiled()


def parse_record(fmt, text):
    return _record(fmt, text, RULES)


def parse_stream(fmt, text):
    return _stream(fmt, text, RULES)


HEAD = "QCR001C LFP31 XDB:S000000001, Chr XIV from 622127-628550, direct, Dubious ORF, cell"
FASTA = {
    f">{HEAD}\nACGT\n": None,
    f";c\n\n>{HEAD}\r\nACGT": None,
    ">QCR001C LFP31 XDB:S000000001,Chr I from 1-2,reverse complement,Verified ORF,\n": None,
    '>QCR001C LFP31 XDB:S000000001, Chr I from 1-2, direct, Verified ORF, "a, b ""c"" d" \t': None,
    "": "markup", ";only\n": "markup", "ACGT\n": "markup", " >x": "markup",
    f'>{HEAD} "x"': "quoting", f'>{HEAD}, "open': "quoting", '>"a"b,c,d,e,f': "quoting", '>a,"b" x,c,d,e': "quoting",
    ">": "desc_fields", ">a,b,c,d": "desc_fields", f">{HEAD},more": "desc_fields",
    ">qcr LFP31 XDB:S000000001, Chr I from 1-2, direct, Verified ORF, x": "desc_value",
    ">QCR  LFP31 XDB:S000000001, Chr I from 1-2, direct, Verified ORF, x": "desc_value",
    ">QCR LFP31 XDB:S00000001, Chr I from 1-2, direct, Verified ORF, x": "desc_value",
    ">QCR LFP31 XDB:S000000001, Chr XVII from 1-2, direct, Verified ORF, x": "desc_value",
    ">QCR LFP31 XDB:S000000001, Chr IX from 01-2, direct, Verified ORF, x": "desc_value",
    ">QCR LFP31 XDB:S000000001, Chr IX from 0-2, direct, Verified ORF, x": "desc_value",
    ">QCR LFP31 XDB:S000000001, Chr IX from 1-2, Direct, Verified ORF, x": "desc_value",
    '>QCR LFP31 XDB:S000000001, Chr IX from 1-2, "direct", Verified ORF, x': "desc_value",
    ">QCR LFP31 XDB:S000000001, Chr IX from 1-2, direct, Verified  ORF, x": "desc_value",
}
FASTQ = {
    "@ZQ-A_1:5:24:14802:2\tnote\nACGTn-\n+\nIIIIII\n": None,
    "\r\n@ZQ:8:1:2:3\r\nAC\r\n+x\r\n!~\r\n\n": None,
    "": "line_count", "@a:1:1:1:1\nAC\n+\n": "line_count", "@a:1:1:1:1\nAC\n+\nII\nII": "line_count", "@a:1:1:1:1\n\n+\n\n": "line_count",
    "a:1:1:1:1\nAC\n+\nII": "markup", "@a:1:1:1:1\nAC\n-\nII": "markup",
    "@a:1:1:1\nAC\n+\nII": "seqid_fields", "@ a:1:1:1:1\nAC\n+\nII": "seqid_fields",
    "@:1:1:1:1\nAC\n+\nII": "seqid_value", "@a.b:1:1:1:1\nAC\n+\nII": "seqid_value", "@a:9:1:1:1\nAC\n+\nII": "seqid_value", "@a:12:1:1:1\nAC\n+\nII": "seqid_value",
    "@a:1::1:1\nAC\n+\nII": "seqid_value", "@a:1:1:1:٣\nAC\n+\nII": "seqid_value", "@é:1:1:1:1\nAC\n+\nII": "seqid_value",
    "@a:1:1:1:1\nAXC\n+\nIII": "seq_letters", "@a:1:1:1:1\nA C\n+\nIII": "seq_letters", "@a:1:1:1:1\nAſ\n+\nII": "seq_letters",
    "@a:1:1:1:1\nAC\n+\nI": "qual_length", "@a:1:1:1:1\nAC\n+\nII\r": "qual_length",
    "@a:1:1:1:1\nAC\n+\nI ": "qual_value", "@a:1:1:1:1\nAC\n+\nI\x7f": "qual_value",
}


@pytest.mark.parametrize("fmt,cases", [("fasta", FASTA), ("fastq", FASTQ)])
def test_first_reason(fmt, cases):
    for text, want in cases.items():
        r = parse_record(fmt, text)
        assert (r.reason if isinstance(r, Broken) else None) == want, (text, r)


def test_errors_are_located():
    e = parse_record("fasta", f'\n;x\n>{HEAD}, a "b\n')
    assert (e.reason, e.line, e.col) == ("quoting", 3, len(HEAD) + 6)
    e = parse_record("fastq", "@a:1:1:x:1\nAC\n+\nII")
    assert (e.reason, e.line, e.col) == ("seqid_value", 1, 8)
    assert desc_fields(' a , "b, c" ') == [("a", 3), ('"b, c"', 7)]


def test_stream_goes_on_at_the_next_anchor():
    good = "@a:1:1:1:{}\nAC\n+\n@I\n"
    text = good.format(1) + "@broken\nAC\n+\nII\n" + good.format(2) + "@a:1:1:1:9\nAC\nII\n" + good.format(3)
    got = [x.reason if isinstance(x, Broken) else x.name for x in parse_stream("fastq", text)]
    assert got == ["a:1:1:1:1", "seqid_fields", "a:1:1:1:2", "markup", "a:1:1:1:3"]
    text = f'>{HEAD}\nAC\n>{HEAD}, "open\nGG\n>{HEAD}\nTT\n'
    got = [x.reason if isinstance(x, Broken) else x.seq for x in parse_stream("fasta", text)]
    assert got == ["AC", "quoting", "TT"]
    assert list(parse_stream("fasta", None)) == []


def test_every_broken_record_of_a_stream_has_its_reason():
    good = "@a:1:1:1:1\nAC\n+\n@I\n"

    def items(text):
        return [(x.reason, x.line) if isinstance(x, Broken) else x.name for x in parse_stream("fastq", text)]

    bad = "@bad{}\nAC\n+\nII\n"
    assert items(bad.format(1) + bad.format(2) + good) == [("seqid_fields", 1), ("seqid_fields", 5), "a:1:1:1:1"]
    assert items("@a:1:1:1:1:1:1\nAC\n+\n@I\n" * 3) == [("seqid_fields", 1), ("seqid_fields", 5), ("seqid_fields", 9)]
    assert items(good + "@a:1:1:1:2\nAC\n-\nII\n@a:1:1:1:3\nAC\n-\nII\n" + good) == ["a:1:1:1:1", ("markup", 7), ("markup", 11), "a:1:1:1:1"]
    assert items("@bad1\nAC\n+\n@bad2\nAC\n+\nII\n" + good) == [("seqid_fields", 1), ("seqid_fields", 4), "a:1:1:1:1"]
    assert items("@bad\nAC\n+\nII\nstray\nlines\n" + good) == [("seqid_fields", 1), ("markup", 5), "a:1:1:1:1"]


def test_operator(spark):
    long = "@a:1:1:1:1\n" + "ACGT" * 50_000 + "\n+\n" + "I" * 200_000
    rows = [(1, "fasta", f">{HEAD}\nAC"), (2, "fasta", None), (3, "fastq", ""), (4, None, "x"), (5, "sam", "x"), (6, "fastq", long), (None, "fastq", "x"), (1, "fasta", f">{HEAD}\nAC")]
    df = spark.createDataFrame(rows, "raw_id long, fmt string, raw_text string").selectExpr("*", "'x' as k", "'x' as f", "'x' as t", "'x' as ok", "'x' as reason")
    assert sorted(map(tuple, broken_records(df, SCHEMA).collect()), key=str) == [(2, "markup"), (3, "line_count"), (None, "line_count")]
    assert sorted(r["raw_id"] for r in valid_records(df, SCHEMA).collect()) == [1, 1, 6]
    assert parse_records(df.where("false"), SCHEMA).collect() == []
    many = spark.createDataFrame([(1, "fasta", f">{HEAD}\nA\n>bad\n>{HEAD}\nC\n"), (2, "fasta", "")], "raw_id long, fmt string, raw_text string")
    assert [(r.record_no, r.ok, r.seq) for r in parse_records(many, SCHEMA, many=True).orderBy("record_no").collect()] == [(1, True, "A"), (2, False, None), (3, True, "C")]


def test_only_validated_anchors_resume_fasta():
    """A '>' line inside what a broken quote left behind is no record start unless letters follow it."""
    text = f'>{HEAD}, "open\nACGT\n> noise, 12 "\n some text.\n>{HEAD}\nTT\n'
    got = [x.reason if isinstance(x, Broken) else x.seq for x in parse_stream("fasta", text)]
    assert got == ["quoting", "TT"]


def test_records_inside_a_broken_text_are_recovered():
    good = "@a:1:1:1:{}\nAC\n+\nII\n"
    items = list(parse_frame("fastq", good.format(1) + "x\n" + good.format(2), RULES))
    assert [x.reason if isinstance(x, Broken) else x.name for x in items] == ["line_count", "a:1:1:1:1", "a:1:1:1:2"]
    items = list(parse_frame("fasta", f'>{HEAD}, "open\nACGT\n>{HEAD}\nTT\n', RULES))
    assert [x.reason if isinstance(x, Broken) else x.seq for x in items] == ["quoting", "TT"]
    assert len(list(parse_frame("fastq", good.format(1), RULES))) == 1
