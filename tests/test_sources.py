import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.sources import alignment, fasta, fastq
from helixframe.streaming.drops import fasta_stream, running_kmers
from helixframe.udf import register


def test_fasta_grammar(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_bytes(b"; c\n\n>one x\r\nACGT\r\nAZC\r\n;mid\n\n>two\n>three\nNNN")
    got = [tuple(r)[1:6] for r in fasta.read_fasta(spark, str(p), "DNA").orderBy("recno").collect()]
    assert got == [(1, 5, "one x", "ACGTAC", 1), (2, 30, "two", "", 0), (3, 35, "three", "NNN", 0)]
    p.write_text("junk\n>one\nAC\n>two\nGG\n")
    assert [r.desc for r in fasta.read_fasta(spark, str(p), "DNA", seek_first_rec=True).orderBy("recno").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="before the first record"):
        fasta.read_fasta(spark, str(p), "DNA").collect()


def test_fasta_splits_index_and_limits(spark, tmp_path):
    text = "".join(f">r{i} d\n" + "\n".join("ACGTTGCA"[j % 8] * (j % 17 + 1) for j in range(i % 23)) + "\n" for i in range(500))
    p = tmp_path / "b.fa"
    p.write_text(text)
    whole = sorted(map(tuple, fasta.read_fasta(spark, str(p), "DNA").collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert sorted(map(tuple, fasta.read_fasta(spark, str(p), "DNA").collect())) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(whole) == 500
    index = fasta.fasta_index(spark, str(p), "DNA")
    assert all(text[r.byte_offset:].startswith(">" + r.desc) for r in index.collect())
    (tmp_path / "c.fa").write_text(">x\nAC\n>y\nGG\n")
    got = fasta.read_fasta(spark, [str(tmp_path / "c.fa"), str(p)], "DNA", nrec=3, skip=1).orderBy("fileno", "recno").collect()
    assert [r.desc for r in got] == ["y", "r0 d", "r1 d"]
    wanted = index.where("recno in (3, 7)").unionByName(index.where("recno = 3"))
    assert sorted(r.recno for r in fasta.read_fasta_at(spark, wanted, "DNA").collect()) == [3, 3, 7]


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a", "ACGT" * 50), ("b", ""), ("c", "A" * 80), (None, "AC"), ("d", None)]
    df = spark.createDataFrame(rows, "name string, seq string")
    for gz in (False, True):
        out = str(tmp_path / f"out{gz}")
        fasta.write_fasta(df, out, width=80, compress=gz)
        assert sorted((r.desc, r.seq) for r in fasta.read_fasta(spark, out, "DNA").collect()) == sorted((n or "", s) for n, s in rows if s is not None)
    assert df.where("name = 'c'").select(fasta.fasta_text("name", "seq").alias("t")).collect()[0].t == ">c\n" + "A" * 80
    with pytest.raises(ValueError):
        fasta.fasta_text("name", "seq", 0)


def records(n):
    return "".join(f"@id{i}\n{'ACGT' * (i % 9 + 1)}\n+\n{'@+I!' * (i % 9 + 1)}\n" for i in range(n))


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
def test_fastq_ranges(spark, tmp_path, size):
    p = tmp_path / "r.fastq"
    p.write_text(records(300))
    got = fastq.read_fastq(spark, str(p), range_bytes=size).orderBy("byte_offset").collect()
    assert [r.name for r in got] == [f"id{i}" for i in range(300)]
    assert all(len(r.seq) == len(r.qual) for r in got)


def test_fastq_errors(spark, tmp_path):
    p = tmp_path / "bad.fastq"
    p.write_text("@a\nACGT\n+\nIIII\n@b\nACXT\n+\nIIII\n@c\nAC\n+\nI\n@d\nAC\n+\nII\n")
    assert [r.name for r in fastq.read_fastq(spark, str(p), on_error="skip").collect()] == ["a", "d"]
    with pytest.raises(Exception, match="outside the alphabet"):
        fastq.read_fastq(spark, str(p)).collect()
    with gzip.open(tmp_path / "z.fastq.gz", "wt") as f:
        f.write(records(20))
    assert fastq.read_fastq(spark, str(tmp_path / "z.fastq.gz")).count() == 20
    assert tuple(fastq.fastq_geometry(fastq.read_fastq(spark, str(tmp_path / "z.fastq.gz"))).collect()[0]) == (20, None)


def test_fastq_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "TTGA", "*+,-"), ("b", "CTCN", None), ("c", None, "x")], "name string, seq string, qual string")
    fastq.write_fastq(df, str(tmp_path / "o"))
    assert sorted((r.name, r.seq, r.qual) for r in fastq.read_fastq(spark, str(tmp_path / "o")).collect()) == [("a", "TTGA", "*+,-"), ("b", "CTCN", ";;;;")]
    with pytest.raises(Exception, match="differ in length"):
        df.select(fastq.fastq_text("name", "seq", F.lit("I"))).collect()


def test_alignment_formats(spark, tmp_path):
    (tmp_path / "a.aln").write_text("CLUSTAL 2\n\nx  AC-G 3\ny  ACTG 4\n   ** *\n\nx  TT 5\ny  TA 6\n")
    got = alignment.read_alignment(spark, str(tmp_path / "a.aln")).collect()
    assert [(r.row_id, r.name, r.seq) for r in got] == [(1, "x", "AC-GTT"), (2, "y", "ACTGTA")]
    assert alignment.parse_alignment("# STOCKHOLM 1.0\nx AC.G\ny ACTG\n//\n", "stockholm")[0] == [("x", "AC-G"), ("y", "ACTG")]
    with pytest.raises(ValueError, match="out of order"):
        alignment.parse_clustal("CLUSTAL\nx AC\ny AC\ny AC\nx AC\n")
    with pytest.raises(ValueError, match="missing"):
        alignment.parse_clustal("CLUSTAL\nx AC\ny AC\nx AC\n")
    rows, mask = [("one", "ACGT" * 30), ("two", "TTTT" * 30)], [(3, 5), (60, 80)]
    assert alignment.parse_phylip(alignment.phylip_text(rows, mask)) == (rows, mask)
    alignment.write_phylip(alignment.read_alignment(spark, str(tmp_path / "a.aln")), str(tmp_path / "p.txt"))
    assert alignment.parse_phylip((tmp_path / "p.txt").read_text())[0] == [("x", "AC-GTT"), ("y", "ACTGTA")]


def test_stream_of_files(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.fa").write_text(">a\nACG\n>b\nAC\n")
    q = running_kmers(fasta_stream(spark, str(drop)), "seq", 2).writeStream.outputMode("complete").format("memory").queryName("kmers_seen").start()
    try:
        q.processAllAvailable()
        (drop / "b.fa").write_text(">c\nACAC\n")
        q.processAllAvailable()
        assert {tuple(r) for r in spark.table("kmers_seen").collect()} == {("AC", 4), ("CG", 1), ("CA", 1)}
    finally:
        q.stop()


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select seq_revcomp('ACCN'), seq_gc('ACGT'), seq_count_mismatch('ATC', 'ATGCATGC', 1), seq_match_mismatch('ATG', 'ATGATG', 0), seq_count_indels('AA', 'ATATTA', 1), seq_gc('')").collect()[0]
    assert tuple(r) == ("NGGT", 0.5, 2, [1, 4], 3, None)
