"""Files, alignments, tests and streams over the tables."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from helixframe.functions.transforms import ascii_upper, letters_only, reverse_complement, strsplit, three_bands
from helixframe.operators import alignment as AL
from helixframe.operators.independence import dinucleotide_test
from helixframe.plans.base import _UP, DNA, PATTERNS, READS, dna, patterns, reads, sql
from helixframe.session import shared_folder, table
from helixframe.sources import fasta, fastq
from helixframe.streaming.drops import windowed_composition
from helixframe.udf import register

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _folder(spark) -> str:
    """A new folder that all executors see: beside the checkpoints, removed at the end."""
    return f"{shared_folder(spark, 'files')}/out"


@query("S1_fasta_round_trip", sql(", f as (select coalesce(nullif(trim(regexp_replace(coalesce(desc_line, ''), '[\\r\\n>;]', '', 'g')), ''), 'none') as name, translate(regexp_replace(seq_data, '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as s from fasta_seqs where seqtype = 'DNA' and seq_data is not null), v as (select length(translate(s, 'ACGTMRWSYKVHDBN', '')) as bad, length(s) as n from f) select n - bad as seqlength, count(*) as n_records from v group by all", DNA))
def s1(spark, d):
    """Written as FASTA files, read again, and the sequence lengths counted."""
    t = table(spark, d, "fasta_seqs").where("seqtype = 'DNA' and seq_data is not null")
    name = F.regexp_replace(F.coalesce("desc_line", F.lit("")), "[\\r\\n>;]", "")
    path = _folder(spark)
    fasta.write_fasta(t.select(name.alias("name"), letters_only("seq_data").alias("seq")), path, width=60)
    return fasta.read_fasta(spark, path, "DNA").groupBy(F.length("seq").alias("seqlength")).agg(F.count(F.lit(1)).alias("n_records"))


_WRITTEN = ", f as (select seq_id, regexp_replace(coalesce(desc_line, ''), '[\\r\\n>;]', '', 'g') as d, translate(regexp_replace(seq_data, '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as s from fasta_seqs where seq_data is not null and {t}), g as (select seq_id, 's' || seq_id || ' ' || d as d, s from f)"


def _written(spark, d, where: str, width: int = 60) -> str:
    """The records as a folder of FASTA files; their description begins with the id."""
    t = table(spark, d, "fasta_seqs").where("seq_data is not null").where(where)
    name = F.concat(F.lit("s"), "seq_id", F.lit(" "), F.regexp_replace(F.coalesce("desc_line", F.lit("")), "[\\r\\n>;]", ""))
    path = _folder(spark)
    fasta.write_fasta(t.select(name.alias("name"), letters_only("seq_data").alias("seq")), path, width=width)
    return path


def _read_sql(alphabet: str, t: str) -> str:
    return sql(_WRITTEN.format(t=t) + f" select d as \"desc\", regexp_replace(s, '[^{alphabet}]', '', 'g') as seq, length(regexp_replace(s, '[{alphabet}]', '', 'g'))::int as n_invalid from g", DNA)


@query("S1_read_rna", _read_sql("ACGUMRWSYKVHDBN", "seqtype = 'RNA'"))
def s1r(spark, d):
    return fasta.read_fasta(spark, _written(spark, d, "seqtype = 'RNA'"), "RNA").select("desc", "seq", "n_invalid")


@query("S1_read_aa", _read_sql("ACDEFGHIKLMNPQRSTVWYUOBJZX", "seqtype = 'AA'"))
def s1a(spark, d):
    return fasta.read_fasta(spark, _written(spark, d, "seqtype = 'AA'"), "AA").select("desc", "seq", "n_invalid")


@query("S2_fasta_grammar", sql(_WRITTEN.format(t="seqtype = 'DNA'") + " select d as \"desc\", length(s)::int as seqlength from g", DNA))
def s2(spark, d):
    """With comments before and inside of records, blank lines and CRLF; none of it shows in what is read."""
    t = table(spark, d, "fasta_seqs").where("seqtype = 'DNA' and seq_data is not null")
    name = F.concat(F.lit("s"), "seq_id", F.lit(" "), F.regexp_replace(F.coalesce("desc_line", F.lit("")), "[\\r\\n>;]", ""))
    s = letters_only("seq_data")
    text = F.concat(F.lit("; written for a test\n\n>"), name, F.lit("\r\n"), F.substring(s, 1, 40), F.lit("\r\n;inside\n\n"), F.expr("substr(regexp_replace(seq_data, '[^A-Za-z]', ''), 41)"))
    path = _folder(spark)
    t.select(text.alias("value")).write.text(path)
    return fasta.read_fasta(spark, path, "B").select("desc", F.length("seq").alias("seqlength"))


@query("S3_skip_and_limit", sql("select least(greatest(count(*) - 10, 0), 25) as n from dna", DNA))
def s3(spark, d):
    """Records 11 to 35 of the files, counted across them."""
    return fasta.read_fasta(spark, _written(spark, d, "seqtype = 'DNA'"), "DNA", nrec=25, skip=10).agg(F.count(F.lit(1)).alias("n"))


_CLEAN = ", f as (select * from reads where s <> '' and translate(s, 'ACGTMRWSYKVHDBN', '') = '' and (q is null or length(q) = length(s)))"


@query("S7_fastq_round_trip", sql(_CLEAN + " select length(s) as width, count(*) as n, sum(length(s))::bigint as letters, min(s) as first_read, max(coalesce(q, repeat(';', length(s)))) as last_quality from f group by all", READS))
def s7(spark, d):
    """Written as FASTQ (a missing quality as ``;``), read again by byte ranges, and counted by width."""
    r = reads(spark, d).where("s <> '' and translate(s, 'ACGTMRWSYKVHDBN', '') = '' and (q is null or length(q) = length(s))")
    path = _folder(spark)
    fastq.write_fastq(r.select(F.col("seq_id").cast("string").alias("name"), F.col("s").alias("seq"), F.col("q").alias("qual")), path)
    back = fastq.read_fastq(spark, path, range_bytes=1 << 20)
    return back.groupBy(F.length("seq").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("letters"), F.min("seq").alias("first_read"), F.max("qual").alias("last_quality"))


@query("S13_saved_parquet", sql("select seq_id, s from dna", DNA))
def s13(spark, d):
    """Saved as Parquet and read again."""
    path = _folder(spark)
    fastq.save_sequences(dna(spark, d), path)
    return spark.read.parquet(path)


@query("S9_quality_scaled_reverse", sql("select seq_id, reverse(translate(s, 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN')) as s, reverse(q) as q from reads where q is not null and length(q) = length(s)", READS))
def s9(spark, d):
    """Reverse complement of reads with their qualities."""
    r = reads(spark, d).where("q is not null and length(q) = length(s)")
    return r.select("seq_id", reverse_complement("s").alias("s"), F.reverse("q").alias("q"))


@query("S9_quality_trim", sql("select seq_id, substr(s, 1, greatest(n - 10, 0)) as s, substr(q, 1, greatest(n - 10, 0)) as q from (select *, length(s) as n from reads where q is not null and length(q) = length(s))", READS))
def s9t(spark, d):
    """Sequence and quality narrowed together: the last ten letters cut off."""
    r = reads(spark, d).where("q is not null and length(q) = length(s)")
    n = F.greatest(F.length("s") - 10, F.lit(0))
    return r.select("seq_id", F.col("s").substr(F.lit(1), n).alias("s"), F.col("q").substr(F.lit(1), n).alias("q"))


@query("P21_dictionary_bands", sql("select pattern_id, substr(p, 1, tb_start - 1) as head, substr(p, tb_start, tb_width) as band, substr(p, tb_start + tb_width) as tail from patterns where tb_start >= 1 and tb_width >= 1 and tb_start + tb_width - 1 <= length(p)", PATTERNS))
def p21(spark, d):
    t = patterns(spark, d).where("tb_start >= 1 and tb_width >= 1 and tb_start + tb_width - 1 <= length(p)")
    b = three_bands("p", start=F.col("tb_start"), width=F.col("tb_width"))
    return t.select("pattern_id", b["left"].alias("head"), b["middle"].alias("band"), b["right"].alias("tail"))


@query("P21_dictionary_bands_flanks", f"with p as (select pattern_id, translate(pattern, {_UP}) as p, tb_start, tb_width from motif_dict where pattern is not null) select pattern_id, substr(p, 1, tb_start - 1) as head, substr(p, tb_start, tb_width) as band, substr(p, tb_start + tb_width) as tail from p where tb_start >= 1 and tb_width >= 1 and tb_start + tb_width - 1 <= length(p) and translate(substr(p, tb_start, tb_width), 'ACGT', '') = ''")
def p21f(spark, d):
    """The bands of all patterns whose trusted band is plain; the flanks may have ambiguity letters."""
    t = table(spark, d, "motif_dict").where("pattern is not null and tb_start >= 1 and tb_width >= 1 and tb_start + tb_width - 1 <= length(pattern)").withColumn("p", ascii_upper("pattern"))
    b = three_bands("p", start=F.col("tb_start"), width=F.col("tb_width"))
    return t.select("pattern_id", b["left"].alias("head"), b["middle"].alias("band"), b["right"].alias("tail")).where(F.translate("band", "ACGT", "") == "")


@query("P3_list_elements", sql(", p as (select seq_id, list_filter(string_split(s, 'GATC'), lambda x: x <> '') as l from dna), e as (select seq_id, unnest(l) as piece, unnest(range(1, len(l) + 1))::int as pos from p) select * from e", DNA))
def p3l(spark, d):
    """Lists of sequences in the long form: one row for an element, with its place."""
    lists = dna(spark, d).select("seq_id", F.posexplode(strsplit("s", "GATC")).alias("pos", "piece"))
    return lists.select("seq_id", (F.col("pos") + 1).alias("pos"), "piece")


@query("P24_rep", sql(", r as (select seq_id, s, unnest(range(1, 4))::int as copy from dna) select * from r", DNA))
def p24(spark, d):
    """Each sequence three times."""
    return dna(spark, d).select("seq_id", "s", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))


@query("C10_longest", sql("select seq_id, length(s) as n from dna order by n desc, seq_id limit 25", DNA))
def c10(spark, d):
    """The 25 longest sequences, a top-k report."""
    return dna(spark, d).select("seq_id", F.length("s").alias("n")).orderBy(F.desc("n"), "seq_id").limit(25)


@query("C6_null_sequences", "select seq_id, seq_data is null as missing from fastq_reads")
def c6(spark, d):
    return table(spark, d, "fastq_reads").select("seq_id", F.col("seq_data").isNull().alias("missing"))


@query("A11_two_way_by_quality", sql(", c as (select s, reverse(translate(s, 'ACGT', 'TGCA')) as t, q, reverse(q) as r, unnest(range(1, length(s) + 1)) as i from reads where qscale = 'phred' and length(q) = length(s)) select substr(s, i, 1) as x, substr(t, i, 1) as y, least(ascii(substr(q, i, 1)), ascii(substr(r, i, 1))) - 33 as quality, count(*) as n from c group by all", READS))
def a11(spark, d):
    """Pairs of letters at a place of a read and its reverse complement, by the smaller of their qualities."""
    r = reads(spark, d).where("qscale = 'phred' and length(q) = length(s)")
    chars = lambda c: F.split(c, "")
    z = F.arrays_zip(chars(F.col("s")).alias("x"), chars(F.reverse(F.translate("s", "ACGT", "TGCA"))).alias("y"), chars(F.col("q")).alias("q"), chars(F.reverse("q")).alias("r"))
    e = r.where("s <> ''").select(F.explode(z).alias("z"))
    return e.groupBy(F.col("z.x").alias("x"), F.col("z.y").alias("y"), (F.least(F.ascii("z.q"), F.ascii("z.r")) - 33).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("U1_sql_functions", sql("select seq_id, reverse(translate(s, 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN')) as rc, round((length(s) - length(translate(s, 'GC', ''))) / nullif(length(s), 0), 9) as gc from dna", DNA))
def u1(spark, d):
    """Registered functions from SQL."""
    register(spark)
    dna(spark, d).createOrReplaceTempView("hx_dna")
    return spark.sql("select seq_id, seq_revcomp(s) as rc, round(seq_gc(s), 9) as gc from hx_dna")


@query("S4_fasta_index", sql(_WRITTEN.format(t="seqtype = 'DNA'") + " select d as \"desc\", length(regexp_replace(s, '[^ACGTMRWSYKVHDBN]', '', 'g'))::int as seqlength, true as begins from g", DNA))
def s4(spark, d):
    """The index of written files; a record does begin at each byte offset."""
    index = fasta.fasta_index(spark, _written(spark, d, "seqtype = 'DNA'"), "DNA")
    at = fasta.read_fasta_at(spark, index, "DNA")
    return at.select("desc", "seqlength", (F.col("found_desc") == F.col("desc")).alias("begins"))


@query("S5_read_by_index", sql(_WRITTEN.format(t="seqtype = 'DNA'") + " select d as \"desc\", regexp_replace(s, '[^ACGTMRWSYKVHDBN]', '', 'g') as seq from g where length(regexp_replace(s, '[^ACGTMRWSYKVHDBN]', '', 'g')) > 2000", DNA))
def s5(spark, d):
    """Random access by byte offset: the records longer than 2,000 letters, and no others, are read."""
    index = fasta.fasta_index(spark, _written(spark, d, "seqtype = 'DNA'"), "DNA").where("seqlength > 2000")
    return fasta.read_fasta_at(spark, index, "DNA").select("desc", "seq")


@query("S6_seqlengths", sql(_WRITTEN.format(t="seqtype = 'DNA'") + " select d as \"desc\", length(regexp_replace(s, '[^ACGTMRWSYKVHDBN]', '', 'g'))::int as seqlength from g", DNA))
def s6(spark, d):
    return fasta.fasta_seqlengths(spark, _written(spark, d, "seqtype = 'DNA'"), "DNA").select("desc", "seqlength")


@query("S8_fastq_geometry", sql(", f as (select s from reads where s <> '' and translate(s, 'ACGTMRWSYKVHDBN', '') = '' and (q is null or length(q) = length(s))) select count(*) as n_reads, case when min(length(s)) = max(length(s)) then min(length(s))::int end as width from f", READS))
def s8(spark, d):
    r = reads(spark, d).where("s <> '' and translate(s, 'ACGTMRWSYKVHDBN', '') = '' and (q is null or length(q) = length(s))")
    path = _folder(spark)
    fastq.write_fastq(r.select(F.col("seq_id").cast("string").alias("name"), F.col("s").alias("seq"), F.col("q").alias("qual")), path)
    return fastq.fastq_geometry(fastq.read_fastq(spark, path))


@query("S7_broken_records_are_skipped", sql(", f as (select seq_id from reads where s <> '' and q is not null and q <> '' and translate(s, 'ACGTMRWSYKVHDBN', '') = '' and length(q) = length(s)) select seq_id from f", READS))
def s7b(spark, d):
    """All reads that have a quality, written as they are; those with odd letters or lengths are skipped when they are read."""
    r = reads(spark, d).where("s <> '' and q <> '' and not s rlike '[\\\\r\\\\n]' and not q rlike '[\\\\r\\\\n]'")
    path = _folder(spark)
    r.select(F.concat(F.lit("@"), "seq_id", F.lit("\n"), "s", F.lit("\n+\n"), "q").alias("value")).write.text(path)
    return fastq.read_fastq(spark, path, on_error="skip").select(F.col("name").cast("long").alias("seq_id"))


@query("P13_seqinfo", sql("select f.seq_id, coalesce(nullif(regexp_extract(f.desc_line, 'XDB:S[0-9]+', 0), ''), 'seq' || f.seq_id) as name, length(dna.s) as length, false as is_circular from fasta_seqs f join dna using (seq_id)", DNA))
def p13(spark, d):
    t = table(spark, d, "fasta_seqs").where("seqtype = 'DNA' and seq_data is not null")
    name = F.regexp_extract("desc_line", "XDB:S[0-9]+", 0)
    return t.select("seq_id", F.when(name != "", name).otherwise(F.concat(F.lit("seq"), "seq_id")).alias("name"), F.length(letters_only("seq_data")).alias("length"), F.lit(False).alias("is_circular"))


def _alignment(spark, d):
    """Reads of one width as the rows of an alignment, N as gap."""
    r = reads(spark, d).where("length(s) = 76")
    return r.select(F.col("seq_id").alias("row_id"), F.translate("s", "N", "-").alias("seq"))


@query("K5_mask_gaps", sql(", a as (select translate(s, 'N', '-') as s, unnest(range(1, 77)) as i from reads where length(s) = 76), c as (select i, count(*) filter (substr(s, i, 1) = '-') / count(*) as p from a where contains('ACGTMRWSYKVHDBN-+.', substr(s, i, 1)) group by i), g as (select i, i - row_number() over (order by i) as k from c where p >= 0.004) select min(i)::int as start, max(i)::int as \"end\" from g group by k having count(*) >= 2", READS))
def k5(spark, d):
    return AL.mask_gaps(_alignment(spark, d), 0.004, 2)


@query("A17_masked_consensus")
def a17(spark, d):
    a = _alignment(spark, d)
    mask = spark.createDataFrame([(5, 8), (30, 40)], "start int, end int")
    return AL.masked_consensus(a, None, mask)


@query("K6_consensus_views")
def k6(spark, d):
    """The consensus with the views on its columns that aren't masked."""
    a = _alignment(spark, d)
    mask = spark.createDataFrame([(5, 8), (30, 40)], "start int, end int")
    letters = AL.masked_consensus(a, None, mask)
    views = AL.unmasked_columns(a, mask)
    cells = views.select("start", "end", F.explode(F.sequence("start", "end")).alias("pos"))
    return cells.join(letters, "pos").groupBy("start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("text"))


@query("A13_dinucleotide_test", sql(
    """, t as (select substr(s, 2, 1) as a, substr(s, 3, 1) as b, count(*)::double as n from dna where length(s) >= 3 and contains('ACGT', substr(s, 2, 1)) and contains('ACGT', substr(s, 3, 1)) group by all),
    r as (select a, sum(n) as ra from t group by a), c as (select b, sum(n) as cb from t group by b), z as (select sum(n) as z from t),
    e as (select r.a, c.b, ra * cb / z as e from r, c, z)
    select 'chisq' as test, round(sum(pow(coalesce(t.n, 0) - e.e, 2) / e.e), 6) as statistic, (((select count(*) from r) - 1) * ((select count(*) from c) - 1))::int as df from e left join t on t.a = e.a and t.b = e.b""", DNA))
def a13(spark, d):
    value, df, _ = dinucleotide_test(dna(spark, d), "s", 2, 3)
    return spark.createDataFrame([("chisq", round(value, 6), df)], "test string, statistic double, df int")


@query("A13_g_test")
def a13g(spark, d):
    rows = [(t, *dinucleotide_test(dna(spark, d), "s", 2, 3, t)) for t in ("G", "adjG")]
    return spark.createDataFrame(rows, "test string, statistic double, df int, p double")


@query("A17_alphabet_frequency", sql("select substr(translate(s, 'N', '-'), i, 1) as letter, count(*) as n from (select s, unnest(range(1, 77)) as i from reads where length(s) = 76) where contains('ACGTMRWSYKVHDBN-+.', substr(translate(s, 'N', '-'), i, 1)) and i not between 5 and 8 group by all", READS))
def a17f(spark, d):
    mask = spark.createDataFrame([(5, 8)], "start int, end int")
    return AL.masked_matrix(_alignment(spark, d), None, mask).groupBy("letter").agg(F.sum("n").alias("n"))


@query("X1_stream_composition", "select date_trunc('hour', loaded_at) as window_start, count(*) as reads, sum(length(seq_data))::bigint as letters, sum(length(seq_data) - length(translate(upper(seq_data), 'GC', '')))::bigint as gc from fastq_reads where seq_data is not null and loaded_at is not null group by 1")
def x1(spark, d):
    """The reads as a stream over their folder, by hour of arrival; complete once the stream has seen all of it."""
    src = f"{d}/fastq_reads.parquet"
    schema = spark.read.parquet(src).schema
    folder = src if os.path.isdir(src) else d
    stream = spark.readStream.schema(schema).parquet(folder) if os.path.isdir(src) else spark.readStream.schema(schema).option("pathGlobFilter", "fastq_reads.parquet").parquet(folder)
    stream = stream.where("loaded_at is not null").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    out = _folder(spark)

    def save(batch, no):
        batch.write.mode("overwrite").parquet(f"{out}/batch")

    q = windowed_composition(stream, "loaded_at", "seq_data", late="36500 days").writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/batch").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))

