"""Queries over raw records."""
from pyspark.sql import functions as F

from helixframe.kernels.record_grammar import RecordSchema
from helixframe.operators.record_recovery import broken_records, parse_records, valid_records
from helixframe.session import table

# The fields of this project's records.
SCHEMA = RecordSchema(
    letters="ACGTMRWSYKVHDBN-+." + "acgtmrwsykvhdbn",
    seqid_parts=("[A-Za-z0-9_-]+", "[1-8]", "[0-9]+", "[0-9]+", "[0-9]+"),
    desc_fields=(
        "[A-Z0-9-]+ [A-Z0-9]+ XDB:S[0-9]{9}", "Chr (?:I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV|XV|XVI) from [1-9][0-9]*-[1-9][0-9]*",
        "direct|reverse complement", "Verified ORF|Uncharacterized ORF|Dubious ORF", None,
    ),
)


def p1_found(spark, d):
    return broken_records(table(spark, d, "raw_records"), SCHEMA)


def p1_loaded(spark, d):
    return valid_records(table(spark, d, "raw_records"), SCHEMA)


def p1_recovered(spark, d):
    """Valid records inside texts that are broken as a whole."""
    return valid_records(table(spark, d, "raw_records"), SCHEMA, recovered=True)


def p1_stream(spark, d):
    """The texts of up to 64 records, one behind the other as in a file, and how many valid records the parser finds in them in spite of the broken ones between."""
    raw = table(spark, d, "raw_records").where("fmt in ('fastq', 'fasta')").withColumn("block", F.floor(F.col("raw_id") / 64))
    order = F.array_sort(F.collect_list(F.struct("raw_id", F.coalesce("raw_text", F.lit("")).alias("t"))))  # 64 rows at most
    files = raw.groupBy("fmt", "fileno", "block").agg(F.array_join(F.transform(order, lambda x: x["t"]), "\n").alias("text"))
    files = files.withColumn("key", F.concat_ws(" ", F.col("fmt"), F.coalesce(F.col("fileno").cast("string"), F.lit("")), F.col("block").cast("string")))
    n = parse_records(files, SCHEMA, "key", "fmt", "text", many=True).groupBy("key").agg(F.sum(F.col("ok").cast("long")).alias("n_valid"))
    return files.select("key", "fmt", "fileno", "block").join(n, "key", "left").select("fmt", "fileno", "block", F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_recovered": p1_recovered, "p1_stream": p1_stream}

_P1 = r"""with t as (select raw_id, fmt, string_split(coalesce(raw_text, ''), chr(10)) as l from raw_records),
c as (select raw_id, fmt, list_filter(list_transform(range(1, len(l) + 1), lambda i: case when i < len(l) and ends_with(l[i], chr(13)) then l[i][:-2] else l[i] end), lambda x: x <> '') as l from t),
q as (select raw_id, l, regexp_extract(l[1], '^.([^ \t]*)', 1) as id from c where fmt = 'fastq'),
fq as (select raw_id, case
  when len(l) <> 4 then 'line_count'
  when not starts_with(l[1], '@') or not starts_with(l[3], '+') then 'markup'
  when len(string_split(id, ':')) <> 5 then 'seqid_fields'
  when not regexp_full_match(id, '[A-Za-z0-9_-]+:[1-8]:[0-9]+:[0-9]+:[0-9]+') then 'seqid_value'
  when not regexp_full_match(l[2], '[ACGTMRWSYKVHDBNacgtmrwsykvhdbn.+-]*') then 'seq_letters'
  when length(l[4]) <> length(l[2]) then 'qual_length'
  when not regexp_full_match(l[4], '[!-~]*') then 'qual_value' end as reason from q),
h as (select raw_id, list_filter(l, lambda x: not starts_with(x, ';'))[1] as h from c where fmt = 'fasta'),
d as (select raw_id, h, substr(h, 2) as d from h),
f as (select raw_id, h, d, list_transform(regexp_extract_all(',' || d, ',[ \t]*("(?:[^"]|"")*"[ \t]*|[^",]*)', 1), lambda x: trim(x, ' ' || chr(9))) as f,
  regexp_full_match(',' || d, '(?s)(,[ \t]*("([^"]|"")*"[ \t]*|[^",]*))*') as quotes from d),
fa as (select raw_id, case
  when h is null or not starts_with(h, '>') then 'markup'
  when not quotes then 'quoting'
  when len(f) <> 5 then 'desc_fields'
  when not regexp_full_match(f[1], '[A-Z0-9-]+ [A-Z0-9]+ XDB:S[0-9]{9}') or not regexp_full_match(f[2], 'Chr (I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV|XV|XVI) from [1-9][0-9]*-[1-9][0-9]*')
    or f[3] not in ('direct', 'reverse complement') or f[4] not in ('Verified ORF', 'Uncharacterized ORF', 'Dubious ORF') then 'desc_value' end as reason from f)"""

_ALL = ", every as (select * from fq union all select * from fa)"
_TRIM = r"trim(x, ' ' || chr(9))"

ORACLE = {
    "p1_found": _P1 + _ALL + " select raw_id, reason from every where reason is not null",
    "p1_loaded": _P1 + _ALL + r""", ok as (select raw_id from every where reason is null),
      s as (select raw_id, list_filter(l, lambda x: not starts_with(x, ';')) as l from c where fmt = 'fasta')
      select raw_id, 'fastq' as fmt, id as name, l[2] as seq, l[4] as qual, null::varchar[] as fields from q join ok using (raw_id)
      union all select raw_id, 'fasta', d, array_to_string(l[2:], ''), null, f from f join s using (raw_id) join ok using (raw_id)""",
}

VALID_BY_BLOCK = _P1 + _ALL + """, b as (select raw_id, fmt, fileno, raw_id // 64 as block from raw_records where fmt in ('fastq', 'fasta'))
      select fmt, fileno, block, count(*) filter (reason is null) as n_valid from b join every using (raw_id) group by all"""
