"""Queries of the training-data operators, with their SQL where there is one."""
from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.llm.bpe import encode_corpus
from helixframe.llm.canonical_dups import canonical_groups, canonical_letters, record_key
from helixframe.llm.leakage import leaked_items
from helixframe.llm.near_dup import expand_pairs, near_duplicates
from helixframe.llm.page_spam import spam_profile
from helixframe.llm.shared_spans import shared_spans
from helixframe.llm.splitting import split_sequences
from helixframe.llm.term_counts import marked_terms, term_counts
from helixframe.session import table


def p2_found(spark, d):
    pairs, members = near_duplicates(table(spark, d, "fastq_reads"), "seq_id", "seq_data")
    return expand_pairs(pairs, members).toDF("seq_id_a", "seq_id_b")


def _dna(spark, d):
    return table(spark, d, "fasta_seqs").where("seqtype = 'DNA'")


def p3_found(spark, d):
    return split_sequences(_dna(spark, d), "seq_id", "seq_data")


def p4_found(spark, d):
    return marked_terms(_dna(spark, d), "seq_data").where("mark is not null").select("word", "mark")


def p4_counts(spark, d):
    return term_counts(_dna(spark, d), "seq_data")


def p5_found(spark, d):
    return shared_spans(_dna(spark, d), "seq_id", "seq_data").withColumnRenamed("id", "seq_id")


def p5_share(spark, d):
    """How much of each record is shared elsewhere."""
    dna = _dna(spark, d)
    runs = shared_spans(dna, "seq_id", "seq_data").groupBy("id").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("n_shared"))
    n = dna.select("seq_id", F.length(canonical_letters(F.col("seq_data"))).alias("n_letters"))
    return n.join(runs, n.seq_id == runs.id, "left").select("seq_id", "n_letters", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def _same_records(spark, d):
    return canonical_groups(table(spark, d, "fasta_seqs"), "seq_id", record_key("desc_line", "seq_data"))


def p6_found(spark, d):
    return _same_records(spark, d).where("n_copies > 1 and id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def p6_counts(spark, d):
    """One row for each record that is kept, with the number of its copies."""
    return _same_records(spark, d).where("id = first_id").select("first_id", "n_copies")


def p7_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark, d):
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark, d):
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_containment(spark, d):
    return _leaks(spark, d)


def p9_found(spark, d):
    return spam_profile(table(spark, d, "documents"), "doc_id", "text", "applicant").where("is_spam").select(F.col("doc").alias("doc_id"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_found, p4_counts, p5_found, p5_share, p6_found, p6_counts, p7_ids, p8_found, p8_containment, p9_found)}

_WORDS = f"""with dna as (select seq_id, regexp_replace(translate(seq_data, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g') as s from fasta_seqs where seqtype = 'DNA'),
pos as (select seq_id, s, unnest(range(1, length(s) - 6)) as i from dna where length(s) >= 8),
words as (select seq_id, substr(s, i, 8) as word from pos where not regexp_matches(substr(s, i, 8), '[^ACGT]')),
counts as (select word, count(*) as tf, count(distinct seq_id) as df from words group by word)"""

_RUNS = _WORDS.split(",\npos as")[0] + """,
w as (select seq_id, i, substr(s, i, 50) as t from (select seq_id, s, unnest(range(1, length(s) - 48)) as i from dna where length(s) >= 50)),
ok as (select * from w where not regexp_matches(t, '[^ACGT]')), rep as (select t from ok group by t having min(seq_id) <> max(seq_id)),
h as (select seq_id, i, case when i > lag(i) over (partition by seq_id order by i) + 50 or lag(i) over (partition by seq_id order by i) is null then 1 else 0 end as fresh from ok where t in (select t from rep)),
g as (select seq_id, i, sum(fresh) over (partition by seq_id order by i) as run from h),
runs as (select seq_id, min(i)::int as start_pos, (max(i) + 49)::int as end_pos from g group by seq_id, run)"""

_SAME = """with c as (select seq_id, regexp_replace(translate(coalesce(seq_data, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g') as s,
  list_sort(list_filter(list_transform(string_split_regex(translate(coalesce(desc_line, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[,;|]'),
    lambda f: array_to_string(regexp_extract_all(f, '[a-z0-9]+'), ' ')), lambda f: f <> '')) as fields from fasta_seqs),
g as (select s, fields, min(seq_id) as first_id, count(*) as n from c where s <> '' group by s, fields)"""

_LEAKS = """with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as w from documents where text is not null),
e as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as w from eval_items where text is not null),
ds as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d where len(w) >= 12)),
es as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as t from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e where len(w) >= 12)),
n as (select item_id, count(*) as size from es group by item_id)"""

ORACLE = {
    "p2_found": """with r as (select seq_id, upper(seq_data) as s from fastq_reads where length(seq_data) >= 37),
        w as (select distinct seq_id, substr(s, i, 8) as t from (select seq_id, s, unnest(range(1, length(s) - 6)) as i from r)),
        n as (select seq_id, count(*) as k from w group by seq_id having count(*) >= 30), v as (select w.* from w join n using (seq_id)),
        p as (select a.seq_id as seq_id_a, b.seq_id as seq_id_b, count(*) as hits from v a join v b on a.t = b.t and a.seq_id < b.seq_id group by all)
        select seq_id_a, seq_id_b from p join n x on x.seq_id = seq_id_a join n y on y.seq_id = seq_id_b where 2 * hits >= x.k + y.k - hits""",
    "p3_found": _WORDS.replace("with dna", "with recursive dna").split(",\npos as")[0] + """,
        c as (select seq_id, length(s) as n, list_filter(range(10, length(s) + 1), lambda i: substr(s, i - 9, 10) = 'NNNNNNNNNN' and substr(s, i + 1, 1) <> 'N') as ends from dna where length(s) > 1500),
        p as (select seq_id, n, ends, 1 as piece_no, 1::bigint as st, coalesce(list_max(list_filter(ends, lambda e: e between 61 and 1500)), 1500) as en from c
          union all select seq_id, n, ends, piece_no + 1, en - 59, case when n - (en - 59) + 1 <= 1500 then n else coalesce(list_max(list_filter(ends, lambda e: e between en - 59 + 60 and en - 59 + 1499)), en - 59 + 1499) end from p where en < n)
        select seq_id, piece_no::int as piece_no, st::int as start_pos, en::int as end_pos from p""",
    "p5_found": _RUNS + " select * from runs",
    "p5_share": _RUNS + " select dna.seq_id, length(s)::int as n_letters, coalesce(sum(end_pos - start_pos + 1), 0)::bigint as n_shared from dna left join runs using (seq_id) where s is not null group by dna.seq_id, s union all select seq_id, 0, 0 from dna where s is null",
    "p6_found": _SAME + " select first_id, seq_id as copy_id from c join g using (s, fields) where seq_id <> first_id",
    "p6_counts": _SAME + " select first_id, n as n_copies from g",
    "p8_found": _LEAKS + " select distinct doc_id, item_id from ds join es using (t)",
    "p8_containment": _LEAKS + " select doc_id as doc, item_id as item, count(*)::int as shared, count(*) / any_value(size) as containment from ds join es using (t) join n using (item_id) group by all",
    "p4_found": _WORDS + """ select word, case when df < 3 then 'rare' else 'common' end as mark from counts
        where df < 3 or df > 0.2 * (select count(*) from fasta_seqs where seqtype = 'DNA')""",
    "p4_counts": _WORDS + " select word, tf, df from counts",
}
