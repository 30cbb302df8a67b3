"""Per-letter transforms, slicing, comparison and counting."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from helixframe import alphabets as A
from helixframe.functions import counting as C, quality as Q, transforms as T
from helixframe.operators import compare, kmers as K
from helixframe.plans.base import DNA, READS, RECORDS, dna, reads, records, sql
from helixframe.session import table

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


_COMP = "'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN'"


def _column(name: str, f, expr: str) -> None:
    """A query of one expression over all DNA records."""
    QUERIES[name] = lambda spark, d: dna(spark, d).select("seq_id", f(F.col("s")).alias("v"))
    ORACLE[name] = sql(f"select seq_id, {expr} as v from dna", DNA)


_column("P1_clean_dna", lambda s: F.md5(s), "md5(s)")
_column("P1_is_valid", T.is_valid, f"translate(s, '{A.DNA_ALPHABET}', '') = ''")
_column("T1_complement", T.complement, f"translate(s, {_COMP})")
_column("T2_reverse", T.reverse, "reverse(s)")
_column("T3_revcomp", T.reverse_complement, f"reverse(translate(s, {_COMP}))")
_column("T4_chartr", lambda s: T.chartr(s, "ACA", "TGC"), "translate(s, 'AC', 'CG')")
_column("T5_replace_ambiguities", T.replace_ambiguities, "translate(s, 'MRWSYKVHDBN', 'NNNNNNNNNNN')")
_column("P12_dna_to_rna", T.dna_to_rna, "translate(s, 'T', 'U')")
_column("P5_subseq_end", lambda s: F.when(F.length(s) >= 40, T.subseq(s, start=-40, end=-11, strict=False)), "case when length(s) >= 40 then substr(s, length(s) - 39, 30) end")
_column("P5_subseq_width", lambda s: T.subseq(s, start=11, width=50, strict=False), "case when length(s) >= 60 then substr(s, 11, 50) end")
_column("P7_xscat", lambda s: T.xscat(s, F.lit("NN"), T.reverse_complement(s)), f"s || 'NN' || reverse(translate(s, {_COMP}))")
_column("P8_letter", lambda s: T.letter(s, [1, 5, 30]), "case when length(s) >= 30 then substr(s, 1, 1) || substr(s, 5, 1) || substr(s, 30, 1) end")
_column("P14_codons", T.codons, "list_transform(range(0, length(s) // 3), lambda i: substr(s, 3 * i + 1, 3))")
_column("P15_strsplit", lambda s: T.strsplit(s, "GATC"), "list_filter(string_split(s, 'GATC'), lambda x: x <> '')")
_column("P16_unstrsplit", lambda s: T.unstrsplit(T.codons(s), "-"), "coalesce(array_to_string(list_transform(range(0, length(s) // 3), lambda i: substr(s, 3 * i + 1, 3)), '-'), '')")
_column("P17_pad_and_clip", lambda s: T.pad_and_clip(s, -4, 120, "<", ">"), "'<<<<<' || substr(s, 1, 115) || repeat('>', greatest(115 - length(s), 0))")
_column("P18_stack", lambda s: T.stack_strings(s, 1, 90, F.lit(7), "-", "-"), "'-------' || substr(s, 1, 83) || repeat('-', greatest(83 - length(s), 0))")
_column("T12_longest_run", lambda s: T.longest_consecutive(s, "A"), "coalesce(list_max(list_transform(string_split_regex(s, '[^A]+'), lambda x: length(x))), 0)")
_column("A3_unique_letters", C.unique_letters, "array_to_string(list_filter(string_split('" + "','".join([A.DNA_ALPHABET])[:18] + "', ''), lambda x: contains(s, x)), '')")
_column("M5_count_exact", lambda s: C.count_pattern("ATTA", s), "length(list_filter(range(1, greatest(length(s) - 2, 1)), lambda i: substr(s, i, 4) = 'ATTA'))")
_column("M5_count_ambiguous", lambda s: C.count_pattern("RGNCY", s, fixed=False), "length(list_filter(range(1, greatest(length(s) - 3, 1)), lambda i: regexp_matches(substr(s, i, 5), '^" + C.ambiguity_regex("RGNCY") + "$')))")
_column("M4_match_exact", lambda s: C.match_starts("GATTA", s), "list_filter(range(1, greatest(length(s) - 3, 1)), lambda i: substr(s, i, 5) = 'GATTA')")
_column("M8_overlapping_starts", lambda s: C.match_starts("AA", s), "list_filter(range(1, greatest(length(s), 1)), lambda i: substr(s, i, 2) = 'AA')")
_column("M1_nedit_starting_at", lambda s: C.n_mismatch_at("GATTACA", s, F.lit(-1)), "list_sum(list_transform(range(1, 8), lambda j: case when j >= 3 and substr(s, j - 2, 1) = substr('GATTACA', j, 1) and j - 2 <= length(s) then 0 else 1 end))::int")
_column("M1_nedit_ending_at", lambda s: C.n_mismatch_ending_at("GATTACA", s, F.length(s)), "list_sum(list_transform(range(1, 8), lambda j: case when length(s) - 7 + j >= 1 and substr(s, length(s) - 7 + j, 1) = substr('GATTACA', j, 1) then 0 else 1 end))::int")
_column("M2_is_matching_at", lambda s: C.is_matching_at("GCTTAC", s, F.lit(12), 3), "list_sum(list_transform(range(1, 7), lambda j: case when 11 + j <= length(s) and substr(s, 11 + j, 1) = substr('GCTTAC', j, 1) then 0 else 1 end)) <= 3")
_column("M3_which_matching_at", lambda s: C.which_matching_at("TTA", s, [1, 2, 3, 4, 5, 6], 1), "list_position(list_transform(range(1, 7), lambda i: list_sum(list_transform(range(1, 4), lambda j: case when substr(s, i + j - 1, 1) = substr('TTA', j, 1) then 0 else 1 end)) <= 1), true)")
_column("M19_mismatch_places", lambda s: C.mismatch_places("ACGTACGT", s, F.lit(5)), "list_filter(range(1, 9), lambda j: not (4 + j <= length(s) and substr(s, 4 + j, 1) = substr('ACGTACGT', j, 1)))")
_column("M18_common_prefix", lambda s: C.common_prefix(s, T.reverse_complement(s)), f"coalesce(list_min(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 1) <> substr(reverse(translate(s, {_COMP})), i, 1))) - 1, length(s))")
_column("M14_arm_length", C.palindrome_arm_length, f"case when length(s) < 2 then 0 else coalesce(list_min(list_filter(range(1, length(s) // 2 + 1), lambda i: not (substr(s, i, 1) in ('A', 'C', 'G', 'T') and substr(s, i, 1) = translate(substr(s, length(s) - i + 1, 1), 'ACGT', 'TGCA')))) - 1, length(s) // 2) end")
_column("C7_only_bases", C.has_only_bases, "translate(s, 'ACGT', '') = ''")
_column("C8_has_letter_at", lambda s: C.has_letter_at(s, "A", 100), "case when length(s) >= 100 then substr(s, 100, 1) = 'A' end")
_column("T10_hard_mask", lambda s: F.when(F.length(s) >= 30, T.inject_hard_mask(s, F.array(F.struct(F.lit(4).alias("start"), F.lit(5).alias("width")), F.struct(F.lit(20).alias("start"), F.lit(3).alias("width"))))), "case when length(s) >= 30 then substr(s, 1, 3) || '+++++' || substr(s, 9, 11) || '+++' || substr(s, 23) end")
_column("T9_replace_at", lambda s: F.when(F.length(s) >= 30, T.replace_at(s, F.array(F.struct(F.lit(15).alias("start"), F.lit(0).alias("width"), F.lit("NNN").alias("value")), F.struct(F.lit(2).alias("start"), F.lit(6).alias("width"), F.lit("").alias("value"))))), "case when length(s) >= 30 then substr(s, 1, 1) || substr(s, 8, 7) || 'NNN' || substr(s, 15) end")
_column("P6_three_bands", lambda s: F.concat_ws("|", *[T.three_bands(s, start=11, width=20)[x] for x in ("left", "middle", "right")]), "case when length(s) >= 30 then substr(s, 1, 10) || '|' || substr(s, 11, 20) || '|' || substr(s, 31) else '' end")
_column("P10_as_vector", lambda s: F.split(s, ""), "case when s = '' then [''] else list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1)) end")
_column("P11_width", lambda s: F.length(s), "length(s)")
_column("P19_to_complex", lambda s: F.aggregate(T.to_complex(s, {"A": (1, 0), "G": (-1, 0), "C": (0, 1), "T": (0, -1)}), F.lit(0.0), lambda a, z: a + F.coalesce(z["re"] + 2 * z["im"], F.lit(0.0))), "coalesce(list_sum(list_transform(range(1, length(s) + 1), lambda i: case substr(s, i, 1) when 'A' then 1.0 when 'G' then -1.0 when 'C' then 2.0 when 'T' then -2.0 else 0.0 end)), 0.0)::double")
QUERIES["T7_replace_letter_at"] = lambda spark, d: dna(spark, d).select("seq_id", T.replace_letter_at("s", F.array(F.lit(2), F.lit(9)), F.array(F.lit("R"), F.lit("N")), "merge").alias("v"))
_MERGE = "case substr(s, 2, 1) when '' then '' when 'A' then 'R' when 'G' then 'R' when 'R' then 'R' when 'C' then 'V' when 'T' then 'D' when 'S' then 'V' when 'M' then 'V' when 'V' then 'V' when 'W' then 'D' when 'K' then 'D' when 'D' then 'D' else 'N' end"
ORACLE["T7_replace_letter_at"] = sql(f"select seq_id, substr(s, 1, 1) || {_MERGE} || substr(s, 3, 6) || case when length(s) >= 9 then 'N' else '' end || substr(s, 10) as v from dna", DNA)

# ---- translation ---------------------------------------------------------


@query("T6_translate", sql(
    """, t as (select seq_id, translate(s, 'MRWSYKVHDBN', 'NNNNNNNNNNN') as s from dna),
    p as (select seq_id, list_transform(range(0, length(s) // 3), lambda i: substr(s, 3 * i + 1, 3)) as c from t)
    select seq_id, coalesce(array_to_string(list_transform(range(1, len(c) + 1), lambda i: case
      when i = 1 and c[i] in ('TTG', 'CTG') then 'M'
      when contains(c[i], 'N') then case when substr(c[i], 1, 2) in ('CT', 'GT', 'TC', 'CC', 'AC', 'GC', 'CG', 'GG') then
        map(['CT', 'GT', 'TC', 'CC', 'AC', 'GC', 'CG', 'GG'], ['L', 'V', 'S', 'P', 'T', 'A', 'R', 'G'])[substr(c[i], 1, 2)] else 'X' end
      else substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG',
        16 * (strpos('TCAG', substr(c[i], 1, 1)) - 1) + 4 * (strpos('TCAG', substr(c[i], 2, 1)) - 1) + strpos('TCAG', substr(c[i], 3, 1)), 1) end), ''), '') as aa from p""", DNA))
def t6(spark, d):
    return dna(spark, d).select("seq_id", T.translate_codons(T.replace_ambiguities(F.col("s")), if_fuzzy="solve").alias("aa"))


@query("P22_genetic_codes")
def p22(spark, d):
    rows = [(i, n, codon, aa) for i, n, _ in A.genetic_code_table() for codon, aa in A.genetic_code(i)[0].items()]
    return spark.createDataFrame(rows, "id string, name string, codon string, aa string")


@query("P20_all_words", "select a || b || c as word from (select unnest(['A', 'C', 'G', 'T']) as a), (select unnest(['A', 'C', 'G', 'T']) as b), (select unnest(['A', 'C', 'G', 'T']) as c)")
def p20(spark, d):
    return T.all_words(spark, "ACGT", 3).select("word")


@query("P9_extract_at", sql(
    """select r.seq_id, r.range_id, case when r.start_pos >= 1 and r.width >= 0 and r.start_pos + r.width - 1 <= length(dna.s) then substr(dna.s, r.start_pos, r.width) end as part
    from seq_ranges r join dna using (seq_id)""", DNA))
def p9(spark, d):
    """Views of all rows: the ranges are joined to their sequence, then cut without a UDF."""
    r = table(spark, d, "seq_ranges").join(dna(spark, d), "seq_id")
    one = F.array(F.struct(F.col("start_pos").alias("start"), F.col("width").alias("width")))
    return r.select("seq_id", "range_id", T.extract_at("s", one)[0].alias("part"))


@query("P4_views", sql(
    """select r.seq_id, r.range_id, greatest(r.start_pos, 1) as view_start,
    greatest(least(r.start_pos + r.width - 1, length(dna.s)) - greatest(r.start_pos, 1) + 1, 0) as view_nchar from seq_ranges r join dna using (seq_id)
    where r.start_pos is not null and r.width is not null""", DNA))
def p4v(spark, d):
    """Views clipped to their sequence."""
    r = table(spark, d, "seq_ranges").where("start_pos is not null and width is not null").join(dna(spark, d), "seq_id")
    end = F.least(F.col("start_pos") + F.col("width") - 1, F.length("s"))
    return r.select("seq_id", "range_id", F.greatest("start_pos", F.lit(1)).alias("view_start"), F.greatest(end - F.greatest("start_pos", F.lit(1)) + 1, F.lit(0)).alias("view_nchar"))


# ---- qualities -----------------------------------------------------------

@query("T11_quality_scores", sql(
    """select seq_id, list_sum(list_transform(range(1, length(q) + 1), lambda i: ascii(substr(q, i, 1)) - case qscale when 'phred' then 33 else 64 end))::bigint as total
    from reads where q is not null and q <> '' and qscale in ('phred', 'solexa', 'illumina')""", READS))
def t11(spark, d):
    r = reads(spark, d).where("q is not null and q <> '' and qscale in ('phred', 'solexa', 'illumina')")
    return r.select("seq_id", F.aggregate(Q.scores_by_scale("q", "qscale"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("T11_error_probability", sql(
    """select seq_id, round(list_sum(list_transform(range(1, length(q) + 1), lambda i: pow(10.0, -(ascii(substr(q, i, 1)) - 33) / 10.0))), 6) as expected_errors
    from reads where q is not null and q <> '' and qscale = 'phred'""", READS))
def t11p(spark, d):
    r = reads(spark, d).where("q is not null and q <> '' and qscale = 'phred'")
    return r.select("seq_id", F.round(F.aggregate(Q.error_probabilities("q"), F.lit(0.0), lambda a, x: a + x), 6).alias("expected_errors"))


@query("T11_rescale", sql("select seq_id, array_to_string(list_transform(range(1, length(q) + 1), lambda i: chr(ascii(substr(q, i, 1)) - 31)), '') as q33 from reads where qscale = 'illumina' and q <> ''", READS))
def t11r(spark, d):
    """Illumina qualities on the phred scale."""
    r = reads(spark, d).where("qscale = 'illumina' and q <> ''")
    return r.select("seq_id", Q.encode_scores(Q.scores("q", "illumina"), "phred").alias("q33"))


# ---- counting ------------------------------------------------------------

_NAMES = {"-": "gap", "+": "plus", ".": "dot"}


@query("A1_alphabet_frequency", sql("select seq_id, " + ", ".join(f"length(s) - length(replace(s, '{x}', '')) as n_{_NAMES.get(x, x)}" for x in A.DNA_ALPHABET) + " from dna", DNA))
def a1(spark, d):
    return dna(spark, d).select("seq_id", *C.alphabet_frequency("s"))


@query("A1_base_only_collapsed", sql("select " + ", ".join(f"sum(length(s) - length(replace(s, '{x}', '')))::bigint as n_{x}" for x in "ACGT") + ", sum(length(translate(s, 'ACGT', '')))::bigint as n_other from dna", DNA))
def a1c(spark, d):
    f = dna(spark, d).select(*C.alphabet_frequency("s", base_only=True))
    return f.agg(*[F.sum(c).alias(c) for c in f.columns])


@query("A2_gc_content", sql("select seq_id, round((length(s) - length(translate(s, 'GC', ''))) / length(s), 9) as gc from dna where s <> ''", DNA))
def a2(spark, d):
    return dna(spark, d).where("s <> ''").select("seq_id", F.round(C.letter_frequency("s", ["GC"], as_prob=True)[0], 9).alias("gc"))


def _kmer_sql(k: int, step: int = 1) -> str:
    return f", w as (select seq_id, unnest(list_transform(range(1, length(s) - {k - 2}, {step}), lambda i: substr(s, i, {k}))) as kmer from dna where length(s) >= {k}), k as (select * from w where translate(kmer, 'ACGT', '') = '')"


@query("A4_oligo3", sql(_kmer_sql(3) + " select seq_id, kmer, count(*) as n from k group by all", DNA))
def a4(spark, d):
    return K.oligo_frequency(dna(spark, d), "seq_id", "s", 3)


@query("A4_oligo3_step3", sql(_kmer_sql(3, 3) + " select kmer, count(*) as n from k group by all", DNA))
def a4s(spark, d):
    return K.oligo_frequency_collapsed(dna(spark, d), "seq_id", "s", 3, step=3, zeros=False)


_BASES3 = "(select a || b || c as kmer from (select unnest(['A','C','G','T']) as a), (select unnest(['A','C','G','T']) as b), (select unnest(['A','C','G','T']) as c)) words"


@query("A4_oligo3_collapsed", sql(_kmer_sql(3) + f" select words.kmer, count(k.kmer) as n from {_BASES3} left join k on k.kmer = words.kmer group by words.kmer", DNA))
def a4c(spark, d):
    return K.oligo_frequency_collapsed(dna(spark, d), "seq_id", "s", 3)


@query("A5_dinucleotide_zeros", sql(_kmer_sql(2) + """, c as (select seq_id, kmer, count(*) as n from k group by all)
    select r.seq_id, x.kmer, coalesce(c.n, 0) as n from (select seq_id from dna) r cross join (select a || b as kmer from (select unnest(['A','C','G','T']) as a), (select unnest(['A','C','G','T']) as b)) x
    left join c on c.seq_id = r.seq_id and c.kmer = x.kmer""", DNA))
def a5(spark, d):
    return K.oligo_frequency(dna(spark, d), "seq_id", "s", 2, zeros=True)


@query("A6_transitions", sql(_kmer_sql(2) + """, c as (select kmer, count(*) as n from k group by all)
    select substr(kmer, 1, 1) as left_word, substr(kmer, 2, 1) as right_word, n, round(n / sum(n) over (partition by substr(kmer, 1, 1)), 9) as prob from c""", DNA))
def a6(spark, d):
    return K.oligo_transitions(dna(spark, d), "seq_id", "s").withColumn("prob", F.round("prob", 9))


@query("A7_nucleotide_at", sql("select substr(s, 3, 1) as l1, substr(s, 10, 1) as l2, count(*) as n from dna where length(s) >= 10 and substr(s, 3, 1) in ('A','C','G','T') and substr(s, 10, 1) in ('A','C','G','T') group by all", DNA))
def a7(spark, d):
    return K.nucleotide_frequency_at(dna(spark, d), "s", [3, 10])


_MATRIX = f", c as (select unnest(range(1, length(s) + 1)) as i, s from reads where s <> ''), m as (select i::int as pos, substr(s, i, 1) as letter, count(*) as n from c where contains('{A.DNA_ALPHABET}', substr(s, i, 1)) group by pos, letter)"


@query("A8_consensus_matrix", sql(_MATRIX + " select pos, letter, n from m", READS))
def a8(spark, d):
    return K.consensus_matrix(reads(spark, d), "s")


@query("A8_consensus_shift", sql(f", c as (select unnest(range(1, length(s) + 1)) as i, s, (seq_id % 3)::int as shift from reads where s <> ''), m as (select (i + shift)::int as pos, substr(s, i, 1) as letter, count(*) as n from c where i + shift <= 60 group by all) select * from m where contains('{A.DNA_ALPHABET}', letter)", READS))
def a8s(spark, d):
    return K.consensus_matrix(reads(spark, d).withColumn("shift", (F.col("seq_id") % 3).cast("int")), "s", "shift", 60)


@query("A8_consensus_shift_whole", sql(f", c as (select unnest(range(1, length(s) + 1)) as i, s, (seq_id % 3)::int as shift from reads where s <> ''), m as (select (i + shift)::int as pos, substr(s, i, 1) as letter, count(*) as n from c group by all) select * from m where contains('{A.DNA_ALPHABET}', letter)", READS))
def a8sw(spark, d):
    """The shifted matrix over whole reads."""
    return K.consensus_matrix(reads(spark, d).withColumn("shift", (F.col("seq_id") % 3).cast("int")), "s", "shift")


@query("A9_consensus_string", sql(
    _MATRIX + """, p as (select pos, letter, n / sum(n) over (partition by pos) as p from m),
    b as (select pos, base, sum(case letter """ + " ".join(f"when '{k}' then case when contains('{v}', base) then p / {len(v)} else 0 end" for k, v in A.IUPAC_CODE_MAP.items()) + """ else 0 end) as p
      from p, (select unnest(['A','C','G','T']) as base) group by all),
    s as (select pos, coalesce(string_agg(case when p >= 0.25 - 1e-12 then base end, '' order by base), '') as bases from b group by pos)
    select pos, coalesce(case bases """ + " ".join(f"when '{v}' then '{k}'" for k, v in A.IUPAC_CODE_MAP.items()) + " end, '?') as letter from s", READS))
def a9(spark, d):
    return K.consensus_string(K.consensus_matrix(reads(spark, d), "s"))


@query("A10_two_way", sql(f", c as (select s, reverse(translate(s, {_COMP})) as t, unnest(range(1, length(s) + 1)) as i from dna where s <> '') select substr(s, i, 1) as x, substr(t, i, 1) as y, count(*) as n from c group by all", DNA))
def a10(spark, d):
    return K.two_way_frequency(dna(spark, d).withColumn("t", T.reverse_complement("s")), "s", "t")


@query("A12_n50", sql(", z as (select length(s) as size from dna), r as (select size, sum(size) over (order by size desc rows unbounded preceding) as run, sum(size) over () as total from z) select max(size) as n50 from r where run * 2 >= total", DNA))
def a12(spark, d):
    return K.n50(dna(spark, d).select(F.length("s").alias("size")), "size")


@query("A12_n50_index", "with z as (select seqlength as size from fasta_idx where seqlength is not null), r as (select size, sum(size) over (order by size desc rows unbounded preceding) as run, sum(size) over () as total from z) select max(size) as n50 from r where run * 2 >= total")
def a12i(spark, d):
    return K.n50(table(spark, d, "fasta_idx"), "seqlength")


@query("W1_sliding_gc", sql(", w as (select seq_id, s, unnest(range(1, length(s) - 98)) as i from dna where length(s) >= 100) select seq_id, i::int as start, 100 - length(translate(substr(s, i, 100), 'GC', '')) as n from w", DNA))
def w1(spark, d):
    return K.sliding_letter_frequency(dna(spark, d), "seq_id", "s", 100, "GC")


# ---- comparison, order and sets -------------------------------------------

_KEY = f"translate(s, '{A.ORDER_BY_CODE}', '{'abcdefghijklmnopqr'[:len(A.ORDER_BY_CODE)]}')"


@query("C2_order", sql(f"select seq_id, row_number() over (order by {_KEY}, seq_id) as place from records where seqtype = 'DNA'", RECORDS))
def c2(spark, d):
    return compare.order(records(spark, d).where("seqtype = 'DNA'"), "seq_id", "s")


@query("C3_rank", sql(f"select seq_id, rank() over (order by {_KEY}) as rnk from dna", DNA))
def c3r(spark, d):
    return compare.rank(dna(spark, d), "seq_id", "s")


@query("C3_duplicated", sql("select seq_id, row_number() over (partition by s order by seq_id) > 1 as duplicated from dna", DNA))
def c3(spark, d):
    return compare.duplicated(dna(spark, d), "seq_id", "s")


@query("C3_unique", sql("select min(seq_id) as seq_id, s from dna group by s", DNA))
def c3u(spark, d):
    return compare.unique(dna(spark, d), "seq_id", "s")


@query("C1_equals", sql("select a.seq_id, a.s = b.s as same from dna a join (select seq_id, translate(s, 'U', 'T') as s from records) b using (seq_id)", DNA, RECORDS))
def c1(spark, d):
    b = records(spark, d).select("seq_id", T.rna_to_dna("s").alias("t"))
    return dna(spark, d).join(b, "seq_id").select("seq_id", (F.col("s") == F.col("t")).alias("same"))


_AB = """, t as (select r.seq_id, translate(regexp_replace(r.seq_data, '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as s, f.width > 60 as wide
 from fasta_seqs r join seq_files f using (fileno) where r.seqtype = 'DNA' and r.seq_data is not null), a as (select seq_id, s from t where wide), b as (select seq_id, s from t where not wide)"""


def _halves(spark, d):
    """The records of files with wide lines, and of those with narrow ones."""
    files = table(spark, d, "seq_files").select("fileno", (F.col("width") > 60).alias("wide"))
    rows = table(spark, d, "fasta_seqs").where("seqtype = 'DNA' and seq_data is not null").join(F.broadcast(files), "fileno")
    x = rows.select("seq_id", T.letters_only("seq_data").alias("s"), "wide")
    return x.where("wide").drop("wide"), x.where("not wide").drop("wide")


@query("C4_match", sql(_AB + " select a.seq_id, m.first_id from a left join (select s, min(seq_id) as first_id from b group by s) m on a.s = m.s", DNA))
def c4(spark, d):
    return compare.match(*_halves(spark, d), "seq_id", "s")


@query("C4_in", sql(_AB + " select seq_id from a where s in (select s from b)", DNA))
def c4i(spark, d):
    return compare.is_in(*_halves(spark, d), "s").select("seq_id")


for _n, _f, _s in (("union", compare.union, "union"), ("intersect", compare.intersect, "intersect"), ("setdiff", compare.setdiff, "except")):
    QUERIES[f"C5_{_n}"] = lambda spark, d, f=_f: f(*_halves(spark, d), "s")
    ORACLE[f"C5_{_n}"] = sql(_AB + f" select s from a {_s} select s from b", DNA)


@query("C5_setequal", sql(_AB + " select not exists (select s from a except select s from b) and not exists (select s from b except select s from a) as equal", DNA))
def c5e(spark, d):
    return compare.setequal(*_halves(spark, d), "s")
