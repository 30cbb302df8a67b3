"""Pattern, dictionary and interval queries."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from helixframe.alphabets import IUPAC_CODE_MAP
from helixframe.operators import dictionary as D, intervals as I, kmers as K, matching as M
from helixframe.plans.base import DNA, PATTERNS, READS, dna, patterns, reads, sql
from helixframe.session import table

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _mm_sql(p: str, frame: str, mm: int) -> str:
    """Starts with at most mm mismatches, those that hang off included."""
    k = len(p)
    bad = " + ".join(f"case when i + {j} between 1 and length(s) and substr(s, greatest(i + {j}, 1), 1) = '{c}' then 0 else 1 end" for j, c in enumerate(p))
    return f", w as (select seq_id, s, unnest(range(1 - {mm}, length(s) - {k} + 2 + {mm})) as i from {frame} where length(s) >= {k - mm}), h as (select seq_id, i::int as st from w where {bad} <= {mm})"


@query("M4_match_mm1", sql(_mm_sql("GATTACA", "dna", 1) + ' select seq_id as subject_id, st as start, st + 6 as "end" from h', DNA))
def m4mm(spark, d):
    return M.match_pattern(dna(spark, d), "seq_id", "s", "GATTACA", max_mismatch=1)


@query("M6_vcount_mm2", sql(_mm_sql("GATTACAGG", "reads", 2) + ", c as (select seq_id, count(*) as n from h group by seq_id) select r.seq_id as subject_id, coalesce(c.n, 0) as n from reads r left join c using (seq_id)", READS))
def m6(spark, d):
    return M.count_matches(reads(spark, d), "seq_id", "s", "GATTACAGG", max_mismatch=2)


@query("M6_vcount_exact", sql("select seq_id as subject_id, length(list_filter(range(1, greatest(length(s) - 2, 1)), lambda i: substr(s, i, 4) = 'GGCA')) as n from reads", READS))
def m6e(spark, d):
    return M.count_matches(reads(spark, d), "seq_id", "s", "GGCA")


_CLASS = {"N": "[ACMGRSVTWYHKDBN]", "G": "[GRSVKDBN]", "Y": "[CMSVTWYHKDBN]", "A": "[AMRVWHDN]"}


@query("M4_match_iupac", sql(', w as (select seq_id, s, unnest(range(1, length(s) - 3)) as i from reads where length(s) >= 5) select seq_id as subject_id, i::int as start, (i + 4)::int as "end" from w where regexp_matches(substr(s, i, 5), \'^' + _CLASS["G"] + _CLASS["A"] + _CLASS["Y"] + _CLASS["N"] + _CLASS["G"] + "$')", READS))
def m4i(spark, d):
    """Ambiguity letters on both sides stand for sets of bases."""
    return M.match_pattern(reads(spark, d), "seq_id", "s", "GAYNG", fixed=(False, False))


@query("M4_match_indels")
def m4ind(spark, d):
    return M.match_pattern(reads(spark, d), "seq_id", "s", "GATTACAGGCT", max_mismatch=2, indels=True)


@query("M4_match_tiled", sql(', w as (select seq_id, s, unnest(range(1, length(s) - 5)) as i from dna where length(s) >= 7) select seq_id as subject_id, i::int as start, (i + 6)::int as "end" from w where substr(s, i, 7) = \'ATTTCTT\'', DNA))
def m4t(spark, d):
    return M.match_pattern(dna(spark, d), "seq_id", "s", "ATTTCTT", tile=500)


@query("M14_palindromes", sql(""", c as (select seq_id, s, unnest(range(1, length(s) + 1)) as i from reads), p as (select seq_id, i, j from (select seq_id, s, i, unnest(range(i + 1, length(s) + 1)) as j from c)
   where (substr(s, i, 1), substr(s, j, 1)) in (('A', 'T'), ('T', 'A'), ('A', 'U'), ('U', 'A'), ('C', 'G'), ('G', 'C'), ('-', '-'))),
 g as (select seq_id, i, j, i + j as centre, j - row_number() over (partition by seq_id, i + j order by j) as run from p)
 select seq_id as subject_id, min(i)::int as start, max(j)::int as "end" from g group by seq_id, centre, run having count(*) >= 5 and min(j - i - 1) <= 6""", READS))
def m14(spark, d):
    return M.palindromes(reads(spark, d), "seq_id", "s", min_arm=5, max_loop=6)


@query("M17_partial_matches", sql(""", c as (select seq_id, s, unnest(range(1, length(s) + 1)) as j from reads), m as (select seq_id, j, i from (select seq_id, s, j, unnest(range(1, 21)) as i from c) where substr(s, j, 1) = substr('GATTACAGGCTTAACCGGAT', i, 1)),
 g as (select *, j - row_number() over (partition by seq_id, j - i order by j) as run from m), r as (select seq_id, min(i) as pa, max(i) as pz, min(j) as sa, max(j) as sz from g group by seq_id, j - i, run),
 o as (select *, row_number() over (partition by seq_id order by sz - sa desc, sa, pa) as k from r) select seq_id as subject_id, pa::int as p_start, pz::int as p_end, sa::int as s_start, sz::int as s_end from o where k <= 3""", READS))
def m17(spark, d):
    return M.partial_matches(reads(spark, d), "seq_id", "s", "GATTACAGGCTTAACCGGAT", 3)


@query("M16_trim_adapters", sql(
    """, b as (select seq_id, s, length(s) as n,
      coalesce(list_max(list_filter(range(1, 13), lambda k: k <= length(s) and substr('ACGTTGCAGATC', 13 - k, k) = substr(s, 1, k))), 0) as lk,
      coalesce(list_max(list_filter(range(1, 14), lambda k: k <= length(s) and substr('AGATCGGAAGAGC', 1, k) = substr(s, length(s) - k + 1, k))), 0) as rk from reads)
    select seq_id as subject_id, (case when lk > n - rk then n - rk + 1 else lk + 1 end)::int as start, (n - rk)::int as "end" from b""", READS))
def m16(spark, d):
    return M.trim_patterns(reads(spark, d), "seq_id", "s", "ACGTTGCAGATC", "AGATCGGAAGAGC", left_mismatch=0.0, right_mismatch=0.0)


_HITS = "{n} as (select seq_id as subject_id, i as start, i + {k} - 1 as \"end\" from (select seq_id, s, unnest(range(1, length(s) - {k} + 2)) as i from dna where length(s) >= {k}) where substr(s, i, {k}) = '{p}')"


def _hits_sql(n: str, p: str) -> str:
    return _HITS.format(n=n, k=len(p), p=p)


@query("M15_lr_pairs", sql(', ' + _hits_sql("l", "ATG") + ', ' + _hits_sql("r", "TAA") + ' select l.subject_id, l.start::int as start, r."end"::int as "end" from l join r on l.subject_id = r.subject_id and r.start - l."end" - 1 between 0 and 90', DNA))
def m15(spark, d):
    x = dna(spark, d)
    return M.lr_pairs(M.match_pattern(x, "seq_id", "s", "ATG"), M.match_pattern(x, "seq_id", "s", "TAA"), 90)


@query("M22_probe_pairs", sql(
    ', ' + _hits_sql("f", "GTTA") + ', ' + _hits_sql("g", "CTCA") + ', ' + _hits_sql("fr", "TAAC") + ', ' + _hits_sql("gr", "TGAG")
    + ', st as (select subject_id, start from f union select subject_id, start from g), en as (select subject_id, "end" from fr union select subject_id, "end" from gr),'
    + ' ev as (select subject_id, start as pos, 0 as kind from st union select subject_id, "end", 1 from en), l as (select *, lag(kind) over w as pk, lag(pos) over w as pp from ev window w as (partition by subject_id order by pos, kind))'
    + ' select subject_id, pp::int as start, pos::int as "end" from l where kind = 1 and pk = 0', DNA))
def m22(spark, d):
    """Theoretical amplicons of a pair of probes: both probes and their reverse complements, then minimal pairs."""
    x = dna(spark, d)
    hit = lambda p: M.match_pattern(x, "seq_id", "s", p)
    starts = hit("GTTA").unionByName(hit("CTCA")).select("subject_id", "start")
    ends = hit("TAAC").unionByName(hit("TGAG")).select("subject_id", "end")
    return M.probe_pairs(starts, ends)


_PWM = np.array([[0.7, 0.1, 0.1, 0.05, 0.6], [0.1, 0.1, 0.6, 0.05, 0.1], [0.1, 0.1, 0.2, 0.85, 0.2], [0.1, 0.7, 0.1, 0.05, 0.1]])
_WEIGHT = " + ".join("case substr(s, i + %d, 1) %s else 0 end" % (j, " ".join(f"when '{b}' then {_PWM[r, j]}" for r, b in enumerate("ACGT"))) for j in range(5))


@query("M21_match_pwm", sql(f', w as (select seq_id, s, unnest(range(1, length(s) - 3)) as i from dna where length(s) >= 5) select seq_id as subject_id, i::int as start, (i + 4)::int as "end" from w where {_WEIGHT} >= 2.62', DNA))
def m21(spark, d):
    return M.match_pwm(dna(spark, d), "seq_id", "s", _PWM, 2.62)


@query("M21_pwm_score_at", sql(f", w as (select seq_id, s, unnest([3, 50]) as i from dna) select seq_id as subject_id, i as start, case when i + 4 <= length(s) then round(({_WEIGHT})::double, 9) end as score from w", DNA))
def m21s(spark, d):
    return M.pwm_score_at(dna(spark, d), "seq_id", "s", _PWM, [3, 50]).withColumn("score", F.round("score", 9))


@query("M20_pwm_of_reads", sql(""", r as (select s, length(s) as width from reads where s <> '' and translate(s, 'ACGT', '') = ''), c as (select width, substr(s, i, 1) as base, i as pos from (select *, unnest(range(1, width + 1)) as i from r)),
 n as (select width, count(*) as n from r group by width), x as (select width, pos, b.base, (select 1) from (select width, unnest(range(1, width + 1)) as pos from n), (select unnest(['A', 'C', 'G', 'T']) as base) b),
 k as (select x.width, x.pos, x.base, count(c.base) as k from x left join c on c.width = x.width and c.pos = x.pos and c.base = x.base group by all), w as (select width, pos, base, ln((k + 0.25) / (n + 1) / 0.25) / ln(2) as w from k join n using (width)),
 e as (select width, sum(lo) as lo, sum(hi) as hi from (select width, pos, min(w) as lo, max(w) as hi from w group by all) group by width)
 select width::int as width, pos::int as pos, base, case when abs((w - lo / width) / (hi - lo)) < 1e-8 then 0.0::double else round((w - lo / width) / (hi - lo), 7) end as weight from w join e using (width)""", READS))
def m20(spark, d):
    """The weight matrices of all reads without other letters than bases, one for each width."""
    r = reads(spark, d).where("s <> '' and translate(s, 'ACGT', '') = ''")
    return K.weight_matrices(r, "s").withColumn("weight", F.when(F.abs("weight") < 1e-8, 0.0).otherwise(F.round("weight", 7)))  # no negative zero


# ---- dictionaries -----------------------------------------------------------

def _dict(spark, d):
    return patterns(spark, d).withColumnRenamed("p", "pattern")


_DM = ', w as (select seq_id, s, k, unnest(range(1, length(s) - k + 2)) as i from reads, (select distinct length(p) as k from patterns) where length(s) >= k), m as (select p.pattern_id, w.seq_id as subject_id, w.i::int as start, (w.i + k - 1)::int as "end" from w join patterns p on substr(w.s, w.i, w.k) = p.p)'


def _matches(spark, d):
    return D.match_dictionary(_dict(spark, d), reads(spark, d), "seq_id", "s")


@query("M10_match_dict", sql(_DM + " select * from m", READS, PATTERNS))
def m10(spark, d):
    return _matches(spark, d)


_NEAR = """, t as (select seq_id, '.' || s || '.' as s from reads), k as (select distinct length(p) as k from patterns),
 w as (select seq_id, k, i - 1 as st, substr(s, i, k) as w from (select seq_id, s, k, unnest(range(1, length(s) - k + 2)) as i from t, k where length(s) >= k))"""


@query("M10_match_dict_mm1", sql(_NEAR + """, q as (select pattern_id, p, length(p) as k, length(p) // 2 as h from patterns), c as (
  select pattern_id, seq_id, st, w, p, q.k from w join q on w.k = q.k and substr(w, 1, h) = substr(p, 1, h)
  union select pattern_id, seq_id, st, w, p, q.k from w join q on w.k = q.k and substr(w, h + 1) = substr(p, h + 1))
 select pattern_id, seq_id as subject_id, st::int as start, (st + k - 1)::int as "end" from c where hamming(w, p) <= 1""", READS, PATTERNS))
def m10mm(spark, d):
    """Pigeonhole bands: two halves of each pattern, one of which matches exactly."""
    return D.match_dictionary(_dict(spark, d), reads(spark, d), "seq_id", "s", max_mismatch=1)


def _banded(spark, d):
    """The patterns whose trusted band is inside and plain, as it has to be; their flanks may hold ambiguity letters."""
    p = _dict(spark, d).where("tb_start >= 1 and tb_width >= 1 and tb_start + tb_width - 1 <= length(pattern)")
    return p.where(F.translate(F.col("pattern").substr(F.col("tb_start"), F.col("tb_width")), "ACGT", "") == "")


_BANDED = "tb as (select *, substr(p, tb_start, tb_width) as band from patterns where tb_start >= 1 and tb_width >= 1 and tb_start + tb_width - 1 <= length(p) and translate(substr(p, tb_start, tb_width), 'ACGT', '') = '')"


@query("M9_trusted_band", sql(_NEAR + ", " + _BANDED + """ select pattern_id, seq_id as subject_id, st::int as start, (st + k - 1)::int as "end"
 from w join tb on w.k = length(p) and substr(w.w, tb_start, tb_width) = band where hamming(w.w, p) <= 1""", READS, PATTERNS))
def m9(spark, d):
    """Mismatches outside the trusted band only."""
    return D.match_dictionary(_banded(spark, d), reads(spark, d), "seq_id", "s", 1, "tb_start", "tb_width")


@query("M10_ambiguous_patterns", sql(""", k as (select distinct length(p) as k from patterns), w as (select seq_id, k, i as st, substr(s, i, k) as w from (select seq_id, s, k, unnest(range(1, length(s) - k + 2)) as i from reads, k where length(s) >= k)),
 q as (select pattern_id, p, length(p) as k, regexp_extract(p, '^[ACGT]*') as head from patterns where translate(p, 'ACGT', '') <> '')
 select q.pattern_id, seq_id as subject_id, st::int as start, (st + q.k - 1)::int as "end" from w join q on w.k = q.k and starts_with(w.w, head)
 where list_bool_and(list_transform(range(1, q.k + 1), lambda i: contains(case substr(q.p, i, 1) """ + " ".join(f"when '{k}' then '{v}'" for k, v in IUPAC_CODE_MAP.items()) + """ else substr(q.p, i, 1) end, substr(w.w, i, 1))))""", READS, PATTERNS))
def m10a(spark, d):
    """Ambiguity letters of the patterns stand for their bases; those of the reads match only what includes them."""
    p = _dict(spark, d).where(F.translate("pattern", "ACGT", "") != "")
    return D.match_dictionary(p, reads(spark, d), "seq_id", "s", fixed=(False, True))


@query("M10_match_dict35", sql(""", q as (select min(seq_id) as pattern_id, substr(s, 1, 35) as p from reads where length(s) >= 35 and translate(substr(s, 1, 35), 'ACGT', '') = '' group by 2),
 w as (select seq_id, i, substr(s, i, 35) as w from (select seq_id, s, unnest(range(1, length(s) - 33)) as i from reads where length(s) >= 35))
 select pattern_id, seq_id as subject_id, i::int as start, (i + 34)::int as "end" from w join q on w = p""", READS))
def m10w(spark, d):
    """A dictionary of 35-mers: how all reads begin, looked up in all reads."""
    r = reads(spark, d)
    head = F.substring("s", 1, 35)
    p = r.where((F.length("s") >= 35) & (F.translate(head, "ACGT", "") == "")).groupBy(head.alias("pattern")).agg(F.min("seq_id").alias("pattern_id")).select("pattern_id", "pattern")
    return D.match_dictionary(p, r, "seq_id", "s")


@query("M11_vcount", sql(_DM + " select pattern_id, subject_id, count(*) as n from m group by all", READS, PATTERNS))
def m11(spark, d):
    return D.count_dictionary(_matches(spark, d))


@query("M11_collapse_patterns", sql(_DM + " select pattern_id, sum(1 + subject_id % 2)::double as n from m group by all", READS, PATTERNS))
def m11p(spark, d):
    weights = reads(spark, d).select(F.col("seq_id").alias("subject_id"), (1 + F.col("seq_id") % 2).cast("double").alias("weight"))
    return D.collapse_by_pattern(_matches(spark, d), weights)


@query("M11_collapse_subjects", sql(_DM + " select subject_id, count(*)::double as n from m group by all", READS, PATTERNS))
def m11s(spark, d):
    return D.collapse_by_subject(_matches(spark, d))


@query("M12_vwhich", sql(_DM + " select subject_id, list_sort(list(distinct pattern_id)) as pattern_ids from m group by all", READS, PATTERNS))
def m12(spark, d):
    return D.which_patterns(_matches(spark, d))


@query("M13_extract_matches", sql(_DM + " select m.pattern_id, m.subject_id, m.start, p.p as text from m join patterns p using (pattern_id)", READS, PATTERNS))
def m13(spark, d):
    return D.extract_matches(_matches(spark, d), reads(spark, d), "seq_id", "s")


@query("A15_pattern_frequency", sql("select pattern_id, count(*) over (partition by p) as n from patterns", PATTERNS))
def a15(spark, d):
    return D.pattern_frequency(patterns(spark, d), "pattern_id", "p")


@query("A15_duplicated_patterns", sql("select a.pattern_id as member_id, min(b.pattern_id) as pattern_id from patterns a join patterns b using (p) group by 1", PATTERNS))
def a15d(spark, d):
    return D.dedup_patterns(patterns(spark, d), "pattern_id", "p")[1]


@query("M24_probe_variants", sql(", m as (select pattern_id, p, (length(p) + 1) // 2 as c from patterns) select distinct pattern_id, seq_id from m, reads where contains(s, p) or contains(s, substr(p, 1, c - 1) || translate(substr(p, c, 1), 'ACGT', 'TGCA') || substr(p, c + 1))", READS, PATTERNS))
def m24(spark, d):
    """Probes as they are, or with their middle base complemented: two exact dictionaries."""
    p = _dict(spark, d).where("pattern <> ''").select("pattern_id", "pattern", F.floor((F.length("pattern") + 1) / 2).cast("int").alias("c"))
    middle = F.concat(F.expr("substr(pattern, 1, c - 1)"), F.translate(F.expr("substr(pattern, c, 1)"), "ACGT", "TGCA"), F.expr("substr(pattern, c + 1)"))
    both = p.select("pattern_id", "pattern").unionByName(p.select("pattern_id", middle.alias("pattern")))
    return D.match_dictionary(both, reads(spark, d), "seq_id", "s").select("pattern_id", F.col("subject_id").alias("seq_id")).distinct()


# ---- intervals ----------------------------------------------------------------

_R = ", r as (select seq_id, start_pos as st, start_pos + width - 1 as en from seq_ranges where start_pos is not null and width > 0)"
_MERGED = """, o as (select *, max(en) over (partition by seq_id order by st, en rows between unbounded preceding and 1 preceding) as m from r),
 g as (select *, sum(case when m is null or st > m + 1 then 1 else 0 end) over (partition by seq_id order by st, en rows unbounded preceding) as i from o), mg as (select seq_id, min(st) as st, max(en) as en from g group by seq_id, i)"""


def _ranges(spark, d):
    r = table(spark, d, "seq_ranges").where("start_pos is not null and width > 0")
    return r.select("seq_id", F.col("start_pos").alias("start"), (F.col("start_pos") + F.col("width") - 1).alias("end"))


@query("K2_merge", "with x as (select 1)" + _R + _MERGED + ' select seq_id, st as start, en as "end" from mg')
def k2(spark, d):
    return I.merge_ranges(_ranges(spark, d), "seq_id")


def _clipped(spark, d):
    lengths = dna(spark, d).select("seq_id", F.length("s").alias("length"))
    return I.restrict(_ranges(spark, d), lengths, "seq_id"), lengths


_CLIP = ", rr as (select seq_id, start_pos as st, start_pos + width - 1 as en from seq_ranges where start_pos is not null and width > 0), r as (select rr.seq_id, greatest(st, 1) as st, least(en, length(s)) as en from rr join dna using (seq_id) where least(en, length(s)) >= greatest(st, 1))"


@query("K7_restrict", sql(_CLIP + ' select seq_id, st::int as start, en::int as "end" from r', DNA))
def k7(spark, d):
    return _clipped(spark, d)[0]


@query("K3_gaps", sql(_CLIP + _MERGED + ', c as (select seq_id, st, en from mg union all select seq_id, length(s) + 1, length(s) + 1 from dna), l as (select seq_id, coalesce(lag(en) over (partition by seq_id order by st), 0) + 1 as a, st - 1 as z from c) select seq_id, a::int as start, z::int as "end" from l where z >= a', DNA))
def k3(spark, d):
    r, lengths = _clipped(spark, d)
    return I.gaps(I.merge_ranges(r, "seq_id"), lengths, "seq_id")


@query("A14_coverage", sql(_CLIP + ', e as (select seq_id, st as p, 1 as d from r union all select seq_id, en + 1, -1 from r), g as (select seq_id, p, sum(d) as d from e group by all having sum(d) <> 0), q as (select seq_id, p, sum(d) over (partition by seq_id order by p rows unbounded preceding) as depth, lead(p) over (partition by seq_id order by p) - 1 as z from g) select seq_id, p::int as start, z::int as "end", depth::bigint as depth from q where depth <> 0 and z is not null', DNA))
def a14(spark, d):
    return I.coverage(_clipped(spark, d)[0], "seq_id")


@query("A16_masked_width", sql(_CLIP + _MERGED + " select seq_id, sum(en - st + 1)::bigint as masked from mg group by seq_id", DNA))
def a16(spark, d):
    return I.masked_width(I.merge_ranges(_clipped(spark, d)[0], "seq_id"), "seq_id")


@query("K1_runs_of_n", sql(", c as (select seq_id, s, unnest(range(1, length(s) + 1)) as i from dna where contains(s, 'N')), n as (select seq_id, i, i - row_number() over (partition by seq_id order by i) as g from c where substr(s, i, 1) = 'N') select seq_id, min(i)::int as start, max(i)::int as \"end\" from n group by seq_id, g", DNA))
def k1(spark, d):
    return I.letter_runs(dna(spark, d), "seq_id", "s", "N+")


@query("M23_mask_motif", sql(', ' + _hits_sql("h", "TATA") + ', r as (select subject_id as seq_id, start as st, "end" as en from h)' + _MERGED + ' select seq_id as subject_id, st::int as start, en::int as "end" from mg where en - st + 1 >= 6', DNA))
def m23(spark, d):
    return I.mask_motif(M.match_pattern(dna(spark, d), "seq_id", "s", "TATA"), 6)


@query("K4_intersect_masks", sql(', ' + _hits_sql("h", "TTT") + ', r as (select subject_id as seq_id, start as st, "end" as en from h)' + _MERGED + ', x as (select seq_id, st, en from mg), ' + _hits_sql("h2", "TAT") + """,
 o2 as (select subject_id as seq_id, start as st, "end" as en, max("end") over (partition by subject_id order by start rows between unbounded preceding and 1 preceding) as m from h2),
 g2 as (select *, sum(case when m is null or st > m + 1 then 1 else 0 end) over (partition by seq_id order by st rows unbounded preceding) as i from o2), y as (select seq_id, min(st) as st, max(en) as en from g2 group by seq_id, i)
 select x.seq_id as subject_id, greatest(x.st, y.st)::int as start, least(x.en, y.en)::int as "end" from x join y on x.seq_id = y.seq_id and x.st <= y.en and y.st <= x.en""", DNA))
def k4(spark, d):
    x = dna(spark, d)
    a, b = (I.mask_motif(M.match_pattern(x, "seq_id", "s", p)) for p in ("TTT", "TAT"))
    return I.combine_masks(a, b, "subject_id", "intersect")
