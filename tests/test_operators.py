"""Dictionaries, intervals, comparison, k-mers and alignments: small fixtures and brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import alignment as AL, compare as C, dictionary as D, intervals as I, kmers as K, matching as M
from helixframe.operators.independence import independence_test, upper_gamma


def rows(df):
    return sorted(map(tuple, df.collect()))


def seqs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "seq_id long, s string").selectExpr("*", "'x' as subject_id", "'x' as start", "'x' as id")


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(11)
    subjects = ["".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "A", "ACGT" * 30_000]
    patterns = ["".join(rng.choices("ACGT", k=rng.randint(6, 9))) for _ in range(20)]
    patterns += [s[3:11] for s in subjects[:20] if s and len(s) > 12 and "N" not in s[3:11]] + [patterns[0], None, ""]
    return subjects, patterns


def brute(subjects, patterns, k, band=None):
    out = set()
    for i, p in enumerate(patterns, 1):
        for j, s in enumerate(subjects, 1):
            if not p or s is None or len(s) > 1000:
                continue
            for a in range(1 - len(p), len(s) + 1):
                hit = [1 <= a + x <= len(s) and s[a + x - 1] == c for x, c in enumerate(p)]
                if len(p) - sum(hit) <= k and (band is None or all(hit[band[0] - 1:band[0] - 1 + band[1]])):
                    out.add((i, j, a, a + len(p) - 1))
    return out


@pytest.mark.parametrize("k,banded", [(0, False), (1, False), (2, False), (1, True)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_dictionary(spark, fixture, monkeypatch, k, banded, broadcast):
    if not broadcast:
        monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    subjects, patterns = fixture
    d = spark.createDataFrame([(i, p, 2, 4) for i, p in enumerate(patterns, 1)], "pattern_id long, pattern string, tb_start int, tb_width int")
    band = ("tb_start", "tb_width") if banded else (None, None)
    short = seqs(spark, [s if s is None or len(s) < 1000 else "" for s in subjects])
    got = rows(D.match_dictionary(d, short, "seq_id", "s", k, *band))
    assert len(got) == len(set(got)) and set(got) == brute(subjects, patterns, k, (2, 4) if banded else None)


@pytest.mark.parametrize("broadcast", [True, False])
def test_dictionary_of_wide_and_ambiguous_patterns(spark, monkeypatch, broadcast):
    """Any width; ambiguity letters stand for themselves or for their bases; in a trusted band they are an error."""
    if not broadcast:
        monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    rng = random.Random(12)
    subjects = ["".join(rng.choices("ACGT", k=120)) for _ in range(12)] + ["ACGNT" * 8, "", None]
    wide = [s[10:45] for s in subjects[:5]] + [subjects[5][:80], "ACG" + subjects[6][3:38]]
    odd = [subjects[7][:20] + "N" + subjects[7][21:36], "R" + subjects[8][1:30], "ACGNTACGN"]
    d = spark.createDataFrame(list(enumerate(wide + odd, 1)), "pattern_id long, pattern string")
    x = seqs(spark, subjects)
    from helixframe.kernels.matching import match_hamming

    for k, fixed in ((0, (True, True)), (1, (True, True)), (2, (True, True)), (0, (False, True))):
        want = sorted((i, j, a, a + len(p) - 1) for i, p in enumerate(wide + odd, 1) for j, s in enumerate(subjects, 1) if s is not None for a in match_hamming(p, s, k, 0, fixed))
        assert rows(D.match_dictionary(d, x, "seq_id", "s", k, fixed=fixed)) == want and want
    banded = d.selectExpr("pattern_id", "pattern", "2 as a", "20 as w")
    with pytest.raises(Exception, match="trusted band"):
        D.match_dictionary(banded, x, "seq_id", "s", 1, "a", "w").collect()
    flanks = banded.where("pattern_id not in (8, 10)")
    assert {r["pattern_id"] for r in D.match_dictionary(flanks, x, "seq_id", "s", 1, "a", "w", fixed=(False, True)).collect()} == {1, 2, 3, 4, 5, 6, 9}
    views = spark.createDataFrame([(1, 5, 60), (2, 12, 60)], "subject_id long, start int, end int")
    assert rows(D.match_dictionary(d, x, "seq_id", "s", ranges=views)) == [(1, 1, 11, 45)]


def test_dictionary_with_indels_and_ambiguous_subjects(spark):
    from helixframe.kernels.matching import match_hamming, match_indels

    subjects, patterns = ["ACGTTACGNNT", "TTTACGACG", "", None], ["ACG", "ACT", "GTN"]
    d = spark.createDataFrame(list(enumerate(patterns, 1)), "pattern_id long, pattern string")
    want = sorted((i, j, *m) for i, p in enumerate(patterns, 1) for j, s in enumerate(subjects, 1) if s for m in match_indels(p, s, 1))
    assert rows(D.match_dictionary(d, seqs(spark, subjects), "seq_id", "s", 1, indels=True)) == want
    want = sorted((i, j, a, a + 2) for i, p in enumerate(patterns, 1) for j, s in enumerate(subjects, 1) if s for a in match_hamming(p, s, 0, 0, (False, False)))
    assert rows(D.match_dictionary(d, seqs(spark, subjects), "seq_id", "s", fixed=(False, False))) == want


def test_dictionary_examples_and_empty(spark):
    words = spark.createDataFrame(list(enumerate(("AA", "AT", "TA", "TT"), 1)), "pattern_id long, pattern string")
    m = D.match_dictionary(words, seqs(spark, ["ATTATTAATTAA"]), "seq_id", "s")
    starts = {p: sorted(r.start for r in m.where(F.col("pattern_id") == p).collect()) for p in range(1, 5)}
    assert starts == {1: [7, 11], 2: [1, 4, 8], 3: [3, 6, 10], 4: [2, 5, 9]}
    assert rows(D.which_patterns(m)) == [(1, [1, 2, 3, 4])]
    assert rows(D.match_dictionary(words.where("false"), seqs(spark, ["A"]), "seq_id", "s")) == []
    p = spark.createDataFrame([(1, "acgt"), (2, "gt"), (3, "cgt"), (4, "ac")], "pattern_id long, p string").select("pattern_id", F.upper("p").alias("pattern"), F.lit(1).alias("a"), F.lit(2).alias("w"))
    for k, want in ((0, {4: 2}), (1, {1: 1, 3: 2, 4: 2}), (2, {1: 2, 3: 2, 4: 2})):
        hits = D.match_dictionary(p, seqs(spark, ["ACGGACCG"]), "seq_id", "s", k, "a", "w")
        assert dict((r[0], r[1]) for r in hits.groupBy("pattern_id").count().collect()) == want


def test_left_right_pairs(spark):
    for text, gaps in (("AAATTAACCCTT", {0: [(2, 5)], 1: [(1, 5), (2, 5)], 3: [(1, 5), (2, 5), (6, 12)], 7: [(1, 5), (2, 5), (2, 12), (6, 12)]}),):
        x = seqs(spark, [text])
        left, right = M.match_pattern(x, "seq_id", "s", "AA"), M.match_pattern(x, "seq_id", "s", "TT")
        for g, want in gaps.items():
            assert sorted((r.start, r.end) for r in M.lr_pairs(left, right, g).collect()) == sorted(want)


def test_probe_pairs(spark):
    s = spark.createDataFrame([(1, 3), (1, 5), (1, 20)], "subject_id long, start int")
    e = spark.createDataFrame([(1, 2), (1, 9), (1, 12), (1, 30)], "subject_id long, end int")
    assert rows(M.probe_pairs(s, e)) == [(1, 5, 9), (1, 20, 30)]


@pytest.mark.parametrize("core", [7, 50])
def test_tiles_find_every_hit_once(spark, fixture, core):
    x = seqs(spark, [s for s in fixture[0] if s is None or len(s) < 1000])
    assert rows(M.match_pattern(x, "seq_id", "s", "AC", tile=core)) == rows(M.match_pattern(x, "seq_id", "s", "AC"))
    for k in (1, 2):
        assert rows(M.match_pattern(x, "seq_id", "s", "ACGT", k, tile=core)) == rows(M.match_pattern(x, "seq_id", "s", "ACGT", k))


def test_views_and_masked_subjects(spark):
    """Each view is searched for itself; of a masked subject, what the mask leaves."""
    x = seqs(spark, ["ACGTACGTACGT", None, "ACG"])
    views = spark.createDataFrame([(1, 1, 3), (1, 2, 8), (1, 10, 99), (3, -4, 2), (3, 9, 12)], "subject_id long, start int, end int")
    assert rows(M.match_pattern(x, "seq_id", "s", "AC", ranges=views)) == [(1, 1, 2), (1, 5, 6), (3, 1, 2)]
    assert rows(M.match_pattern(x, "seq_id", "s", "ACG", 1, ranges=views.where("start = 10"))) == [(1, 9, 11)]
    lengths = x.where("s is not null").selectExpr("seq_id as subject_id", "length(s) as length")
    mask = spark.createDataFrame([(1, 4, 6)], "subject_id long, start int, end int")
    left = I.gaps(mask, lengths, "subject_id")
    assert rows(M.match_pattern(x, "seq_id", "s", "GT", ranges=left)) == [(1, 7, 8), (1, 11, 12)]
    from helixframe.kernels.matching import find_palindromes

    want = sorted((1, a + 1, z + 1) for a, z in find_palindromes("CGTACGT", min_arm=2))
    assert rows(M.palindromes(x, "seq_id", "s", ranges=views.where("start = 2"), min_arm=2)) == want and want


def test_edits_at(spark):
    from helixframe.kernels.matching import edits_at

    rng = random.Random(6)
    texts = ["".join(rng.choices("ACGT", k=rng.randint(0, 14))) for _ in range(40)]
    for p in ("ACG", "GATTACA"):
        got = {(r[0], r[1]): r[2] for r in M.edits_at(seqs(spark, [*texts, None]), "seq_id", "s", p, [-2, 1, 4, 30]).collect()}
        assert got == {(i, at): edits_at(p, s, at) for i, s in enumerate(texts, 1) for at in (-2, 1, 4, 30)}
        back = {(r[0], r[1]): r[2] for r in M.edits_at(seqs(spark, texts), "seq_id", "s", p, [5, 1], ending=True).collect()}
        assert back == {(i, at): edits_at(p[::-1], s[::-1], len(s) - at + 1) for i, s in enumerate(texts, 1) for at in (5, 1)}


def test_linear_in_the_length(spark):
    """One text of a million letters takes about a second in each of these, whatever the operator."""
    import time

    from helixframe.functions import counting as CC, transforms as T

    one = spark.range(1).select(F.lit(1).cast("long").alias("seq_id"), F.repeat(F.lit("ACGTTGCAAC"), 100_000).alias("s")).cache()
    one.count()
    work = {
        "starts": one.select(CC.match_starts("GTTGC", "s").alias("v")), "codons": one.select(T.codons("s").alias("v")), "aa": one.select(T.translate_codons("s").alias("v")),
        "prefix": one.select(CC.common_prefix("s", F.concat("s", F.lit("A"))).alias("v")), "arm": one.select(CC.palindrome_arm_length(F.concat("s", T.reverse_complement("s"))).alias("v")),
        "kmers": K.kmers(one, "seq_id", "s", 8), "places": M.match_pattern(one, "seq_id", "s", "GTTGC"), "mm": M.match_pattern(one, "seq_id", "s", "GTTGCAACAC", 1),
    }
    for name, df in work.items():
        df.write.format("noop").mode("overwrite").save()
        t = time.time()
        df.write.format("noop").mode("overwrite").save()
        assert time.time() - t < 10, name


def test_matching_odd_cases(spark):
    x = seqs(spark, [None, "", "ACGT", "ACGT"])
    assert rows(M.count_matches(x, "seq_id", "s", "CG")) == [(1, None), (2, 0), (3, 1), (4, 1)]
    assert rows(M.count_matches(x, "seq_id", "s", "CC", 1)) == [(1, None), (2, 0), (3, 2), (4, 2)]
    assert rows(M.match_pattern(x, "seq_id", "s", "CG")) == [(3, 2, 3), (4, 2, 3)]
    assert rows(M.palindromes(x, "seq_id", "s", min_arm=2)) == [(3, 1, 4), (4, 1, 4)]
    assert rows(M.match_pwm(x.where("false"), "seq_id", "s", np.eye(4))) == []
    odd = seqs(spark, ["éAAA", "AA", "A", "AéA"])
    assert rows(M.match_pattern(odd, "seq_id", "s", "AA")) == [(1, 2, 3), (1, 3, 4), (2, 1, 2)]
    with pytest.raises(ValueError):
        M.match_pattern(x, "seq_id", "s", "")


@pytest.mark.parametrize("options", [dict(min_arm=2), dict(min_arm=2, max_loop=6), dict(min_arm=3, max_loop=4, min_loop=1, wobble=True)])
def test_palindromes_of_a_batch(spark, fixture, options):
    from helixframe.kernels.matching import find_palindromes

    texts = [s for s in fixture[0] if s is None or len(s) < 1000]
    want = sorted((i, a, z) for i, s in enumerate(texts, 1) if s for a, z in find_palindromes(s, **options))
    assert rows(M.palindromes(seqs(spark, texts), "seq_id", "s", **options)) == want


def test_intervals(spark):
    r = spark.createDataFrame([(1, 2, 4), (1, 4, 6), (1, 7, 8), (1, 11, 12), (1, 5, 4), (2, -3, 2), (2, 9, 20)], "k int, start int, end int")
    assert rows(I.merge_ranges(r, "k")) == [(1, 2, 8), (1, 11, 12), (2, -3, 2), (2, 9, 20)]
    n = spark.createDataFrame([(1, 14), (2, 10), (3, 5)], "k int, length int")
    clipped = I.merge_ranges(I.restrict(r, n, "k"), "k")
    assert rows(clipped) == [(1, 2, 8), (1, 11, 12), (2, 1, 2), (2, 9, 10)]
    assert rows(I.gaps(clipped, n, "k")) == [(1, 1, 1), (1, 9, 10), (1, 13, 14), (2, 3, 8), (3, 1, 5)]
    assert rows(I.coverage(r.where("k = 1"), "k")) == [(1, 2, 3, 1), (1, 4, 4, 2), (1, 5, 8, 1), (1, 11, 12, 1)]
    assert rows(I.combine_masks(clipped.where("k = 1"), clipped.where("k = 2"), "k")) == rows(clipped)
    x = spark.createDataFrame([(1, "NNACNNNGN"), (2, "AC"), (3, None), (4, "")], "id int, s string")
    assert rows(I.letter_runs(x, "id", "s", "N+")) == [(1, 1, 2), (1, 5, 7), (1, 9, 9)]
    hits = M.match_pattern(spark.createDataFrame([(1, "AABBAACC")], "id long, s string"), "id", "s", "BB")
    assert rows(I.mask_motif(hits)) == [(1, 3, 4)] and rows(I.mask_motif(hits, 3)) == []


def test_comparison(spark):
    a = spark.createDataFrame([(3, "TA"), (1, "AC"), (2, "AC"), (4, "N"), (5, "M"), (6, "")], "id long, s string")
    b = spark.createDataFrame([(9, "AC"), (8, "AC"), (7, "G")], "id long, s string")
    assert rows(C.order(a, "id", "s")) == [(1, 2), (2, 3), (3, 5), (4, 6), (5, 4), (6, 1)]
    assert rows(C.rank(a, "id", "s")) == [(1, 2), (2, 2), (3, 5), (4, 6), (5, 4), (6, 1)]
    assert rows(C.duplicated(a, "id", "s")) == [(1, False), (2, True), (3, False), (4, False), (5, False), (6, False)]
    assert rows(C.match(a.where("id < 4"), b, "id", "s")) == [(1, 8), (2, 8), (3, None)]
    assert rows(C.setdiff(a, b, "s")) == [("",), ("M",), ("N",), ("TA",)] and rows(C.intersect(a, b, "s")) == [("AC",)]
    assert rows(C.setequal(a, a, "s")) == [(True,)] and rows(C.setequal(a, b, "s")) == [(False,)]
    assert rows(C.order(a.where("false"), "id", "s")) == []


def test_kmers(spark, fixture):
    x = seqs(spark, [s for s in fixture[0] if s is None or len(s) < 1000])
    for k, step in ((1, 1), (3, 2), (11, 1)):
        slow = K.kmers(x, "seq_id", "s", k, step).groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("n"))
        fast = K.oligo_frequency(x, "seq_id", "s", k, step)
        assert rows(fast) == rows(slow)
        assert rows(K.oligo_frequency_collapsed(x, "seq_id", "s", k, step, zeros=False)) == rows(slow.groupBy("kmer").agg(F.sum("n")))
    assert len(rows(K.oligo_frequency(x, "seq_id", "s", 2, zeros=True))) == 16 * x.count()
    assert K.oligo_frequency_collapsed(x.where("false"), "seq_id", "s", 2).agg(F.sum("n")).collect()[0][0] == 0
    brute_n = sorted((i, a + 1, sum(c in "GC" for c in s[a:a + 5])) for i, s in enumerate([s for s in fixture[0] if s is None or len(s) < 1000], 1) if s for a in range(len(s) - 4))
    assert rows(K.sliding_letter_frequency(x, "seq_id", "s", 5, "GC")) == brute_n
    sizes = spark.createDataFrame([(5,), (5,), (3,), (2,), (None,), (1,)], "n long")
    assert rows(K.n50(sizes, "n")) == [(5,)]


def test_consensus(spark):
    x = spark.createDataFrame([("ATGC",), ("ATTC",), (None,), ("",)], "s string")
    assert "".join(r.letter for r in K.consensus_string(K.consensus_matrix(x, "s")).orderBy("pos").collect()) == "ATKC"
    assert "".join(r.letter for r in K.consensus_string(K.consensus_matrix(x, "s"), 0.6, ambiguity=False).orderBy("pos").collect()) == "AT?C"
    two = spark.createDataFrame([("ACGT", "ACGA"), ("A", "AA"), (None, "A")], "a string, b string")
    assert rows(K.two_way_frequency(two, "a", "b")) == [("A", "A", 1), ("C", "C", 1), ("G", "G", 1), ("T", "A", 1)]


def test_alignment(spark):
    a = spark.createDataFrame([(1, "A", "AC-GT--A"), (2, "B", "AC-GA--C"), (3, "C", "AT-GTAAG")], "row_id int, name string, seq string")
    text = lambda df: "".join(r.letter for r in df.orderBy("pos").collect())
    assert text(AL.masked_consensus(a)) == "AY-GW--V"
    mask = spark.createDataFrame([(2, 3)], "start int, end int")
    assert text(AL.masked_consensus(a, spark.createDataFrame([(3,)], "row_id int"), mask)) == "A##GW--M"
    assert rows(AL.mask_gaps(a, 0.5, 1)) == [(3, 3), (6, 7)] and rows(AL.mask_gaps(a, 0.5, 2)) == [(6, 7)]
    assert rows(AL.unmasked_columns(a, mask)) == [(1, 1), (4, 8)]


def test_independence():
    assert abs(upper_gamma(0.5, 3.841458820694124 / 2) - 0.05) < 1e-9 and abs(upper_gamma(2, 0.1) - (1.1 * np.exp(-0.1))) < 1e-12
    value, df, p = independence_test(np.array([[10, 20, 0], [20, 10, 0], [0, 0, 0]]))
    assert abs(value - 20 / 3) < 1e-9 and df == 1 and abs(p - 0.009823275) < 1e-7
    assert independence_test(np.zeros((4, 4))) == (0.0, 0, 1.0)
    assert 0 < independence_test(np.array([[5, 9], [8, 4]]), "adjG", simulate=200)[2] <= 1


def test_shares_and_other_letters(spark):
    x = seqs(spark, ["ACGN", "AC", "A-G", None, ""])
    got = {(r["pos"], r["letter"]): round(r["n"], 6) for r in K.consensus_matrix(x, "s", base_only=True, as_prob=True).collect()}
    assert got == {(1, "A"): 1.0, (2, "C"): round(2 / 3, 6), (2, "other"): round(1 / 3, 6), (3, "G"): 1.0, (4, "other"): 1.0}
    assert {r["kmer"]: round(r["n"], 6) for r in K.oligo_frequency_collapsed(x, "seq_id", "s", 2, zeros=False, as_prob=True).collect()} == {"AC": round(2 / 3, 6), "CG": round(1 / 3, 6)}
    assert K.oligo_frequency(x, "seq_id", "s", 2, zeros=True).count() == 5 * 16


def test_unsorted_and_mask_shares(spark):
    a = spark.createDataFrame([(i, "ACGT"[i // 300] * 3) for i in range(1000)], "id long, s string")
    assert rows(C.is_unsorted(a, "id", "s")) == [(False,)] and rows(C.is_unsorted(a.where("false"), "id", "s")) == [(False,)]
    assert rows(C.is_unsorted(a.unionByName(spark.createDataFrame([(2000, "AAA")], "id long, s string")), "id", "s")) == [(True,)]
    n = spark.createDataFrame([(1, 10), (2, 4), (3, 0)], "k int, length int")
    mask = spark.createDataFrame([(1, 2, 4), (1, 9, 10)], "k int, start int, end int")
    assert rows(I.masked_ratio(mask, n, "k")) == [(1, 0.5), (2, 0.0), (3, None)]
    assert rows(I.invert_mask(mask, n, "k")) == [(1, 1, 1), (1, 5, 8), (2, 1, 4)]
