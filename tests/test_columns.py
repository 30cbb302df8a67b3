"""Column functions: example values and null, empty and odd cases."""
import pytest
from pyspark.sql import functions as F

from helixframe import alphabets as A
from helixframe.functions import counting as C, quality as Q, transforms as T


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(expr.alias("v")).collect()[0]["v"]


def test_complement_and_case(spark):
    assert one(spark, T.reverse_complement("s"), s="ACGTMRWSYKVHDBN-") == "-NVHDBMRSWYKACGT"
    assert one(spark, T.chartr("s", "AA", "TC"), s="AAG") == "CCG"
    assert one(spark, T.letters_only("s"), s="ac 1ſ-ıßGt") == "ACGT"
    assert one(spark, T.complement("s"), s=None) is None
    assert one(spark, T.is_valid("s"), s="acgtn-") and not one(spark, T.is_valid("s"), s="ACZ")


def test_slices(spark):
    assert one(spark, T.subseq("s", start=-3), s="ABCDE") == "CDE"
    assert one(spark, T.subseq("s", end=-2, width=2), s="ABCDE") == "CD"
    assert one(spark, T.subseq("s", start=0, width=2, strict=False), s="ABCDE") is None
    with pytest.raises(Exception, match="outside"):
        one(spark, T.subseq("s", start=4, width=3), s="ABCDE")
    assert one(spark, T.subseq("s", start=1, width=3), s=None) is None
    assert one(spark, T.pad_and_clip("s", 3, 4, "<", ">"), s="ABCD") == "CD>>"
    assert one(spark, T.pad_and_clip("s", -8, 3, "<", ">"), s="ABCD") == "<<<"
    assert one(spark, T.pad_and_clip("s", 9, 3, "<", ">"), s="ABCD") == ">>>"
    assert one(spark, T.letter("s", [1, 9]), s="ABC") is None
    assert one(spark, T.codons("s"), s="ACGTTGA") == ["ACG", "TTG"] and one(spark, T.codons("s"), s="AC") == []
    assert one(spark, T.strsplit("s", "G"), s="ATGCATGC") == ["AT", "CAT", "C"]


def ranges(*rows):
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(w).alias("width"), F.lit(v).alias("value")) for a, w, v in rows])


def test_edits(spark):
    assert one(spark, T.replace_at("s", ranges((7, 0, "xx"), (1, 2, ""), (4, 1, "Q"))), s="ABCDEF") == "CQEFxx"
    with pytest.raises(Exception, match="overlap"):
        one(spark, T.replace_at("s", ranges((1, 3, ""), (2, 1, ""))), s="ABCDEF")
    at, new = F.array(*map(F.lit, range(1, 7))), F.array(*map(F.lit, "AAAMMM"))
    assert one(spark, T.replace_letter_at("s", at, new), s="RMWSYK") == "AAAMMM"
    assert one(spark, T.replace_letter_at("s", at, new, "merge"), s="RMWSYK") == "RMWVHN"
    assert one(spark, T.replace_letter_at("s", at, new, "skip"), s="RMWSYK") == "RMWSYK"
    with pytest.raises(Exception, match="extend"):
        one(spark, T.replace_letter_at("s", at, new, "error"), s="RMWSYK")


def test_translation(spark):
    t = lambda s, **k: one(spark, T.translate_codons("s", **k), s=s)
    assert t("TTGATATGGCCCTTATAA") == "MIWPL*" and t("TTGATATGGCCCTTATAA", no_init_codon=True) == "LIWPL*"
    assert t("TTYTTTTTC", if_fuzzy="solve") == "FFF" and t("TTYTTTTTC", if_fuzzy="X") == "XFF" and t("TTYTTTTTC", if_fuzzy="error.if.X") == "FFF"
    assert t("TTNTTYTTC", if_fuzzy="solve") == "XFF" and t("TTNTTYTTC", if_fuzzy="X") == "XXF"
    for mode in ("error", "error.if.X"):
        with pytest.raises(Exception, match="no amino acid"):
            t("TTNTTYTTC", if_fuzzy=mode)
    assert t("TGA", code="SGC1") == "W" and t("") == "" and t(None) is None and t("UUGAU+AA") == "MI"
    with pytest.raises(ValueError):
        A.genetic_code("Mitochondrial", full_search=True)
    assert A.genetic_code("Ciliate", full_search=True)[0]["TAA"] == "Q"
    assert A.merge_iupac("ACT") == "H" and len(A.genetic_code_table()) == 20


def test_counting(spark):
    s = "ATGCATGC.+Y"
    assert [one(spark, c, s=s) for c in C.letter_frequency("s", ["A", "GC", "T"])] == [2, 4, 2]
    assert one(spark, C.unique_letters("s"), s=s) == "ACGTY+."
    assert [one(spark, T.longest_consecutive("s", "A"), s=x) for x in ("AAACTGTGFG", "GGGAATT", "CCAAAAAAAAAATT", "", None)] == [3, 2, 10, 0, None]
    assert one(spark, C.match_starts("aa", "s"), s="XaaaYaa") == [2, 3, 6] and one(spark, C.match_starts("aa", "s"), s="a") == []
    assert one(spark, C.count_pattern("aa", "s"), s="XaaaYaa") == 3 and one(spark, C.count_pattern(".", "s"), s="a.b") == 1
    assert one(spark, C.count_pattern("GTN", "s", fixed=False), s="ACGTNMRWSYKVHDB") == 4
    assert one(spark, C.has_letter_at("s", "G", 9), s="ACG") is None
    assert one(spark, C.n_mismatch_at("AC", "s", F.lit(0)), s="CC") == 1 and one(spark, C.n_mismatch_at("AC", "s", F.lit(1)), s=None) is None
    assert one(spark, C.common_prefix("a", "b"), a="ACGT", b="ACTT") == 2 and one(spark, C.common_suffix("a", "b"), a="", b="A") == 0
    assert one(spark, C.palindrome_arm_length("s"), s="AACCTT") == 2


def test_order_is_by_code(spark):
    df = spark.createDataFrame([(x,) for x in A.DNA_ALPHABET], "s string")
    assert "".join(r["s"] for r in df.orderBy(C.order_key("s")).collect()) == "ACMGRSVTWYHKDBN-+."


@pytest.mark.parametrize("scale", list(Q.SCALES))
def test_quality_round_trip(spark, scale):
    off, low, high = Q.SCALES[scale]
    scores = list(range(max(low, 1), min(high, 93) + 1))
    df = spark.createDataFrame([(scores,)], "q array<int>")
    text = Q.encode_scores("q", scale)
    assert df.select(Q.scores(text, scale).alias("v")).collect()[0]["v"] == scores
    low_scores = [q for q in scores if q <= 60]
    df = spark.createDataFrame([(low_scores,)], "q array<int>")
    probs = Q.error_probabilities(Q.encode_scores("q", scale), scale)
    assert df.select(Q.scores(Q.encode_probabilities(probs, scale), scale).alias("v")).collect()[0]["v"] == low_scores
    assert one(spark, Q.scores("s", scale), s="") == [] and one(spark, Q.scores("s", scale), s=None) is None
    assert one(spark, Q.encode_scores(F.array(F.lit(500), F.lit(-500)), scale)) == chr(high + off) + chr(low + off)
