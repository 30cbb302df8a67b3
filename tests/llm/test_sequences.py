"""Splitting, word counts, shared spans and canonical duplicates against brute force."""
import random
import re
from collections import Counter, defaultdict

import pytest

from helixframe.llm import canonical_dups as C, shared_spans as S, splitting as P, term_counts as T

SCHEMA = "seq_id long, desc_line string, seq_data string"


def letters(s):
    return re.sub("[^A-Za-z]", "", s or "").upper()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = ["".join(rng.choice("ACGT") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    out, no = [], 0
    for _ in range(60):
        no += 1
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("ACGTN") for _ in range(rng.randint(10, 300))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            parts.insert(1, "N" * rng.randint(5, 30))
        s = "".join(parts)
        if rng.random() < 0.3:
            s = "\n".join(s[i:i + 60] for i in range(0, len(s), 60)).lower()
        out.append((no, f"Id{no % 7}, Chr {no % 3} ; direct|x-y", s))
    for i in range(40):  # copies of one record in other layouts
        no += 1
        d = ["A one", "b Two", "c"]
        rng.shuffle(d)
        out.append((no, rng.choice((", ", ";", " | ")).join(d) + rng.choice(("", " !", ",")), " ".join(pool[0][j:j + 10] for j in range(0, len(pool[0]), 10))))
    out += [(no + 1, None, None), (no + 2, None, ""), (no + 3, "", "12 34"), (no + 4, None, "ACGT"), (no + 5, "", "acgt"), (no + 6, "q", "ACGTTGCA" * 30000), (None, "z", pool[1])]
    return out


def test_split(spark, rows, clash):
    want = set()
    for i, _, s in rows:
        x = letters(s)
        if len(x) <= 500:
            continue
        ends = {m.end() for m in re.finditer("N{10,}", x)}
        a, no = 1, 1
        while len(x) - a + 1 > 500:
            e = max((g for g in ends if a + 20 <= g <= a + 499), default=a + 499)
            want.add((i, no, a, e))
            a, no = e - 19, no + 1
        want.add((i, no, a, len(x)))
    got = P.split_sequences(clash(spark.createDataFrame(rows, SCHEMA)), "seq_id", "seq_data", 500, 20, with_text=True).collect()
    assert {tuple(r)[:4] for r in got} == want
    whole = {i: letters(s) for i, _, s in rows}
    assert all(r.piece == whole[r.seq_id][r.start_pos - 1:r.end_pos] and len(r.piece) <= 500 for r in got)
    with pytest.raises(ValueError):
        P.split_sequences(spark.createDataFrame(rows, SCHEMA), "seq_id", "seq_data", 10, 10)


def test_packing_follows_the_tree():
    """Two scaffolds of three contigs; the second fits a piece by itself and isn't cut inside, though its first contig would fit the first piece."""
    contig = lambda n, gap: "A" * n + "N" * gap
    text = contig(200, 10) + contig(150, 10) + contig(180, 40) + contig(120, 10) + contig(160, 10) + contig(300, 40) + contig(100, 0)
    ends = [210, 370, 590, 720, 890, 1230, 1330]
    nested, flat = P.structure_tree(text, (40, 10)), P.structure_tree(text)
    assert [(n.start, n.end, [x.end for x in n.parts]) for n in nested.parts] == [(1, 590, [210, 370, 590]), (591, 1230, [720, 890, 1230]), (1231, 1330, [])]
    assert [n.end for n in flat.parts] == ends and not any(n.parts for n in flat.parts)
    assert P.pack(flat, 730, 20) == [(1, 720), (701, 1330)]
    assert P.pack(nested, 730, 20) == [(1, 590), (571, 1230), (1211, 1330)]  # the scaffolds stay whole
    assert P.pack(nested, 500, 20) == [(1, 370), (351, 720), (701, 890), (871, 1330)]  # too long for a piece: descended into, and the rest merged on
    assert P.pack(P.structure_tree("A" * 1000), 400, 50) == [(1, 400), (351, 750), (701, 1000)]
    deep = P.Node(1, 900, [P.Node(1, 800, [P.Node(1, 100), P.Node(101, 700, [P.Node(101, 350), P.Node(351, 700)]), P.Node(701, 800)]), P.Node(801, 900)])
    assert P.pack(deep, 400, 0) == [(1, 350), (351, 700), (701, 900)]


def test_flat_packing_equals_the_rule_for_any_text():
    rng = random.Random(8)
    for _ in range(400):
        x = "".join(rng.choice("ACGT") * rng.randint(1, 90) + "N" * rng.choice((0, 3, 5, 9, 30)) for _ in range(rng.randint(1, 25)))
        limit = rng.randint(40, 400)
        overlap = rng.randint(0, limit // 2)
        ends = {m.end() for m in re.finditer("N{5,}", x)}
        want, a = [], 1
        while len(x) - a + 1 > limit:
            e = max((g for g in ends if a + overlap <= g <= a + limit - 1), default=a + limit - 1)
            want.append((a, e))
            a = e - overlap + 1
        want.append((a, len(x)))
        assert P.pack(P.structure_tree(x, (5,)), limit, overlap) == want


def test_split_empty(spark):
    assert P.split_sequences(spark.createDataFrame([], SCHEMA), "seq_id", "seq_data").collect() == []


@pytest.mark.parametrize("k", [1, 5, 8, 31])
def test_term_counts(spark, rows, clash, k):
    tf, df = Counter(), Counter()
    for _, _, s in rows:
        x = letters(s)
        words = [x[i:i + k] for i in range(len(x) - k + 1) if not set(x[i:i + k]) - set("ACGT")]
        tf.update(words)
        df.update(set(words))
    d = clash(spark.createDataFrame(rows, SCHEMA))
    got = {r.word: (r.tf, r.df) for r in T.term_counts(d, "seq_data", k).collect()}
    assert got == {w: (tf[w], df[w]) for w in tf}
    marks = {r.word: r.mark for r in T.marked_terms(d, "seq_data", k).where("mark is not null").collect()}
    assert marks == {w: "rare" if df[w] < 3 else "common" for w in df if df[w] < 3 or df[w] > 0.2 * len(rows)}


def test_term_counts_heavy_and_light_agree(spark, rows, monkeypatch):
    d = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, T.term_counts(d, "seq_data").collect()))
    monkeypatch.setattr(T, "HEAVY_SHARE", 1.0)  # no heavy word
    assert sorted(map(tuple, T.term_counts(d, "seq_data").collect())) == want
    assert T.term_counts(spark.createDataFrame([], SCHEMA), "seq_data").collect() == []


@pytest.mark.parametrize("n", [7, 20, 31, 50, 130])
def test_shared_spans(spark, rows, clash, n):
    seqs = {i: letters(s) for i, _, s in rows if i is not None}
    holders = defaultdict(set)
    for i, x in seqs.items():
        for j in range(len(x) - n + 1):
            holders[x[j:j + n]].add(i)
    want = set()
    for i, x in seqs.items():
        covered = bytearray(b"0" * (len(x) + 1))
        for j in range(len(x) - n + 1):
            w = x[j:j + n]
            if len(holders[w]) > 1 and not set(w) - set("ACGT"):
                covered[j:j + n] = b"1" * n
        want |= {(i, m.start() + 1, m.end()) for m in re.finditer("1+", covered.decode())}
    got = [tuple(r) for r in S.shared_spans(clash(spark.createDataFrame(rows, SCHEMA)), "seq_id", "seq_data", n).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_levels_double():
    assert S.levels(50) == [25, 50] and S.levels(20) == [20] and S.levels(31) == [31]
    for n in range(1, 400):
        ls = S.levels(n)
        assert ls[-1] == n and ls[0] <= 31 and all(a < b <= 2 * a for a, b in zip(ls, ls[1:]))


def test_shared_spans_of_repeated_rows_and_copies(spark):
    rng = random.Random(5)
    text = "".join(rng.choices("ACGT", k=200))
    rows = [(1, text), (1, text), *((i, text) for i in range(10, 40)), (50, text[:49]), (51, "".join(rng.choices("ACGT", k=90)) + text[30:90])]
    got = sorted(map(tuple, S.shared_spans(spark.createDataFrame(rows, "seq_id long, seq_data string"), "seq_id", "seq_data").collect()))
    assert got == sorted([(1, 1, 200), (1, 1, 200), *((i, 1, 200) for i in range(10, 40)), (51, 91, 150)])


def test_shared_spans_empty(spark):
    assert S.shared_spans(spark.createDataFrame([], SCHEMA), "seq_id", "seq_data").collect() == []


def test_canonical_groups(spark, rows, clash):
    groups = defaultdict(list)
    for i, d, s in rows:
        if i is None or not letters(s):
            continue
        fields = [tuple(re.findall("[a-z0-9]+", p.lower())) for p in re.split("[,;|]", d or "")]
        groups[letters(s), tuple(sorted(f for f in fields if f))].append(i)
    want = {(i, min(g), len(g)) for g in groups.values() for i in g}
    df = clash(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r) for r in C.canonical_groups(df, "seq_id", C.record_key("desc_line", "seq_data")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_canonical_groups_same_hash_and_empty(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    key = C.record_key("desc_line", "seq_data")
    want = sorted(map(tuple, C.canonical_groups(df, "seq_id", key).collect()))
    monkeypatch.setattr(C.F, "xxhash64", lambda c: C.F.lit(7).cast("long"))  # every record is a possible repeat: the result stays
    assert sorted(map(tuple, C.canonical_groups(df, "seq_id", key).collect())) == want
    monkeypatch.undo()
    assert C.canonical_groups(spark.createDataFrame([], SCHEMA), "seq_id", key).collect() == []


def test_filter_flags_repeats_only_and_stays_small(spark):
    """Two million rows, one in a hundred repeated, a third of them with one key: exactly the repeats are flagged, at a few bytes a row."""
    from helixframe.llm.repeats import Replies, _blocks, numbered, repeated
    from helixframe.session import stored

    n = 2_000_000
    h = C.F.when(C.F.col("id") % 3 == 0, 5).when(C.F.col("id") % 100 == 1, C.F.col("id") - 1).otherwise(C.F.col("id"))
    rows = stored(numbered(spark.range(n).select(C.F.xxhash64(h).alias("h"))))
    blocks = rows.mapInArrow(_blocks(C._hashes, 4), "part int, p int, n int, entries binary")
    entries, size = blocks.selectExpr("sum(n)", "sum(length(entries))").first()
    assert entries < 0.68 * n and size < 13 * entries
    folder = repeated(rows, C._hashes)

    def flags(batches):
        replies = Replies(folder)
        for b in batches:
            got = sum(int(replies.has(p, C.np.asarray(b.column("h")).view(C.np.uint64)[r], C.np.zeros(len(r), C.np.uint32)).sum()) for p, r in C.by_task(b))
            yield C.pa.RecordBatch.from_pydict({"n": C.pa.array([got], C.pa.int64())})

    flagged = rows.mapInArrow(flags, "n long").agg({"n": "sum"}).first()[0]
    counts = rows.groupBy("h").count().where("count > 1").agg({"count": "sum"}).first()[0]
    assert flagged == counts
