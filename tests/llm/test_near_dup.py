import random
from itertools import combinations

from helixframe.llm import near_dup as N


def windows(s, k=8):
    s = (s or "").upper()
    return {s[i:i + k] for i in range(len(s) - k + 1)}


def brute(rows, threshold=0.5, least=30):
    sets = {i: w for i, s in rows if i is not None and len(w := windows(s)) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 3)):
        at, kind = rng.randrange(len(s)), rng.random()
        if kind < 0.5:
            s[at] = rng.choice("ACGT")
        elif kind < 0.75:
            s.insert(at, rng.choice("ACGT"))
        else:
            del s[at]
    s = "".join(s)
    if rng.random() < 0.2:
        cut = rng.randrange(20, len(s) - 20)
        s = s[cut:] + s[:cut]
    return s.lower() if rng.random() < 0.2 else s


def fixture():
    rng = random.Random(7)
    adapter = "".join(rng.choice("ACGT") for _ in range(24))
    rows, no = [], 0
    for _ in range(120):
        base = "".join(rng.choice("ACGT") for _ in range(rng.choice((60, 90, 120))))
        if rng.random() < 0.3:
            base += adapter
        for _ in range(rng.choice((1, 1, 2, 4))):
            no += 1
            rows.append((no, edited(rng, base)))
    hot = "".join(rng.choice("ACGT") for _ in range(100))
    for i in range(60):  # one text and its near copies: a third of all rows
        no += 1
        rows.append((no, hot if i % 2 else edited(rng, hot)))
    rows += [(no + 1, None), (no + 2, ""), (no + 3, "ACGT"), (no + 4, "A" * 200), (None, hot), (no + 5, "N" * 90), (no + 6, "ACGTN" * 20000), (no + 7, "é" * 50 + hot)]
    return rows


def found(spark, rows, clash):
    df = clash(spark.createDataFrame(rows, "seq_id long, seq_data string"))
    pairs, members = N.near_duplicates(df, "seq_id", "seq_data")
    return [tuple(r) for r in N.expand_pairs(pairs, members).collect()]


def test_pairs_equal_brute_force(spark, clash):
    rows = fixture()
    got = found(spark, rows, clash)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_repeated_row_and_empty_table(spark, clash):
    text = "".join(random.Random(1).choices("ACGT", k=80))
    assert set(found(spark, [(1, text), (1, text), (2, text)], clash)) == {(1, 2)}
    assert found(spark, [], clash) == []


def test_moved_parts_beside_a_frequent_adapter(spark, clash):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    adapter = text(30)
    rows = []
    for i in range(0, 52, 2):  # so few that the adapter is frequent, but not with a letter before it
        parts = [text(15) for _ in range(3)]
        rows += [(i, "".join(parts) + adapter), (i + 1, "".join(parts[::-1]) + adapter)]
    want = brute(rows)
    assert len(want) >= 26
    assert set(found(spark, rows, clash)) == want


def test_letters_beyond_ascii_differ(spark, clash):
    rng = random.Random(13)
    base = "".join(rng.choices("ACGT", k=80))
    other = "".join("\u0100" if i % 3 == 0 else c for i, c in enumerate(base))
    rows = [(1, other), (2, other.replace("\u0100", "\u0180")), (3, other[5:]), (4, base), (5, base[:60] + "\u0100" * 9), (6, "".join(map(chr, range(0x1000, 0x1040))))]
    rows.append((7, rows[5][1][4:]))
    want = brute(rows)
    assert (1, 3) in want and (4, 5) in want and (6, 7) in want and (1, 2) not in want
    assert set(found(spark, rows, clash)) == want


def test_code_points_that_are_equal_mod_127(spark, clash):
    text = "".join(random.Random(17).choices("ACGT\u0102", k=90))
    rows = [(1, text), (2, text.replace("\u0102", "\u0181"))]
    assert (0x102 - 0x181) % 127 == 0
    assert brute(rows) == set() and found(spark, rows, clash) == []


def _met(spark, texts, n_parts=4):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    bits, hot = N.hot_windows(rows.select("seq"))
    entries = rows.mapInArrow(N._anchors(8 * n_parts, 22, bits, hot, N.SKETCH), "bucket int, entries binary")
    return bits, hot, entries.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(N._meet, "a long, b long")


def test_a_dense_family_meets_a_few_times_a_pair(spark):
    """A third of the records are edits of one text, with some 20 anchors in common: a pair meets at those behind a difference only."""
    rng = random.Random(23)
    base = "".join(rng.choices("ACGT", k=150))
    family = set()
    while len(family) < 400:
        x = list(base)
        for _ in range(rng.randint(1, 3)):
            x[rng.randrange(150)] = rng.choice("ACGT")
        family.add("".join(x))
    texts = sorted(family) + ["".join(rng.choices("ACGT", k=150)) for _ in range(800)]
    true = len(brute(list(enumerate(texts))))
    _, _, met = _met(spark, texts)
    assert true > 50_000 and met.count() < 7 * true and met.distinct().count() >= true


def test_unrelated_long_texts_are_not_hot(spark):
    rng = random.Random(29)
    texts = ["".join(rng.choices("ACGT", k=3000)) for _ in range(3000)]
    bits, hot, _ = _met(spark, texts)
    assert bits == 25 and sum(map(len, hot.values())) < 100
