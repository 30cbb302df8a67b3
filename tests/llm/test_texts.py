"""Encoding, leaks and spam."""
import os
import random
import re

import pytest

from helixframe.llm import bpe as B, leakage as L, page_spam as G

WEIRD = [
    None, "", " ", "a   b", "a \n\n  b", "  lead", " trail ", "\x1c x\x1dy", " a  b", "tab\t\tx  \n y", "it's we'LL", "½ ² ٣ é ​ x", "a" * 5000, "\x85x \x0b y", "<|endoftext|>",
    "如图6所示,转轴102穿过法兰147。", "nul\0in text", " \n", "word " * 20000, "A/cm² ± 3 %. [0001] The lower", "﻿x", "🙂🙂 👩‍👩‍👧 é",
]
needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(B.VOCABULARY, "byte_bpe_50k.tiktoken")), reason="no vocabulary")


@needs_vocabulary
def test_encoding_equals_the_library_and_round_trips(spark, clash):
    import tiktoken

    ranks = B.read_ranks(os.path.join(B.VOCABULARY, "byte_bpe_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = clash(spark.createDataFrame(list(enumerate(WEIRD)), "doc_id long, text string"))
    got = {r["doc_id"]: r["ids"] for r in B.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {i: ref.encode_ordinary(t) if t else [] for i, t in enumerate(WEIRD)}
    back = {v: k for k, v in ranks.items()}
    assert all(b"".join(back[x] for x in got[i]).decode() == (t or "") for i, t in enumerate(WEIRD))
    assert B.encode_corpus(df.where("false"), "doc_id", "text").collect() == []


@needs_vocabulary
def test_replay_equals_word_by_word():
    ranks = B.read_ranks(os.path.join(B.VOCABULARY, "byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéxyz ") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)]
    assert B.replay_merges(words, ranks) == [B.replay_merges([w], ranks)[0] for w in words]


@needs_vocabulary
def test_small_cache_and_any_table_change_nothing(monkeypatch):
    path = os.path.join(B.VOCABULARY, "byte_bpe_50k.tiktoken")
    e = B.Encoder(path)
    want = [e.encode([t]).to_pylist() for t in WEIRD]
    names = ["x", "word", "\0a", "lead", ""]
    ids = e.ids_of(["a" if c == "\0a" else " " + c for c in names])
    table = (names, B.np.array([i for x in ids for i in x], B.np.int32), B.np.concatenate([[0], B.np.cumsum([len(x) for x in ids])]))
    monkeypatch.setattr(B, "CACHE_BYTES", 300)
    monkeypatch.setattr(B, "CHUNK_BYTES", 4)
    for given in (None, table):
        e = B.Encoder(path, given)
        assert [e.encode([t]).to_pylist() for t in WEIRD] == want
        assert e.encode(WEIRD).to_pylist() == [x[0] for x in want]


@needs_vocabulary
def test_memory_is_bounded_by_bytes():
    path = os.path.join(B.VOCABULARY, "byte_bpe_50k.tiktoken")
    e = B.Encoder(path)
    for i in range(20):  # texts that can't be cut are not kept
        e.encode([f"a \n \n b{i} " + "xyz " * 5000])
    assert sum(map(len, e.chunk_no)) + 4 * len(e.flat) < 10_000 and sum(map(len, e.words)) < 10_000


@needs_vocabulary
def test_table_holds_the_frequent_chunks(spark, monkeypatch):
    path = os.path.join(B.VOCABULARY, "byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([("the pump " * 9,), ("the valve valve",), (None,), ("a  b",)], "t string")
    monkeypatch.setattr(B, "TABLE_ROWS", 2)
    names, flat, starts = B.corpus_table(df, path)
    assert names == ["pump", "the"] and list(B.np.diff(starts)) == [1, 1] and len(flat) == 2


def shingles(t, n=12):
    w = [x.lower() for x in re.findall("[A-Za-z0-9]+", t or "")]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def leak_fixture():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(5, 40))) for i in range(40)] + [(40, None), (41, ""), (42, "one two"), (None, text(20))]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 50)) for _ in range(3)]
        if rng.random() < 0.6:
            own = (rng.choice(items[:40])[1]).split()
            cut = rng.randrange(len(own))
            parts.insert(1, ", ".join(own[cut:cut + rng.randint(8, 20)]).upper())
        docs.append((i, " …\n".join(parts)))
    docs += [(60, None), (61, ""), (62, text(200_000)), (62, items[3][1]), (None, items[5][1]), (63, items[3][1].replace(" ", "é"))]
    return docs, items


@pytest.mark.parametrize("bits", [1 << 27, 1 << 10])
def test_leaks_equal_brute_force(spark, clash, monkeypatch, bits):
    monkeypatch.setattr(L, "GATE_BITS", bits)  # with the small one the filter is full
    docs, items = leak_fixture()
    items += [(7, items[7][1]), (8, items[9][1]), *((100 + i, items[i][1]) for i in range(20))]  # repeated ids, with the same and another text; items that share all passages
    sets, texts = {}, {}
    for i, t in items:
        if i is not None and (s := shingles(t)):
            sets[i] = sets.get(i, set()) | s
    for d, t in docs:
        if d is not None:
            texts[d] = texts.get(d, set()) | shingles(t)
    want = {(d, i, len(x), len(x) / len(s)) for d, t in texts.items() for i, s in sets.items() if (x := s & t)}
    dd = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    ii = clash(spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(r) for r in L.leaked_items(dd, "doc_id", "text", ii, "item_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert L.leaked_items(dd.where("false"), "doc_id", "text", ii.where("false"), "item_id", "text").collect() == []


def test_leaks_of_many_items_read_the_documents_once(spark, tmp_path):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(8000)]  # 232,000 passages
    docs = [(i, " ".join(rng.choices(words, k=30)) + " " + items[i * 31 % 8000][1][:80]) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    dd = spark.read.parquet(str(tmp_path / "docs"))
    ii = spark.createDataFrame(items, "item_id long, text string")
    df = L.leaked_items(dd, "doc_id", "text", ii, "item_id", "text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    where = {}
    for i, t in items:
        for s in shingles(t):
            where.setdefault(s, set()).add(i)
    want = {(d, i) for d, t in docs for s in shingles(t) for i in where.get(s, ())}
    assert {(r["doc"], r["item"]) for r in df.collect()} == want and want


PROSE = "The lower recess has a pressure of about 3 bar. During operation the piston is arranged below the sealing ring until the flow rate falls. "
POLISH = "Budynek stoi obok rzeki, przez którą prowadzi stary kamienny most zbudowany dawno temu.\nMieszkańcy chętnie spacerują tamtędy wieczorami latem.\n"
PAGES = {
    1: (PROSE * 10, False),
    2: ("\n".join(f"cheap pump valve shop XX-{i} {i}.99 EUR" for i in range(40)), True),
    3: ("\n".join(f"https://pump.example/valve?id={i}" for i in range(40)), True),
    4: ("buy pump cheap, best valve offer, pump sale online, valve discount, " * 12, True),
    5: (" | ".join(["Home", "Login", "Sitemap", "Next page", "Tags: pump sale"] * 20), True),
    6: (" ".join(f"#pump_valve_{i}" for i in range(60)), True),
    7: ("\n".join(f"{i} threaded insert" for i in range(10, 60)), False),
    8: ("Citations: XA 6337584 A1; XC 4711618 B2; XB 7281834 A1; " * 10, False),
    9: ("\n".join("<210> 14" if i % 5 == 0 else "acgtacgtac ggttaaccgg 60" for i in range(40)), False),
    10: ("如图6所示,转轴102穿过法兰147。由此减少密封面66的磨损。" * 10, False),
    11: (PROSE * 8 + "\nbuy pump, best valve, pump sale, cheap valve", False),
    12: ("Pump price valve. Valve cheap pump. Price pump sale. Cheap sale valve. " * 10, True),
    13: (POLISH, False),
    14: (None, None), 15: ("", False), 16: (" \n\t ", False),
    17: ("buy buy pump\n" * 20000, True),
}


CORPUS = [(1000 + i, PROSE * 4, f"host{i}") for i in range(12)]  # shows what the connectives are


def test_spam(spark, clash):
    rows = [(i, t, None if i % 3 else f"host{i % 5}") for i, (t, _) in PAGES.items()] + [(2, PAGES[2][0], "host1"), (None, PAGES[2][0], "host1")]
    rows += [(100 + i, t, "elsewhere") for i, (t, _) in PAGES.items()] + CORPUS
    df = clash(spark.createDataFrame(rows, "doc_id long, text string, applicant string"))
    got = G.spam_profile(df, "doc_id", "text", "applicant").collect()
    flags = {r["doc"]: r["is_spam"] for r in got}
    want = {i: spam for i, (_, spam) in PAGES.items() if spam is not None}
    assert {i: flags[i] for i in want} == want and {i: flags[100 + i] for i in want} == want
    assert not any(flags[i] for i, _, _ in CORPUS) and len(got) == 33 + len(CORPUS)
    assert G.spam_profile(df.where("false"), "doc_id", "text", "applicant").collect() == []


def test_phrases_that_no_other_host_has_flag_nothing(spark):
    rows = [(i, t, "one host") for i, (t, _) in PAGES.items()] + [(i, t, "one host") for i, t, _ in CORPUS]
    df = spark.createDataFrame(rows, "doc_id long, text string, applicant string")
    assert not [r["doc"] for r in G.spam_profile(df, "doc_id", "text", "applicant").collect() if r["is_spam"]]


def test_connectives_are_learned(spark):
    df = spark.createDataFrame([(t,) for _, t, _ in CORPUS] + [("buy pump, best pump, pump of steel, mixing chamber, " * 20,)], "t string")
    got = G.connectives(df, "t")
    assert "the" in got and not got & {"pump", "buy", "mixing", "chamber", "recess", "falls"}


def test_prose_that_repeats_its_words_and_headings_are_no_spam(spark):
    prose = ("Talo rakennettiin joen rannalle. Joen vesi virtasi talo vieressä hitaasti. Vanha talo seisoi joen rannalle rakennetun sillan vieressä. "
             "Sillan vieressä virtasi hitaasti joen vesi. Talo seisoi vieressä, vesi virtasi hitaasti sillan alla. Kylän lapset juoksivat sillan yli talo vieressä. "
             "Lapset seisoi joen rannalle. Illalla vesi virtasi hitaasti, lapset seisoi sillan vieressä. ")
    rows = [(1, prose, "h1"), (9, prose, "h9"), *((i, "BESCHREIBUNG", f"h{i}") for i in range(2, 8))]
    df = spark.createDataFrame(rows, "doc_id long, text string, applicant string")
    assert not [r["doc"] for r in G.spam_profile(df, "doc_id", "text", "applicant").collect() if r["is_spam"]]
