"""Keyword-stuffed and link-list pages: phrases replicated on other hosts, joined with list density.

Each text is cut into segments at line ends and sentence ends.  A segment is

* a *sentence*: enough of its words are connectives, it ends as a sentence of different words does, or it is CJK text with its punctuation;
* *exempt*: reference signs, citations, formulas, sequence listings, which by the problem's statement are no lists even if they stand alone;
* a *list* part: links, price offers, hash tags, menus, comma lists or repeated phrases;
* *open*: words without connectives and without any of these marks (it may be a
  keyword string, or prose of a language too rare in the corpus to show its connectives).

Connectives aren't listed anywhere: they are the words of the corpus that hardly ever stand last before a mark or line end and
that no single word follows most of the time (``the``, ``der``, ``la``, not ``pump``, ``buy`` or the ``mixing`` of ``mixing chamber``).

Open parts count as list parts if most of their words are repeated on the page and they aren't *varied*: prose of any language
repeats its words too, but a good part of its vocabulary occurs only once.

List density alone flags nothing.  The shingles of ``PHRASE`` words of all list and open parts are exploded, and the distinct hosts of each counted over the whole
corpus; a phrase that stands on at least ``HOSTS`` hosts is replicated.  A page is flagged if list parts
make up more than ``SHARE`` of its characters and at least ``REPLICATED`` of its phrases are replicated elsewhere.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from helixframe.kernels.arrow import pieces
from helixframe.llm.near_dup import mix
from helixframe.operators.skew import join_groups
from helixframe.session import stored

SHARE = 0.45       # between a third and six tenths
PHRASE = 2         # words of a phrase; numbers count as one word
HOSTS = 2          # a phrase on so many hosts is replicated
REPLICATED = 0.25  # of a flagged page's phrases
REPEATED = 0.6     # open parts count as lists if more than this share of their words is repeated
SENTENCE_WORDS = (5, 40)  # words of a sentence of prose: the one that the middle word of the text stands in
VARIED = 0.25      # prose has at least this share of its vocabulary only once
FUNCTION_SHARE = 0.12
CONNECTIVES = 5000       # learned words at most
LAST_SHARE = 0.02        # of a connective's occurrences stand last
FOLLOWER_SHARE = 0.5     # and no more than this share is followed by one word
LEAST = 30               # occurrences from which a word is judged

PLAIN_SHARE = 0.25  # a line with so many function words and no mark of a list is prose as a whole

_TOKEN = re.compile(r"[^\W_]+")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")
_END = re.compile(r"[.!?;](?=\s)|[。！？；]")
_MARK = re.compile(r"[^\w\s'’/-]+")
_LINK = re.compile(r"https?://|www\.|<a href|\]\(|\b[\w-]+\.[a-z]{2,8}/\S")
_PRICE = re.compile(r"\d[.,]\d\d\s*(?:[A-Z]{3}\b|[€$£¥]|in stock|★|-\d+ ?%)")
_TAG = re.compile(r"(?:^|\s)#\w")
_MENU = re.compile(r"\s[|·»›>•/]\s")
_MARKS = ("/", "www.", "](", "★", "€", "|", "·", "»", "›", " > ", "•", "#")  # what any of these list marks begins with
_REFERENCE = re.compile(r"^\(?\d{1,4}[a-z]?\)?[\s:.,=–-]+[^\W\d_][^\n,;|·»#]{0,60}$")
_CITATION = re.compile(r"\b[A-Z]{2} ?\d{5,}\s?[A-Z]\d?\b")
_FORMULA = re.compile(r"[=^{}\\→⇌∑∫√]|\[Formula|\b[A-Z][a-z]?\s?\d\s")
_LISTING = re.compile(r"^<\d+>|^(?:[acgtun]{5,}[\s\d]*)+$|^(?:[A-Z][a-z]{2}\s)+[A-Z][a-z]{2}$")
_NUMBER = re.compile(r"\d+")

SENTENCE, EXEMPT, LIST, OPEN = range(4)


def _marked(text: str) -> bool:
    """Links, prices, tags or menus."""
    if any(m in text for m in _MARKS):
        if _LINK.search(text) or "★★" in text:
            return True
        if text.count("#") >= 2 and len(_TAG.findall(text)) >= 2 or len(_MENU.findall(text)) >= 2:
            return True
    return bool(_PRICE.search(text))


def _repeats(words: list[str]) -> bool:
    """The same phrases over and over."""
    return len(words) >= 6 and 2 * len(set(words)) <= len(words) and 2 * len(set(zip(words, words[1:]))) <= len(words) - 1


def kind_of(segment: str, connectives: frozenset[str]) -> int:
    """The kind of one segment (stripped, not empty)."""
    if _marked(segment):
        return LIST
    words = _TOKEN.findall(segment.lower())
    if not words:
        return EXEMPT
    if _repeats(words):
        return LIST
    if not segment.isascii() and len(_CJK.findall(segment)) >= 0.4 * len(segment):
        marks = sum(map(segment.count, "、,，|· "))
        return LIST if marks * 5 > len(segment) else SENTENCE
    if sum(map(connectives.__contains__, words)) >= FUNCTION_SHARE * len(words):
        return SENTENCE
    if segment[-1] in ".!?" and len(words) >= 8 and 10 * len(set(words)) >= 8 * len(words):
        return SENTENCE
    if _LISTING.search(segment) or _REFERENCE.search(segment) or _CITATION.search(segment) or _FORMULA.search(segment):
        return EXEMPT
    commas = segment.count(",")
    if commas >= 3 and commas * 5 >= len(words):
        return LIST
    return OPEN


def segments(text: str, connectives: frozenset[str]):
    """Lines, cut at sentence ends; a line of plain prose is left out as a whole."""
    for line in text.split("\n"):
        words = line.lower().split()
        if not words:
            continue
        if sum(map(connectives.__contains__, words)) >= PLAIN_SHARE * len(words) and not _repeats(words) and not _marked(line):
            continue
        at = 0
        for m in _END.finditer(line):
            if part := line[at:m.end()].strip():
                yield part
            at = m.end()
        if part := line[at:].strip():
            yield part


def _length(text: str) -> int:
    return len(text) - sum(map(text.count, " \n\t\r"))


def is_varied(opened: list[str], count: Counter) -> bool:
    """Prose by its vocabulary; fragments and strings of words without any punctuation aren't."""
    lengths = []
    for segment in opened:
        n = len(_TOKEN.findall(segment))
        lengths += [n] if n <= SENTENCE_WORDS[1] else [len(_TOKEN.findall(x)) for x in _MARK.split(segment)]
    lengths.sort()
    run, middle = 0, sum(lengths) / 2
    for n in lengths:
        run += n
        if run >= middle:
            return SENTENCE_WORDS[0] <= n <= SENTENCE_WORDS[1] and sum(k == 1 for k in count.values()) >= VARIED * len(count)
    return False


def profile(text: str, connectives: frozenset[str]) -> tuple[int, int, int, list[str]]:
    """(characters without blanks: all, in lists, in open parts that count as lists; distinct phrases of list and open parts)."""
    listed = opened = 0
    texts: list[str] = []
    phrases: set[str] = set()
    count: Counter = Counter()
    for segment in segments(text, connectives):
        kind = kind_of(segment, connectives)
        if kind not in (LIST, OPEN):
            continue
        words = _TOKEN.findall(segment.lower())
        if kind == LIST:
            listed += _length(segment)
        else:
            opened += _length(segment)
            texts.append(segment)
            count.update(words)
        words = [_NUMBER.sub("0", w) for w in words]
        phrases.update(" ".join(words[i:i + PHRASE]) for i in range(len(words) - PHRASE + 1))
    if opened and (sum(n for n in count.values() if n > 1) <= REPEATED * sum(count.values()) or is_varied(texts, count)):
        opened = 0
    return _length(text), listed, opened, sorted(phrases)


def _profiles(connectives):
    def run(batches):
        words = connectives.value
        for b in batches:
            out = [profile(t, words) for t in b.column("t").to_pylist()]
            cols = {"doc": b.column("doc"), "host": b.column("host")}
            cols |= {k: pa.array([x[i] for x in out], pa.int32()) for i, k in enumerate(("n_chars", "n_list", "n_open"))}
            cols["phrases"] = pa.array([x[3] for x in out], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(cols)

    return run


#: letters (any byte beyond ASCII is one), and what may stand between two words of one segment
_LETTER, _BETWEEN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_BETWEEN[48:58] = True
_BETWEEN[[9, 13, 32, 39, 45]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _followers(batches):
    """(word, next, n): how often each word is followed by each other (by its hash; 0 where a segment ends), counted over the task."""
    words: dict[int, str] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    powers = (np.ones(1, np.uint64),) * 2

    def summed():
        h, nxt, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((nxt, h))
        h, nxt, n = h[order], nxt[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (nxt[1:] != nxt[:-1])]))
        return h[at], nxt[at], np.add.reduceat(n, at)

    def emit(h, nxt, n):
        return pa.RecordBatch.from_arrays([pa.array([words[x] for x in h.tolist()], pa.string()), pa.array(nxt.view(np.int64)), pa.array(n)], ["word", "next", "n"])

    size = 0
    for b in batches:
        for _, data, offsets in pieces(pc.utf8_lower(b.column(0)), 1 << 19):
            if len(data) > len(powers[0]):
                powers = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), x, np.uint64)])) for x in (_BASE, _BACK))
            on = _LETTER[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            begin, stop = on.copy(), on.copy()
            begin[1:] &= ~on[:-1] | edge[1:-1]
            stop[:-1] &= ~on[1:] | edge[1:-1]
            starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            if not len(starts):
                continue
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * powers[0][:len(data)], dtype=np.uint64)])
            h = mix((sums[ends] - sums[starts]) * powers[1][starts]) | np.uint64(1)
            bad = np.concatenate([[0], np.cumsum(~on & ~_BETWEEN[data])])
            row = np.searchsorted(offsets, starts, side="right")
            nxt = np.zeros(len(h), np.uint64)
            joined = (bad[starts[1:]] == bad[ends[:-1]]) & (row[1:] == row[:-1])
            nxt[:-1][joined] = h[1:][joined]
            pair = mix(h * _BASE + nxt)
            _, first, n = np.unique(pair, return_index=True, return_counts=True)
            held.append((h[first], nxt[first], n))
            size += len(first)
            distinct, at = np.unique(h, return_index=True)
            for x, i in zip(distinct.tolist(), at.tolist()):
                if x not in words:
                    words[x] = data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace")
            if size > 2_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield emit(*held[0])
                    held, size = [], 0
                    words.clear()
    if held:
        yield emit(*summed())


def connectives(texts: DataFrame, text_col: str) -> frozenset[str]:
    """The connectives of a corpus, at most CONNECTIVES of them, the most frequent first.

    Pairs of neighbouring words are counted over all texts, combined before the shuffle; the end of a segment counts as a follower.
    """
    pairs = texts.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(_followers, "word string, next long, n long")
    counts = pairs.groupBy("word", "next").agg(F.sum("n").alias("n"))
    stats = counts.groupBy("word").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("next") == 0, F.col("n"))), F.lit(0)).alias("last"), F.max(F.when(F.col("next") != 0, F.col("n"))).alias("top"))
    kept = stats.where((F.col("n") >= LEAST) & (F.col("last") <= LAST_SHARE * F.col("n")) & (F.col("top") <= FOLLOWER_SHARE * F.col("n")))
    return frozenset(r[0] for r in kept.orderBy(F.desc("n"), "word").limit(CONNECTIVES).select("word").collect())


def spam_profile(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``(doc, list_share, replicated_share, is_spam)`` for every row with a text and an id.

    Defined results: null texts have no row; an empty or blank one is no spam; a
    null host counts as a host of its own; a repeated row counts once for the
    hosts and keeps its row; other columns are not carried, so none clash.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(host_col), F.concat(F.lit("row "), F.col(id_col).cast("string"))).alias("host"), F.col(text_col).alias("t")).where("doc is not null and t is not null")
    learned = spark.sparkContext.broadcast(connectives(src, "t"))
    pages = src.mapInArrow(_profiles(learned), "doc long, host string, n_chars int, n_list int, n_open int, phrases array<string>")
    hashed = F.transform("phrases", lambda p: F.xxhash64(p))
    pages = stored(pages.select(F.monotonically_increasing_id().alias("row"), "doc", F.xxhash64("host").alias("host"), ((F.col("n_list") + F.col("n_open")) / F.greatest("n_chars", F.lit(1))).alias("list_share"), hashed.alias("phrases")), "pages")
    by_host = pages.select("host", F.explode("phrases").alias("phrase")).groupBy("phrase", "host").agg(F.count(F.lit(1)).alias("n"))
    replicated = by_host.groupBy("phrase").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= HOSTS)
    dense = pages.where(F.col("list_share") > SHARE).select("row", F.explode("phrases").alias("phrase"))
    found = join_groups(dense, replicated.select("phrase", "n"), ["phrase"], "n").groupBy("row").agg(F.count(F.lit(1)).alias("found"))
    joined = pages.select("row", "doc", "list_share", F.size("phrases").alias("all")).join(found, "row", "left")
    share = F.coalesce(F.col("found") / F.greatest("all", F.lit(1)), F.lit(0.0))
    return joined.select("doc", "list_share", share.alias("replicated_share"), ((F.col("list_share") > SHARE) & (share >= REPLICATED)).alias("is_spam"))
