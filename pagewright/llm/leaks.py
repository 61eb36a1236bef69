"""Problem 9: find evaluation items that leaked into training texts, and remove them."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Words of an n-gram, and the part of an item's words that makes a leak.
GRAM, PART = 4, 0.6
#: Items up to which their n-grams go to every worker as a hash set; more are met by a join on the hash of the n-gram.
ITEMS_PER_PASS = 20_000
#: Bits of the filter that a larger table sends to every worker instead, whatever its size.
FILTER_BITS = 1 << 26
#: Part of an item's words that must stand intact and in order about a hit before the passage is aligned with slips
#: allowed. A leak has PART of the words; up to three in ten of those may be misspelled.
INTACT = 0.42

_WORD = re.compile(r"[^\W_]+")
_DROP = re.compile(r"[.,'’`´](?:(?<=\w['’`´])(?=\w)|(?<=\d[.,])(?=\d))")
_ACCENTS = {c: unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(0xC0, 0x250)}
_ACCENTS |= {ord("ß"): "ss", ord("œ"): "oe", ord("æ"): "ae", ord("ø"): "o", ord("ł"): "l"}


def words(text: str) -> list[tuple[str, int, int]]:
    """(normalised word, start, end) in the text: no case, accents or punctuation; marks inside words and numbers go."""
    out = []
    for m in re.finditer(r"[^\W_]+(?:(?:['’`´]|(?<=\d)[.,](?=\d))[^\W_]+)*", text):
        w = _DROP.sub("", m.group()).lower().translate(_ACCENTS)
        if w:
            out.append((w, m.start(), m.end()))
    return out


def plain_words(text: str) -> list[str]:
    """The words of `words` without positions, for the fast scan."""
    t = _DROP.sub("", text).lower()
    for c in () if t.isascii() else set(t):
        if (plain := _ACCENTS.get(ord(c))) is not None:
            t = t.replace(c, plain)
    return _WORD.findall(t)


def close(a: str, b: str) -> bool:
    """One slip apart (two for long words): a letter missing, added, changed, or two exchanged."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4 or a.isdigit() or b.isdigit():
        return False
    if a[0] != b[0] and a[-1] != b[-1]:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return len(x) <= 1 and len(y) <= 1 or len(x) == len(y) == 2 and x == y[::-1]


def align(item: list[str], doc: list[str]) -> tuple[int, int, int]:
    """(matched, first, last): the best local alignment of the item's words in order with one stretch of doc.

    A match counts 1; a word skipped on either side costs 0.34, so short accidental matches far from the passage
    never pay for the gap to it. doc words one slip from an item word count as that word.
    """
    vocab = set(item)
    long = [w for w in vocab if len(w) >= 4]
    fixed: dict[str, str] = {}
    for w in set(doc) - vocab:
        if len(w) >= 4 and not w.isdigit() and (hit := next((v for v in long if close(v, w)), None)):
            fixed[w] = hit
    at = defaultdict(list)
    for i, w in enumerate(item):
        at[w].append(i)
    m = len(item)
    gap = 0.34
    # cells hold (score, matched, first doc word); only the row before is kept
    score, count, first = [0.0] * (m + 1), [0] * (m + 1), [-1] * (m + 1)
    best = (0.0, 0, -1, -1)
    for d, w in enumerate(doc):
        hits = set(at.get(fixed.get(w, w), ()))
        new_s, new_c, new_f = [0.0] * (m + 1), [0] * (m + 1), [-1] * (m + 1)
        for i in range(1, m + 1):
            s, c, f = 0.0, 0, -1
            if i - 1 in hits:
                s, c, f = score[i - 1] + 1, count[i - 1] + 1, first[i - 1] if first[i - 1] >= 0 else d
            if (v := score[i] - gap) > s:
                s, c, f = v, count[i], first[i]
            if (v := new_s[i - 1] - gap) > s:
                s, c, f = v, new_c[i - 1], new_f[i - 1]
            new_s[i], new_c[i], new_f[i] = s, c, f
            if s > best[0]:
                best = (s, c, f, d)
        score, count, first = new_s, new_c, new_f
    return best[1], best[2], best[3]


def places(item: list[str]) -> dict[str, int]:
    """Where each word stands in the item, as the bits of a number."""
    out: dict[str, int] = {}
    for k, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << k
    return out


def in_order(at: dict[str, int], m: int, doc: list[str]) -> int:
    """Length of the longest common subsequence of an item of m words and doc, all places of the item at once (bit-parallel)."""
    ones = (1 << m) - 1
    v = ones
    for w in doc:
        if u := v & at.get(w, 0):
            v = ((v + u) | (v - u)) & ones
    return m - v.bit_count()


class Items:
    """Normalised items and the set of their n-grams."""

    def __init__(self, rows: Iterable[tuple[int, str]]):
        self.items = [(i, w) for i, w in ((i, [w for w, _, _ in words(t)]) for i, t in sorted(rows)) if w]
        self.places = [places(w) for _, w in self.items]
        self.grams: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for j, (_, w) in enumerate(self.items):
            for k, g in enumerate(grams(w)):
                self.grams[g].append((j, k))
        self.lengths = sorted({len(g) for g in self.grams})
        self.keys = set(self.grams)

    def scan(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, part of its words found, first and last character of the passage) for each item in the text."""
        w = plain_words(text)
        met = [self.keys.intersection(zip(*(w[k:] for k in range(n)))) for n in self.lengths]
        if not any(met):
            return []
        hits = defaultdict(list)
        for n, some in zip(self.lengths, met):
            for d, g in enumerate(zip(*(w[k:] for k in range(n)))) if some else ():
                if g in some:
                    for j, k in self.grams[g]:
                        hits[j].append(d - k)
        full: list[tuple[str, int, int]] = []  # where the words stand, worked out for texts with a passage
        out: dict[int, tuple[float, int, int]] = {}
        for j, shifts in hits.items():
            i, item = self.items[j]
            m = len(item)
            shifts.sort()
            best = None
            # hits whose shift is close belong to one passage; a passage is aligned once
            a = 0
            tried: list[tuple[int, int]] = []
            for b in range(len(shifts)):
                while shifts[b] - shifts[a] > max(6, m // 4):
                    a += 1
                if b + 1 < len(shifts) and shifts[b + 1] - shifts[a] <= max(6, m // 4):
                    continue
                lo, hi = max(0, shifts[a] - m // 5 - 3), min(len(w), shifts[b] + m + m // 5 + 3)
                if any(x <= lo and hi <= y for x, y in tried):
                    continue
                tried.append((lo, hi))
                if in_order(self.places[j], m, w[lo:hi]) < INTACT * m:
                    continue
                if not full:
                    full = words(text)
                got, f, z = align(item, [x for x, _, _ in full[lo:hi]])
                if got and (best is None or got > best[0]):
                    best = (got, full[lo + f][1], full[lo + z][2])
            if best and best[0] >= PART * m - 1e-9 and best[0] / m > out.get(i, (0.0,))[0]:
                out[i] = (best[0] / m, best[1], best[2])
        return [(i, *x) for i, x in out.items()]


def grams(w: list[str]) -> list[tuple[str, ...]]:
    """The n-grams of the words; all of them as one if there are fewer than GRAM."""
    n = min(GRAM, len(w))
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if n else []


def code(gram: tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest(" ".join(gram)) - (1 << 63)


HIT = "doc_id long, item_id long, part double, first int, last int"


def _few(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Every text against the hash set of all items, which is broadcast and built once in a worker."""
    shared = documents.sparkSession.sparkContext.broadcast([[(r["item_id"], r["text"]) for r in rows.collect()]])

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = shared.value
        if len(state) == 1:
            state.append(Items(state[0]))
        known = state[1]
        for pdf in batches:
            got = [(d, *hit) for d, t in zip(pdf["doc_id"], pdf["text"]) for hit in known.scan(t)]
            yield pd.DataFrame(got, columns=["doc_id", "item_id", "part", "first", "last"])

    return documents.mapInPandas(scan, HIT)


def _many(documents: DataFrame, rows: DataFrame, bits: int) -> DataFrame:
    """One pass over the texts with a filter of fixed size; what passes it meets the n-grams of the items in a join."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "items")

    def of_items(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for r, t in zip(pdf["row"], pdf["text"]):
                w = plain_words(t)
                got += [(r, len(w), g) for g in {code(g) for g in grams(w)}]
            yield pd.DataFrame(got, columns=["row", "m", "gram"])

    known = cut(rows.select("row", "text").mapInPandas(of_items, "row long, m int, gram long"), "grams")
    lengths = [r["m"] for r in known.select(F.least("m", F.lit(GRAM)).alias("m")).distinct().collect()]  # 1 to GRAM
    word = known.select(F.pmod("gram", F.lit(bits)).alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("set"))
    filled = np.zeros(-(-bits // 64), dtype=np.int64)  # at most bits / 64 rows are collected
    for r in word.toLocalIterator():
        filled[r["at"]] = r["set"]
    shared = documents.sparkSession.sparkContext.broadcast(filled)

    def of_texts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        has = shared.value
        for pdf in batches:
            got = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                w = plain_words(t)
                for n in lengths:
                    codes = np.array([code(g) for g in zip(*(w[k:] for k in range(n)))], dtype=np.int64)
                    at = codes % bits
                    for c in set(codes[(has[at >> 6] >> (at & 63)) & 1 == 1].tolist()):
                        got.append((d, c))
            yield pd.DataFrame(got, columns=["doc_id", "gram"])

    hits = cut(documents.mapInPandas(of_texts, "doc_id long, gram long").distinct(), "hits")
    pairs = hits.join(known.select("gram", "row"), "gram").select("doc_id", "row").distinct()
    pairs = cut(pairs, "pairs").join(rows, "row").select("doc_id", "item_id", F.col("text").alias("item"))
    both = cut(pairs.join(documents.select("doc_id", "text"), "doc_id"), "candidates")

    def verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(d, *hit) for d, i, x, t in zip(pdf["doc_id"], pdf["item_id"], pdf["item"], pdf["text"]) for hit in Items([(i, x)]).scan(t)]
            yield pd.DataFrame(got, columns=["doc_id", "item_id", "part", "first", "last"])

    return both.mapInPandas(verify, HIT)


def leaks(documents: DataFrame, items: DataFrame, most: int | None = None, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, part, first, last): every item of which at least PART of the words stand in one passage of a text.

    Up to `most` items (ITEMS_PER_PASS) the corpus is only read: no shuffle, the items go to the tasks as a hash set of normalised n-grams,
    and just the windows that hit it are aligned. More items than that are never held by a worker: the n-grams of the
    texts that pass a filter of `bits` bits meet those of the items in a join, and the pairs found are aligned alike. Null
    texts hold nothing; an item without words is never found; copies of a text are each reported; of several passages of
    one item, or several texts under one item_id, the fullest is given.
    """
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    if rows.count() <= (ITEMS_PER_PASS if most is None else most):
        return _few(docs, rows)
    got = _many(docs, rows, bits).withColumn("s", F.struct("part", "first", "last"))
    return got.groupBy("doc_id", "item_id").agg(F.max("s").alias("s")).select("doc_id", "item_id", "s.*")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def cleaned(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, spans, n_chars, text): the affected documents with the leaked passages taken out."""
    spans = leaks(documents, items).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("s"))

    def remove(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, t, s in zip(pdf["doc_id"], pdf["text"], pdf["s"]):
                kept, at = [], 0
                for x in s:
                    kept.append(t[at : max(at, x["first"])])
                    at = max(at, x["last"])
                t = "".join([*kept, t[at:]])
                out.append((d, len(s), len(t), t))
            yield pd.DataFrame(out, columns=["doc_id", "spans", "n_chars", "text"])

    both = documents.where("text is not null").select("doc_id", "text").join(spans, "doc_id")
    return both.mapInPandas(remove, "doc_id long, spans int, n_chars int, text string")
