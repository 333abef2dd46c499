"""Problem 7: evaluation texts inside training texts, by suffix arrays over shards of the corpus.

A shard holds the words (or, for items in Chinese, the characters) of some whole documents as one array of integers: all
stretches of units that occur in items and are long enough for a match, with a separator that matches nothing after each. Its suffix array is made by prefix doubling, up to a depth that covers the
least match. Every suffix of every item is then binary-searched in every shard: the range of corpus suffixes that share
its first `least` units gives the documents, and extending a match on both texts gives the longest verbatim match.

The items go to every shard, by a broadcast of at most ITEM_CHARS characters; larger sets of items are searched in
blocks of about that size, each with its own scan of the documents. A worker makes the table of item suffixes, of 4 bytes
for each unit, once. The documents never leave their partition, and a document lies in one shard only, so there is no
shuffle.

Defined results: case, punctuation, symbols and white space are ignored, words are runs of letters and digits; null, empty
and short texts match nothing; a document given twice is reported twice under its two ids; an item given twice likewise;
empty tables give no rows; other columns are ignored. Items are matched by characters if their lang is zh in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.session import spread, staged, work_dir

LEAST_WORDS = 12
LEAST_CHARS = 24
#: Characters of the items of one block, about; an item that alone is longer is a block of its own.
ITEM_CHARS = 2_000_000
#: Units of a shard, but for one document that alone is longer.
SHARD_UNITS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[\W_]+")


_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


def words_of(text: str) -> list[str]:
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text.casefold())


def chars_of(text: str) -> str:
    return _OTHER.sub("", text.casefold())


def suffix_array(units: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their first `depth` units at least (ties by position)."""
    n = len(units)
    rank = np.unique(units, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth:
        after = np.full(n, -1, dtype=np.int64)
        after[: n - width] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        width *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


def _bounds(units: np.ndarray, order: np.ndarray, flat: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each needle (flat[a : a + depth], a in at) the range of the suffix array whose suffixes begin with it: binary searches, all at once."""
    n = len(order)
    padded = np.concatenate((units, np.full(depth, -1, dtype=units.dtype)))
    found = []
    for right in (False, True):
        lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), n, dtype=np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            start = order[np.minimum(mid, n - 1)]
            sign, equal = np.zeros(len(at), dtype=np.int8), np.flatnonzero(open_)
            for d in range(depth):  # only those that agree so far
                sign[equal] = np.sign(padded[start[equal] + d] - flat[at[equal] + d])
                equal = equal[sign[equal] == 0]
                if not len(equal):
                    break
            go = open_ & ((sign < 0) | ((sign == 0) & right))
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        found.append(lo)
    return found[0], found[1]


class _Needles:
    """The items' suffixes of at least `least` units, with a vocabulary for the units that occur in items."""

    def __init__(self, items: list[tuple[int, list[str] | str]], least: int):
        self.least = least
        self.ids = {u: i + 1 for i, u in enumerate(sorted({u for _, units in items for u in units}))}
        self.items = [(item, np.array([self.ids[u] for u in units], dtype=np.int32)) for item, units in items]
        sizes = np.array([len(units) for _, units in items], dtype=np.int64)
        counts = np.maximum(sizes - least + 1, 0)
        item = np.repeat(np.arange(len(items)), counts)
        #: (number of the item, place in it) of each needle, and its place in all units.
        self.where = np.stack((item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)), axis=1)
        self.flat = np.concatenate([units for _, units in self.items])
        self.at = (np.cumsum(sizes) - sizes)[item] + self.where[:, 1]
        self.table = np.zeros(0x110000, dtype=np.int64)  # characters only
        for u, i in self.ids.items():
            if len(u) == 1:
                self.table[ord(u)] = i
        #: Every needle has a unit that is not ASCII, so a text in ASCII cannot match.
        other = np.concatenate(([0], np.cumsum([not u.isascii() for _, units in items for u in units])))
        self.never_ascii = bool((other[self.at + least] > other[self.at]).all())

    def encode(self, units: list[str] | str) -> np.ndarray:
        """Numbers of the vocabulary; 0: in no item."""
        if isinstance(units, str):
            return self.table[np.frombuffer(units.encode("utf-32-le", "replace"), dtype=np.uint32)]
        get = self.ids.get
        return np.array([get(u, 0) for u in units], dtype=np.int64)


def _search(docs: list[tuple[int, int, int, np.ndarray]], needles: _Needles) -> list[tuple[int, int, int, int, int]]:
    """(doc, item, matched, item_pos, doc_pos): the longest match of each pair in a shard of stretches (number of the document, its id, place, units)."""
    lengths = np.array([len(u) for *_, u in docs])
    number, place = np.array([d[0] for d in docs]), np.array([d[2] for d in docs])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    units = np.full(starts[-1], -2, dtype=np.int64)  # -2: separator
    for (*_, u), s in zip(docs, starts):
        units[s : s + len(u)] = u
    lo, hi = _bounds(units, order := suffix_array(units, needles.least), needles.flat, needles.at, needles.least)
    out = []
    hit = np.flatnonzero(hi > lo)
    for own in np.split(hit, np.flatnonzero(np.diff(needles.where[hit, 0])) + 1):  # item by item
        if not len(own):
            continue
        k, (s, n) = int(needles.where[own[0], 0]), (needles.where[own, 1], hi[own] - lo[own])
        s, p = np.repeat(s, n), order[np.repeat(lo[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        d = np.searchsorted(starts, p, side="right") - 1
        p = p - starts[d]
        # Needles that follow each other on one diagonal of a document are one match; the longest counts, the first of equals.
        by = np.lexsort((s, p - s, d))
        d, s, p = d[by], s[by], p[by]
        first = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] - s[1:] != p[:-1] - s[:-1]) | (s[1:] != s[:-1] + 1)))
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(s))) + needles.least - 1
        d, s, p = d[at], s[at], p[at] + place[d[at]]
        by = np.lexsort((p, s, -length, number[d]))
        d, s, p, length = d[by], s[by], p[by], length[by]
        one = np.concatenate(([True], number[d[1:]] != number[d[:-1]]))
        out += [(docs[i][1], needles.items[k][0], *m) for i, *m in zip(d[one].tolist(), length[one].tolist(), s[one].tolist(), p[one].tolist())]
    return out


def _scanner(items, least_words: int, least_chars: int, shard_units: int):
    """items: a broadcast of {"rows": [(item_id, lang, text)]}; a worker keeps what it makes of them for its later tasks."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "kinds" not in items.value:
            chars, words = [], []
            for item, lang, text in items.value["rows"]:
                (chars if lang == "zh" else words).append((item, chars_of(text) if lang == "zh" else words_of(text)))
            kinds = [(_Needles(own, least), cut) for own, least, cut in ((words, least_words, words_of), (chars, least_chars, chars_of)) if own]
            items.value["kinds"] = [(n, cut) for n, cut in kinds if len(n.where)]
        kinds = items.value["kinds"]
        shards: list[list[tuple[int, int, int, np.ndarray]]] = [[] for _ in kinds]
        sizes, number = [0] * len(kinds), 0

        def flush(i: int) -> Iterator[pd.DataFrame]:
            if shards[i]:
                rows = _search(shards[i], kinds[i][0])
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched", "item_pos", "doc_pos"])
            shards[i], sizes[i] = [], 0

        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                if not text:
                    continue
                for i, (needles, cut) in enumerate(kinds):
                    if needles.never_ascii and text.isascii():
                        continue
                    units = needles.encode(cut(text))
                    # A match lies in a stretch of units that occur in items; the others part the text, and short stretches match nothing.
                    breaks = np.flatnonzero(np.concatenate(([0], units, [0])) == 0)
                    long = np.flatnonzero(np.diff(breaks) > needles.least)
                    for a, b in zip(breaks[long].tolist(), (breaks[long + 1] - 1).tolist()):
                        shards[i].append((number, doc, a, units[a:b]))
                        sizes[i] += b - a + 1
                    if sizes[i] >= shard_units:
                        yield from flush(i)
                number += 1
        for i in range(len(kinds)):
            yield from flush(i)

    return scan


def find_matches(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS, shard_units: int = SHARD_UNITS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, matched, item_pos, doc_pos): each pair once, with the longest match in units and its places."""
    spark = documents.sparkSession
    docs = spread(documents.select("doc_id", "text"))
    known = items.filter(F.length("text") > 0).select("item_id", F.lower(F.coalesce("lang", F.lit(""))).alias("lang"), "text")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_chars))
    if blocks > 1:
        known = staged(known.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), f"{work_dir(spark)}/items", "block")
    found = None
    for block in range(blocks):
        own = known if blocks == 1 else known.filter(F.col("block") == block)
        rows = {"rows": [tuple(r) for r in own.select("item_id", "lang", "text").collect()]}
        part = docs.mapInPandas(_scanner(spark.sparkContext.broadcast(rows), least_words, least_chars, shard_units), "doc_id BIGINT, item_id BIGINT, matched INT, item_pos INT, doc_pos INT")
        found = part if found is None else found.unionAll(part)
    return found


def remove_leaked(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """The documents in which no item was found."""
    return documents.join(matches.select("doc_id").distinct(), "doc_id", "left_anti")
