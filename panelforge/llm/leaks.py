"""Evaluation texts leaking into training text (problem 6).

Every run of ``m`` neighbouring words of a test item is a test string. A Wu-Manber search over the word sequence of each
document finds all occurrences: a shift table over blocks of two words skips positions where no test string can end,
a bucket over the hash of the words in the window selects the strings to try, and comparing the words confirms. Items
with enough occurrences in a document are then aligned: runs of equal words are chained in the order of item and document
across small gaps, and a dense chain that spans half of the item's words is a leak.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
HYPHEN_BREAK = re.compile(r"(?<=\w)[-‐‑¬]\s*\n\s*(?=\w)")
#: Apostrophes and hyphens within words, and separators within numbers: spelled in many ways or left out.
JOINT = re.compile(r"['’ʼ`‐‑-](?<=\w.)(?=\w)|[,.](?<=\d.)(?=\d{3}(?!\d))")
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


@dataclass(frozen=True)
class LeakRules:
    """``m`` words make a test string; an item is aligned when its occurrences cover ``try_share`` of it; runs of at
    least ``run`` equal words are chained over at most ``item_gap`` and ``doc_gap`` skipped words. A leak is a chain that
    spans ``share`` of the item's words, holds ``dense`` of those between its ends (redactions and interruptions hide the
    rest) and one run of ``dense_run`` words; or that holds ``share`` of the item's words, ``loose`` of those between its ends and
    one run of ``loose_run``. A chain holds ``least_words``, or the whole item where that is shorter. Texts that share stock
    phrases only make chains with many gaps and short runs."""

    m: int = 4
    try_share: float = 0.4
    run: int = 3
    item_gap: int = 8
    doc_gap: int = 16
    share: float = 0.5
    least_words: int = 6
    dense: float = 0.8
    dense_run: int = 4
    loose: float = 0.75
    loose_run: int = 6


def words_of(text: str | None) -> list[str]:
    """Words without regard to case, typography, invisible characters and hyphenation at line ends."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(INVISIBLE)
    if "\n" in text:
        text = HYPHEN_BREAK.sub("", text)
    text = JOINT.sub("", text)
    return WORD.findall(text.casefold())


class Searcher:
    """The tables of a multi-pattern search for one block of items."""

    def __init__(self, items: list[tuple], rules: LeakRules):
        self.rules, m = rules, rules.m
        self.ids: dict[str, int] = {}
        self.item_ids = [i for i, _ in items]
        self.items = [np.array([self.ids.setdefault(w, len(self.ids)) for w in words_of(t)], np.int64) for _, t in items]
        self.sizes = np.array([len(x) for x in self.items])
        self.v = len(self.ids) + 1
        self.mark = np.zeros(self.v, bool)  # the last place stands for words of no item
        # items too short for a test string are compared whole
        self.short = {n: [k for k, size in enumerate(self.sizes) if size == n] for n in range(rules.run, m) if (self.sizes == n).any()}
        windows = [(np.lib.stride_tricks.sliding_window_view(x, m), k) for k, x in enumerate(self.items) if len(x) >= m]
        rows = np.concatenate([w for w, _ in windows]) if windows else np.zeros((0, m), np.int64)
        owner = np.concatenate([np.full(len(w), k) for w, k in windows]) if windows else np.zeros(0, np.int64)
        offset = np.concatenate([np.arange(len(w)) for w, _ in windows]) if windows else np.zeros(0, np.int64)
        self.patterns, inverse = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        order = np.argsort(inverse.ravel(), kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        self.first = np.searchsorted(inverse.ravel()[order], np.arange(len(self.patterns) + 1))
        # SHIFT: how far the window may move when a block of two words ends it
        bits = 20
        self.mask = np.int64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - 1, np.int8)
        for end in range(1, m):
            np.minimum.at(self.shift, self._block(self.patterns[:, end - 1], self.patterns[:, end]), m - 1 - end)
        key = self._hash(self.patterns)
        order = np.argsort(key, kind="stable")
        self.bucket_key, self.bucket = key[order], order
        self.longest = int((np.searchsorted(self.bucket_key, self.bucket_key, "right") - np.searchsorted(self.bucket_key, self.bucket_key, "left")).max()) if len(key) else 0

    def _block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a + 1) * np.int64(1_000_003) + (b + 1) * np.int64(7_919)) & self.mask

    def _hash(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), np.int64)
        for k in range(windows.shape[1]):
            out = (out * np.int64(1_000_003) + windows[:, k] + 1) & np.int64((1 << 40) - 1)
        return out

    def occurrences(self, text: np.ndarray, stripe: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in ``text`` (word ids, -1 for words of no item).

        The text is cut into stripes whose cursors advance together, each by the shift of its own block.
        """
        m, n = self.rules.m, len(text)
        if n < m or not len(self.patterns):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cursor = np.arange(m - 1, n, stripe)
        limit = np.minimum(cursor + stripe, n)
        ends = []
        while len(cursor):
            a, b = text[cursor - 1], text[cursor]
            step = np.where(b < 0, m - 1, self.shift[self._block(a, b)]).astype(np.int64)
            step[b < 0] = m
            hit = step == 0
            if hit.any():
                ends.append(cursor[hit])
            cursor = cursor + np.maximum(step, 1)
            alive = cursor < limit
            cursor, limit = cursor[alive], limit[alive]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.concatenate(ends) - (m - 1)
        window = text[start[:, None] + np.arange(m)]
        key = self._hash(window)
        at = np.searchsorted(self.bucket_key, key)
        found_start, found_pattern = [], []
        for k in range(self.longest):
            there = at + k < len(self.bucket_key)
            idx = np.where(there, at + k, 0)
            ok = there & (self.bucket_key[idx] == key)
            if not ok.any():
                break
            pattern = self.bucket[idx[ok]]
            same = (self.patterns[pattern] == window[ok]).all(1)
            found_start.append(start[ok][same])
            found_pattern.append(pattern[same])
        if not found_start:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_start), np.concatenate(found_pattern)

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(index of text, index of item) of every leak."""
        get = self.ids.get
        parts, bounds, total = [], [0], 0
        for t in texts:
            own = np.fromiter((get(w, -1) for w in words_of(t)), np.int64)
            parts.append(own)
            parts.append(np.array([-1]))
            total += len(own) + 1
            bounds.append(total)
        text = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bounds = np.array(bounds)
        out = self._whole(text, bounds)
        start, pattern = self.occurrences(text)
        if not len(start):
            return out
        doc = np.searchsorted(bounds, start, "right") - 1
        # each occurrence stands for one position in each item that has the string
        n = self.first[pattern + 1] - self.first[pattern]
        which = np.repeat(np.arange(len(start)), n)
        slot = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[pattern], n)
        item, at = self.owner[slot], self.offset[slot]
        longest = int(self.sizes.max()) + 1
        code = np.unique((doc[which] * len(self.items) + item) * longest + at)
        group, at = code // longest, code % longest
        gap = np.full(len(code), self.rules.m)
        gap[:-1] = np.where(group[1:] == group[:-1], np.minimum(at[1:] - at[:-1], self.rules.m), self.rules.m)
        groups, first = np.unique(group, return_index=True)
        covered = np.add.reduceat(gap, first)
        size = self.sizes[groups % len(self.items)]
        for g in groups[covered >= self.rules.try_share * size]:
            d, k = int(g // len(self.items)), int(g % len(self.items))
            if self.leaks(text[bounds[d] : bounds[d + 1] - 1], self.items[k]):
                out.append((d, k))
        return out

    def _whole(self, text: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(index of text, index of item) where an item of fewer than ``m`` words stands whole; by direct comparison."""
        out = set()
        for n, own in self.short.items():
            windows = np.lib.stride_tricks.sliding_window_view(text, n) if len(text) >= n else np.zeros((0, n), np.int64)
            key = self._hash(windows)
            for k in own:
                at = np.flatnonzero(key == self._hash(self.items[k][None, :])[0])
                at = at[(windows[at] == self.items[k]).all(1)]
                out |= {(int(d), k) for d in np.searchsorted(bounds, at, "right") - 1}
        return sorted(out)

    def leaks(self, doc: np.ndarray, item: np.ndarray) -> bool:
        """Whether a chain of equal runs, in the order of both and over small gaps only, holds enough of the item."""
        r = self.rules
        if len(item) < r.run or len(doc) < r.run:
            return False
        i, j, n = self._runs(doc, item)
        held = np.zeros(len(item) + 1, np.int64)
        np.add.at(held, j, 1)
        np.add.at(held, j + n, -1)
        least = max(min(r.share * r.dense, r.share) * len(item), min(r.least_words, len(item)))
        if (np.cumsum(held) > 0).sum() < least:
            return False
        runs = sorted(zip(i.tolist(), j.tolist(), n.tolist()))
        # chains that end with each run: the most words for each start in the item and each step that the longest run has reached
        fronts: list[dict[tuple[int, int], tuple[int, int]]] = []
        low, steps = 0, sorted((r.dense_run, r.loose_run))
        for x, (i, j, n) in enumerate(runs):
            while runs[low][0] + len(item) + r.doc_gap < i:
                low += 1
            chains = [(n, j, n)]
            for y in range(low, x):
                i0, j0, n0 = runs[y]
                gi, gj = i - i0 - n0, j - j0 - n0
                lap = max(0, -gi, -gj)
                if i > i0 and j > j0 and gi <= r.doc_gap and gj <= r.item_gap and lap < n:
                    chains += [(words + n - lap, start, max(longest, n)) for (start, _), (words, longest) in fronts[y].items()]
            rest = len(item) - j - n
            kept: dict[tuple[int, int], tuple[int, int]] = {}
            for words, start, longest in chains:
                span = j + n - start
                if words >= min(r.least_words, len(item)):
                    if span >= r.share * len(item) and words >= r.dense * span and longest >= min(r.dense_run, len(item)):
                        return True
                    if words >= r.share * len(item) and words >= r.loose * span and longest >= r.loose_run:
                        return True
                # what even all the rest of the item cannot make long and dense enough is left out
                if words + rest < least or words + rest < min(r.loose, r.dense) * (len(item) - start):
                    continue
                at = start, (longest >= steps[0]) + (longest >= steps[1])
                if at not in kept or kept[at][0] < words:
                    kept[at] = words, longest
            fronts.append(kept)
        return False

    def _runs(self, doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start in the document, start in the item and length of every longest run of at least ``run`` equal words."""
        k = self.rules.run
        self.mark[item] = True
        known = self.mark[doc]
        self.mark[item] = False
        known = np.concatenate([known, [False]])
        inside = np.flatnonzero(np.logical_and.reduce([known[x : len(doc) - k + 1 + x] for x in range(k)]))
        own, wanted = self._hash(np.lib.stride_tricks.sliding_window_view(item, k)), self._hash(doc[inside[:, None] + np.arange(k)])
        order = np.argsort(own, kind="stable")
        lo, hi = np.searchsorted(own[order], wanted, "left"), np.searchsorted(own[order], wanted, "right")
        times = hi - lo
        i = np.repeat(inside, times)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)]
        same = (doc[i[:, None] + np.arange(k)] == item[j[:, None] + np.arange(k)]).all(1)
        i, j = i[same], j[same]
        order = np.lexsort((i, i - j))
        i, j = i[order], j[order]
        if not len(i):
            return i, j, i
        first = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(i - j) != 0)])
        return i[first], j[first], np.diff(np.r_[first, len(i)]) + k - 1


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, streamed to the driver block by block."""
    block, chars = [], 0
    for i, t in items.select(item_id, text).filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).distinct().orderBy(item_id, text).toLocalIterator():
        block.append((i, t))
        chars += len(t)
        if chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", rules: LeakRules | None = None, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id) of every document that repeats at least half of an item in one stretch.

    Case, typography, line-end hyphens, small interruptions (page headers) and redactions do not hide a leak. Documents
    are searched whole, in one pass per block of items (``block_chars`` characters, the bound of what is sent to the
    tasks); nothing is shuffled but the result. Items of three words must stand whole; null texts and ids give nothing, nor do items
    of one or two words, which are no passages.
    """
    rules = rules or LeakRules()
    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    spark, out = documents.sparkSession, None
    for block in item_blocks(items, item_id, text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            searcher = Searcher(shared.value, rules)
            for pdf in batches:
                found = searcher.search(pdf["text"].tolist())
                ids = pdf["doc_id"].to_numpy()
                yield pd.DataFrame({"doc_id": [ids[d] for d, _ in found], "item_id": [searcher.item_ids[k] for _, k in found]})

        part = docs.mapInPandas(find, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else spark.createDataFrame([], schema)
