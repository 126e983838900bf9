"""Keyword-stuffed and link-list pages (problem 8).

Two passes over the distinct texts. The first counts, over the whole corpus, in how many of them each pair of neighbouring
words stands, so that copies are no further evidence; the second scores the lines of every document by the mean pointwise mutual information of their
neighbouring words. Word salad and lists have a low mean, since their neighbours meet by chance; repeated collocations are
those that fill a line and recur all over the document. A page is spam when such lines hold most of its words.

Texts are handled in blocks of bounded size; their documents get the scores by a hash of the text. A block sends each of its distinct pairs and words once and gets back
the corpus counts of exactly these, so the counts are exact and no table of all pairs is held anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.exprs import splittable_join

URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
# targets that are no absolute address: of href attributes, and of links in brackets
HREF = re.compile(r"""\bhref\s*=\s*["']?\s*(?!https?://|(?://)?www\.|["'\s>])\S""", re.I)
TARGET = re.compile(r"\]\(\s*(?:\.{0,2}/|[#?]|[\w%-]+(?:/|\.\w))[^()\s]*\)")
MARKUP = re.compile(r"</?\w+\b[^<>]*>|\bhref\s*=")
WORD = re.compile(r"[^\W\d_]+")
MARKS = frozenset("-/|>:*=+~<&,.;#") | frozenset("–—•·»«")
# Lines of a ruling that are lists by nature: labelled catchwords and panels, exhibits (B7 - ...), citations with a year.
_LABELS = r"^\s*(?:catchwords|keywords|stichw[oö]rter|stichworte|schlagw[oö]rter|schlagworte|mots[- ]cl[ée]s|authorities|before|besetzung|composition)\b"
LABEL = re.compile(_LABELS, re.I)
APPARATUS = re.compile(
    _LABELS + r"|^\s*[A-Z]{1,2}\d{1,3}\s*[-:–.)]?\s"
    r"|[\[(](?:1[5-9]|20)\d\d[\])]\s*(?:\w+\s+){0,4}\w*\s*$",
    re.I,
)
_LEFT, _RIGHT, _TOTAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class SpamRules:
    """Thresholds; the same at every size of corpus.

    ``least_pmi``: a line whose discounted mean PMI lies below is incoherent; ``list_pmi`` holds for lines with a comma to
    ``1 / list_commas`` words. ``repeated_share``: so many of a line's pairs must recur at least ``recurs`` times and in
    ``recurs_share`` of the document's pairs, while under ``common_share`` of all documents have them: phrases of the
    trade may recur. ``words_per_link``: up to so many words to a link make a link list. ``discount``: a pair in n documents
    counts (n - 1) / (n + discount) of its positive PMI. ``least_words``: shorter units are judged by links and tags only.
    ``short_line``: consecutive lines of fewer words are judged as one unit, besides each for itself; shorter units are
    not judged by repetition. ``ruling_share``: lists of a ruling are exempt where coherent text outside them holds so much
    of the page; ``label_words`` and ``label_repeats``: not lines of more words, nor of more pairs that stood in the line before.
    """

    least_pmi: float = 1.15
    list_pmi: float = 2.0
    list_commas: float = 0.25
    common_share: float = 0.01
    repeated_share: float = 0.5
    recurs: int = 4
    recurs_share: float = 0.008
    words_per_link: int = 6
    discount: float = 4.0
    least_words: int = 5
    short_line: int = 8
    ruling_share: float = 0.2
    label_words: int = 200
    label_repeats: float = 0.3
    spam_share: float = 0.5


@dataclass
class _Block:
    """The words of a block of documents as flat arrays."""

    vocabulary: list[str] = field(default_factory=list)
    words: np.ndarray = None  # id of each word
    line: np.ndarray = None  # line of each word
    unit: np.ndarray = None  # of each line: a run of short lines, or the line alone
    doc_of_line: np.ndarray = None
    links: np.ndarray = None  # of each line
    tags: np.ndarray = None
    commas: np.ndarray = None
    tokens: np.ndarray = None  # words as they are written, between blanks
    exempt: np.ndarray = None


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting beats numpy's hash table here)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def parse(texts: list[str | None], *, judge: bool = True, short_line: int = SpamRules.short_line) -> _Block:
    """Split texts into lines and words. Links and numbers are words too but have no neighbours. Lines of more than
    25 words are apparatus by their label only. ``judge=False`` leaves out what only the scoring needs."""
    found: list[list[str]] = []
    counts, docs, links, tags, commas, tokens, exempt = [], [], [], [], [], [], []
    for d, text in enumerate(texts):
        if not text:
            continue
        for raw in text.split("\n"):
            if not raw or raw.isspace():
                continue
            n_links = 0
            ln = raw
            if "://" in ln or "www." in ln:
                ln, n_links = URL.subn(" ", ln)
            if "href" in raw or "HREF" in raw:
                n_links += len(HREF.findall(raw))
            if "](" in ln:
                ln, more = TARGET.subn("] ", ln)
                n_links += more
            if "<" in ln:
                ln = MARKUP.sub(" ", ln)
            own = WORD.findall(ln.lower())
            if not own and not n_links:
                continue
            found.append(own)
            counts.append(len(own))
            docs.append(d)
            if judge:
                links.append(n_links)
                tags.append(ln.count("#"))
                commas.append(ln.count(","))
                written = raw.split()
                tokens.append(len(written) - sum(map(MARKS.__contains__, written)))
                exempt.append((APPARATUS.search(raw) if len(own) <= 25 else LABEL.match(raw)) is not None)
    counts = np.array(counts, np.int64)
    of = np.array(docs, np.int64)
    short = counts < short_line
    goes_on = np.r_[False, short[1:] & short[:-1] & (of[1:] == of[:-1])][: len(counts)]
    unit = np.cumsum(~goes_on) - 1
    vocabulary = sorted(set(chain.from_iterable(found)))
    ids = {w: i for i, w in enumerate(vocabulary)}
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(found)), np.int64)
    return _Block(vocabulary, flat, np.repeat(np.arange(len(counts)), counts), unit, of, np.array(links, np.int64), np.array(tags, np.int64), np.array(commas, np.int64), np.array(tokens, np.int64), np.array(exempt, bool))


def _pairs(b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left word, right word and line of all neighbours, and whether the line has both: in runs of three short lines or
    more, words are neighbours across line breaks too."""
    within = b.line[1:] == b.line[:-1]
    unit = b.unit[b.line]
    same = within | (unit[1:] == unit[:-1]) & (np.bincount(b.unit)[unit[1:]] > 2) if len(unit) else within
    return b.words[:-1][same], b.words[1:][same], b.line[1:][same], within[same]


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (left ^ (left >> np.uint64(29))) * _LEFT + (right ^ (right >> np.uint64(31))) * _RIGHT
        return x ^ (x >> np.uint64(32))


def _word_key(word: np.ndarray, side: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (word ^ side) * _TOTAL
        return x ^ (x >> np.uint64(29)) ^ side


TOTAL_KEY, DOCUMENTS_KEY = 0, 1


def block_counts(texts: list[str | None], short_line: int = SpamRules.short_line) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of texts: of each pair, of each word as a left and as a right neighbour, of all pairs, and of
    documents with any text."""
    b = parse(texts, judge=False, short_line=short_line)
    left, right, line, _ = _pairs(b)
    n = max(1, len(b.vocabulary))
    code = _distinct((b.doc_of_line[line] * n + left) * n + right)
    pair, times = np.unique(code % (n * n), return_counts=True)
    h = _hashes(b.vocabulary)
    lw, rw = pair // n, pair % n
    ln, rn = np.bincount(lw, times, n), np.bincount(rw, times, n)
    li, ri = np.flatnonzero(ln), np.flatnonzero(rn)
    keys = np.concatenate([_pair_key(h[lw], h[rw]), _word_key(h[li], _LEFT), _word_key(h[ri], _RIGHT), np.array([TOTAL_KEY, DOCUMENTS_KEY], np.uint64)])
    documents = len(_distinct(b.doc_of_line))
    return keys.view(np.int64), np.concatenate([times, ln[li], rn[ri], [times.sum(), documents]]).astype(np.int64)


def score_lines(b: _Block, keys: np.ndarray, counts: np.ndarray, rules: SpamRules) -> tuple[np.ndarray, np.ndarray]:
    """For each line its words and whether it is spam."""
    n_lines = len(b.doc_of_line)
    size = np.bincount(b.line, minlength=n_lines) if len(b.line) else np.zeros(n_lines, np.int64)
    words = b.tokens
    left, right, line, within = _pairs(b)
    n_units = int(b.unit[-1]) + 1 if n_lines else 0
    in_unit = lambda x: np.bincount(b.unit, x, n_units)
    size_u = in_unit(size)

    def lists(links: np.ndarray, tags: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (links > 0) & (size <= rules.words_per_link * links) | (tags > 1) & (2 * tags >= size)

    spam = lists(b.links, b.tags, size) | lists(in_unit(b.links), in_unit(b.tags), size_u)[b.unit]
    if len(left):
        n = len(b.vocabulary)
        h = _hashes(b.vocabulary)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]

        def count(wanted: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, counts[at], 1).astype(float)

        code, inverse = np.unique(left * n + right, return_inverse=True)
        lw, rw = code // n, code % n
        seen = count(_pair_key(h[lw], h[rw]).view(np.int64))
        lefts, rights = count(_word_key(h, _LEFT).view(np.int64)), count(_word_key(h, _RIGHT).view(np.int64))
        total, documents = count(np.array([TOTAL_KEY, DOCUMENTS_KEY], np.int64))
        pmi = np.log(seen * total / (lefts[lw] * rights[rw]))
        pmi = np.where(pmi > 0, pmi * np.maximum(seen - 1, 0) / (seen + rules.discount), pmi)
        doc = b.doc_of_line[line]
        in_doc, where, times = np.unique(doc * len(code) + inverse, return_inverse=True, return_counts=True)
        doc_pairs = np.bincount(doc)
        rare = seen <= np.maximum(rules.common_share * documents, 3)
        often = (times[where] >= np.maximum(rules.recurs, rules.recurs_share * doc_pairs[doc])) & rare[inverse]

        def incoherent(at: np.ndarray, own: np.ndarray, often: np.ndarray, size: np.ndarray, commas: np.ndarray) -> np.ndarray:
            n_pairs = np.maximum(1, np.bincount(at, minlength=len(size)))
            mean = np.bincount(at, own, len(size)) / n_pairs
            repeated = np.bincount(at, often.astype(float), len(size)) / n_pairs
            low = mean < np.where(commas >= rules.list_commas * size, rules.list_pmi, rules.least_pmi)
            return (size >= rules.least_words) & (low | (repeated >= rules.repeated_share) & (size >= rules.short_line))

        own = pmi[inverse]
        by_line = incoherent(line[within], own[within], often[within], size, b.commas)
        by_unit = incoherent(b.unit[line], own, often, size_u, in_unit(b.commas))
        bad = by_line | by_unit[b.unit]
        coherent = np.bincount(b.doc_of_line, words * ~(b.exempt | bad | spam))
        ruling = coherent >= rules.ruling_share * np.maximum(1, np.bincount(b.doc_of_line, words))
        at = line[within]
        different = np.bincount(_distinct(at * len(code) + inverse[within]) // len(code), minlength=n_lines)
        repeats = 1 - different / np.maximum(1, np.bincount(at, minlength=n_lines)) > rules.label_repeats
        spam |= bad & ~(b.exempt & ruling[b.doc_of_line] & (size <= rules.label_words) & (~repeats | (size < rules.short_line)))
    return words, spam


def spam_scores(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: SpamRules | None = None, block_chars: int = 8_000_000, blocks_per_sum: int = 256) -> DataFrame:
    """(doc_id, n_words, n_spam_words, spam_share) of every document.

    Empty and null texts have 0 words and a share of 0. Repeated rows of one id are scored apart and the largest share holds; copies of a
    text count once in the statistics and all get its score.
    A very long text is one row of its block and processed whole; blocks hold about ``block_chars`` characters, so their
    number grows with the corpus and their size does not. Counts of a key are summed over ``blocks_per_sum`` blocks first and
    then over all. Other columns are not read.
    """
    rules = rules or SpamRules()
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    hashed = docs.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), F.col("text")))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))

    def once(batches: Iterator) -> Iterator:
        # a task sends each text once, so that a text of many copies is no hot block
        import pyarrow as pa

        sent: set = set()
        for batch in batches:
            new = []
            for k, key in enumerate(zip(batch.column("h").to_pylist(), batch.column("h2").to_pylist())):
                if key not in sent:
                    sent.add(key)
                    new.append(k)
            yield batch.take(pa.array(new, pa.int64()))

    distinct = hashed.filter("text IS NOT NULL").select("h", "h2", "text").mapInArrow(once, "h long, h2 long, text string")
    # one partition a block, so that a task's share does not grow with the corpus
    blocked = distinct.withColumn("block", F.pmod("h", F.lit(n_blocks)).cast("int")).repartitionById(n_blocks, F.col("block"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = block_counts(pdf.drop_duplicates(["h", "h2"])["text"].tolist(), rules.short_line)
        return pd.DataFrame({"block": pdf["block"].iat[0], "key": keys, "n": counts})

    own = blocked.groupBy("block").applyInPandas(count, "block int, key long, n long")
    # a key comes once from a block, so a group of this window has at most ``blocks_per_sum`` rows, however common the key
    part = Window.partitionBy("key", "part")
    summed = own.withColumn("part", F.floor(F.col("block") / blocks_per_sum)).withColumn("total", F.sum("n").over(part))
    if n_blocks > blocks_per_sum:
        first = F.row_number().over(part.orderBy("block")) == 1
        totals = summed.withColumn("first", first).filter("first").groupBy("key").agg(F.sum("total").alias("total"))
        summed = splittable_join(summed.select("block", "key"), totals, ["key"])
    global_counts = summed.select("block", "key", "total").repartitionById(n_blocks, F.col("block"))

    def score(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["h", "h2"])
        b = parse(pdf["text"].tolist(), short_line=rules.short_line)
        words, spam = score_lines(b, known["key"].to_numpy(), known["total"].to_numpy(), rules)
        n = np.bincount(b.doc_of_line, words, len(pdf)).astype(np.int64)
        bad = np.bincount(b.doc_of_line, words * spam, len(pdf)).astype(np.int64)
        return pd.DataFrame({"h": pdf["h"].to_numpy(), "h2": pdf["h2"].to_numpy(), "n_words": n, "n_spam_words": bad, "spam_share": bad / np.maximum(1, n)})

    scored = blocked.groupBy("block").cogroup(global_counts.groupBy("block")).applyInPandas(score, "h long, h2 long, n_words long, n_spam_words long, spam_share double")
    zero = [F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in (("n_words", "long"), ("n_spam_words", "long"), ("spam_share", "double"))]
    return hashed.select("doc_id", "h", "h2").join(scored, ["h", "h2"], "left").select("doc_id", *zero)


def spam_pages(documents: DataFrame, *, rules: SpamRules | None = None, **options) -> DataFrame:
    """The doc_id of every page of which more than half of the words stand in spam lines."""
    rules = rules or SpamRules()
    return spam_scores(documents, rules=rules, **options).filter(F.col("spam_share") > rules.spam_share).select("doc_id").distinct()
