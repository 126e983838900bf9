import random

import numpy as np
import pytest

from panelforge.llm.leaks import LeakRules, Searcher, leaked_items, words_of

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "hi", "jo", "ku") for b in ("lan", "mer", "nit", "por", "ras", "sel", "tov", "vek", "wil", "zor")]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_words_ignore_typography():
    assert words_of("The “Court’s” re-\nview of ﬁnal so\xadft or­der, No. 5") == ["the", "courts", "review", "of", "final", "soft", "order", "no", "5"]
    assert words_of("n’a procès-verbal 12,345 - x, y 3.5") == words_of("na procèsverbal 12345 – x y 3 5") == ["na", "procèsverbal", "12345", "x", "y", "3", "5"]
    assert words_of(None) == words_of("") == words_of(" \n ") == []


def test_occurrences_equal_naive_search():
    rng = random.Random(0)
    few = WORDS[:6]
    items = [(k, " ".join(rng.choice(few) for _ in range(20))) for k in range(8)]
    s = Searcher(items, LeakRules(m=3))
    text = np.array([s.ids.get(w, -1) for w in (rng.choice([*few, "other"]) for _ in range(3000))])
    for stripe in (1, 7, 512, 10_000):
        start, pattern = s.occurrences(text, stripe)
        got = set(zip(start.tolist(), pattern.tolist()))
        want = {(i, p) for i in range(len(text) - 2) for p in range(len(s.patterns)) if (text[i : i + 3] == s.patterns[p]).all()}
        assert got == want


@pytest.mark.parametrize("cut,leaks", [((0, 80), True), ((0, 45), True), ((30, 75), True), ((0, 30), False), ((50, 80), False)])
def test_share_of_the_item_decides(spark, cut, leaks):
    rng = random.Random(1)
    item = passage(rng, 80)
    doc = passage(rng, 200) + item[cut[0] : cut[1]] + passage(rng, 200)
    docs = spark.createDataFrame([(1, " ".join(doc), "x")], "doc_id long, text string, item_id string")
    got = leaked_items(docs, spark.createDataFrame([(7, " ".join(item), "en")], "item_id long, text string, lang string")).collect()
    assert [tuple(r) for r in got] == ([(1, 7)] if leaks else [])


def test_interruptions_redactions_and_case_do_not_hide_a_leak():
    rng = random.Random(2)
    item = passage(rng, 60)
    s = Searcher([(1, " ".join(item))], LeakRules())
    broken = item[:14] + ["KMR-02 2011/4306 Page 3 - 4 -"] + [w.upper() for w in item[14:30]] + ["[redacted]"] + item[32:50]
    assert s.search([" ".join(passage(rng, 50) + broken)]) == [(0, 0)]
    scattered = [w for k in range(0, 60, 10) for w in item[k : k + 8] + passage(rng, 40)]
    assert s.search([" ".join(scattered)]) == []


def test_stock_phrases_do_not_make_a_leak():
    rng = random.Random(4)
    frame = passage(rng, 60)
    fill = lambda: " ".join(w if k % 6 < 4 else rng.choice(WORDS) for k, w in enumerate(frame))
    assert Searcher([(1, fill())], LeakRules(m=3)).search([fill()]) == []


def test_two_items_one_document_and_one_item_twice(spark):
    rng = random.Random(3)
    a, b = passage(rng, 50), passage(rng, 70)
    docs = [(1, " ".join(a + passage(rng, 30) + b + a)), (2, None), (3, ""), (4, "short"), (None, " ".join(a)), (5, " ".join(passage(rng, 9000) + b))]
    items = [(10, " ".join(a)), (11, " ".join(b)), (11, " ".join(b)), (12, None), (13, ""), (14, "two words"), (None, " ".join(a))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 100):  # all items at once, and one block each
        assert {tuple(r) for r in leaked_items(docs, items, block_chars=block).collect()} == {(1, 10), (1, 11), (5, 11)}
    assert leaked_items(docs, items.limit(0)).count() == 0
    assert leaked_items(docs.limit(0), items).count() == 0
