import random

import pytest

from panelforge.llm.leaks import LeakRules, Searcher
from tests.llm.test_leaks import passage


@pytest.mark.parametrize("length,rate", [(n, r) for n in (20, 60, 200) for r in (0, 10, 6, 5)])
def test_recall_by_length_and_redaction_rate(length, rate):
    """Items quoted whole with one word in ``rate`` redacted, at regular or at random places."""
    rng = random.Random(length * 10 + rate)
    items = [passage(rng, length) for _ in range(60)]
    texts = []
    for k, item in enumerate(items):
        hidden = set() if not rate else {i for i in range(length) if i % rate == rate - 1} if k % 2 else set(rng.sample(range(length), length // rate))
        texts.append(" ".join(passage(rng, 80) + ["█" if i in hidden else w for i, w in enumerate(item)] + passage(rng, 80)))
    found = set(Searcher([(k, " ".join(x)) for k, x in enumerate(items)], LeakRules()).search(texts))
    assert sum((k, k) in found for k in range(60)) >= (54 if rate != 5 else 48)
    assert all(d == k for d, k in found)


@pytest.mark.parametrize("length", [3, 4, 5, 6, 8])
def test_short_items_quoted_whole(length):
    rng = random.Random(length)
    item = [f"w{k}" for k in range(length)]
    s = Searcher([(1, " ".join(item)), (2, "w0 w1"), (3, "")], LeakRules())
    assert s.search([" ".join(passage(rng, 30) + item + passage(rng, 30)), " ".join(item[:2] + ["x"] + item[2:4]), " ".join(item)]) == [(0, 0), (2, 0)]


def test_sixty_words_with_every_sixth_redacted():
    rng = random.Random(9)
    item = passage(rng, 60)
    s = Searcher([(1, " ".join(item))], LeakRules())
    assert s.search([" ".join("[...]" if k % 6 == 5 else w for k, w in enumerate(item))]) == [(0, 0)]
