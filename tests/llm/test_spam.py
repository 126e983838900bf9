import random
from collections import Counter

import numpy as np

from panelforge.llm import spam

NOUNS = [a + b + c for a in ("har", "ves", "led", "car", "wit", "gar", "tur", "man") for b in ("bo", "se", "ger", "go", "ne", "den", "bi", "ua") for c in ("lim", "ton", "ra", "fex", "nop", "zu")]
FUNCTION = "the of to in and that was it with as for on had by not his but from at which have an they you were her she all this would we there been one if no who so when what up out about into than them can only other some could time two may then do first any my now such like our over man me even most made after also did many before must through".split()
_RNG = random.Random(99)
SENTENCES = [" ".join(x for _ in range(4) for x in [*_RNG.sample(FUNCTION, 3), "{}"]) + "." for _ in range(30)]


def prose(rng, n):
    return "\n".join(rng.choice(SENTENCES).format(*(rng.choice(NOUNS) for _ in range(4))) for _ in range(n))


def corpus(rng, n=250):
    docs = {k: prose(rng, 10) for k in range(n)}
    bad = {
        1000: " ".join(rng.choice(NOUNS) for _ in range(150)),
        1001: ", ".join(rng.choice(["cheap vessel", "best harbour", "garden cargo"]) for _ in range(90)),
        1002: "\n".join(f'<a href="http://x.test/{k}">{rng.choice(NOUNS)} {rng.choice(NOUNS)}</a>' for k in range(40)),
        1003: " ".join("#" + rng.choice(NOUNS) + rng.choice(NOUNS) for _ in range(40)),
        1004: prose(rng, 3) + "\n" + " ".join(rng.choice(NOUNS) for _ in range(200)),
        1005: "\n".join(f"[{rng.choice(NOUNS)}](www.y.test/{k})" for k in range(40)),
    }
    good = {
        2000: prose(rng, 12) + "\n" + " ".join(rng.choice(NOUNS) for _ in range(40)),
        2001: prose(rng, 2) + "\n" + "\n".join(f"B{k} - {rng.choice(NOUNS)} {rng.choice(NOUNS)}" for k in range(20)),
        2002: prose(rng, 2) + "\nCatchwords: " + ", ".join(rng.choice(NOUNS) for _ in range(60)),
        2003: prose(rng, 2) + "\n" + "\n".join(f"Xor v Yar [19{60 + k}] KLR {k}" for k in range(20)),
        2004: prose(rng, 6) + " (http://x.test/a)",
    }
    return docs | bad | good, set(bad)


def test_spam_forms_are_found_and_lists_of_rulings_are_not(spark):
    docs, bad = corpus(random.Random(0))
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id long, text string, block int")
    assert {r["doc_id"] for r in spam.spam_pages(df).collect()} == bad


def test_scores_do_not_depend_on_blocks(spark):
    docs, _ = corpus(random.Random(1), 120)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    runs = [{r["doc_id"]: (r["n_words"], r["n_spam_words"]) for r in spam.spam_scores(df, block_chars=b).collect()} for b in (10**9, 20_000)]
    assert runs[0] == runs[1] and len(runs[0]) == len(docs)


def test_counts_against_brute_force():
    texts = ["a b a b\nb c", "A b", None, "", "a http://x.test/q b"]
    keys, n = spam.block_counts(texts)
    got = dict(zip(keys.tolist(), n.tolist()))
    pairs = Counter()
    for pairs_of_doc in ({("a", "b"), ("b", "a"), ("b", "c")}, {("a", "b")}, {("a", "b")}):
        pairs.update(pairs_of_doc)
    h = lambda w: spam._hashes([w])
    for (x, y), times in pairs.items():
        assert got[int(spam._pair_key(h(x), h(y)).view(np.int64)[0])] == times
    for w in "ab":
        assert got[int(spam._word_key(h(w), spam._LEFT).view(np.int64)[0])] == sum(v for (x, _), v in pairs.items() if x == w)
    assert got[spam.TOTAL_KEY] == sum(pairs.values())


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "a b c"), (4, "word " * 200_000), (5, "[2011] " + "x" * 300_000), (6, "a b"), (6, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spam.spam_scores(df).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2}
    assert all(r["spam_share"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert {r["doc_id"] for r in spam.spam_pages(df).collect()} == {4}
    assert spam.spam_scores(df.limit(0)).count() == 0
