import os
import random

import pytest
import tiktoken

from panelforge.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")


def corpus(spark, sizes, seed=0):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), " ".join(rng.choice(["court", "appeal", "the", "of"]) for _ in range(rng.randint(5, 120))), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def mixed(spark, docs, rows):
    drawn, shares = mixing.mix_sources(docs, targets(spark, rows))
    return [r.asDict() for r in drawn.collect()], {r["source"]: r.asDict() for r in shares.collect()}


def test_shares_come_near_their_targets_within_the_cap(spark):
    docs = corpus(spark, {"big": 600, " BIG ": 50, "mid": 200, "small": 20, None: 30, "unlisted": 40})
    drawn, shares = mixed(spark, docs, [("big", 0.4, 1), ("Mid", 0.35, 3), ("small", 0.2, 4), ("absent", 0.05, 2), ("mid", 0.9, 3)])
    assert shares["big"]["share_of_corpus"] == pytest.approx(0.4, abs=0.002)
    assert shares["mid"]["share_of_corpus"] == pytest.approx(0.35, abs=0.002)
    assert shares["small"]["tokens_drawn"] == 4 * shares["small"]["tokens_available"]
    assert shares["absent"]["tokens_drawn"] == 0
    assert len({r["doc_id"] for r in drawn}) == len(drawn)
    caps = {"big": 1, "mid": 3, "small": 4}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in drawn)
    for s in caps:
        assert shares[s]["tokens_drawn"] == sum(r["tokens"] * r["copies"] for r in drawn if r["source"] == s)
    assert sum(x["share_of_drawn"] for x in shares.values()) == pytest.approx(1)


def test_equal_documents_and_hot_lengths(spark):
    docs = spark.createDataFrame([(k, "the court of appeal", "a") for k in range(300)] + [(1000 + k, "the court", "b") for k in range(10)], "doc_id long, text string, source string")
    drawn, shares = mixed(spark, docs, [("a", 0.5, 2), ("b", 0.01, 5)])
    goal = 0.5 * (1200 + 20)
    assert abs(shares["a"]["tokens_drawn"] - goal) <= 4
    assert abs(shares["b"]["tokens_drawn"] - 12.2) <= 2


def test_empty_texts_and_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "court", "a"), (4, "court", None)], "doc_id long, text string, source string")
    drawn, shares = mixed(spark, docs, [("a", 0.5, 2)])
    assert [(r["doc_id"], r["copies"]) for r in drawn] == [(3, 1)]
    drawn, shares = mixed(spark, docs.limit(0), [("a", 0.5, 2)])
    assert not drawn and shares["a"]["share_of_drawn"] == 0
    assert mixed(spark, docs, []) == ([], {})


def test_token_counts_are_those_of_the_tokenizer(spark):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(mixing.TOKENIZER, "rb"))}
    own = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["The court’s <|endoftext|> order.\n\n  — 12,345 €", "x" * 20_000, "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.count_tokens(df, keep=["doc_id"]).collect()}
    assert got == {k: len(own.encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}
