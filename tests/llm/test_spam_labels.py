import random

from panelforge.llm import spam
from tests.llm.test_spam import NOUNS, corpus, prose


def test_labels_hide_no_stuffed_pages(spark):
    rng = random.Random(8)
    docs, bad = corpus(rng)
    noun = lambda: rng.choice(NOUNS)
    more = {
        3000: "Keywords: " + ", ".join(f"cheap {noun()}" for _ in range(300)),
        3001: "before " + " ".join(noun() for _ in range(150)),
        3002: "\n".join(f"X{k} {noun()} {noun()} {noun()} {noun()} {noun()}" for k in range(1, 40)),
        3003: "\n".join(f"X{k} {noun()} {noun()}" for k in range(1, 60)),
        3004: prose(rng, 8) + "\nKeywords: " + ", ".join(noun() for _ in range(400)),
        3005: prose(rng, 8) + "\nKeywords: " + ", ".join(["cheap vessel", "best harbour", "garden cargo"] * 50),
        3006: prose(rng, 1) + "\n" + "\n".join("Keywords: " + ", ".join(noun() for _ in range(50)) for _ in range(4)),
    }
    rulings = {3100: prose(rng, 6) + "\nBefore: " + " ".join(noun() for _ in range(12)) + "\nCatchwords: " + ", ".join(noun() for _ in range(120))}
    df = spark.createDataFrame([*docs.items(), *more.items(), *rulings.items()], "doc_id long, text string")
    assert {r["doc_id"] for r in spam.spam_pages(df).collect()} == bad | set(more)
