import random

from panelforge.llm import spam
from tests.llm.test_spam import NOUNS, corpus


def test_copies_of_salad_and_of_repeated_keywords_are_found(spark):
    rng = random.Random(4)
    docs, bad = corpus(rng)
    rows = list(docs.items())
    salad = " ".join(rng.choice(NOUNS) for _ in range(150))
    keywords = "\n".join(" ".join(["cheap vessel best harbour garden cargo"] * 4) for _ in range(8))
    rows += [(5000 + k, salad) for k in range(130)] + [(6000 + k, keywords) for k in range(10)]
    found = {r["doc_id"] for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == bad | set(range(5000, 5130)) | set(range(6000, 6010))


def test_counts_summed_in_parts_are_the_same(spark):
    rows = [(i, f"the court held in case {i} that the appeal of party {i % 7} be dismissed\n" + "cheap shoes buy now " * (i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r for r in spam.spam_scores(df, block_chars=700).collect()}
    parts = {r["doc_id"]: r for r in spam.spam_scores(df, block_chars=700, blocks_per_sum=3).collect()}
    assert one == parts and len(one) == 120
