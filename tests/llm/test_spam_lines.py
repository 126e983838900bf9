import random

from panelforge.llm import spam
from tests.llm.test_spam import NOUNS, corpus, prose


def test_lists_of_short_lines_and_of_relative_links_are_found(spark):
    rng = random.Random(6)
    docs, bad = corpus(rng)
    noun = lambda: rng.choice(NOUNS)
    more = {
        4000: "\n".join(noun() for _ in range(200)),
        4001: "\n\n".join(f"{noun()} {noun()}" for _ in range(90)),
        4002: "\n".join("fresh lemon near market street corner" for _ in range(60)),
        4003: "\n".join(f"#{noun()}" for _ in range(50)),
        4004: "\n".join(f'<a href="/goods/{k}.html">{noun()} {noun()}</a>' for k in range(40)),
        4005: "\n".join(f"[{noun()} {noun()}](../goods/{k}.html)" for k in range(40)),
        4006: "\n".join(x for k in range(40) for x in (f"<a href='goods/{k}'>{noun()}</a>", f"{noun()} {noun()}")),
    }
    # sentences of a ruling in narrow columns stay coherent
    narrow = {4100 + k: "\n".join(w for line in prose(rng, 10).split("\n") for w in [" ".join(line.split()[i : i + 4]) for i in range(0, 16, 4)]) for k in range(20)}
    # copies of the repeated phrase on pages of its trade give its pairs a high mutual information
    trade = {4200 + k: prose(rng, 10) + "\nfresh lemon near market street corner" for k in range(2)}
    df = spark.createDataFrame([*docs.items(), *more.items(), *narrow.items(), *trade.items()], "doc_id long, text string")
    assert {r["doc_id"] for r in spam.spam_pages(df).collect()} == bad | set(more)


def test_targets_are_counted_once():
    texts = ['<a href="http://x.test/a">b</a>', "<a href=/a>b</a>", "<A HREF='a.html'>b</A> <a href=www.x.test/a class=c>d</a>", "[b](/a) [c](http://x.test) [12](b)", '<a href="">b</a>']
    assert spam.parse(texts).links.tolist() == [1, 1, 2, 2, 0]
