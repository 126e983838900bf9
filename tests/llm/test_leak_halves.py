from panelforge.llm import leaks


def test_fragments_before_a_verbatim_half_do_not_hide_it():
    words = [f"w{k}" for k in range(100)]
    redacted = [w if k % 7 in (1, 2, 3) and k < 46 else f"x{k}" for k, w in enumerate(words[:50])]
    searcher = leaks.Searcher([(1, " ".join(words))], leaks.LeakRules())
    texts = [" ".join(words[50:]), " ".join(redacted + words[50:]), " ".join(words[:50] + [f"w{99 - k}" for k in range(50)]), " ".join(redacted + words[60:])]
    assert sorted(d for d, _ in searcher.search(texts)) == [0, 1, 2]
