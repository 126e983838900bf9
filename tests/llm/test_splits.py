import random

import pytest

from panelforge.core.errors import InputValidationError
from panelforge.llm.graph import components
from panelforge.operators.ranks import exact_rank
from panelforge.llm.splits import assign_splits, related_groups


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, e in edges:
        parent[root(("r", r))] = root(("e", e))
    groups = {}
    for r, _ in edges:
        groups.setdefault(root(("r", r)), set()).add(r)
    return {r: min(g) for g in groups.values() for r in g}


def labels(spark, edges):
    df = components(spark.createDataFrame(edges, "r long, e string"), "r", "e")
    out = {x["r"]: x["label"] for x in df.collect()}
    assert len(out) == df.count()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), f"e{rng.randrange(90)}") for _ in range(130)]
    assert labels(spark, edges + edges[:20]) == brute(edges)


def test_long_chain_and_hot_entity(spark):
    order = list(range(200))
    random.Random(5).shuffle(order)
    chain = [(order[k], f"c{k}") for k in range(200)] + [(order[k + 1], f"c{k}") for k in range(199)]
    hot = [(1000 + k, "hot") for k in range(400)]
    assert labels(spark, chain + hot) == {**{k: 0 for k in range(200)}, **{1000 + k: 1000 for k in range(400)}}


def test_null_ends_and_empty_edges(spark):
    assert labels(spark, []) == {}
    assert labels(spark, [(1, None), (None, "a"), (2, "a"), (3, "a")]) == {2: 2, 3: 2}


def test_related_groups_through_families_and_people(spark):
    ties = spark.createDataFrame([(5, "A"), (3, "A"), (9, "B"), (7, "C"), (1, None), (4, "D"), (4, "E"), (8, "E")], "subject long, fam string")
    people = spark.createDataFrame([("A", 1), ("B", 1), ("B", 2), ("C", 2), ("D", None), ("Z", 1)], "fam string, person long")
    got = {r["subject"]: r["group_id"] for r in related_groups(ties, "subject", ties, "fam", people, "person").collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 3, 1: 1, 4: 4, 8: 4}


def test_exact_rank_is_a_permutation_within_groups(spark):
    rows = [(k % 3 if k % 10 else None, k % 50) for k in range(600)]
    out = exact_rank(spark.createDataFrame(rows, "g long, x long"), ["g"], ["x"]).collect()
    assert len(out) == 600
    for g in {r["g"] for r in out}:
        own = [r for r in out if r["g"] == g]
        assert sorted(r["rank"] for r in own) == list(range(len(own))) and {r["group_size"] for r in own} == {len(own)}


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for g in range(700):
        for _ in range(300 if g == 0 else rng.choice([1, 1, 2, 3])):
            n += 1
            rows.append((n, g, rng.choice(["F", "M", None])))
    rows.append((9999, None, "F"))
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    out = assign_splits(spark.createDataFrame(rows, "row long, g long, label string"), "g", "label", shares).collect()
    assert len(out) == len(rows)
    by_group = {}
    for r in out:
        by_group.setdefault(r["g"], set()).add(r["split"])
    assert by_group.pop(None) == {None}
    assert all(len(s) == 1 and None not in s for s in by_group.values())
    for label in ("F", "M", None):
        own = [r["split"] for r in out if r["label"] == label and r["g"] is not None]
        for name, share in shares.items():
            assert abs(own.count(name) - share * len(own)) <= 2


def test_splits_of_nothing_and_bad_shares(spark):
    empty = spark.createDataFrame([], "row long, g long, label string")
    assert assign_splits(empty, "g", "label", {"a": 1.0}).count() == 0
    with pytest.raises(InputValidationError):
        assign_splits(empty, "g", "label", {})
    with pytest.raises(InputValidationError):
        assign_splits(empty, "g", "label", {"a": 0.0, "b": 1.0})
    with pytest.raises(InputValidationError):
        assign_splits(empty.withColumnRenamed("row", "split"), "g", "label", {"a": 1.0})


def test_splits_where_one_group_exceeds_its_share(spark):
    rows = [(k, 1, "F") for k in range(60)] + [(100 + k, 100 + k, "F") for k in range(40)]
    out = assign_splits(spark.createDataFrame(rows, "row long, g long, label string"), "g", "label", {"a": 0.5, "b": 0.5}).collect()
    sizes = sorted([sum(r["split"] == x for r in out) for x in "ab"])
    assert sizes == [40, 60]


def test_blocks_of_kinds_stay_stratified(spark):
    """Many kinds in small blocks: no label is given up."""
    rng = random.Random(3)
    rows = [(1000 * g + k, g, rng.choice("ABC")) for g in range(300) for k in range(rng.choice([1, 2, 5, 9, 14]))]
    df = spark.createDataFrame(rows, "row long, g long, label string")
    out = assign_splits(df, "g", "label", {"a": 0.5, "b": 0.25, "c": 0.25}, block=20).collect()
    assert len(out) == len(rows) and all(len({r["split"] for r in out if r["g"] == g}) == 1 for g in range(300))
    for label in "ABC":
        own = [r["split"] for r in out if r["label"] == label]
        for name, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
            assert abs(own.count(name) - share * len(own)) <= 0.02 * len(own) + 2
