import random

import numpy as np
import pytest

from panelforge.operators import clean
from panelforge.plans import reference_queries


def naive(dist, n_clusters, limit):
    """Average linkage from its definition: the mean of all distances between the members."""
    groups = {i: [i] for i in range(len(dist))}
    while len(groups) > n_clusters:
        least, a, b = min((round(float(np.mean([dist[x, y] for x in groups[i] for y in groups[j]])), 12), i, j) for i in groups for j in groups if i < j)
        if least > limit:
            break
        groups[a] += groups.pop(b)
    return {x: i for i, own in groups.items() for x in own}


@pytest.mark.parametrize("seed,n_clusters,limit", [(0, 1, 0.6), (1, 4, np.inf), (2, 1, 0.3), (3, 1, np.inf)])
def test_average_linkage_against_its_definition(seed, n_clusters, limit):
    x = np.random.default_rng(seed).uniform(0, 1, (18, 18))
    dist = (x + x.T) / 2
    got = clean._average_linkage(dist, n_clusters, limit)
    assert dict(enumerate(got.tolist())) == naive(dist, n_clusters, limit)


def test_trigram_distances_against_sets():
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(30)})
    got = clean._gram_distances(keys)
    for i, a in enumerate(keys):
        for j, b in enumerate(keys):
            p, q = clean._trigrams(a), clean._trigrams(b)
            assert got[i, j] == pytest.approx(1 - len(p & q) / len(p | q))


def test_thousands_of_labels_end():
    rng = random.Random(5)
    labels = {"".join(rng.choice("abcdef") for _ in range(rng.randint(3, 10))) for _ in range(2500)}
    assert set(clean.cluster_labels(dict.fromkeys(labels, 1))) == labels


def test_the_query_maps_every_label(spark, tmp_path):
    rows = [(1, "F"), (2, "Female"), (3, "female "), (4, "FEMALE"), (5, "Male"), (6, "M"), (7, None), (8, "Male")]
    spark.createDataFrame(rows, "row_id long, sex_label string").write.parquet(str(tmp_path / "subjects.parquet"))
    got = {r["original"]: r["harmonised"] for r in reference_queries.harmonise_mapping(spark, str(tmp_path)).collect()}
    assert got == {"F": "F", "M": "M", "Female": "FEMALE", "female ": "FEMALE", "FEMALE": "FEMALE", "Male": "Male"}
