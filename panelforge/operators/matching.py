"""Maximum-weight bipartite matching on sparse candidate edges, one independent problem per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost (shortest augmenting paths); rows <= columns."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = row_of[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            open_cols = np.where(used[1:], np.inf, least[1:])
            j1 = int(np.argmin(open_cols)) + 1
            delta = open_cols[j1 - 1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def match_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges (old_field, new_field, weight) of one group that a maximum-weight matching keeps."""
    pdf = pdf.sort_values(["old_field", "new_field"])
    olds, news = sorted(set(pdf["old_field"])), sorted(set(pdf["new_field"]))
    flip = len(olds) > len(news)
    rows, cols = (news, olds) if flip else (olds, news)
    at_row, at_col = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
    # each row has a column of its own for staying alone, so no edge is forced
    cost = np.zeros((len(rows), len(cols) + len(rows)))
    edge = np.zeros((len(rows), len(cols)), bool)
    for o, n, w in zip(pdf["old_field"], pdf["new_field"], pdf["weight"]):
        r, c = (at_row[n], at_col[o]) if flip else (at_row[o], at_col[n])
        cost[r, c], edge[r, c] = -w, True
    cost[:, : len(cols)][~edge] = 1.0
    chosen = assign(cost)
    keep = [(r, c) for r, c in enumerate(chosen) if c < len(cols) and edge[r, c]]
    pairs = {(cols[c], rows[r]) if flip else (rows[r], cols[c]) for r, c in keep}
    return pdf[[(o, n) in pairs for o, n in zip(pdf["old_field"], pdf["new_field"])]]


def best_matching(edges: DataFrame, group: str) -> DataFrame:
    """One-to-one edges of most total weight within each ``group``.

    ``edges`` has group, old_field, new_field and a positive weight. An edge whose two ends have no other edge is kept
    at once; only groups with competing edges reach Python, each with the edges of its fields, never with records.
    """
    from pyspark.sql import Window

    n_old = F.count(F.lit(1)).over(Window.partitionBy(group, "old_field"))
    n_new = F.count(F.lit(1)).over(Window.partitionBy(group, "new_field"))
    marked = edges.select(group, "old_field", "new_field", "weight").withColumn("alone", (n_old == 1) & (n_new == 1))
    schema = marked.drop("alone").schema
    rest = marked.filter(~F.col("alone")).drop("alone").groupBy(group).applyInPandas(lambda pdf: match_frame(pdf), schema)
    return marked.filter("alone").drop("alone").unionByName(rest)
