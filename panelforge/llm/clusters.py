"""Grouping records into similarity clusters (problem 5).

Density clustering (core points have ``min_points`` records within ``eps``) under the largest coordinate difference:

1. Space is cut into cells along the coordinates in which the vectors of a cell spread most; cells with many vectors are cut
   again along further coordinates. A coordinate never separates vectors that are nearer than their distance.
2. The vectors of a cell are gathered into boxes whose sides are at most ``eps``. All members of a box are neighbours, so a
   box of ``min_points`` records consists of core points, however many, and is one node; other vectors are nodes of their own.
3. Nodes are copied into every cell that their margin overlaps. Each cell counts neighbours, ties core nodes, and names
   its local clusters; local clusters that share a core node merge.

Boxes decide most pairs by their bounds; only where bounds cannot tell are the vectors of two boxes compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError, LibraryError
from panelforge.core.session import cut
from panelforge.llm.graph import components

SLACK = 1e-9


def cliques(vectors: np.ndarray, eps: float) -> np.ndarray:
    """The number of a box for each vector; a box's sides are at most ``eps``, so that its vectors are all neighbours.

    A set whose bounds are too wide is split along its widest coordinate, at every gap over ``eps``, else at the widest gap
    of its middle half.
    """
    out = np.full(len(vectors), -1)
    todo, n = [np.arange(len(vectors))] if len(vectors) else [], 0
    while todo:
        own = todo.pop()
        v = vectors[own]
        side = v.max(0) - v.min(0)
        d = int(side.argmax())
        if side[d] <= eps + SLACK:
            out[own] = n
            n += 1
            continue
        order = own[np.argsort(v[:, d], kind="stable")]
        x = vectors[order, d]
        gaps, off = np.diff(x), np.abs((x[1:] + x[:-1]) - (x[0] + x[-1])) / 2
        cuts = np.flatnonzero(gaps > eps + SLACK)
        if not len(cuts):
            inner = np.where(off <= side[d] / 4, gaps, 0)
            cuts = [int((inner if inner.any() else gaps).argmax())]
        todo += np.split(order, np.array(cuts) + 1)
    return out


def box_pairs(lo: np.ndarray, hi: np.ndarray, eps: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of boxes that are at most ``eps`` apart in every coordinate; a band search on the widest one first."""
    rows, cols = [], []
    if len(lo) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    dims = np.argsort(-(hi.max(0) - lo.min(0)), kind="stable")
    d = dims[0]
    order = np.argsort(lo[:, d], kind="stable")
    l, h = lo[order], hi[order]
    end = np.searchsorted(l[:, d], h[:, d] + eps + SLACK, "right")
    for a in range(0, len(l), block):
        b, last = min(a + block, len(l)), int(end[a : a + block].max())
        near = np.arange(a, last)[None, :] > np.arange(a, b)[:, None]
        near &= np.arange(a, last)[None, :] < end[a:b, None]
        for k in dims[1:3]:
            near &= (l[None, a:last, k] <= h[a:b, None, k] + eps + SLACK) & (h[None, a:last, k] >= l[a:b, None, k] - eps - SLACK)
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        for k in dims[3:]:
            keep = (l[j, k] <= h[i, k] + eps + SLACK) & (h[j, k] >= l[i, k] - eps - SLACK)
            i, j = i[keep], j[keep]
        rows.append(order[i])
        cols.append(order[j])
    return np.concatenate(rows), np.concatenate(cols)


def within(a: np.ndarray, b: np.ndarray, eps: float, block: int = 256) -> np.ndarray:
    """For each row of ``a`` whether each row of ``b`` is within ``eps``, as rows of a boolean matrix (block by block)."""
    out = np.zeros((len(a), len(b)), bool)
    for s in range(0, len(a), block):
        out[s : s + block] = np.abs(a[s : s + block, None, :] - b[None, :, :]).max(2) <= eps + SLACK
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parent = np.arange(n)
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        parent = parent[parent]
        if (parent == before).all():
            return parent


def _matrix(series: pd.Series, dims: int) -> np.ndarray:
    return np.array(series.tolist(), float).reshape(-1, dims)


def _bounds(prefix: str, v: str, dims: int) -> list[Column]:
    return [F.array(*(f(F.col(v)[i]) for i in range(dims))).alias(f"{prefix}{name}") for f, name in ((F.min, "lo"), (F.max, "hi"))]


def _split_cells(points: DataFrame, dims: int, eps: float, chunk: int, max_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """``points`` (vid, v, w) with their cell, and the splits that led there: (cell, dim, start, width, slabs) of each round.

    A cell of more than ``chunk`` vectors is split along its widest coordinate into slabs of at least 4 ``eps``, and again in the
    next round, until it is small or narrow in every coordinate.
    """
    least = 4 * eps
    # the name of the first cell is no literal, so that the joins below stay joins on a key
    placed, splits = points.withColumn("cell", F.substring(F.col("vid").cast("string"), 1, 0)), []
    for _ in range(max_rounds):
        stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *_bounds("", "v", dims)).filter(F.col("n") > chunk)
        stats = stats.withColumn("side", F.zip_with("hi", "lo", lambda h, x: h - x)).withColumn("widest", F.array_max("side"))
        slabs = F.least(F.floor(F.col("widest") / least), F.ceil(2 * F.col("n") / chunk), F.lit(64)).cast("int")
        stats = stats.withColumn("slabs", slabs).filter("slabs >= 2").withColumn("dim", F.array_position("side", F.col("widest")).cast("int"))
        split = cut(stats.select("cell", "dim", F.element_at("lo", F.col("dim")).alias("start"), (F.col("widest") / F.col("slabs")).alias("width"), "slabs"))
        if split.isEmpty():
            return placed, splits
        splits.append(split)
        slab = F.least(F.greatest(F.floor((F.element_at("v", F.col("dim")) - F.col("start")) / F.col("width")), F.lit(0)), F.col("slabs") - 1)
        name = F.when(F.col("dim").isNull(), F.col("cell")).otherwise(F.concat_ws(".", "cell", slab.cast("string")))
        placed = cut(placed.join(split, "cell", "left").select("vid", "v", "w", name.alias("cell")))
    raise LibraryError(f"cells are still being split after {max_rounds} rounds")


def _route(nodes: DataFrame, splits: list[DataFrame], dims: int, margin: float) -> DataFrame:
    """Copies of ``nodes`` (with lo and hi) in every cell within ``margin`` of them, with the bounds of the cell."""
    far = lambda sign: F.array(*(F.lit(sign * float("inf")) for _ in range(dims)))
    out = nodes.withColumn("cell", F.substring(F.col("node").cast("string"), 1, 0)).withColumn("from", far(-1)).withColumn("to", far(1))
    for split in splits:
        joined = out.join(split, "cell", "left")
        at = lambda name, shift: F.least(F.greatest(F.floor((F.element_at(name, F.col("dim")) + shift - F.col("start")) / F.col("width")), F.lit(0)), F.col("slabs") - 1)
        slabs = F.when(F.col("dim").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(at("lo", -margin), at("hi", margin)))
        joined = joined.withColumn("slab", F.explode(slabs))
        edge = lambda name, k, inner: F.when(
            F.col("slab").isNull() | ~inner, F.col(name)
        ).otherwise(F.transform(name, lambda x, i: F.when(i == F.col("dim") - 1, F.col("start") + (F.col("slab") + k) * F.col("width")).otherwise(x)))
        out = joined.select(
            *nodes.columns,
            F.when(F.col("slab").isNull(), F.col("cell")).otherwise(F.concat_ws(".", "cell", F.col("slab").cast("string"))).alias("cell"),
            edge("from", 0, F.col("slab") > 0).alias("from"),
            edge("to", 1, F.col("slab") < F.col("slabs") - 1).alias("to"),
        )
    return out


def density_clusters(
    points: DataFrame, record: str, vector: str, *, dims: int, eps: float = 1.0, min_points: int = 2, chunk: int = 4000, max_rounds: int = 60
) -> DataFrame:
    """(record, cluster_id) of every record with a whole vector; ``cluster_id`` is the least record of the cluster.

    A record is a core point if ``min_points`` records, itself included, lie within ``eps`` of it in every coordinate. Core
    points within ``eps`` of each other are in one cluster; another record within ``eps`` of core points joins the one of their
    clusters whose least core point is least; what is left is a cluster of its own. The result is exact for any data.

    Records whose vector is null, has another length, or a null or NaN coordinate take no part. Repeated records count
    once (the vector that sorts first). Records with equal vectors are one weighted point, so copies cost nothing. A
    cell that is narrow in every coordinate and still holds more than ``chunk`` vectors is built into boxes chunk by chunk; where
    boxes themselves are that many, they meet block by block. An empty table gives no rows.
    """
    if min_points < 1 or eps <= 0:
        raise InputValidationError("min_points must be at least 1 and eps positive")
    clean = points.select(F.col(record).alias("r"), F.col(vector).alias("v")).filter(F.col("r").isNotNull() & (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    clean = cut(clean.groupBy("r").agg(F.min("v").alias("v")))
    kind = dict(clean.dtypes)["r"]
    vectors = cut(clean.groupBy("v").agg(F.min("r").alias("vid"), F.count(F.lit(1)).alias("w")))
    placed, splits = _split_cells(vectors.select("vid", "v", "w"), dims, eps, chunk, max_rounds)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    chunked = placed.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int")).drop("chunks")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        box, w = cliques(_matrix(pdf["v"], dims), eps), pdf["w"].to_numpy()
        vid = pdf["vid"]
        whole = np.bincount(box, w)[box] >= min_points
        node = vid.where(~whole, vid.groupby(box).transform("min"))
        return pd.DataFrame({"node": node, "dense": whole, "vid": vid, "v": pdf["v"], "w": w})

    members = cut(chunked.groupBy("cell", "chunk").applyInPandas(gather, f"node {kind}, dense boolean, vid {kind}, v array<double>, w long"))
    nodes = members.groupBy("node", "dense").agg(F.sum("w").alias("n"), *_bounds("", "v", dims))
    routed = _route(nodes, splits, dims, eps / 2 + 1e-6)
    # cells whose nodes are too many for one task meet as pairs of blocks
    per_cell = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * chunk)).cast("int").alias("blocks"))
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meeting = routed.join(per_cell, "cell").withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = meeting.withColumn("b1", F.least("home", "other")).withColumn("b2", F.greatest("home", "other")).drop("blocks", "other")

    def pairs(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Index pairs of this cell and pair of blocks, and whether their bounds prove that all members are neighbours."""
        lo, hi = _matrix(pdf["lo"], dims), _matrix(pdf["hi"], dims)
        a, b = box_pairs(lo, hi, eps)
        home, b1, b2 = pdf["home"].to_numpy(), pdf["b1"].iat[0], pdf["b2"].iat[0]
        if b1 != b2:
            keep = home[a] != home[b]
            a, b = a[keep], b[keep]
        # the cell that holds the middle between two boxes has the pair, no other
        middle = (np.maximum(lo[a], lo[b]) + np.minimum(hi[a], hi[b])) / 2
        start, end = np.array(pdf["from"].iat[0], float), np.array(pdf["to"].iat[0], float)
        keep = ((middle >= start) & (middle < end)).all(1)
        a, b = a[keep], b[keep]
        sure = (np.maximum(hi[a], hi[b]) - np.minimum(lo[a], lo[b]) <= eps + SLACK).all(1)
        return a, b, sure

    empty = lambda kinds: pd.DataFrame({c: pd.Series([], dtype=t) for c, t in kinds.items()})
    ids = {"bigint": "int64", "int": "int32"}.get(kind, "object")

    def compared(undecided: DataFrame) -> DataFrame:
        """The members of both nodes of each pair that lie within ``eps`` of the other node's bounds."""
        m = members.select("node", "vid", "v", "w")
        bounds = nodes.select("node", "lo", "hi")
        sides = []
        for own, other in (("a", "b"), ("b", "a")):
            near = undecided.join(bounds.select(F.col("node").alias(other), "lo", "hi"), other).join(m.withColumnRenamed("node", own), own)
            gap = F.zip_with(F.zip_with("v", "lo", lambda x, y: y - x), F.zip_with("v", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
            sides.append(near.filter(F.array_max(gap) <= eps + SLACK).select("a", "b", F.lit(own).alias("side"), "vid", "v", "w"))
        return sides[0].unionByName(sides[1])

    # core nodes: dense boxes, and vectors with enough neighbours; with min_points 2 any neighbour is enough
    if min_points > 2:
        core = cut(_core_nodes(meeting, members, nodes, compared, pairs, dims, eps, min_points, kind, ids, empty))
        meeting = meeting.join(core, "node", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    else:
        meeting = meeting.withColumn("core", F.lit(True))

    def tie(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = {"a": ids, "b": ids, "local": "object", "what": "object"}
        a, b, sure = pairs(pdf)
        node, is_core = pdf["node"].to_numpy(), pdf["core"].to_numpy(bool)
        if not len(a):
            return empty(kinds)
        both = is_core[a] & is_core[b]
        root = _roots(len(node), a[both & sure], b[both & sure])
        tag = f"{pdf['cell'].iat[0]}/{pdf['b1'].iat[0]}/{pdf['b2'].iat[0]}/"
        out = []
        tied = np.unique(np.concatenate([a[both & sure], b[both & sure]]))
        out.append(pd.DataFrame({"a": node[tied], "b": node[root[tied]], "local": [tag + str(x) for x in root[tied]], "what": "core"}))
        open_ = both & ~sure & (root[a] != root[b])
        out.append(pd.DataFrame({"a": node[a[open_]], "b": node[b[open_]], "local": None, "what": "undecided"}))
        for own, other in ((a, b), (b, a)):
            edge = ~is_core[own] & is_core[other]
            for yes, what in ((edge & sure, "border"), (edge & ~sure, "undecided")):
                # of several core nodes of one local cluster one is enough
                x = np.unique(np.stack([own[yes], root[other[yes]] if what == "border" else other[yes]], 1), axis=0)
                out.append(pd.DataFrame({"a": node[x[:, 0]], "b": node[x[:, 1]], "local": None, "what": what}))
        return pd.concat(out).astype({"local": object})

    met = cut(meeting.groupBy("cell", "b1", "b2").applyInPandas(tie, f"a {kind}, b {kind}, local string, what string"))
    undecided = met.filter("what = 'undecided'").select("a", "b").distinct()

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == "a"], pdf[pdf["side"] == "b"]
        if len(left) and len(right):
            x, y = _matrix(left["v"], dims), _matrix(right["v"], dims)
            for s in range(0, len(x), 256):
                if within(x[s : s + 256], y, eps).any():
                    return pdf[["a", "b"]].head(1)
        return pdf[["a", "b"]].head(0)

    decided = cut(compared(undecided).groupBy("a", "b").applyInPandas(near, f"a {kind}, b {kind}")) if not undecided.isEmpty() else undecided
    tied = decided
    if min_points > 2:
        of = core.filter("core").select("node")
        tied = decided.join(of.withColumnRenamed("node", "a"), "a", "left_semi").join(of.withColumnRenamed("node", "b"), "b", "left_semi")
    pair = F.concat_ws("~", F.col("a").cast("string"), F.col("b").cast("string"))
    edges = met.filter("what = 'core'").select("a", "local").unionByName(tied.select("a", pair.alias("local"))).unionByName(tied.select(F.col("b").alias("a"), pair.alias("local")))
    labels = components(edges, "a", "local").select(F.col("a").alias("node"), "label")
    if min_points > 2:
        border = met.filter("what = 'border'").select("a", "b").unionByName(decided.join(of.withColumnRenamed("node", "a"), "a", "left_anti").select("a", "b"))
        # core points that have only border points around them are clusters too
        labels = cut(of.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
        joined = border.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        labels = cut(labels.unionByName(joined.groupBy("node").agg(F.min("label").alias("label"))))
    # a label is the least core node and a node its least vector; a box is a cluster even without neighbours
    of_vector = members.join(labels, "node", "left").select("vid", F.coalesce("label", F.when(F.col("dense"), F.col("node"))).alias("cluster_id"))
    if min_points > 2:
        # border records may be less than the core points of their cluster
        least = of_vector.groupBy("cluster_id").agg(F.min("vid").alias("least"))
        of_vector = of_vector.join(cut(least), "cluster_id").select("vid", F.col("least").alias("cluster_id"))
    of_value = cut(vectors.select("v", "vid").join(of_vector, "vid").select("v", "cluster_id"))
    return clean.join(of_value, "v", "left").select(F.col("r").alias(record), F.coalesce("cluster_id", "r").alias("cluster_id"))


def _core_nodes(meeting, members, nodes, compared, pairs, dims, eps, min_points, kind, ids, empty) -> DataFrame:
    """(node, core): whether a node has ``min_points`` records within ``eps``."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = {"a": ids, "b": ids, "n": "int64"}
        a, b, sure = pairs(pdf)
        if not len(a):
            return empty(kinds)
        node, dense, n = pdf["node"].to_numpy(), pdf["dense"].to_numpy(bool), pdf["n"].to_numpy()
        total = np.bincount(a[sure], n[b[sure]], len(node)) + np.bincount(b[sure], n[a[sure]], len(node))
        own = np.flatnonzero(total)
        open_ = ~sure & ~(dense[a] & dense[b])
        return pd.concat([pd.DataFrame({"a": node[own], "b": node[own], "n": total[own].astype(np.int64)}), pd.DataFrame({"a": node[a[open_]], "b": node[b[open_]], "n": -1})])

    def neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == "a"], pdf[pdf["side"] == "b"]
        if not len(left) or not len(right):
            return empty({"node": ids, "n": "int64"})
        near = within(_matrix(left["v"], dims), _matrix(right["v"], dims), eps)
        # a node without a box is one vector; the count of the others does not matter
        return pd.DataFrame({"node": [pdf["a"].iat[0], pdf["b"].iat[0]], "n": [int((near @ right["w"].to_numpy()).max()), int((near.T @ left["w"].to_numpy()).max())]})

    counted = cut(meeting.groupBy("cell", "b1", "b2").applyInPandas(count, f"a {kind}, b {kind}, n long"))
    sure = counted.filter("n >= 0").select(F.col("a").alias("node"), "n")
    more = compared(counted.filter("n < 0").select("a", "b").distinct()).groupBy("a", "b").applyInPandas(neighbours, f"node {kind}, n long")
    total = nodes.select("node", "n").unionByName(sure).unionByName(more).groupBy("node").agg(F.sum("n").alias("n"))
    return nodes.select("node", "dense").join(total, "node").select("node", (F.col("dense") | (F.col("n") >= min_points)).alias("core"))


def describe_clusters(clusters: DataFrame, points: DataFrame, record: str, vector: str, *, dims: int, typical: int = 3) -> DataFrame:
    """Per cluster its size, medoid and ``typical`` most typical members.

    The medoid is the member with the least sum of squared distances to all members, which is the one nearest to the
    cluster's mean; so medoids need no pairs. Ties go to the least record.
    """
    full = clusters.join(points.select(record, F.col(vector).alias("v")), record)
    means = cut(full.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"), F.array(*(F.avg(F.col("v")[i]) for i in range(dims))).alias("mean")))
    gap = F.aggregate(F.zip_with("v", "mean", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
    ranked = full.join(means, "cluster_id").select("cluster_id", "n_members", record, F.round(F.sqrt(gap), 9).alias("gap"))
    top = ranked.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy("gap", record))).filter(F.col("place") <= typical)
    return top.groupBy("cluster_id").agg(
        F.max("n_members").alias("n_members"),
        F.min(F.when(F.col("place") == 1, F.col(record))).alias("medoid"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(record).alias("x")))), lambda s: s["x"].cast("string"))).alias("typical_members"),
        F.max("gap").alias("largest_gap"),
    )
