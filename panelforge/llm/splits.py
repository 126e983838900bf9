"""Splits that keep related records together (problem 4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.functions.exprs import splittable_join
from panelforge.llm.graph import components
from panelforge.operators.ranks import exact_rank


def related_groups(records: DataFrame, record: str, ties: DataFrame, family: str, more: DataFrame | None = None, more_entity: str | None = None) -> DataFrame:
    """(record, group_id): records of one family or of families tied through further entities share a group.

    ``ties`` has (record, family), ``more`` (family, entity). Families are the records of the bipartite graph; the
    entities that ``more`` names and the records that belong to several families connect them. The group id is the
    least record of the group. A record without any family is a group of its own; null records get none.
    """
    of = ties.select(F.col(record).alias("rec"), F.col(family).alias("fam")).filter("rec IS NOT NULL AND fam IS NOT NULL").distinct()
    edges = of.select("fam", F.concat(F.lit("r:"), F.col("rec").cast("string")).alias("entity"))
    if more is not None:
        edges = edges.unionByName(more.select(F.col(family).alias("fam"), F.concat(F.lit("e:"), F.col(more_entity).cast("string")).alias("entity")))
    labels = components(edges, "fam", "entity")
    labelled = of.join(labels, "fam").groupBy("rec").agg(F.min("label").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rec").alias("group_id"))
    grouped = splittable_join(labelled, least, ["label"]).select("rec", "group_id")
    every = records.select(F.col(record).alias("rec")).filter("rec IS NOT NULL").distinct()
    return every.join(grouped, "rec", "left").select(F.col("rec").alias(record), F.coalesce("group_id", "rec").alias("group_id"))


def _fill(n: int, deficits: list[float]) -> list[int]:
    """``n`` deals in whole numbers in proportion to the positive ``deficits`` (largest remainders first)."""
    wanted = [max(0.0, x) for x in deficits]
    total = sum(wanted)
    exact = [n * x / total for x in wanted] if total > 0 else [n / len(wanted)] * len(wanted)
    out = [int(x) for x in exact]
    for j in sorted(range(len(out)), key=lambda j: (out[j] - exact[j], j))[: n - sum(out)]:
        out[j] += 1
    return out


def _deal(kinds: list[tuple[tuple[int, ...], int]], shares: list[float], totals: list[float]) -> list[list[int]]:
    """How many groups of each kind (rows per label, number of groups) go to each split.

    Whole quotas first, then the rest, large groups first, each to the split where the sum over labels of the squared
    relative gaps shrinks most.
    """
    k = len(shares)
    placed = [[0.0] * len(totals) for _ in range(k)]
    counts = [[0] * k for _ in kinds]

    def put(index: int, j: int, n: int = 1) -> None:
        counts[index][j] += n
        for i, v in enumerate(kinds[index][0]):
            placed[j][i] += v * n

    order = sorted(range(len(kinds)), key=lambda i: (-sum(kinds[i][0]), kinds[i][0]))
    for index in order:
        for j in range(k):
            put(index, j, int(kinds[index][1] * shares[j]))
    weight = [1 / max(1, t) ** 2 for t in totals]
    for index in order:
        vector, n = kinds[index]
        for _ in range(n - sum(counts[index])):
            gains = []
            for j in range(k):
                gain = 0.0
                for i, v in enumerate(vector):
                    if v:
                        gap = shares[j] * totals[i] - placed[j][i]
                        gain += weight[i] * (gap * gap - (gap - v) ** 2)
                gains.append(gain / max(shares[j], 1e-9))
            put(index, max(range(k), key=lambda j: (gains[j], -j)))
    return counts


def assign_splits(rows: DataFrame, group: str, label: str, shares: dict[str, float], *, block: int = 50_000) -> DataFrame:
    """``rows`` with a column ``split``; all rows of a group get one split.

    Groups are described by their rows per label; groups with equal vectors are one kind. Kinds are dealt to the splits in
    blocks of about ``block`` of them, one task each, so that the label distribution of every split deviates least within
    each block; kinds of one row, one a label, come last and fill what all blocks together left open. Which
    groups of a kind go where follows their exact hash rank. A null label is a label of its own; rows without a
    group get no split. Shares are scaled to sum to 1. Other columns of ``rows`` stay as they are; one named ``split`` is
    refused, and so are more than 50 labels. An empty table gives no rows.
    """
    if not shares or min(shares.values()) <= 0:
        raise InputValidationError("shares must be positive")
    if "split" in rows.columns:
        raise InputValidationError("column 'split' exists already")
    names = sorted(shares)
    scaled = [shares[n] / sum(shares.values()) for n in names]
    own = rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("(none)")).alias("l"))
    labels = sorted(r["l"] for r in own.select("l").distinct().limit(51).collect())
    if len(labels) > 50:
        raise InputValidationError("stratify by a label of at most 50 values")
    if not labels:
        return rows.withColumn("split", F.lit(None).cast("string"))
    fields = [f"n{i}" for i in range(len(labels))]
    vectors = cut(own.groupBy("g").agg(*(F.count_if(F.col("l") == x).alias(f) for f, x in zip(fields, labels))))
    kinds = cut(vectors.groupBy(*fields).agg(F.count(F.lit(1)).alias("groups")).withColumn("size", sum((F.col(f) for f in fields), F.lit(0))))
    n = F.col("groups")
    many = F.col("size") > 1
    sums = kinds.agg(
        F.sum(n).alias("groups"), F.count_if(many).alias("kinds"), F.sum(F.when(many, F.col("size") * n)).alias("rows"),
        *(F.sum(F.col(f) * n).alias(f) for f in fields), *(F.coalesce(F.sum(F.when(~many, F.col(f) * n)), F.lit(0)).alias(f"s_{f}") for f in fields),
    ).first()
    singles = [sums[f"s_{f}"] for f in fields]
    n_blocks = max(1, -(-sums["kinds"] // block))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = list(zip(pdf[fields].itertuples(index=False, name=None), pdf["groups"].tolist()))
        inside = sum(sum(v) * m for v, m in listed)
        # a block counts on its part of the single rows
        totals = [sum(v[i] * m for v, m in listed) + singles[i] * inside / sums["rows"] for i in range(len(fields))]
        return pdf[fields].assign(counts=_deal(listed, scaled, totals))

    schema = ", ".join(f"{f} long" for f in fields) + ", counts array<long>"
    blocks = kinds.filter(many).withColumn("block", F.pmod(F.xxhash64(*fields), F.lit(n_blocks)).cast("int"))
    dealt = cut(blocks.groupBy("block").applyInPandas(deal, schema))
    placed = dealt.agg(*(F.coalesce(F.sum(F.col(f) * F.col("counts")[j]), F.lit(0)).alias(f"{f}_{j}") for f in fields for j in range(len(names)))).first()
    filled = []
    for i, f in enumerate(fields):
        if singles[i]:
            counts = _fill(singles[i], [scaled[j] * sums[f] - placed[f"{f}_{j}"] for j in range(len(names))])
            filled.append((*(int(i == x) for x in range(len(fields))), counts))
    dealt = dealt.unionByName(rows.sparkSession.createDataFrame(filled, schema))
    ranked = exact_rank(vectors, fields, ["g"], rows=sums["groups"])
    # the split whose share of the kind's ranks holds the rank
    ends = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda k: F.aggregate(F.slice("counts", 1, k), F.lit(0).cast("long"), lambda a, x: a + x))
    place = F.size(F.filter(ends, lambda end: end <= F.col("rank")))
    chosen = splittable_join(ranked, dealt, fields).select(F.col("g").alias("__g"), F.get(F.array(*map(F.lit, names)), place).alias("split"))
    return rows.join(chosen, rows[group] == F.col("__g"), "left").drop("__g")
