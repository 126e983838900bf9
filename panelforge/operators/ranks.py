"""Exact ranks and prefix counts within groups, however large one group is: nothing sorts a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.functions.exprs import numeric, quoted


def exact_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], *, seed: int | None = None, rank: str = "rank", rows: int | None = None) -> DataFrame:
    """``df`` with the rank (from 0) of each row within ``group`` in the order of a hash of ``order`` (and ``seed``), and a
    column ``group_size``.

    Rows are ranked within hash buckets of their group, and the counts of the group's preceding buckets are added; what
    is kept per group is one count per bucket. There are 64 buckets, or more, so that even a group of all ``rows`` (counted
    unless given) has some 50 000 in each. Null group values are a group; rows that are equal in ``order`` are ranked in any order.
    """
    if {rank, "group_size"} & set(df.columns):
        raise InputValidationError(f"columns {rank!r} and 'group_size' must not exist yet")
    keys = [F.col(quoted(c)) for c in order] + ([F.lit(seed)] if seed is not None else [])
    bits = max(6, ((df.count() if rows is None else rows) // 50_000).bit_length())
    hashed = df.withColumn("__h", F.xxhash64(*keys)).withColumn("__b", F.shiftright("__h", 64 - bits))
    sizes = hashed.groupBy(*map(quoted, group), "__b").agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*map(quoted, group))
    sizes = sizes.select(
        *(F.col(quoted(c)).alias(f"__g{i}") for i, c in enumerate(group)),
        F.col("__b").alias("__sb"),
        F.coalesce(F.sum("__n").over(own.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(own).alias("group_size"),
    )
    ranked = hashed.withColumn("__r", F.row_number().over(Window.partitionBy(*map(quoted, group), "__b").orderBy("__h", *map(quoted, order))) - 1)
    on = [F.col(quoted(c)).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)] + [F.col("__b") == F.col("__sb")]
    joined = ranked.join(sizes, on, "inner")
    return joined.select(*(F.col(quoted(c)) for c in df.columns), (F.col("__r") + F.col("__before")).cast("long").alias(rank), "group_size")


def prefix_counts(counts: DataFrame, group: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Distinct (group, value) rows with ``{s}_before`` and ``{s}_all`` for each count column: the group's sums over smaller
    values and over all.

    The rows are range-sorted by (group, value) and written with the number of their range; a window adds up within a
    range, and the totals of the group's earlier ranges, a row each, are joined in. A range is as large as a
    partition, so a group of any size is spread over many tasks.
    """
    order = [*group, value]
    ranged = cut(counts.repartitionByRange(*map(quoted, order)).withColumn("__part", F.spark_partition_id()))
    local = Window.partitionBy("__part", *map(quoted, group)).orderBy(quoted(value)).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.select("*", *(F.coalesce(F.sum(quoted(s)).over(local), F.lit(0)).alias(f"__in_{s}") for s in sums))
    totals = ranged.groupBy("__part", *map(quoted, group)).agg(*(F.sum(quoted(s)).alias(f"__t_{s}") for s in sums))
    own = Window.partitionBy(*map(quoted, group))
    earlier = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__part").alias("__opart"),
        *(F.col(quoted(c)).alias(f"__g{i}") for i, c in enumerate(group)),
        *(F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__off_{s}") for s in sums),
        *(F.sum(f"__t_{s}").over(own).alias(f"{s}_all") for s in sums),
    )
    on = [F.col("__part") == F.col("__opart")] + [F.col(quoted(c)).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    joined = inner.join(offsets, on)
    return joined.select(*(F.col(quoted(c)) for c in counts.columns), *((F.col(f"__in_{s}") + F.col(f"__off_{s}")).alias(f"{s}_before") for s in sums), *(f"{s}_all" for s in sums))


def exact_quantiles(counts: DataFrame, group: Sequence[str], value: str, n: str, shares: Sequence[float], *, midpoint: bool = True) -> DataFrame:
    """(group, q0, q1, ...) from distinct (group, value, n) rows: for each share the value at it, by linear interpolation
    between neighbours (``midpoint``) or the least value that the share of all does not exceed."""
    placed = prefix_counts(counts, group, value, [n])
    lo, total = F.col(f"{n}_before"), F.col(f"{n}_all")
    hi = lo + F.col(quoted(n)) - 1  # ranks from 0 that the value takes
    v = F.col(quoted(value))
    made = []
    for i, q in enumerate(shares):
        if midpoint:
            at = (total - 1) * F.lit(float(q))
            below, above = F.floor(at), F.ceil(at)
            a = F.max(F.when((lo <= below) & (hi >= below), v))
            b = F.max(F.when((lo <= above) & (hi >= above), v))
            part = F.max(at - below)
            made.append((a + (b - a) * part).alias(f"q{i}"))
        else:
            at = F.greatest(F.ceil(total * F.lit(float(q))) - 1, F.lit(0))
            made.append(F.max(F.when((lo <= at) & (hi >= at), v)).alias(f"q{i}"))
    return placed.groupBy(*map(quoted, group)).agg(*made)


def column_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, q0, q1, ...): exact quantiles of the numbers in each column, all columns in one pass over counts per value."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), numeric(df, c).alias("value")) for c in columns))
    rows = df.select(F.explode(cells).alias("x")).select("x.*").filter("value IS NOT NULL")
    return exact_quantiles(rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), ["column"], "value", "n", shares)
