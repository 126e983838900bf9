"""Connected components of a bipartite record-entity graph by iterative minimum-label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import LibraryError
from panelforge.core.session import cut, release
from panelforge.functions.exprs import splittable_join


def components(edges: DataFrame, record: str, entity: str, *, max_rounds: int = 60) -> DataFrame:
    """(record, label) where two records have one label if a chain of shared entities ties them.

    The label is the least record of the component; records without an edge to a shared entity are their own label.
    Each round sends the least label of an entity's records to all of them and then follows the label of the label,
    which halves long chains. An entity is reduced with partial aggregation and joined back as one row by joins that
    split hot keys, so an entity with a third of all records costs no more than its edges. Labels are written to the shared folder after each
    round; only the number of changed rows reaches the driver. Null records or entities make no edge; repeated edges
    count once; an empty table gives no rows.
    """
    base = edges.select(F.col(record).alias("r"), F.col(entity).alias("e")).filter("r IS NOT NULL AND e IS NOT NULL").distinct()
    base = cut(base)
    shared = base.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    ties = cut(splittable_join(base, shared, ["e"], "left_semi"))
    first = ties.groupBy("e").agg(F.min("r").alias("l"))
    labels = cut(splittable_join(ties, first, ["e"]).groupBy("r").agg(F.min("l").alias("l")))
    for _ in range(max_rounds):
        least = ties.join(labels, "r").groupBy("e").agg(F.min("l").alias("l"))
        spread = splittable_join(ties, least, ["e"]).groupBy("r").agg(F.min("l").alias("l"))
        ahead = labels.select(F.col("r").alias("l"), F.col("l").alias("further"))
        moved = splittable_join(spread, ahead, ["l"], "left").select("r", F.least("l", F.coalesce("further", "l")).alias("l"))
        marked = moved.join(labels.withColumnRenamed("l", "old"), "r").select("r", "l", (F.col("l") != F.col("old")).alias("changed"))
        new = cut(marked)
        release(labels)
        labels = new.select("r", "l")
        labels._panelforge_path = new._panelforge_path
        if new.filter("changed").isEmpty():
            break
    else:
        raise LibraryError(f"labels still change after {max_rounds} rounds")
    release(ties)
    records = base.select("r").distinct()
    return records.join(labels, "r", "left").select(F.col("r").alias(record), F.coalesce("l", "r").alias("label"))
