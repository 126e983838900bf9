"""Incremental arrival of panel rows with Structured Streaming: deliveries are merged into the newest row per key.

The engine this one stands in for has no streaming; late and repeated deliveries are part of its data, so this is the
streaming form of keep-first and of the missing-rate profile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.exprs import is_missing, quoted


def read_deliveries(spark: SparkSession, folder: str, schema: T.StructType, *, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def distinct_deliveries(stream: DataFrame, keys: Sequence[str], time: str, late: str = "7 days") -> DataFrame:
    """One row per key; repeats within ``late`` of the watermark are dropped, and state older than that is forgotten."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_missing_rate(stream: DataFrame, columns: Sequence[str], time: str, *, window: str = "30 days", late: str = "7 days", codes: Sequence[float] = ()) -> DataFrame:
    """Rows and missing counts per time window; rows later than the watermark are left out."""
    counts = [F.count_if(is_missing(stream, c, codes)).alias(f"missing_{c}") for c in columns]
    out = stream.withWatermark(time, late).groupBy(F.window(quoted(time), window).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    return out.select(F.col("w.start").alias("window_start"), "n_rows", *(f"missing_{c}" for c in columns))
