"""Mean pooling of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """keys, pos, mean: the average at each position over a group's vectors.

    One grouped average over exploded positions: partial sums before the shuffle.
    """
    return rows.select(*keys, F.posexplode(vector).alias("pos", "__x")).groupBy(*keys, "pos").agg(F.avg(F.col("__x").cast("double")).alias("mean"))


def pooled(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """keys, embedding: the averages as one array."""
    each = mean_pool(rows, keys, vector)
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("embedding"))
