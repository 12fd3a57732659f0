"""Removal of repeated strings and graphs within a program.

The survivor is the first by an order column. It is found by a grouped minimum over a
digest of the content, not by a window: partial minima are taken before the shuffle, so
a program or a text that holds a third of all rows loads no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*content: Column) -> Column:
    """SHA-256 of values with their lengths, so that different values never run together; null counts as a value of its own."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in content]
    return F.sha2(F.concat_ws("|", *parts), 256)


def survivors(rows: DataFrame, within: Sequence[str], content: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """All columns of the first row of each content in each group."""
    cols = [F.col(c) if isinstance(c, str) else c for c in content]
    first = F.min(F.struct(*order, F.struct(*[c for c in rows.columns if c not in within and c not in order]).alias("rest")))
    kept = rows.withColumn("__digest", digest(*cols)).groupBy(*within, "__digest").agg(first.alias("f"))
    return kept.select(*within, *[F.col(f"f.{c}") for c in order], "f.rest.*").select(*rows.columns)


def dedup_strings(strings: DataFrame, value_only: bool = False, strict: bool = False, within: Sequence[str] = ("binary",), name: str = "name", text: str = "text", order: Sequence[str] = ("path",)) -> DataFrame:
    """First of each (name, text) in a program, or with `value_only` of each text.

    strict: `value_only` compares names as well, as earlier tools did.
    """
    content = [text] if value_only and not strict else [name, text]
    return survivors(strings, within, content, order)


def dedup_graphs(graphs: DataFrame, within: Sequence[str] = ("binary",), graph: str = "graph", order: Sequence[str] = ("path",)) -> DataFrame:
    """First of each graph (adjacency and nodes) in a program, compared as canonical JSON."""
    return survivors(graphs, within, [F.to_json(graph)], order)


def duplicates(rows: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that did not survive: what an in-place run would delete. Input is never deleted."""
    return rows.join(kept.select(*keys), list(keys), "left_anti")


def statistics(rows: DataFrame, within: Sequence[str], content: Sequence[Column | str]) -> DataFrame:
    """within, before, after, removed, percent (single precision) of each group."""
    cols = [F.col(c) if isinstance(c, str) else c for c in content]
    each = rows.withColumn("__digest", digest(*cols)).groupBy(*within, "__digest").agg(F.count("*").alias("n"))
    out = each.groupBy(*within).agg(F.sum("n").alias("before"), F.count("*").alias("after"))
    gone = F.col("before") - F.col("after")
    return out.select(*within, "before", "after", gone.alias("removed"), ((gone.cast("float") / F.col("before").cast("float")).cast("float") * F.lit(100.0).cast("float")).cast("float").alias("percent"))
