"""Function metadata: subsets, block averages over functions, and positional combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.operators import blocks as B

# Columns of the subsets and their defaults.
SUBSET = ("name", "ninstrs", "edges", "indegree", "outdegree", "nlocals", "nargs", "signature")
NULL_TO_ZERO = ("indegree", "outdegree", "nlocals", "nargs")
DEFAULT = {"name": "", "ninstrs": 0, "edges": 0, "indegree": 0, "outdegree": 0, "nlocals": 0, "nargs": 0, "signature": ""}
COMBINED = ("edges", "indegree", "outdegree", "nlocals", "nargs")
TIKNIB_DEFAULT = {"name": "default"} | {f"{a}_{n}": 0.0 for a in ("avg", "sum") for n in B.TIKNIB}


def float_ratio(a: Column, b: Column) -> Column:
    """a / b in single precision: NaN for 0/0 and infinities for x/0."""
    x, y = a.cast("float"), b.cast("float")
    by_zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)).cast("float")


def subset(info: DataFrame, extended: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The columns that graphs carry; extended: blocks and instructions a block instead of the signature."""
    cols = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in NULL_TO_ZERO else F.col(c) for c in SUBSET[:-1]]
    more = [F.col("nbbs"), float_ratio(F.col("ninstrs"), F.col("nbbs")).alias("avg_ins_bb")] if extended else [F.col("signature")]
    return info.select(*keep, *cols, *more)


def block_statistics(vectors: Column, names: Sequence[str] = B.TIKNIB, fixed: bool = False) -> Column:
    """Averages and sums, in single precision, of blocks' vectors: struct avg_*, sum_*.

    avg_compare repeats avg_arithshift, which data sets made with earlier tools rely on;
    `fixed` gives its own average. Without blocks the averages are NaN and the sums 0.
    """
    total = lambda i: F.aggregate(vectors, F.lit(0.0).cast("float"), lambda a, v: (a + F.get(v, F.lit(i)).cast("float")).cast("float"))
    place = {n: i for i, n in enumerate(names)}
    if not fixed and "compare" in place and "arithshift" in place:
        place["compare"] = place["arithshift"]
    means = [float_ratio(total(place[n]), F.size(vectors)).alias(f"avg_{n}") for n in names]
    return F.struct(*means, *[total(i).alias(f"sum_{n}") for i, n in enumerate(names)])


def tiknib_functions(functions: DataFrame, arch: Column | None = None, fixed: bool = False) -> DataFrame:
    """binary, func_idx, name, features of every function with a known architecture."""
    arch = F.col("arch") if arch is None else arch
    vectors = F.transform("blocks", lambda b: B.tiknib(b, arch))
    out = functions.withColumn("__v", vectors).filter(F.forall("__v", lambda v: v.isNotNull()))
    return out.select("binary", "func_idx", "name", block_statistics(F.col("__v"), fixed=fixed).alias("features"))


def group_statistics(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Flat form: average and sum of each value by key, as floats."""
    aggs = [F.avg(v).cast("float").alias(f"avg_{v}") for v in values] + [F.sum(v).cast("float").alias(f"sum_{v}") for v in values]
    return rows.groupBy(*keys).agg(*aggs)


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], place: str = "func_idx") -> DataFrame:
    """Rows of two tables at the same place of the same program; the longer one is cut.

    Both sides carry their place from the file's array, so this is an equi-join.
    """
    return left.join(right, [*keys, place])


def combined(info: DataFrame, tiknib: DataFrame, by_name: bool = False) -> DataFrame:
    """binary, name, five columns of the metadata and the averages and sums; by position or by name.

    The name is the metadata's. Neither side's instruction count is kept.
    """
    meta = subset(info, keep=("binary", "func_idx")).select("binary", "func_idx", "name", *COMBINED)
    feats = tiknib.select("binary", "func_idx", "name", "features.*")
    if by_name:
        first = feats.groupBy("binary", "name").agg(F.min_by(F.struct(*[c for c in feats.columns if c not in ("binary", "name", "func_idx")]), F.col("func_idx")).alias("f"))
        return meta.join(first, ["binary", "name"]).select("binary", "func_idx", "name", *COMBINED, "f.*")
    return zipped(meta, feats.drop("name"), ["binary"])


def zip_files(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs of two sorted path lists of equal length."""
    if len(left) != len(right):
        raise ValueError(f"{len(left)} files on one side and {len(right)} on the other")
    return list(zip(sorted(left), sorted(right)))
