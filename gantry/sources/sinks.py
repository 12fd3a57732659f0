"""Writers. All write folders of part files; nothing is collected, and input is never deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.functions import paths

# Endings of output names, by (format, p-code kind, pairs).
PCODE_NAMES = {("single", "func", False): "-pcode-singles.txt", ("single", "func", True): "-pcode-pairs.txt", ("funcstring", "func", False): "-pcode-funcstrings.json", ("single", "bb", False): "-pcode-singles.txt", ("single", "bb", True): "-pcode-pairs.txt", ("funcstring", "bb", False): "-pcode-funcstrings-bb-metadata.json"}
GRAPH_SUFFIXES = {None: "", "finfo": "-meta", "tiknib": "-tiknib", "finfo-tiknib": "-finfo-tiknib"}


def pcode_name(form: str, kind: str, pairs: bool = False) -> str:
    key = (form, kind, pairs and form == "single")
    if key not in PCODE_NAMES:
        raise ValueError(f"no p-code output of format {form!r} and kind {kind!r}")
    return PCODE_NAMES[key]


def write_lines(rows: DataFrame, path: str, text: str = "text", by: str | None = "binary") -> None:
    """One text a line; a folder for each program. An existing output is left as it is."""
    out = rows.select(*([by] if by else []), F.col(text).alias("value"))
    writer = out.write.mode("ignore")
    (writer.partitionBy(by) if by else writer).text(path)


def write_graphs(graphs: DataFrame, path: str, variant: str, metadata: str | None = None, by: str = "binary", name: str = "func") -> None:
    """One graph a line as JSON with its file name, a folder for each program.

    Long names are shortened; plain and finfo graphs lose characters that file names can't have.
    """
    base = paths.shortened(F.col(name))
    if metadata in (None, "finfo"):
        base = paths.stripped(base)
    file = F.concat(base, F.lit(f"-{variant}{GRAPH_SUFFIXES[metadata]}.json"))
    graphs.select(by, file.alias("file"), "graph").write.mode("ignore").partitionBy(by).json(path)


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("ignore")
    (writer.partitionBy(by) if by else writer).json(path)


def write_bytes(functions: DataFrame, path: str, name: str = "name", data: str = "bytes") -> None:
    """binary, file, bytes of each function as Parquet; the first of equal file names stays."""
    file = F.concat(paths.sanitised(F.col(name)), F.lit(".bin"))
    rows = functions.withColumn("file", file).groupBy("binary", "file").agg(F.min_by(F.unhex(F.col(data)), F.col("func_idx")).alias("bytes"))
    rows.write.mode("ignore").parquet(path)


def new_only(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose output doesn't exist yet."""
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti")
