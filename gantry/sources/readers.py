"""Scans of disassembler JSON: one row per function, with its binary and its place in the file.

A file is one JSON document, so it is one row of text and has to fit in a task. Large
inputs are best staged once: `stage` writes parsed rows as Parquet, where later runs get
column pruning and row-group filters. A file that can't be parsed, or lacks a required
field, is left out and listed by `unreadable`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.functions import paths, text
from gantry.operators.blocks import once
from gantry.sources import schemas

# What a file's name tells about its content, and what each command accepts.
FRAGMENTS = {"_reg.json": "registers", "_xrefs.json": "crossrefs", "_cg.json": "callgraph", "_cfg.json": "controlflow", "_finfo.json": "function_info", "_pcode-func.json": "pcode", "_pcode-bb.json": "pcode"}
ACCEPTED = {"cfg": ("controlflow", "pcode"), "cg": ("callgraph",), "metadata_finfo": ("function_info",), "metadata_tiknib": ("controlflow",), "nlp": ("controlflow", "pcode")}


def validate(path: str, command: str) -> None:
    """Raise unless the path is a JSON file of a kind that the command takes."""
    if not path.endswith(".json"):
        raise ValueError(f"{path} is no JSON file")
    kind = next((k for part, k in FRAGMENTS.items() if part in path), "")
    if kind not in ACCEPTED.get(command, ()):
        raise ValueError(f"{path} ({kind or 'of an unknown kind'}) doesn't fit {command}, which takes {', '.join(ACCEPTED.get(command, ('nothing',)))}")


def listing(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """path, modified, size of all files below a folder whose names end in `<suffix>.json`; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}.json").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def binaries(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of all files below a folder that aren't JSON."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(~F.col("path").endswith(".json")).select("path", F.col("length").alias("size"))


def documents(spark: SparkSession, path: str | list[str], suffix: str | None = None) -> DataFrame:
    """path, document: whole files as text."""
    reader = spark.read.option("wholetext", True)
    if suffix is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}.json")
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def binary_of(path: Column) -> Column:
    """Name of the binary: the file's name without its mode suffix."""
    modes = "|".join(re.escape(m) for m in sorted(schemas.MODES, key=len, reverse=True))
    return F.regexp_replace(paths.stem(path), F.lit(rf"_(?:{modes}|xrefs)(?:_annotations)?$"), F.lit(""))


def jump_target(text: Column) -> Column:
    """-1 where it is missing, 0 where it is no 64-bit number."""
    return F.when(text.isNull(), F.lit(-1).cast("bigint")).otherwise(F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint")))


def _block(b: Column) -> Column:
    minus = F.lit(-1).cast("bigint")
    return F.struct(F.coalesce(b["offset"], minus).alias("offset"), jump_target(b["jump"]).alias("jump"), F.coalesce(b["fail"], minus).alias("fail"), b["size"].alias("size"), b["switchop"].alias("switchop"), F.coalesce(b["ops"], F.array().cast(f"array<{schemas.OP}>")).alias("ops"))


def parse(files: DataFrame, mode: str) -> DataFrame:
    """Rows of documents of a mode.

    Arrays give path, binary, func_idx and the fields; maps give path, binary, name and
    value. Control-flow functions have parsed jumps, and -1 for missing offsets and fails.
    """
    schema, shape = schemas.MODES[mode]
    head = [F.col("path"), binary_of(F.col("path")).alias("binary")]
    if shape == "map":
        return files.select(*head, F.explode(_document(mode)).alias("name", "value"))
    # A filter on the parsed document would parse it anew: one that is left out is null instead, which gives no rows.
    whole = once(_document(mode), lambda d: F.when(F.forall(d, lambda r: _complete(r, mode)), d))
    rows = files.select(*head, F.posexplode(whole).alias("func_idx", "r"))
    if shape == "rows":
        return rows.select("path", "binary", "func_idx", "r.*")
    rows = rows.select("path", "binary", "func_idx", F.get("r", F.lit(0)).alias("f")).filter("f is not null")
    return rows.select("path", "binary", "func_idx", "f.*").withColumn("blocks", F.transform("blocks", _block))


def _document(mode: str) -> Column:
    """The parsed document; control flow that the tool printed as one array after another is put together first."""
    schema, _ = schemas.MODES[mode]
    plain = F.from_json("document", schema)
    return F.coalesce(plain, F.from_json(text.repaired_json(F.col("document")), schema)) if mode == "cfg" else plain


def _complete(r: Column, mode: str) -> Column:
    r = F.get(r, F.lit(0)) if mode == "cfg" else r
    ok = F.lit(True)
    for c in schemas.REQUIRED.get(mode, ()):
        ok = ok & r[c].isNotNull()
    return ok


def unreadable(files: DataFrame, mode: str) -> DataFrame:
    """Paths of documents that `parse` leaves out."""
    schema, shape = schemas.MODES[mode]
    parsed = files.withColumn("d", _document(mode))
    bad = F.col("d").isNull()
    if shape != "map":
        bad = bad | ~F.coalesce(F.forall("d", lambda r: _complete(r, mode)), F.lit(True))
    return parsed.filter(bad).select("path")


def read(spark: SparkSession, path: str | list[str], mode: str, recursive: bool = False) -> DataFrame:
    """Rows of a file, of files, or of all files of a mode below a folder."""
    return parse(documents(spark, path, f"_{mode}" if recursive and mode not in ("efs", "dfs", "tiknib") else f"-{mode}" if recursive else None), mode)


def read_graphs(spark: SparkSession, folder: str, node: str, layout: str) -> DataFrame:
    """path, binary, graph of all graph files below a folder; unreadable and empty graphs are left out."""
    if node not in schemas.NODES:
        raise ValueError(f"unknown node type {node!r}: one of {', '.join(schemas.NODES)}")
    files = documents(spark, folder, "").withColumn("graph", F.from_json("document", schemas.graph(schemas.NODES[node])))
    kept = files.filter(F.col("graph").isNotNull() & (F.size("graph.nodes") > 0))
    return kept.select("path", paths.program(F.col("path"), layout).alias("binary"), "graph")


def read_strings(spark: SparkSession, folder: str, suffix: str = "efs") -> DataFrame:
    """path, binary, arch, name, text of all function-string files below a folder."""
    rows = parse(documents(spark, folder, suffix), "efs")
    program, arch = paths.string_file_parts(paths.file_name(F.col("path")))
    return rows.select("path", program.alias("binary"), arch.alias("arch"), "name", F.col("value").alias("text"))


def stage(rows: DataFrame, path: str) -> DataFrame:
    """Write parsed rows as Parquet, partitioned by nothing and clustered by binary, and read them back."""
    rows.write.mode("ignore").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
