"""The commands: one function each, from input paths to result tables or written output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.operators import blocks, corpus, dedup, graphs, metadata, tokeniser
from gantry.sources import readers, schemas, sinks

TEXT_FEATURES = ("disasm", "esil", "pseudo")


def extract(spark: SparkSession, path: str, modes: list[str]) -> dict[str, DataFrame]:
    """Rows of files that a disassembler has written, by mode. The disassembler itself runs outside."""
    unknown = [m for m in modes if m not in schemas.MODES]
    if unknown:
        raise ValueError(f"unknown modes {unknown}: {', '.join(schemas.MODES)}")
    return {m: readers.read(spark, path, m, recursive=True) for m in modes}


def with_arch(functions: DataFrame) -> DataFrame:
    """Functions with their binary's architecture; the small table joins as the planner sees fit."""
    return functions.join(blocks.detect_architecture(functions), "binary", "left")


def cfg_graphs(functions: DataFrame, feature: str, min_blocks: int = 5) -> DataFrame:
    """binary, name, graph. Text features are always register-masked."""
    if feature in TEXT_FEATURES:
        return graphs.attributed_cfg(functions, feature, min_blocks, arch=F.lit(None), texts=lambda b: corpus.block_texts(b, feature, True))
    return graphs.attributed_cfg(with_arch(functions), feature, min_blocks)


def call_graphs(entries: DataFrame, variant: str = "cg", include_unk: bool = False, meta: DataFrame | None = None, kind: str | None = None, strict: bool = False) -> DataFrame:
    """binary, func, graph for each function; kind: finfo, tiknib or finfo-tiknib nodes from `meta`.

    strict: repeated names are nodes of their own, as earlier tools built them.
    """
    if strict:
        nodes, edges = graphs.strict_graph(entries, variant, include_unk)
    else:
        edges = graphs.local_edges(graphs.calls(entries, include_unk), variant, include_unk)
        nodes = graphs.local_nodes(edges, entries)
    key = "key" if strict else "name"
    if kind is None:
        return graphs.graph_documents(nodes, edges, key=key)
    columns, defaults, into = node_metadata(kind)
    described = graphs.attach(nodes, meta, columns, defaults, into=into)
    return graphs.graph_documents(described, edges, attributes=[into], key=key)


def node_metadata(kind: str) -> tuple[list[str], dict, str]:
    """(columns, defaults, name of the node's struct) of a metadata kind."""
    if kind == "finfo":
        return list(metadata.SUBSET[1:]), metadata.DEFAULT, "functionFeatureSubset"
    tiknib = [c for c in metadata.TIKNIB_DEFAULT if c != "name"]
    if kind == "tiknib":
        return tiknib, metadata.TIKNIB_DEFAULT, "features"
    if kind == "finfo-tiknib":
        return [*metadata.COMBINED, *tiknib], {"name": "", **dict.fromkeys(metadata.COMBINED, 0), **metadata.TIKNIB_DEFAULT} | {"name": ""}, "features"
    raise ValueError(f"unknown metadata type {kind!r}: finfo, tiknib or finfo-tiknib")


def global_graphs(entries: DataFrame, include_unk: bool = False, meta: DataFrame | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with adjacency, edges) of each program's call graph without isolated nodes."""
    called = graphs.calls(entries, include_unk)
    nodes, edges = graphs.global_edges(called, entries, include_unk)
    nodes = graphs.pruned(nodes, edges)
    rows = graphs.adjacency_rows(nodes, edges)
    if kind:
        columns, defaults, into = node_metadata(kind)
        rows = graphs.attach(rows, meta, columns, defaults, into=into)
    return rows, edges


def nlp(functions: DataFrame, kind: str = "disasm", form: str = "single", random_walk: bool = False, pairs: bool = False, min_blocks: int = 5, registers: bool = False, strict: bool = False) -> DataFrame:
    """Lines (form single) or function strings (form funcstring). strict: the walk's hop counter is carried over, as earlier tools did."""
    if form == "funcstring":
        return corpus.function_strings(functions, kind, min_blocks, registers)
    if form != "single":
        raise ValueError(f"unknown output format {form!r}: single or funcstring")
    kind = "instructions" if kind == "disasm" else kind
    if random_walk:
        return corpus.walk_lines(functions, kind, min_blocks, registers, pairs, strict)
    if pairs:
        return corpus.row_pairs(corpus.linear_walk(functions, kind, min_blocks, registers), ["binary", "func_idx", "name"], ["ord"], "text").withColumnRenamed("pair", "text")
    return corpus.linear_walk(functions, kind, min_blocks, registers)


def nlp_pcode(functions: DataFrame, with_blocks: bool = False, form: str = "single", pairs: bool = False) -> DataFrame:
    sinks.pcode_name(form, "bb" if with_blocks else "func", pairs)
    if form == "funcstring":
        return corpus.pcode_strings(functions, with_blocks)
    return corpus.pcode_block_lines(functions, pairs) if with_blocks else corpus.pcode_lines(functions, pairs)


def pcode_graphs(functions: DataFrame) -> DataFrame:
    return functions.select("binary", "function_name", graphs.pcode_graph(F.col("pcode_blocks")).alias("graph"))


def metadata_tables(rows: DataFrame, kind: str, extended: bool = False) -> DataFrame:
    """finfo: a subset of function metadata; tiknib: averages and sums over blocks of functions."""
    if kind == "finfo":
        return metadata.subset(rows, extended, keep=("binary", "func_idx"))
    if kind == "tiknib":
        return metadata.tiknib_functions(with_arch(rows))
    raise ValueError(f"unknown metadata type {kind!r}: finfo or tiknib")


def combos(info: DataFrame, tiknib: DataFrame, kind: str = "finfo+tiknib", by_name: bool = False) -> DataFrame:
    if kind != "finfo+tiknib":
        raise ValueError(f"combination {kind!r} is not supported: finfo+tiknib is")
    return metadata.combined(info, tiknib, by_name)


def train_tokeniser(rows: DataFrame, path: str, size: int = 10_000, kind: str = "byte-bpe") -> None:
    tokeniser.save(*tokeniser.learn(rows, size, kind=kind), path)


def dedup_graphs(spark: SparkSession, folder: str, node: str, layout: str, in_place: bool = False) -> DataFrame:
    """Surviving graphs, or with `in_place` the paths of the others; files are never deleted."""
    rows = readers.read_graphs(spark, folder, node, layout)
    kept = dedup.dedup_graphs(rows)
    return dedup.duplicates(rows, kept, ["path"]).select("path") if in_place else kept


def dedup_strings(spark: SparkSession, folder: str, value_only: bool = False, strict: bool = False, only_statistics: bool = False) -> DataFrame:
    rows = readers.read_strings(spark, folder)
    if only_statistics:
        return dedup.statistics(rows, ["binary"], ["text"] if value_only and not strict else ["name", "text"])
    return dedup.dedup_strings(rows, value_only, strict)


def header_info(spark: SparkSession, folder: str) -> DataFrame:
    """path, format of binaries by their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    magic = F.hex(F.substring("content", 1, 4))
    kind = F.when(magic == "7F454C46", "ELF").when(magic.startswith("4D5A"), "PE").when(magic.isin("CFFAEDFE", "CEFAEDFE", "FEEDFACE", "FEEDFACF", "CAFEBABE"), "Mach-O").when(magic.startswith("213C6172"), "archive").otherwise("unknown")
    return files.filter(~F.col("path").endswith(".json")).select("path", kind.alias("format"))
