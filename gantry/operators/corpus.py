"""Text corpora: block texts, function strings, linear and bounded depth-first walks, pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.functions import normalise

# Separators of instruction pairs.
PAIR, PCODE_PAIR = " " * 6, " ---- "
MAX_HOPS = 10
#: Walks that take their steps together, and lines handed over together.
STARTS, LINES = 8192, 1 << 17


def op_texts(ops: Column, kind: str, registers: bool = False) -> Column:
    """Normalised texts of an array of operations; null for those that have none.

    esil, disasm, pseudo: those of two bytes or more; instructions: every disassembly text
    that isn't null.
    """
    source = {"esil": "esil", "disasm": "disasm", "pseudo": "opcode", "instructions": "disasm"}[kind]
    if kind == "esil":
        return F.transform(ops, lambda o: F.when(F.octet_length(o[source]) > 1, normalise.esil(o[source], o["type"], registers)))
    texts = ops[source] if kind == "instructions" else F.transform(ops[source], lambda t: F.when(F.octet_length(t) > 1, t))
    return normalise.disasm_array(texts, registers)


def block_texts(block: Column, kind: str, registers: bool = False) -> Column:
    """Normalised texts of a block's operations that have one."""
    return F.filter(op_texts(block["ops"], kind, registers), lambda t: t.isNotNull())


def _function_texts(kind: str, registers: bool) -> Column:
    """Texts of all operations of the row's function in order; null for those that have none."""
    return op_texts(F.flatten("blocks.ops"), kind, registers)


def _valid(min_blocks: int, strict: bool) -> Column:
    n = F.size("blocks")
    return (n > min_blocks if strict else n >= min_blocks) & (F.get("blocks", F.lit(0))["offset"] != 1)


def function_strings(functions: DataFrame, kind: str = "esil", min_blocks: int = 5, registers: bool = False) -> DataFrame:
    """binary, func_idx, name, text: all texts of a function in order, by spaces, commas as spaces; functions without text are left out."""
    texts = F.filter(_function_texts(kind, registers), lambda t: t != "")
    joined = F.array_join(F.transform(texts, lambda t: F.translate(t, ",", " ")), " ")
    return functions.filter(_valid(min_blocks, False)).select("binary", "func_idx", "name", joined.alias("text")).filter("text <> ''")


def string_map(strings: DataFrame, keys: Sequence[str] = ("binary",)) -> DataFrame:
    """keys, strings: one map for each program; of functions with the same name the last one stays."""
    last = strings.groupBy(*keys, "name").agg(F.max_by("text", "func_idx").alias("text"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "text")))).alias("strings"))


def linear_walk(functions: DataFrame, kind: str = "instructions", min_blocks: int = 5, registers: bool = False) -> DataFrame:
    """binary, func_idx, name, ord, text: a row for each instruction."""
    texts = F.filter(_function_texts(kind, registers), lambda t: t.isNotNull())
    return functions.filter(F.size("blocks") >= min_blocks).select("binary", "func_idx", "name", F.posexplode(texts).alias("ord", "text"))


def pairs(texts: Column, separator: str = PAIR) -> Column:
    """Neighbours of an array joined by a separator: one fewer than there are texts."""
    n = F.greatest(F.size(texts) - 1, F.lit(0))
    return F.zip_with(F.slice(texts, F.lit(1), n), F.slice(texts, F.lit(2), n), lambda a, b: F.concat(a, F.lit(separator), b))


def row_pairs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str = PAIR) -> DataFrame:
    """Flat form: keys, order, pair of each row and the next one of its group."""
    after = F.lead(text).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.select(*keys, *order, F.concat(F.col(text), F.lit(separator), after).alias("pair")).filter("pair is not null")


def _bounded(sizes: np.ndarray, src: np.ndarray, dst: np.ndarray, max_hops: int, strict: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Walks over many graphs at once: first start, nodes by walk and hop, lengths, for STARTS starts at a time.

    sizes: nodes of each graph, which are numbered through; an edge's ends are such numbers.
    A step goes from the last node of the walk that has a successor out of it to the first
    such successor, so a walk is nodes with places in their successors, and all walks of a
    slice take their steps together.
    """
    n, width = int(sizes.sum()), max(max_hops + strict, 1)
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    # Only the first of equal edges counts: a walk then passes over fewer successors of a node than it has hops.
    first = np.sort(np.unique(src * max(n, 1) + dst, return_index=True)[1])
    src, dst = src[first], dst[first]
    begin = np.searchsorted(src, np.arange(n + 1))
    is_first = np.zeros(n, bool)
    is_first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    hops = 0
    for start in range(0, n, STARTS):
        starts = np.arange(start, min(start + STARTS, n))
        nodes = np.full((len(starts), width), -1)
        at, end = np.zeros((2, len(starts), width), np.int64)
        nodes[:, 0], at[:, 0], end[:, 0] = starts, begin[starts], begin[starts + 1]
        length, top = np.ones(len(starts), np.int64), np.zeros(len(starts), np.int64)
        going = np.arange(len(starts) if width > 1 else 0)
        while len(going):
            t = top[going]
            place = at[going, t]
            more = place < end[going, t]
            top[going[~more]] -= 1
            w, t, place = going[more], t[more], place[more]
            at[w, t] += 1
            node = dst[place]
            new = (nodes[w] != node[:, None]).all(axis=1)
            w, node = w[new], node[new]
            nodes[w, length[w]] = node
            length[w] += 1
            top[w] += 1
            at[w, top[w]], end[w, top[w]] = begin[node], begin[node + 1]
            going = going[(top[going] >= 0) & (length[going] < width)]
        if strict:
            for i, (natural, restart) in enumerate(zip(length.tolist(), is_first[starts].tolist())):
                hops = 0 if restart else hops
                left = max_hops - hops
                length[i], hops = (left, 0) if natural > left else (natural, hops + natural)
        yield start, nodes, np.minimum(length, max_hops)


def walks(successors: list[list[int]], max_hops: int = MAX_HOPS, strict: bool = False) -> list[list[int]]:
    """Nodes of the bounded depth-first walk from each node, by order of visit.

    A node's successors are visited in their order. strict: the hop counter is carried
    over to the next start where a walk ends by itself, and the node at which it runs out
    is lost, so that later walks are shorter.
    """
    src = np.repeat(np.arange(len(successors)), [len(s) for s in successors])
    dst = np.array([d for s in successors for d in s], np.int64)
    parts = _bounded(np.array([len(successors)]), src, dst, max_hops, strict)
    return [w[:k] for _, nodes, length in parts for w, k in zip(nodes.tolist(), length.tolist())]


def _ends(edges: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and both ends (src, dst) of all edges of the rows."""
    flat = edges.flatten()
    src, dst = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("src", "dst"))
    return np.repeat(np.arange(len(edges)), _lengths(edges)), src, dst


def _control_flow(row: np.ndarray, offset: np.ndarray, targets: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of `graphs.cfg_edges`, as numbers of blocks, of the blocks of many functions, by sorting.

    row: each block's function; targets: per kind, each block's target.
    """
    known, number = np.unique(offset, return_inverse=True)
    keys = row * max(len(known), 1) + number
    starts, block = np.unique(keys, return_index=True)  # the first block of a function with an offset
    src, dst = np.empty((2, len(offset), len(targets)), np.int64)
    for k, target in enumerate(targets):
        number = np.minimum(np.searchsorted(known, target), max(len(known) - 1, 0))
        key = row * max(len(known), 1) + number
        at = np.minimum(np.searchsorted(starts, key), max(len(starts) - 1, 0))
        there = (target != -1) & (known[number] == target) & (starts[at] == key)
        dst[:, k] = np.where(there, block[at], -1)
        src[:, k] = block[np.searchsorted(starts, keys)]
    is_edge = dst.ravel() >= 0
    return src.ravel()[is_edge], dst.ravel()[is_edge]


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of given begins and lengths, one range after the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


def with_walks(rows: DataFrame, edges: Column, n: Column, to: str = "walks", max_hops: int = MAX_HOPS, strict: bool = False) -> DataFrame:
    """`rows` with the walks over each row's graph as an array of arrays.

    Walking carries a stack, so it is Python, over whole Arrow batches of edges.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.ArrayType(T.ArrayType(T.IntegerType())))])
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(b.column(width + 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            row, src, dst = _ends(b.column(width))
            if ((src < 0) | (dst < 0) | (np.maximum(src, dst) >= sizes[row])).any():
                raise IndexError("an edge's end is no node of its graph")
            row_of = np.repeat(np.arange(len(sizes)), sizes)
            flat, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, nodes, length in _bounded(sizes, first[row] + src, first[row] + dst, max_hops, strict):
                own = nodes - first[row_of[start : start + len(length)]][:, None]
                flat.append(own[np.arange(nodes.shape[1]) < length[:, None]])
                lengths.append(length)
            offsets = [np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in (np.concatenate(lengths), sizes)]
            each = pa.ListArray.from_arrays(offsets[0], pa.array(np.concatenate(flat).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.ListArray.from_arrays(offsets[1], each)], schema.names)

    pair = F.transform(edges, lambda e: F.struct(e["src"].cast("int").alias("src"), e["dst"].cast("int").alias("dst")))
    return rows.select("*", pair.alias("__edges"), n.cast("int").alias("__n")).mapInArrow(run, schema)


def walk_lines(functions: DataFrame, kind: str = "instructions", min_blocks: int = 5, registers: bool = False, as_pairs: bool = False, strict: bool = False) -> DataFrame:
    """binary, func_idx, name, start, ord, text: the texts along the walk from each block.

    Lines are made in Python where the walks are: a walk is places in the batch's texts, and
    its lines are taken from there, LINES at a time.
    """
    numbers = [F.transform("blocks.ops", F.size).alias("n_ops"), *[F.col(f"blocks.{c}").cast("array<bigint>").alias(c) for c in ("offset", "jump", "fail")]]
    rows = functions.filter(_valid(min_blocks, True)).select("binary", "func_idx", "name", _function_texts(kind, registers).alias("texts"), *numbers)
    added = [T.StructField(c, t) for c, t in (("start", T.IntegerType()), ("ord", T.IntegerType()), ("text", T.StringType()))]
    schema = T.StructType([*rows.schema.fields[:3], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strings = b.column(3).flatten()
            has_text = np.concatenate([[0], np.cumsum(strings.is_valid().to_numpy(zero_copy_only=False))])
            strings = strings.drop_null()
            until_op = np.cumsum(b.column(4).flatten().to_numpy())
            n_texts = np.diff(has_text[until_op], prepend=0)
            begin, n_blocks = np.cumsum(n_texts) - n_texts, _lengths(b.column(4))
            row = np.repeat(np.arange(len(n_blocks)), n_blocks)
            offset, *targets = (c.flatten().fill_null(-1).to_numpy() for c in b.columns[5:])
            src, dst = _control_flow(row, offset, targets)
            # A graph's nodes are the blocks up to the last one with an edge.
            from_block = np.cumsum(n_blocks) - n_blocks
            sizes = np.zeros(len(n_blocks), np.int64)
            np.maximum.at(sizes, row[src], np.maximum(src, dst) + 1 - from_block[row[src]])
            first, row_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            block_of = _spread(from_block, sizes)
            skipped = (first - from_block)[row[src]]
            for start, nodes, length in _bounded(sizes, src + skipped, dst + skipped, MAX_HOPS, strict):
                along = block_of[nodes[np.arange(nodes.shape[1]) < length[:, None]]]
                until, n = np.cumsum(length), n_texts[along]
                lines = np.concatenate([[0], np.cumsum(n)])[until]  # of all walks up to each
                at = 0
                while at < len(length):
                    done = lines[at - 1] if at else 0
                    to = max(at + 1, int(np.searchsorted(lines, done + LINES, "right")))
                    own = slice(until[at - 1] if at else 0, until[to - 1])
                    place, each = _spread(begin[along[own]], n[own]), np.diff(lines[at:to], prepend=done)
                    walk, order = np.repeat(np.arange(start + at, start + to), each), _spread(np.zeros(to - at, np.int64), each)
                    if as_pairs:
                        kept = np.flatnonzero(order < np.repeat(each, each) - 1)
                        text = pc.binary_join_element_wise(strings.take(pa.array(place[kept])), strings.take(pa.array(place[kept + 1])), PAIR)
                        walk, order = walk[kept], order[kept]
                    else:
                        text = strings.take(pa.array(place))
                    of = row_of[walk]
                    ids = pa.array(of)
                    numbers = [pa.array(x.astype(np.int32)) for x in (walk - first[of], order)]
                    yield pa.RecordBatch.from_arrays([*[c.take(ids) for c in b.columns[:3]], *numbers, text], schema.names)
                    at = to

    return rows.mapInArrow(run, schema)


def pcode_lines(functions: DataFrame, as_pairs: bool = False) -> DataFrame:
    """function_name, ord, text of function-level p-code."""
    lines = F.col("pcode.pcode")
    return functions.select("function_name", F.posexplode(pairs(lines, PCODE_PAIR) if as_pairs else lines).alias("ord", "text"))


def pcode_block_lines(functions: DataFrame, as_pairs: bool = False) -> DataFrame:
    """function_name, ord, text: the lines of each block, joined by line ends."""
    lines = lambda b: F.array_join(pairs(b["pcode"], PCODE_PAIR) if as_pairs else b["pcode"], "\n")
    return functions.select("function_name", F.posexplode(F.transform("pcode_blocks", lines)).alias("ord", "text"))


def pcode_strings(functions: DataFrame, with_blocks: bool = False) -> DataFrame:
    """function_name, text: p-code joined by spaces."""
    if with_blocks:
        return functions.select("function_name", F.array_join(F.transform("pcode_blocks", lambda b: F.array_join(b["pcode"], " ")), " ").alias("text"))
    return functions.select("function_name", F.trim(F.array_join("pcode.pcode", " ")).alias("text"))
