"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

A test item of n distinct shingles counts as leaked into a document that holds at least
the share `threshold` of them. Items are partitioned by n. The items of a partition of
largest size u are sketched by their minhash values under one permutation, the
k = u - ceil(threshold * u) + 1 smallest hashes (their bottom-k signature); a document
that lacks all k of them lacks more than an allowed number of shingles, so candidates
found by signature values miss nothing, however long the document is. Every candidate
is then verified by the exact share of the item's shingles.

(The usual banded signatures of both sides can't do this: the Jaccard similarity of a
30-shingle item and a 10,000-shingle document is 0.003, and 256 one-row bands would
find it in half of the cases. So the document side is probed with all its shingles.)

Items reach the tasks in blocks whose texts take about `block_bytes`, so that the driver
and a worker hold one block's index at a time at any size of the benchmark. There is one
scan of the documents: each worker takes some megabytes of texts and passes all blocks over
them. Documents are never shuffled, and `remove_leaks` lets rows through where they lie.

Words are runs of characters other than `[\\x20\\x09-\\x0D]` with A-Z lower-cased;
shingles are `k` consecutive words, or the whole sequence where an item has fewer, which
then needs a document to contain that sequence of words. Defined results: null and empty
items match nothing; null and empty documents hold nothing; repeated documents are each
reported, an item that is repeated with its id once; texts and items of any length are
searched whole, and an item beyond `block_bytes` is a block of its own; rows are judged one
by one, whatever their ids; there are no ties; empty tables give empty results; other
columns are not read, and kept by `remove_leaks`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import Scratch, cut, distinct_rows, mapped, shingles, text_slices, words

BLOCK_BYTES = 4 << 20
#: Texts that a worker holds while the blocks pass over them.
HELD_BYTES = 32 << 20
_FILTER_BITS = 22


def _partition(n: int) -> int:
    """Largest size of the partition that holds size n: 8, 12, 16, 24, 32, 48, ..."""
    u = 8
    while u < n:
        u = u * 3 // 2 if u & (u - 1) == 0 else u * 4 // 3
    return u


class ItemIndex:
    """Signatures and shingle sets of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], k: int, threshold: float):
        self.k, self.threshold = k, threshold
        self.ids = [i for i, _ in items]
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.large_string())], ["t"])
        self.sets: list[np.ndarray] = []
        self.width: list[int] = []  # words in a shingle of the item
        for a, b, raw, off in text_slices(batch, "t"):
            h, rows, _, _ = words(raw, off)
            s, so = distinct_rows(*shingles(h, rows, b - a, k))
            counts = np.bincount(rows, minlength=b - a)
            self.sets += [s[so[i] : so[i + 1]] for i in range(b - a)]
            self.width += np.minimum(counts, k).tolist()
        #: for each shingle width, signature hash -> items
        self.signatures: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for j, s in enumerate(self.sets):
            if len(s):
                u = _partition(len(s))
                size = u - math.ceil(threshold * u - 1e-9) + 1
                for x in s[:size].tolist():  # the set is sorted, so these are its minima
                    self.signatures[self.width[j]][x].append(j)
        self.filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w, sig in self.signatures.items():
            hashes = np.array(sorted(sig), np.uint64)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.filters[w] = hashes, seen

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item's place, shared shingles) of every item that a text contains."""
        n = len(offsets) - 1
        hashes, rows, _, _ = words(raw, offsets)
        for w, (known, seen) in self.filters.items():
            s, so = shingles(hashes, rows, n, w)
            at = np.repeat(np.arange(n), np.diff(so))
            maybe = np.flatnonzero(seen[(s & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            if not len(maybe):
                continue
            place = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
            maybe = maybe[known[place] == s[maybe]]
            candidates: dict[int, set[int]] = defaultdict(set)
            for r, x in zip(at[maybe].tolist(), s[maybe].tolist()):
                candidates[r].update(self.signatures[w][x])
            for r, items in candidates.items():
                own = np.unique(s[so[r] : so[r + 1]])
                for j in sorted(items):
                    item = self.sets[j]
                    found = np.searchsorted(own, item)
                    shared = int((own[np.minimum(found, len(own) - 1)] == item).sum())
                    if shared >= self.threshold * len(item) - 1e-9:
                        yield r, j, shared


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in lists whose texts take about block_bytes each; the driver holds one list and one partition at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("t is not null").distinct()
    with Scratch(items.sparkSession):
        held = cut(rows, "items")
        block: list[tuple[int, str]] = []
        size = 0
        for r in held.toLocalIterator():
            block.append((r["i"], r["t"]))
            size += len(r["t"].encode())
            if size >= block_bytes:
                yield block
                block, size = [], 0
        if block:
            yield block


class Search:
    """Finds the items of all blocks in batches of texts. Blocks are broadcast one by one."""

    def __init__(self, items: DataFrame, item_id: str, item_text: str, k: int, threshold: float, block_bytes: int):
        context = items.sparkSession.sparkContext
        self.blocks = [context.broadcast(b) for b in _blocks(items, item_id, item_text, block_bytes)]
        self.k, self.threshold = k, threshold

    def groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Batches in groups of a bounded size; with one block each batch is a group."""
        group: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            group.append(b)
            size += b.nbytes
            if len(self.blocks) < 2 or size >= HELD_BYTES:
                yield group
                group, size = [], 0
        if group:
            yield group

    def run(self, batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int]]]]:
        """Each batch, and what its texts (the column at `place`) hold: (row, item, shared and all shingles of the item)."""
        index = None
        for group in self.groups(batches):
            found: list[list] = [[] for _ in group]
            for block in self.blocks:
                if index is None or len(self.blocks) > 1:
                    index = ItemIndex(block.value, self.k, self.threshold)
                    if len(self.blocks) > 1:
                        block.__dict__.pop("_value", None)  # read again from the executor's disk
                for out, b in zip(found, group):
                    only = pa.RecordBatch.from_arrays([b.column(place)], ["text"])
                    out += [(a + r, index.ids[j], n, len(index.sets[j])) for a, _, raw, off in text_slices(only, "text") for r, j, n in index.search(raw, off)]
            yield from zip(group, found)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: a row for each item in each document."""
    search = Search(items, item_id, item_text, k, threshold, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in search.run(batches, 1):
            rows = np.array([r for r, _, _, _ in found], np.int64)
            cols = [pa.array(x, pa.int64()) for x in (list(zip(*found))[1:] if found else ([], [], []))]
            share = pc.divide(cols[1].cast(pa.float64()), cols[2].cast(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), *cols, share], ["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(source, run, "doc_id long, item_id long, n_shared long, n_shingles long, containment double")


def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns."""
    search, place = Search(items, item_id, item_text, k, threshold, block_bytes), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in search.run(batches, place):
            clean = np.ones(b.num_rows, bool)
            clean[[r for r, _, _, _ in found]] = False
            yield b.filter(pa.array(clean))

    return mapped(docs, run, docs.schema)
