"""MinHash near-dedup with SetSketch registers.

Each distinct shingle set gets SetSketch registers: truncated minima on an exponential
scale, `clip(floor(1 - log_b(min / a)), 0, q + 1)` with b = 1.001, which merge by maximum
and agree with a probability close to the Jaccard similarity. Bands of registers find
candidates, the joint likelihood of two sketches (with the exact set sizes) estimates
their similarity, and every link is confirmed on the full sets.

1. Documents with equal sets form a class; only classes go on, with numbers of their own.
2. Classes that share a band form a bucket; buckets with the same members count once.
   Each member is paired with the bucket's hub (its smallest class): linear, also for a
   bucket that holds a third of all rows. A hub's pairs are dealt to chunks of bounded
   size, and its data goes to each chunk once.
3. Pairs whose likelihood estimate allows the threshold are verified on full sets.
4. Connected components of the verified links, by contraction.
5. Buckets whose members still lie in several components are searched exactly: members
   outside the bucket's largest component (probes) are compared with all of it, in blocks
   of bounded size that hold some probes and some members. Sketches go first; only members
   with a partner that the estimate allows go on with their full sets. A block gives no
   more links than join its components, never all its pairs.

With 36 bands of 5 registers a pair at similarity 0.8 shares no band with probability
6e-7, and the floor of the estimate lies five standard deviations below the threshold.

Words are runs of characters other than `[\\x20\\x09-\\x0D]` with A-Z lower-cased; a set
holds the distinct shingles of k words, or the whole sequence of a shorter text. Defined
results: null, empty and wordless texts have an empty set and link with nothing. Rows are
linked by their texts alone: rows that share an id, or have none, are rows of their own. A
component is named by its smallest id, a null one last; `keep_one` keeps one row of each
component, that of the smallest id and of such rows the first in its file
(`common.keyed`), and every row with an empty set. An empty table gives an empty result;
other columns are not read by `find_groups` and kept by `keep_one`. Texts are never cut, and
one of any length is one set in one task. Sets are compared by 64-bit shingle hashes,
classes by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import BROADCAST_ROWS, ROW, Scratch, constants, cut, distinct_rows, ident, keyed, mapped, mix64, shingles, shown, text_slices, without, words

BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
BASE, SCALE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Pairs of a hub that are compared in one group.
CHUNK = 256
#: Members and shingles of a block in the exact search of unresolved buckets.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000
_A = (constants(REGISTERS, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (constants(REGISTERS, 22) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def registers(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x REGISTERS, uint16) of non-empty sets laid end to end."""
    n = len(offsets) - 1
    least = np.empty((n, REGISTERS), np.uint32)
    row = 0
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + 32_768, "right")) - 1))
        x = mix64(sets[offsets[row] : offsets[end]])
        low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        at = offsets[row:end] - offsets[row]
        t, s = np.empty_like(low), np.empty_like(low)
        for i in range(REGISTERS):
            np.multiply(low, _A[i], out=t)
            t += high
            np.right_shift(t, 15, out=s)
            t ^= s
            t *= _B[i]
            least[row:end, i] = np.minimum.reduceat(t, at)
        row = end
    x = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x / SCALE) / math.log(BASE)), 0, TOP).astype(np.uint16)


def likelihood(n1: np.ndarray, n2: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches.

    more, less: registers in which the first is larger or smaller; the rest are equal.
    """
    out = np.empty(len(n1))
    grid = np.linspace(0, 1, 201)
    for i in range(0, len(n1), 4096):
        s = slice(i, i + 4096)
        u = (n1[s] / (n1[s] + n2[s]))[:, None]
        v = 1 - u
        j = grid * np.minimum(u / v, v / u)

        def p(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        even = np.maximum(1 - up - down, 1e-12)
        a, b = more[s][:, None], less[s][:, None]
        chance = a * np.log(up) + b * np.log(down) + (REGISTERS - a - b) * np.log(even)
        out[s] = np.take_along_axis(j, chance.argmax(axis=1)[:, None], axis=1)[:, 0]
    return out


def floor_of(percent: int) -> float:
    t = percent / 100
    return t - 5 * math.sqrt(t * (1 - t) / REGISTERS)


def _sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of texts laid end to end: hashes, offsets, and two hashes of each set (0 for an empty one)."""
    n = len(offsets) - 1
    h, rows, _, _ = words(raw, offsets)
    s, so = distinct_rows(*shingles(h, rows, n, k))
    size = np.diff(so)
    have = np.flatnonzero(size)
    hi, lo = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(have):
        at = so[:-1][have]
        hi[have] = mix64(np.add.reduceat(mix64(s), at) + size[have].astype(np.uint64))
        lo[have] = np.bitwise_xor.reduceat(mix64(s + np.uint64(0x1234567)), at)
    return s, so, hi.view(np.int64), lo.view(np.int64)


def sketches(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` (bigint columns), n (set size), hi, lo (hash of the set), regs (bytes; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, raw, off in text_slices(b, "text"):
                s, so, hi, lo = _sets(raw, off, k)
                size = np.diff(so)
                have = np.flatnonzero(size)
                regs: list[bytes] = [b""] * (end - start)
                if len(have):
                    for r, x in zip(have, registers(s, np.concatenate([so[:-1][have], [len(s)]]))):
                        regs[r] = x.tobytes()
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(start, end - start) for c in ("doc_id", *keep)), pa.array(size), pa.array(hi), pa.array(lo), pa.array(regs, pa.binary())], ["doc_id", *keep, "n", "hi", "lo", "regs"])

    return mapped(docs.select(ident(doc_id).alias("doc_id"), *keep, F.col(text).alias("text")), run, "doc_id long, " + "".join(f"{c} long, " for c in keep) + "n long, hi long, lo long, regs binary")


Compare = Callable[[int, bytes, np.ndarray, list[bytes]], np.ndarray]


def _against_hubs(pairs: DataFrame, data: DataFrame, compare: Compare) -> DataFrame:
    """Of pairs (a, b, m), those that `compare` keeps. data: node, n, data.

    m is the size of the bucket. A hub's pairs are dealt to groups of about CHUNK, each of
    which gets the hub's data once; compare(n, data, ns, datas) judges a run of partners.
    """
    chunks = F.expr(f"cast(pow(2, ceil(log2(greatest(m, {CHUNK}) / {CHUNK}.0))) as int)")
    dealt = pairs.select("a", "b", "m", chunks.alias("of")).withColumn("chunk", F.pmod(F.xxhash64("b"), "of").cast("int"))
    group = ["a", "of", "chunk"]
    hubs = dealt.select(*group).distinct().join(data.select(F.col("node").alias("a"), "n", "data"), "a").select(*group, F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("m"), "n", "data")
    others = dealt.join(data.select(F.col("node").alias("b"), "n", "data"), "b").select(*group, "b", "m", "n", "data")
    rows = hubs.unionByName(others).repartition(*group).sortWithinPartitions(*group, F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple[int, bytes] | None = None
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                b = whole.slice(first, 1000)
                heads = np.flatnonzero(b.column("b").is_null().to_numpy(zero_copy_only=False))
                n, data = b.column("n").to_numpy(), b.column("data").to_pylist()
                keep = np.zeros(b.num_rows, bool)
                for i, j in zip([-1, *heads.tolist()], [*heads.tolist(), b.num_rows]):
                    if i >= 0:
                        hub = int(n[i]), data[i]
                    if i + 1 < j:
                        keep[i + 1 : j] = compare(*hub, n[i + 1 : j], data[i + 1 : j])
                kept = b.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("a", "b", "m")], ["a", "b", "m"])

    return mapped(rows, run, "a long, b long, m long")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, m), those whose sizes and joint likelihood allow the threshold."""
    floor = floor_of(percent)

    def compare(n: int, regs: bytes, ns: np.ndarray, others: list[bytes]) -> np.ndarray:
        keep = 100 * np.minimum(ns, n) >= percent * np.maximum(ns, n)
        at = np.flatnonzero(keep)
        if len(at):
            x, y = np.frombuffer(regs, np.uint16), np.frombuffer(b"".join([others[i] for i in at]), np.uint16).reshape(len(at), -1)
            keep[at] = likelihood(np.full(len(at), n), ns[at], (x > y).sum(axis=1), (x < y).sum(axis=1)) >= floor
        return keep

    return _against_hubs(pairs, classes.select("node", "n", F.col("regs").alias("data")), compare)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, m), those whose full sets (node, n, data) reach the threshold."""

    def compare(n: int, own: bytes, ns: np.ndarray, others: list[bytes]) -> np.ndarray:
        mine = np.frombuffer(own, np.uint64)
        keep = np.zeros(len(others), bool)
        for i, other in enumerate(others):
            y = np.frombuffer(other, np.uint64)
            small, large = (mine, y) if len(mine) < len(y) else (y, mine)
            both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            keep[i] = 100 * both >= percent * (len(mine) + len(y) - both)
        return keep

    return _against_hubs(pairs, sets, compare)


def shingle_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node, n, data: the shingle hashes of the classes that `nodes` names, in ascending order, as bytes.

    A class's set is made again from a text of it: a row of the class's smallest id whose set has the class's hashes.
    """
    needed = cut(classes.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "first", "hi", "lo"), "needed")
    few = needed.count() <= BROADCAST_ROWS
    at_hand = F.broadcast if few else (lambda df: df)
    source = docs.select(ident(doc_id).alias("first"), F.col(text).alias("text")).filter("text is not null").join(at_hand(needed.select("first").distinct()), "first", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, raw, off in text_slices(b, "text"):
                s, so, hi, lo = _sets(raw, off, k)
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(np.diff(so)), pa.array([s[i:j].tobytes() for i, j in zip(so, so[1:])], pa.binary())], ["hi", "lo", "n", "data"])

    made = mapped(source.select("text"), run, "hi long, lo long, n long, data binary")
    found = made.join(at_hand(needed.select("node", "hi", "lo")), ["hi", "lo"]).select("node", "n", "data")
    return found.dropDuplicates(["node"])  # rows with the same id and set


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of every node with a link (a, b).

    Rounds of: each node points to its smallest neighbour, pointers are followed twice, and
    the graph is contracted along them. Each round at least roughly halves the nodes.
    """
    with Scratch(links.sparkSession) as scratch:
        edges = cut(links.filter("a <> b"), "edges")
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
        first = True
        while not edges.isEmpty():
            both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a"))
            p = cut(both.groupBy("x").agg(F.least("x", F.min("y")).alias("p")), "parents")
            for _ in range(2):
                q = p.select(F.col("x").alias("p"), F.col("p").alias("pp"))
                p = p.join(q, "p").select("x", F.col("pp").alias("p"))
            p = cut(p, "parents")
            if first:
                labels, first = p.select(F.col("x").alias("node"), F.col("p").alias("label")), False
            else:
                labels = cut(labels.join(p, labels["label"] == p["x"], "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
            a, b = p.select(F.col("x").alias("a"), F.col("p").alias("pa")), p.select(F.col("x").alias("b"), F.col("p").alias("pb"))
            edges = cut(edges.join(a, "a").join(b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        return scratch.keep(cut(labels, "components"))


def _unresolved(members: DataFrame, labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """key, node, comp, probe, and in how many blocks a bucket's members and probes lie: of buckets in several components.

    weights: node, n; where given, a block's shingles are bounded too.
    """
    placed = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))
    placed = placed.withColumn("n", F.lit(0).cast("long")) if weights is None else placed.join(weights.select("node", "n"), "node")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    split = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.count("*").alias("comps"), F.sum("n").alias("n"), F.max(F.struct("c", "comp", "n")).alias("main"))
    blocks = lambda c, n: F.greatest(F.lit(1), F.ceil(c / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    split = split.filter("m > 2 and comps > 1").select("key", F.col("main.comp").alias("main"), blocks(F.col("m"), F.col("n")).alias("of"), blocks(F.col("m") - F.col("main.c"), F.col("n") - F.col("main.n")).alias("probes"))
    return placed.join(split, "key").select("key", "node", "comp", "of", "probes", (F.col("comp") != F.col("main")).alias("probe"))


def _blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in the blocks they belong to: each member meets each probe of its bucket in one block (key, bt, bp)."""
    own, mine = F.pmod(F.xxhash64("node"), "of").cast("int"), F.pmod(F.xxhash64("node"), "probes").cast("int")
    place = lambda probe, bt, bp: F.struct(F.lit(probe).alias("as_probe"), bt.alias("bt"), bp.alias("bp"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<struct<as_probe:boolean,bt:int,bp:int>>")
    places = F.concat(F.transform(upto("probes"), lambda i: place(False, own, i)), F.when(F.col("probe"), F.transform(upto("of"), lambda i: place(True, i, mine))).otherwise(none))
    dealt = rows.select("key", "node", "comp", *columns, F.explode(places).alias("p")).select("key", "node", "comp", *columns, "p.*")
    return dealt.repartition("key", "bt", "bp").sortWithinPartitions("key", "bt", "bp")


def _each_block(batches: Iterator[pa.RecordBatch], body: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`body` of each block, gathered from sorted batches."""
    block: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        where = np.stack([t.column(c).to_numpy() for c in ("key", "bt", "bp")])
        starts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
        bounds = [0, *starts.tolist(), t.num_rows]
        for i, j in zip(bounds, bounds[1:]):
            part = t.slice(i, j - i)
            if block and any(block[0].column(c)[0] != part.column(c)[0] for c in ("key", "bt", "bp")):
                yield body(pa.concat_tables(block))
                block = []
            block.append(part)
    if block:
        yield body(pa.concat_tables(block))


class _Sketched:
    """The sketches of a block, and which of its members a probe may be similar to."""

    def __init__(self, g: pa.Table, percent: int):
        self.percent, self.floor = percent, floor_of(percent)
        self.least = int(REGISTERS * max(0.0, self.floor - 0.15))  # equal registers, a quick first sieve
        self.regs = np.frombuffer(b"".join(g.column("regs").to_pylist()), np.uint16).reshape(g.num_rows, -1)
        self.probe = g.column("as_probe").to_numpy(zero_copy_only=False).astype(bool)
        self.node, self.n = (g.column(c).to_numpy() for c in ("node", "n"))

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        n, regs = self.n, self.regs
        near = among[100 * np.minimum(n[among], n[i]) >= self.percent * np.maximum(n[among], n[i])]
        near = near[(regs[near] == regs[i]).sum(axis=1) >= self.least] if len(near) else near
        if len(near):
            est = likelihood(np.full(len(near), n[i]), n[near], (regs[i] > regs[near]).sum(axis=1), (regs[i] < regs[near]).sum(axis=1))
            near = near[est >= self.floor]
        return near


def _with_partners(blocks: DataFrame, percent: int) -> DataFrame:
    """key, node: members with a partner in another component that their sketches allow."""

    def sieve(g: pa.Table) -> pa.RecordBatch:
        block, comp = _Sketched(g, percent), g.column("comp").to_numpy()
        own = np.unique(block.node, return_inverse=True)[1]
        found = np.zeros(g.num_rows, bool)  # by member: those found need no other partner, and look only for those that do
        t = np.flatnonzero(~block.probe)
        for i in np.flatnonzero(block.probe):
            others = t[comp[t] != comp[i]]
            have = found[own[others]]
            near = block.near(i, others[~have])
            if not len(near) and not found[own[i]]:
                near = block.near(i, others[have])
            found[own[near]] = True
            found[own[i]] |= bool(len(near))
        found = found[own]
        keep = g.filter(pa.array(found)).select(["key", "node"]).combine_chunks()
        return keep.to_batches()[0] if keep.num_rows else pa.RecordBatch.from_pylist([], keep.schema)

    return mapped(blocks, lambda batches: _each_block(batches, sieve), "key long, node long").distinct()


def _linked(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a block in different components: enough to join what is linked."""

    def links(g: pa.Table) -> pa.RecordBatch:
        block = _Sketched(g, percent)
        node = block.node
        n = pc.binary_length(g.column("data")).to_numpy().astype(np.int64) // 8
        joined = np.unique(g.column("comp").to_numpy(), return_inverse=True)[1]  # components as this block's links join them
        t = np.flatnonzero(~block.probe)
        tokens, off, universe = None, np.concatenate([[0], np.cumsum(n)]), None
        left, right = [], []
        for i in np.flatnonzero(block.probe):
            near = block.near(i, t[joined[t] != joined[i]])
            if not len(near):
                continue
            if tokens is None:
                known, tokens = np.unique(np.frombuffer(b"".join(g.column("data").to_pylist()), np.uint64), return_inverse=True)
                universe = np.zeros(len(known), np.uint8)
            universe[tokens[off[i] : off[i + 1]]] = 1
            sizes = n[near]
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = np.repeat(off[near] - begin, sizes) + np.arange(sizes.sum())
            shared = np.add.reduceat(universe[tokens[at]], begin, dtype=np.int64)
            universe[tokens[off[i] : off[i + 1]]] = 0
            near = near[100 * shared >= percent * (n[i] + sizes - shared)]
            for c, j in zip(*np.unique(joined[near], return_index=True)):
                left.append(min(node[i], node[near[j]]))
                right.append(max(node[i], node[near[j]]))
                joined[joined == c] = joined[i]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return mapped(blocks, lambda batches: _each_block(batches, links), "a long, b long").distinct()


def _across(members: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between members of a bucket in different components; None are lost that would join two components."""
    regs = classes.select("node", "n", "regs")
    open_ = cut(_unresolved(members, labels), "unresolved")
    some = cut(_with_partners(_blocks(open_.join(regs, "node"), ["n", "regs"]), percent), "partners")
    sets = cut(shingle_sets(some, classes, docs, k, doc_id, text), "sets")
    rows = _unresolved(some, labels, classes).join(regs, "node").join(sets.select("node", "data"), "node")
    return _linked(_blocks(rows, ["n", "regs", "data"]), percent)


def _grouped(docs: DataFrame, k: int, percent: int, doc_id: str, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, `keep`, n, hi, lo; classes: hi, lo, component_id and for `keep` the component's first row), written."""
    with Scratch(docs.sparkSession) as scratch:
        seen = cut(sketches(docs, k, doc_id, text, keep), "sketches")
        full = seen.filter("n > 0")
        own = F.struct(F.col("doc_id").alias("id"), *keep)
        grouped = full.groupBy("hi", "lo").agg(F.min(own).alias("own"), F.max("n").alias("n"), F.max("regs").alias("regs"))
        classes = cut(grouped.select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "own", F.col("own.id").alias("first"), "n", "regs"), "classes")
        slim = scratch.keep(cut(seen.select("doc_id", *keep, "n", "hi", "lo"), "rows"))
        scratch.drop(seen)
        band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)]))
        bands = classes.select("node", band.alias("key"))
        buckets = bands.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("hub"), F.max("node").alias("end"), F.bit_xor(F.xxhash64("node")).alias("sig")).filter("hub <> end")
        buckets = cut(buckets.groupBy("m", "hub", "end", "sig").agg(F.min("key").alias("key")), "buckets")
        members = cut(bands.join(buckets.select("key", "hub", "m"), "key"), "members")
        star = members.filter("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.max("m").alias("m"))
        with Scratch(docs.sparkSession) as step:
            tested = cut(plausible(star, classes, percent), "pairs")
            sets = cut(shingle_sets(tested.select(F.col("a").alias("node")).union(tested.select("b")), classes, docs, k, doc_id, text), "sets")
            links = step.keep(cut(verify(tested, sets, percent).select("a", "b"), "links"))
        labels = components(links)
        with Scratch(docs.sparkSession) as step:
            more = step.keep(cut(_across(members, classes, labels, docs, k, percent, doc_id, text), "across"))
        if not more.isEmpty():
            labels = components(links.union(more))
        # the first row of each component, then of each class
        named = classes.select("node", "own").join(labels, "node").groupBy("label").agg(F.min("own").alias("named")).join(labels, "label").select("node", "named")
        of_class = classes.select("hi", "lo", "node", "own").join(named, "node", "left").select("hi", "lo", F.coalesce("named", "own").alias("first"))
        return slim, scratch.keep(cut(of_class, "named"))


def find_groups(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows, classes = _grouped(docs, k, percent, doc_id, text, ())
    linked = rows.filter("n > 0").join(classes, ["hi", "lo"]).select("doc_id", "n", F.col("first.id").alias("component_id"))
    linked = linked.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return linked.select(shown("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: all columns of the first row of each group."""
    docs = keyed(docs)
    with Scratch(docs.sparkSession) as scratch:
        rows, classes = _grouped(docs, k, percent, doc_id, text, ROW)
        first = [F.col(f"first.{c}") == F.col(c) for c in ROW]
        gone = scratch.keep(cut(rows.filter("n > 0").join(classes, ["hi", "lo"]).filter(~(first[0] & first[1])).select(*ROW), "gone"))
    return without(docs, gone)
