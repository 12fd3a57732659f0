"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

A byte goes if it is covered by a string of `window` bytes that also starts anywhere
else, in the same or another text. Sorting every suffix of the corpus would shuffle
sixteen bytes or more for each byte of text, so the suffixes that can't decide anything
are set aside first, exactly:

1. Each window has an anchor: of its strings of `gram` bytes the one with the least hash
   (the leftmost of equal ones). Equal windows have equal anchors at equal places, so a
   window whose anchor is unique is unique. Neighbouring windows share an anchor, about
   one for 85 bytes; a run of windows with one anchor has a context, its bytes.
2. Runs are counted by anchor. If all contexts of an anchor are equal, all their windows
   repeat. Of the others, contexts that occur twice or more repeat as well.
3. What is left are contexts near the ends of repeats. Their windows are suffix-sorted:
   contexts that can share a window (those with equal bytes on one side of the anchor)
   come together in blocks of bounded size; a block's suffixes are sorted one bucket (by
   leading bytes) at a time, and suffixes that agree on their first bytes are ordered by
   the precomputed ranks of a difference cover's sample. Neighbours in suffix order that
   agree on `window` bytes repeat.
4. Groups of contexts beyond a block's size are resolved window by window with a grouped
   count of 128-bit hashes, which any number of tasks can share.

Memory in a task is bounded by the block and by one text. Hashes of contexts decide with
128 bits (anchor and context). Defined results: null counts as empty; texts below the
window's size lose nothing; a repeated row is a second text, so both lose all windows;
texts of the same id are told apart by their hash; ties are none; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import Scratch, cut, ident, mix64, prefix_hash, range_hash, shown, mapped, text_slices

WINDOW, GRAM = 200, 32
#: Bytes of contexts sorted together, and contexts of a group beyond which windows are counted by hash.
BLOCK_BYTES, GROUP_LIMIT = 2 << 20, 6_000
#: Texts beyond this are scanned in pieces that overlap by a window.
PIECE = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)
#: A difference cover modulo 7: any two residues have a shift that takes both into it.
PERIOD, COVER = 7, (0, 1, 3)
_SLOT = np.full(PERIOD, -1)
_SLOT[list(COVER)] = range(len(COVER))
_SHIFT = [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least key of each `span` consecutive ones."""
    m, width = keys, 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = span - width
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def runs(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with the same anchor: row, lo, hi (first and last start), at (anchor), f, h."""
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    total = int(sizes.sum())
    if not total:
        return {k: np.zeros(0, np.uint64 if k in "fh" else np.int64) for k in ("row", "lo", "hi", "at", "f", "h")}
    prefix = prefix_hash(raw)
    place = np.arange(len(raw) - gram + 1)
    g = range_hash(prefix, place, place + gram)
    at = (_least(g & ~_PLACE | place.astype(np.uint64), window - gram + 1) & _PLACE).astype(np.int64)
    start = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = at[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([first[1:], [total]]) - 1
    lo, hi, at, row = start[first], start[last], at[first], row[first]
    shape = (at - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)
    h = mix64(range_hash(prefix, lo, hi + window) + mix64(shape + np.uint64(1)))
    base = offsets[row]
    return {"row": row, "lo": lo - base, "hi": hi - base, "at": at - base, "f": g[at], "h": h}


def _pieces(raw: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the piece in its text, bytes, offsets)."""
    if len(raw) <= PIECE + window:
        yield 0, raw, offsets
        return
    for s in range(0, len(raw) - window + 1, PIECE):
        part = raw[s : s + PIECE + window - 1]
        yield s, part, np.array([0, len(part)])


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, th, f, h, n, lo, hi, at: distinct runs of each text; with null f: spans that repeat within the text."""
    schema = "doc_id long, th long, f long, h long, n int, lo int, hi int, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            for first, _, whole, where in text_slices(b, "text"):
                for shift, raw, off in _pieces(whole, where, window):
                    x = runs(raw, off, window, gram)
                    order = np.lexsort((x["lo"], x["h"], x["f"], x["row"]))
                    x = {k: v[order] for k, v in x.items()}
                    new = np.ones(len(order), bool)
                    new[1:] = (x["row"][1:] != x["row"][:-1]) | (x["f"][1:] != x["f"][:-1]) | (x["h"][1:] != x["h"][:-1])
                    begin = np.flatnonzero(new)
                    n = np.diff(np.concatenate([begin, [len(order)]]))
                    again = np.repeat(n > 1, n)
                    spans = [(r, s, e) for r, s, e in _merged(x["row"][again], x["lo"][again], x["hi"][again] + window)]
                    row = np.concatenate([x["row"][begin], np.array([r for r, _, _ in spans], np.int64)])
                    lo = np.concatenate([x["lo"][begin], np.array([s for _, s, _ in spans], np.int64)]) + shift
                    hi = np.concatenate([x["hi"][begin], np.array([e - window for _, _, e in spans], np.int64)]) + shift
                    blank, gone = np.zeros(len(spans), np.int64), np.arange(len(row)) >= len(begin)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[first + row]),
                            pa.array(th[first + row]),
                            pa.array(np.concatenate([x["f"][begin].view(np.int64), blank]), mask=gone),
                            pa.array(np.concatenate([x["h"][begin].view(np.int64), blank])),
                            pa.array(np.concatenate([n, blank]).astype(np.int32)),
                            pa.array(lo.astype(np.int32)),
                            pa.array(hi.astype(np.int32)),
                            pa.array((np.concatenate([x["at"][begin], blank]) + shift).astype(np.int32)),
                        ],
                        ["doc_id", "th", "f", "h", "n", "lo", "hi", "at"],
                    )

    return mapped(docs, run, schema)


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal runs of spans of each row."""
    last = None
    order = np.lexsort((start, row))
    for r, s, e in zip(row[order].tolist(), start[order].tolist(), end[order].tolist()):
        if last and last[0] == r and s <= last[2]:
            last = (r, last[1], max(e, last[2]))
        else:
            if last:
                yield last
            last = (r, s, e)
    if last:
        yield last


class CoverRanks:
    """Ranks of the suffixes at the cover's sample positions, by their first 224 bytes.

    Ranks are those of groups in sorted order; each round sorts what is still tied by the
    rank a doubled number of periods ahead.
    """

    def __init__(self, heads: np.ndarray, depth: int):
        periods = len(heads) // PERIOD
        at = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)[None]).ravel()
        keys = heads[at] >> np.uint64(8)
        order = np.argsort(keys, kind="stable")
        self.rank = np.zeros(len(at), np.int64)
        tied = self._place(order, keys[order], np.zeros(len(at), np.int64))
        step = 1
        while step * PERIOD < depth and len(tied):
            ahead = tied + len(COVER) * step
            behind = np.where(ahead < len(at), self.rank[np.minimum(ahead, len(at) - 1)] + 1, 0)
            order = np.lexsort((behind, self.rank[tied]))
            tied, behind = tied[order], behind[order]
            base = self.rank[tied].copy()
            tied = self._place(tied, behind, base)
            step *= 2

    def _place(self, items: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Give sorted items their group's rank; the items that are still tied."""
        n = len(items)
        if not n:
            return items
        new_base = np.concatenate([[True], base[1:] != base[:-1]])
        new = new_base | np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(new, at, 0))
        begin = np.maximum.accumulate(np.where(new_base, at, 0))
        self.rank[items] = base + first - begin
        size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
        return items[np.repeat(size > 1, size)]

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places // PERIOD * len(COVER) + _SLOT[places % PERIOD]]


def repeated(contexts: list[bytes], window: int = WINDOW, bucket: int = 1 << 17) -> list[np.ndarray]:
    """For each context, which of its window starts hold a window that starts elsewhere as well."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    total = int(begin[-1])
    periods = -(-total // PERIOD) + 2
    raw = np.zeros(periods * PERIOD + 8, np.uint8)
    raw[:total] = np.frombuffer(b"".join(contexts), np.uint8)
    heads = np.ndarray((periods * PERIOD,), ">u8", raw, 0, (1,)).astype(np.uint64)
    counts = np.maximum(sizes - window + 1, 0)
    starts = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    hit = np.zeros(total + 1, bool)
    ranks = CoverRanks(heads, window + PERIOD)
    lead = (heads[starts] >> np.uint64(48)).astype(np.int64)
    number = np.cumsum(np.bincount(lead, minlength=1 << 16)) // bucket  # of the bucket of each leading pair of bytes
    number = number[lead]
    for b in np.unique(number):
        _sort_bucket(starts[number == b], heads, ranks, window, hit)
    out = hit[starts]
    return np.split(out, np.cumsum(counts)[:-1])


def _sort_bucket(p: np.ndarray, heads: np.ndarray, ranks: CoverRanks, window: int, hit: np.ndarray) -> None:
    """Sort the suffixes at p and mark those that agree with a neighbour on `window` bytes."""
    keys = heads[p]
    order = np.argsort(keys, kind="stable")
    p, keys = p[order], keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    size = np.diff(np.concatenate([np.flatnonzero(new), [len(p)]]))
    keep = np.repeat(size > 1, size)
    p, group = p[keep], np.repeat(np.arange(len(size)), size)[keep].astype(np.int64) << 32
    if not len(p):
        return
    # how many of its group come before each suffix: counted against each residue by the shift that suits both
    before = np.zeros(len(p), np.int64)
    own = [np.flatnonzero(p % PERIOD == r) for r in range(PERIOD)]
    for two in range(PERIOD):
        if not len(own[two]):
            continue
        made: dict[int, np.ndarray] = {}
        for one in range(PERIOD):
            if not len(own[one]):
                continue
            d = _SHIFT[one][two]
            if d not in made:
                made[d] = np.sort(group[own[two]] | ranks.at(p[own[two]] + d))
            mine = group[own[one]]
            before[own[one]] += np.searchsorted(made[d], mine | ranks.at(p[own[one]] + d)) - np.searchsorted(made[d], mine)
    order = np.lexsort((before, group))
    p, group = p[order], group[order]
    pair = np.flatnonzero(group[1:] == group[:-1])
    for k in [*range(8, window - 8, 8), window - 8]:
        pair = pair[heads[p[pair] + k] == heads[p[pair + 1] + k]]
    hit[p[pair]] = hit[p[pair + 1]] = True


def contexts(found: DataFrame, window: int, gram: int) -> DataFrame:
    """key, doc_id, th, start, single, bytes: both sides of each undecided run, from texts with lists of runs."""
    half = (window - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                text = (b.column("text")[0].as_py() or "").encode()
                raw = np.frombuffer(text, np.uint8)
                item = pa.table(b.column("items").flatten().flatten(), ["lo", "hi", "at", "single"])
                lo, hi, at = (item.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "at"))
                single = item.column("single").to_numpy(zero_copy_only=False)
                keys, start, end, alone = [], [], [], []
                for left, a, z in ((True, lo, np.minimum(hi, at - half)), (False, np.maximum(lo, at - half + 1), hi)):
                    k = np.flatnonzero(a <= z)
                    for j in k.tolist():
                        side = raw[at[j] - half : at[j] + gram] if left else raw[at[j] : at[j] + gram + half]
                        keys.append(int.from_bytes(hashlib.blake2b(side.tobytes(), digest_size=8, person=b"left" if left else b"right").digest(), "big", signed=True))
                    start.append(a[k])
                    end.append(z[k] + window)
                    alone.append(single[k])
                start, end = np.concatenate(start), np.concatenate(end)
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([b.column("doc_id")[0].as_py()] * n, pa.int64()), pa.array([b.column("th")[0].as_py()] * n, pa.int64()), pa.array(start.astype(np.int32)), pa.array(np.concatenate(alone).astype(bool)), pa.array([text[s:e] for s, e in zip(start.tolist(), end.tolist())], pa.binary())],
                    ["key", "doc_id", "th", "start", "single", "bytes"],
                )

    return mapped(found, run, "key long, doc_id long, th long, start int, single boolean, bytes binary")


def _spans(rows: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """doc_id, th, s, e of the repeated windows of the single contexts of a block."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for (_, doc, th, start, single, _), mask in zip(rows, repeated([r[5] for r in rows], window)):
        if single and mask.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                for c, v in zip(out, (doc, th, start + s, start + e - 1 + window)):
                    c.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "th", "s", "e"])


def resolve(parts: DataFrame, window: int, block_bytes: int = BLOCK_BYTES, limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, th, s, e: spans of single contexts that repeat in another context of their group."""
    spark = parts.sparkSession
    hot = cut(parts.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > limit).select("key"), "hot")
    some = not hot.isEmpty()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "th", "start", "single", "bytes"))):
                if group and group[0][0] != r[0]:
                    if len(group) > 1 and any(x[4] for x in group):  # a context alone in its group is unique
                        held += group
                        size += sum(len(x[5]) for x in group)
                        if size >= block_bytes:
                            yield from _spans(held, window)
                            held, size = [], 0
                    group = []
                group.append(r)
        if len(group) > 1:
            held += group
        if held:
            yield from _spans(held, window)

    normal = parts.join(hot, "key", "left_anti") if some else parts
    dealt = normal.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    out = mapped(dealt, blocks, "doc_id long, th long, s long, e long")
    if not some:
        return out

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, th, start, single, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "start", "single", "bytes"))):
                n = len(data) - window + 1
                w = [hashlib.blake2b(data[i : i + window], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(np.arange(start, start + n)), pa.array([single] * n, pa.bool_())], ["w", "doc_id", "th", "s", "single"])

    each = cut(mapped(parts.join(hot, "key", "left_semi"), windows, "w binary, doc_id long, th long, s long, single boolean"), "windows")
    twice = each.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w")
    return out.unionByName(each.filter("single").join(twice, "w", "left_semi").select("doc_id", "th", "s", (F.col("s") + window).alias("e")))


def find_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, th, s, e: spans of bytes that repeat; a text's spans may overlap. docs: doc_id, th, text."""
    with Scratch(docs.sparkSession) as scratch:
        seen = cut(anchors(docs, window, gram), "anchors")
        counted = seen.filter("f is not null").groupBy("f").agg(F.sum("n").alias("m"), F.min("h").alias("h1"), F.max("h").alias("h2")).filter("m > 1")
        held = cut(seen.join(counted.select("f", (F.col("h1") != F.col("h2")).alias("mixed")), "f"), "repeats")
        mixed = held.filter("mixed")
        classes = cut(mixed.groupBy("f", "h").agg(F.sum("n").alias("m"), F.min(F.struct("doc_id", "th", "lo", "hi", "at")).alias("r")), "classes")
        span = ("doc_id", "th", F.col("lo").cast("long").alias("s"), (F.col("hi") + window).cast("long").alias("e"))
        sure = held.filter("not mixed").select(*span).unionByName(mixed.join(classes.filter("m > 1").select("f", "h"), ["f", "h"]).select(*span))
        sure = sure.unionByName(seen.filter("f is null").select(*span))
        # contexts that occur once, and all that they might share a window with
        open_ = classes.groupBy("f").agg(F.min("m").alias("least")).filter("least = 1").select("f")
        todo = classes.join(open_, "f").select("r.*", (F.col("m") == 1).alias("single"))
        todo = cut(todo.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi", "at", "single")).alias("items")), "open")
        parts = cut(contexts(docs.join(todo, ["doc_id", "th"]).select("doc_id", "th", "text", "items"), window, gram), "contexts")
        spans = sure.unionByName(resolve(parts, window)).groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
        return scratch.keep(cut(spans, "spans"))


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (removed runs as arrays of start and end), kept (the remaining bytes)."""
    rows = docs.select(ident(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    spans = find_spans(rows, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                sizes, gone, kept = [], [], []
                for t, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                    s = np.array([x["s"] for x in spans or []], np.int64)
                    e = np.array([x["e"] for x in spans or []], np.int64)
                    mine = [[a, z] for _, a, z in _merged(np.zeros(len(s), np.int64), s, e)]
                    edges = [0, *(x for m in mine for x in m), len(t)]
                    sizes.append(len(t))
                    gone.append(mine)
                    kept.append(b"".join([t[a:z] for a, z in zip(edges[::2], edges[1::2])]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    out = mapped(joined, run, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")
    return out.withColumn("doc_id", shown("doc_id"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove(docs, **options)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
