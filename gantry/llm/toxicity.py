"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

1. Labelled examples are a bounded sample, `max_examples` at most, drawn by a hash of
   the id from the labelled rows that have a document of at most `max_bytes`, half from
   either label where there are enough. Votes are weighted by the share of a label's rows
   that was drawn, so that the sample's balance does not count.
2. Terms are the words of a lower-cased text. Every term of the examples is in the vector
   space; its inverse document frequency is counted over all documents. As most words
   tell nothing about a label, a term's TF-IDF weight is scaled by its likelihood ratio:
   how much better two rates, one for each label, explain the examples that hold it than
   one rate does. No term is dropped, and terms of either label count.
3. The examples' vectors lie in an inverted index whose posting lists are cut into blocks
   of neighbouring examples, each with its largest weight. A query splits its terms: those
   of little weight, which together can't add more than `REST`, are left for the end. The
   others bound what each block can hold; blocks are taken in the order of their bounds
   until none can hold a nearer neighbour, and what may still be near is summed up over
   all its terms, so the neighbours are exact.
4. The neighbours vote with weights by distance. The vote becomes a score by a logistic
   curve, fitted on votes in which each example is left out of its own neighbours.

The index is bounded by the words of `max_examples` texts of `max_bytes`, and broadcast;
documents are never shuffled. Evidence is the neighbours' ids with their cosines.

Defined results: a null or empty text, or one without a word of the examples, has no
neighbours; its vote is label 1's share of the labelled rows. Texts of any length are
scored whole. Of equal cosines the example that comes first in the index is nearer.
Labels that are null or whose id is null, or that belong to no document, are not read; of
repeated labels of an id the largest counts; of documents with the same id one is the
example, the one whose text has the least hash. Without labelled examples of both kinds
every score is 0. Rows are independent, whatever their ids, so repeated rows give repeated
results; an empty table gives an empty result; other columns are not read, and kept by
`keep_clean`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import Scratch, bucket, cut, mapped, prefix_hash, range_hash, text_slices

MAX_EXAMPLES, MAX_BYTES, NEIGHBOURS, BLOCK, FIRST_BLOCKS, REST = 4_000, 256 << 10, 15, 64, 4, 0.02
_FILTER_BITS = 22
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[97:123] = _PLAIN[128:] = True  # digits, letters, and bytes of other letters
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[~_PLAIN] = 32


def _hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of texts laid end to end, with repeats."""
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = _PLAIN[raw]
    first, last = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner], last[inner - 1] = solid[1:-1][inner], solid[1:-1][inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, starts, "right") - 1, range_hash(prefix_hash(_BLANK[raw]), starts, ends)


def _lower(batch: pa.RecordBatch, text: str = "text") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column(text))], ["text"])


def _distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) in order, and how often each comes."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return row[first], key[first], np.diff(np.concatenate([first, [len(row)]]))


class Terms:
    """Looks the examples' terms up in texts. A term's number is its hash's place in ascending order."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.asarray(hashes, np.uint64)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def counts(self, batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each text, in order: term numbers, their counts, number of the row."""
        for start, end, raw, off in text_slices(_lower(batch, text), "text"):
            row, h = _hashed(raw, off)
            maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            h, row = h[maybe], row[maybe]
            at = np.searchsorted(self.hashes, h)
            hit = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h) if len(self.hashes) else np.zeros(0, np.int64)
            keys, n = np.unique(row[hit] << 32 | at[hit], return_counts=True)
            bounds = np.searchsorted(keys >> 32, np.arange(end - start + 1))
            for r in range(end - start):
                s = slice(bounds[r], bounds[r + 1])
                yield keys[s] & 0xFFFFFFFF, n[s], start + r


def vector(terms: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms that weigh something, and their weights (logarithmic count by the term's weight), of length one."""
    w = (1 + np.log(n)) * weight[terms]
    keep = np.flatnonzero(w)
    w = w[keep]
    return terms[keep], (w / np.sqrt((w * w).sum()) if len(w) else w)


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each run, laid end to end."""
    total = int(sizes.sum())
    return np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total) if total else np.zeros(0, np.int64)


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among labelled vectors.

    ids, labels, votes, sizes by example; terms and weights of their vectors (of length
    one or empty) laid end to end. The examples are laid out by label and strongest term,
    so that blocks are alike within; examples without a term lie nowhere.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, votes: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK):
        self.base = float((votes * labels).sum() / votes.sum()) if len(votes) else 0.0
        begin = np.concatenate([[0], np.cumsum(sizes)])
        full = np.flatnonzero(sizes)
        strongest = np.array([terms[begin[i] + weights[begin[i] : begin[i + 1]].argmax()] for i in full], np.int64)
        full = full[np.lexsort((ids[full], strongest, labels[full]))]
        self.ids, self.labels, self.votes = ids[full], labels[full].astype(float), votes[full].astype(float)
        self.order = {int(x): i for i, x in enumerate(self.ids)}
        self.block, self.blocks = block, -(-len(full) // block)
        # vectors in this order, and the postings by term and then example
        self.size = sizes[full]
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        take = _spread(begin[full], self.size)
        self.terms, self.weights = terms[take].astype(np.int32), weights[take].astype(np.float32)
        place = np.repeat(np.arange(len(full), dtype=np.int32), self.size)
        by = np.lexsort((place, self.terms))
        self.post_place, self.post_weight = place[by], self.weights[by]
        # blocks of each posting list: where they begin, whose they are, and their largest weights
        cell = self.terms[by].astype(np.int64) * max(1, self.blocks) + self.post_place // block
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.cell_begin = np.concatenate([start, [len(cell)]])
        self.cell_block = (cell[start] % max(1, self.blocks)).astype(np.int32)
        self.cell_most = np.maximum.reduceat(self.post_weight, start) if len(start) else np.zeros(0, np.float32)
        self.term_cells = np.searchsorted(cell[start] // max(1, self.blocks), np.arange(n_terms + 1))
        self.query = np.zeros(n_terms)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term, nearest first."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms) or not self.blocks:
            return none
        order = np.argsort(weights, kind="stable")
        # what the least terms add together: by Cauchy and Schwarz their length, as the example's is 1 at most
        rest = np.sqrt(np.cumsum(weights[order] ** 2))
        left = int(np.searchsorted(rest, REST, "right"))
        at = self._search(terms[order[left:]], weights[order[left:]], float(rest[left - 1]) if left else 0.0, k, without)
        if at is None:  # the terms of weight don't decide
            at = self._search(terms, weights, 0.0, k, without)
        if at is None or not len(at):
            return none
        self.query[terms] = weights
        sizes = self.size[at]
        own = _spread(self.begin[at], sizes)
        near = np.add.reduceat(self.query[self.terms[own]] * self.weights[own], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        self.query[terms] = 0.0
        keep = np.flatnonzero(near > 1e-12)
        at, near = at[keep], near[keep]
        pick = np.lexsort((at, -np.round(near, 9)))[:k]
        return at[pick], near[pick]

    def _search(self, terms: np.ndarray, weights: np.ndarray, rest: float, k: int, without: int | None) -> np.ndarray | None:
        """Examples that may be among the k nearest if terms left out add `rest` at most; None if some that share none of these may be."""
        sizes = self.term_cells[terms + 1] - self.term_cells[terms]
        cells = _spread(self.term_cells[terms], sizes)
        weight = np.repeat(weights, sizes)
        bound = np.bincount(self.cell_block[cells], weight * self.cell_most[cells], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        sums, least, few = np.zeros(len(self.ids)), 0.0, True
        for take in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            take = take[bound[take] + rest >= least - 1e-6]
            if not len(take):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[take] = True
            mine = np.flatnonzero(chosen[self.cell_block[cells]])
            c = cells[mine]
            n = self.cell_begin[c + 1] - self.cell_begin[c]
            at = _spread(self.cell_begin[c], n)
            sums += np.bincount(self.post_place[at], self.post_weight[at] * np.repeat(weight[mine], n), len(self.ids))
            if without is not None:
                sums[without] = 0.0
            some = sums[np.flatnonzero(sums)]
            few = len(some) < k
            if not few:
                least = np.partition(some, -k)[-k]
        if rest and (few or least <= rest + 1e-6):
            return None
        return np.flatnonzero(sums >= max(least - rest - 1e-6, 1e-12))

    def vote(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[float, list[int], list[float]]:
        """Share of label 1 among the neighbours, weighted by distance; their ids and cosines."""
        at, near = self.nearest(terms, weights, k, without)
        if not len(at):
            return self.base, [], []
        w = self.votes[at] / (1.05 - np.minimum(near, 1))
        return float((w * self.labels[at]).sum() / w.sum()), self.ids[at].tolist(), near.tolist()


def fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from vote to score, by Newton's method with a small ridge."""
    x = np.stack([votes, np.ones(len(votes))], 1)
    b = np.array([4.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weights * (labels - p)) - 1e-3 * b
        hess = (x * (weights * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def likelihood_ratio(yes: np.ndarray, no: np.ndarray, n_yes: float, n_no: float) -> np.ndarray:
    """Twice the logarithm by which two rates explain counts out of n_yes and n_no better than one rate does."""
    share = (yes + no) / (n_yes + n_no)

    def part(k: np.ndarray, want: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(want, 1e-9)), 0.0)

    out = 2 * (part(yes, n_yes * share) + part(no, n_no * share) + part(n_yes - yes, n_yes * (1 - share)) + part(n_no - no, n_no * (1 - share)))
    return np.maximum(out, 0.0)


def draw(docs: DataFrame, labels: DataFrame, label: str, max_examples: int, max_bytes: int) -> tuple[DataFrame, dict[int, float]]:
    """The sample: i, y, text; and how many labelled rows each example of a label stands for. docs: i, text.

    Labels find their documents first (ids are shuffled, not texts), so that labels without one
    take no place in the sample.
    """
    rated = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    fit = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    rows = cut(rated.join(fit.select("i"), "i", "left_semi"), "labelled")
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few = min(total.values(), default=0)
    chosen: list[tuple[int, int]] = []
    for y in (1, 0):
        most = max(max_examples // 2, max_examples - few)
        chosen += [(r["i"], y) for r in rows.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(most).collect()]
    small = docs.sparkSession.createDataFrame(chosen, "i long, y int")  # max_examples rows at most
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    examples = fit.join(F.broadcast(small), "i").groupBy("i", "y").agg(first.alias("f")).select("i", "y", "f.text")
    return cut(examples, "examples"), {y: total[y] / max(1, sum(1 for _, z in chosen if z == y)) for y in total}


class Model:
    """Terms, their weights, index and curve; what `score` broadcasts."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, index: BlockMaxIndex | None, neighbours: int):
        self.hashes, self.weight, self.index, self.neighbours = hashes, weight, index, neighbours
        self.curve: tuple[float, float] | None = None

    def terms(self) -> Terms:
        """Made once in each worker."""
        if not hasattr(self, "_terms"):
            self._terms = Terms(self.hashes)
        return self._terms

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_terms"}

    def scores(self, batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[float, list[int], list[float]]]:
        """Score, and the neighbours' ids and cosines, of each text."""
        if self.index is None or self.curve is None:
            yield from ((0.0, [], []) for _ in range(batch.num_rows))
            return
        for terms, n, _ in self.terms().counts(batch, text):
            vote, ids, cosines = self.index.vote(*vector(terms, n, self.weight), self.neighbours)
            z = self.curve[0] * vote + self.curve[1]
            yield 1 / (1 + math.exp(-max(z, -500.0))), ids, cosines


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES, neighbours: int = NEIGHBOURS) -> Model:
    """A model of the labels given; document frequencies are of all `docs`."""
    spark = docs.sparkSession
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), None, neighbours)
    source = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("text"))
    with Scratch(spark):
        examples, stands = draw(source, labels, label, max_examples, max_bytes)
        if len(stands) < 2:
            return empty

        def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start, end, raw, off in text_slices(_lower(b), "text"):
                    row, h, n = _distinct(*_hashed(raw, off))
                    bounds = np.searchsorted(row, np.arange(end - start + 1))
                    own = [slice(i, j) for i, j in zip(bounds, bounds[1:])]
                    yield pa.RecordBatch.from_arrays([b.column("i").slice(start, end - start), b.column("y").slice(start, end - start), pa.array([h[s].tobytes() for s in own], pa.binary()), pa.array([n[s].astype(np.int32).tobytes() for s in own], pa.binary())], ["i", "y", "terms", "n"])

        rows = sorted(mapped(examples, bags, "i long, y int, terms binary, n binary").collect(), key=lambda r: r["i"])
        ids, y = np.array([r["i"] for r in rows], np.int64), np.array([r["y"] for r in rows], np.int64)
        sizes = np.array([len(r["terms"]) // 8 for r in rows], np.int64)
        every = np.frombuffer(b"".join(r["terms"] for r in rows), np.uint64)
        counts = np.frombuffer(b"".join(r["n"] for r in rows), np.int32)
        del rows
        hashes, terms = np.unique(every, return_inverse=True)
        yes = np.bincount(terms, np.repeat(y, sizes), len(hashes))
        ratio = likelihood_ratio(yes, np.bincount(terms, minlength=len(hashes)) - yes, float(y.sum()), float((1 - y).sum()))

        known = spark.sparkContext.broadcast(hashes)  # the words of max_examples texts at most

        def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have, df, n = Terms(known.value), np.zeros(len(known.value), np.int64), 0
            for b in batches:
                n += b.num_rows
                for t, _, _ in have.counts(b):
                    df[t] += 1
            there = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(df[there], n))], ["t", "n"])

        found = mapped(source.select("text"), frequencies, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
        place, df = found.column("t").to_numpy(), found.column("n").to_numpy()
        n_docs, by_term = int(df[place < 0].sum()), np.zeros(len(hashes))
        by_term[place[place >= 0]] = df[place >= 0]
        weight = (np.log((1 + n_docs) / (1 + by_term)) + 1) * ratio
        model = Model(hashes, weight, None, neighbours)
        own = [vector(terms[i:j], counts[i:j], weight) for i, j in zip(np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.cumsum(sizes))]
        lengths = np.array([len(t) for t, _ in own], np.int64)
        model.index = BlockMaxIndex(ids, y, np.array([stands[x] for x in y.tolist()]), lengths, np.concatenate([t for t, _ in own]), np.concatenate([w for _, w in own]), len(hashes))
        shared = spark.sparkContext.broadcast(model)

        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for b in batches:
                mine = b.column("i").to_pylist()
                votes = [held.index.vote(*vector(t, n, held.weight), neighbours, held.index.order.get(mine[r]))[0] for t, n, r in held.terms().counts(b)]
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("y"), pa.array(votes, pa.float64())], ["i", "y", "vote"])

        votes = sorted(mapped(examples, left_out, "i long, y int, vote double").collect(), key=lambda r: r["i"])
        shared.destroy()
        known.destroy()
    side = np.array([r["y"] for r in votes])
    model.curve = fit_curve(np.array([r["vote"] for r in votes]), side, np.array([stands[x] for x in side.tolist()]) / max(stands.values()))
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, evidence (ids and cosines of the nearest examples) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
        for b in batches:
            rows = list(shared.value.scores(b))
            evidence = [[{"doc_id": i, "cosine": c} for i, c in zip(ids, cosines)] for _, ids, cosines in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _, _ in rows], pa.float64()), pa.array(evidence, near)], ["doc_id", "score", "evidence"])

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double, evidence array<struct<doc_id:long,cosine:double>>")


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence: learned from the labels outside the fold, applied to all."""
    model = learn(docs, labels.filter(bucket("doc_id", 5) != 0))
    out = score(docs, model).withColumn("held_out", bucket("doc_id", 5) == 0)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs` with a score below the threshold, with all their columns: each row is judged and let through where it lies."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.filter(bucket("doc_id", 5) != 0), text=text))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            only = pa.RecordBatch.from_arrays([b.column(place)], ["text"])
            yield b.filter(pa.array([s < threshold for s, _, _ in model.value.scores(only)], pa.bool_()))

    return mapped(docs, run, docs.schema)
