"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > g | text) = logistic(w . x - t_g): one weight vector for all grades and ordered
thresholds t_g (kept ordered by fitting the logarithms of their gaps). x holds hashed
counts of whole words and of three-byte strings, damped by a logarithm and scaled to
length one, and the share of words that came before. The expected grade is the sum of the grades by their probabilities; the tail
probability is that of the selected grade or a better one, and texts are kept by it.

The model is fitted on a bounded sample of labelled rows, `max_examples` drawn by a hash
of the id, by accelerated full-batch gradient steps; its `dims` weights are broadcast and
every whole text is scored where it lies, without a shuffle.

Defined results: a null or empty text has no features and gets what the thresholds alone
say. Null grades, and grades of ids without a document, are not read; of repeated grades
of an id the largest counts. With one grade that grade is expected with certainty; with
none the grade is null, the tail probability 0 and nothing is kept. Texts of any length are
read whole; of documents with the same id one is rated, that of the least text hash; ties
don't matter to a score. Rows are independent;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import Scratch, bucket, cut, mapped, prefix_hash, range_hash, text_slices, words

MAX_EXAMPLES, DIMS, STEPS, RIDGE = 4_000, 1 << 14, 150, 2e-5


def features(batch: pa.RecordBatch, dims: int = DIMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, values) of each text of column `text`, in order."""
    for start, end, raw, off in text_slices(batch, "text"):
        h, rows, _, _ = words(raw, off)
        prefix = prefix_hash(raw, True)
        at = np.arange(max(0, len(raw) - 2))
        row3 = np.searchsorted(off, at, "right") - 1
        inside = at + 3 <= off[row3 + 1]
        at, row3 = at[inside], row3[inside]
        key = np.concatenate([rows, row3]) * dims + (np.concatenate([h, range_hash(prefix, at, at + 3)]) >> np.uint64(40)).astype(np.int64) % dims
        key, n = np.unique(key, return_counts=True)
        bounds = np.searchsorted(key, np.arange(end - start + 1) * dims)
        value = np.log1p(n)
        order = np.lexsort((h, rows))
        again = (h[order][1:] == h[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        repeated = np.bincount(rows[order][1:][again], minlength=end - start) / np.maximum(np.bincount(rows, minlength=end - start), 1)
        for r in range(end - start):
            s = slice(bounds[r], bounds[r + 1])
            v = value[s]
            at, v = key[s] - r * dims, v / np.sqrt((v * v).sum()) if len(v) else v
            if repeated[r]:  # a place of its own behind the hashed ones
                at, v = np.append(at, dims), np.append(v, repeated[r])
            yield at, v


class OrdinalModel:
    """Grades, weights and thresholds."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > g) for each row and each grade but the last."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None], -35, 35)))


def fit(index: np.ndarray, value: np.ndarray, offsets: np.ndarray, y: np.ndarray, dims: int = DIMS, steps: int = STEPS, ridge: float = RIDGE) -> OrdinalModel:
    """Cumulative-link model of grades y on sparse rows laid end to end."""
    grades = sorted(set(y.tolist()))
    k = len(grades)
    if k < 2:
        return OrdinalModel(grades, np.zeros(dims + 1), np.zeros(0))
    place = np.searchsorted(grades, y)
    rows = np.repeat(np.arange(len(y)), np.diff(offsets))
    better = np.array([(place > j).mean() for j in range(k - 1)])
    first = -np.log(better / (1 - better))
    dims += 1
    w, t = np.zeros(dims), np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m_w, v_w, m_t, v_t = np.zeros(dims), np.zeros(dims), np.zeros(k - 1), np.zeros(k - 1)
    for step in range(1, steps + 1):
        gaps = np.exp(t[1:])
        thresholds = t[0] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(rows, value * w[index], len(y))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - thresholds[None], -35, 35)))
        # P(grade) = above(lower threshold) - above(upper threshold), and how it changes with each
        wide = np.concatenate([np.ones((len(y), 1)), p, np.zeros((len(y), 1))], 1)
        slope = wide * (1 - wide)
        at = np.arange(len(y))
        chance = np.maximum(wide[at, place] - wide[at, place + 1], 1e-9)
        by_z = (slope[at, place] - slope[at, place + 1]) / chance
        by_t = np.zeros((len(y), k + 1))
        np.add.at(by_t, (at, place), -slope[at, place] / chance)
        np.add.at(by_t, (at, place + 1), slope[at, place + 1] / chance)
        by_t = by_t[:, 1:k].mean(axis=0)
        g_w = -np.bincount(index, value * by_z[rows], dims) / len(y) + ridge * w
        tail = np.cumsum(by_t[::-1])[::-1]
        g_t = -np.concatenate([tail[:1], tail[1:] * gaps])
        for x, g, m, v, rate in ((w, g_w, m_w, v_w, 0.3), (t, g_t, m_t, v_t, 0.05)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return OrdinalModel(grades, w, t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]))


def learn(docs: DataFrame, labels: DataFrame, grade: str = "quality", doc_id: str = "doc_id", text: str = "text", max_examples: int = MAX_EXAMPLES, dims: int = DIMS) -> OrdinalModel:
    """The model of at most `max_examples` rated documents."""
    rated = labels.filter(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max(F.col(grade).cast("int")).alias("y"))
    source = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("text"))
    # ratings find their documents first, so that those without one take no place in the sample
    rows = [(r["i"], r["y"]) for r in rated.join(source.select("i"), "i", "left_semi").orderBy(F.xxhash64("i"), "i").limit(max_examples).collect()]
    if not rows:
        return OrdinalModel([], np.zeros(dims + 1), np.zeros(0))
    chosen = docs.sparkSession.createDataFrame(rows, "i long, y int")  # max_examples rows at most
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))  # of documents with the same id the one of the least hash
    drawn = source.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(first.alias("f")).select("i", "y", "f.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(features(b.select(["text"]), dims))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["i", "y", "at", "value"])

    with Scratch(docs.sparkSession):
        held = sorted(cut(mapped(drawn, run, "i long, y int, at binary, value binary"), "rated").collect(), key=lambda r: r["i"])
    index = np.frombuffer(b"".join(r["at"] for r in held), np.int32)
    value = np.frombuffer(b"".join(r["value"] for r in held), np.float32)
    return fit(index, value, np.concatenate([[0], np.cumsum([len(r["at"]) // 4 for r in held])]), np.array([r["y"] for r in held], np.int64), dims)


def score(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text", select: int | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept of every row.

    select: the least grade to be kept; by default the best one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        grades = np.array(held.grades, float)
        for b in batches:
            z = np.array([float((v * held.weights[i]).sum()) for i, v in features(b.select(["text"]), len(held.weights) - 1)])
            n = b.num_rows
            if len(grades):
                above = np.concatenate([np.ones((n, 1)), held.above(z), np.zeros((n, 1))], 1)
                expected = pa.array(((above[:, :-1] - above[:, 1:]) * grades).sum(axis=1))
                tail = above[:, int(np.searchsorted(grades, grades[-1] if select is None else select))]
            else:
                expected, tail = pa.nulls(n, pa.float64()), np.zeros(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), expected, pa.array(tail), pc.greater_equal(pa.array(tail), threshold)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean")


def grade_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept: learned outside a fold, applied to all."""
    model = learn(docs, labels.filter(bucket("doc_id", 5) != 1))
    return score(docs, model).select("doc_id", (bucket("doc_id", 5) == 1).alias("held_out"), "expected_grade", "tail_probability", "kept")
