"""Language identification by rank-order profiles (out-of-place distance).

A profile lists the most frequent character n-grams (1 to 3 letters, words padded with a
space) of a language. A document's own most frequent n-grams are ranked the same way,
and its distance to a profile is the sum over them of how far the ranks are apart, or
the profile's size where the n-gram is absent. The nearest profile wins.

Profiles are counted over all training rows: each task adds up its own n-grams by
language, the sums are shuffled, and only the top ranks of each language come to the
driver (`size` n-grams for each of at most `max_languages` languages).

Letters beyond code point 8190 are folded onto as many codes, so a few of them count as the
same letter. Texts of any length are ranked whole.

Defined results: a null text, a text without a letter, or no profile at all gives
`und` with score 0. Equal counts rank by n-gram code, equal distances by language name.
Null languages aren't learned. Rows are independent; an empty table gives an empty
result; other columns are not read. The score is how much nearer the best profile is
than the next one, as a share of the next one's distance (with one profile: of the
largest possible distance).
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gantry.llm.common import bucket, mapped

SIZE, MAX_LANGUAGES = 300, 512
#: Code points below this are told apart, others are folded onto as many codes.
_DIRECT = 8191
_BITS = 14
_GRAM_BITS = 3 * _BITS
_CHUNK_CHARS = 400_000


@functools.lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Code of each code point: 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint64)
    letters = np.array([i for i in range(sys.maxunicode + 1) if chr(i).isalpha()])
    out[letters] = np.where(letters < _DIRECT, letters, _DIRECT + 1 + letters % (_DIRECT - 1)) + 1  # 16382 at most: 16383 marks an absent letter
    return out & np.uint64((1 << _BITS) - 1)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of every n-gram of each text, ordered by row and n-gram."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    joined = " " + "  ".join(texts) + " "
    code = _codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    solid = code > 0
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # one blank after a word
    keep[:-1] |= solid[1:]  # and before it
    code, row = code[keep], row[keep]
    if not len(code):
        return (np.zeros(0, np.uint64),) * 3
    # blanks of two neighbours: drop the second, so that words stand apart by one blank
    double = np.zeros(len(code), bool)
    double[1:] = (code[1:] == 0) & (code[:-1] == 0) & (row[1:] == row[:-1])
    code, row = code[~double], row[~double]
    # a code of all ones marks the absent places of shorter n-grams
    none = np.uint64((1 << _BITS) - 1)
    one = np.uint64(_BITS)
    top = row << np.uint64(_GRAM_BITS)
    a = top | none << np.uint64(2 * _BITS) | none << one | code
    same = row[1:] == row[:-1]
    b = (top[1:] | none << np.uint64(2 * _BITS) | code[:-1] << one | code[1:])[same]
    same3 = same[1:] & same[:-1]
    c = (top[2:] | code[:-2] << np.uint64(2 * _BITS) | code[1:-1] << one | code[2:])[same3]
    keys = np.concatenate([a[code > 0], b, c])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([first, [len(keys)]])).astype(np.uint64)
    keys = keys[first]
    return keys >> np.uint64(_GRAM_BITS), keys & np.uint64((1 << _GRAM_BITS) - 1), counts


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of lower-cased texts of a bounded size: (first row, texts)."""
    start = 0
    while start < len(texts):
        part, size, end = [], 0, start
        while end < len(texts) and (not part or size < _CHUNK_CHARS):
            part.append((texts[end] or "").lower())
            size += len(part[-1])
            end += 1
        yield start, part
        start = end


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram, n over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        loose: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def merge() -> None:
            for name, parts in loose.items():
                parts = parts + ([held[name]] if name in held else [])
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                held[name] = grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams))
            loose.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            merge()
            for name, (grams, n) in held.items():
                for i in range(0, len(grams), 100_000):
                    g = grams[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for b in batches:
            names = np.array(b.column("lang").to_pylist(), object)
            for start, part in _chunks(b.column("text").to_pylist()):
                row, gram, n = _grams(part)
                mine = names[start : start + len(part)]
                for name in set(mine):
                    pick = np.isin(row, np.flatnonzero(mine == name).astype(np.uint64))
                    loose.setdefault(name, []).append((gram[pick], n[pick].astype(np.float64)))
                waiting += len(gram)
                if waiting > 2_000_000:
                    merge()
                    waiting = 0
                    if sum(len(g) for g, _ in held.values()) > 3_000_000:
                        yield from flush()
        yield from flush()

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    parts = mapped(rows, run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = SIZE, max_languages: int = MAX_LANGUAGES) -> dict[str, list[int]]:
    """Profiles: each language's `size` most frequent n-grams, most frequent first."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = gram_counts(docs, lang, text).withColumn("rank", rank).filter(F.col("rank") <= size)
    rows = top.limit(size * max_languages + 1).collect()
    if len(rows) > size * max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """The ranks of all profiles as one matrix over the union of their n-grams."""

    def __init__(self, profiles: dict[str, list[int]], size: int = SIZE):
        self.names = sorted(profiles)
        self.size = size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.ranks = np.full((len(self.grams), len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[name], np.uint64)), j] = np.arange(len(profiles[name]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for _, part in _chunks(texts):
            row, gram, n = _grams(part)
            best = np.full(len(part), -1)
            score = np.zeros(len(part))
            if len(row) and self.names:
                order = np.lexsort((gram, -n.astype(np.int64), row))
                row, gram = row[order].astype(np.int64), gram[order]
                first = np.searchsorted(row, row, "left")
                rank = np.arange(len(row)) - first
                top = rank < self.size
                row, gram, rank = row[top], gram[top], rank[top]
                at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
                ranks = np.where((self.grams[at] == gram)[:, None], self.ranks[at], -1)
                far = np.where(ranks < 0, self.size, np.abs(ranks - rank[:, None]))
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                total = np.add.reduceat(far, starts, axis=0)
                have = row[starts]
                best[have] = total.argmin(axis=1)
                if len(self.names) > 1:
                    two = np.partition(total, 1, axis=1)[:, :2]
                    score[have] = (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1)
                else:
                    most = np.diff(np.concatenate([starts, [len(row)]])) * self.size
                    score[have] = 1 - total[:, 0] / most
            names += [self.names[j] if j >= 0 else "und" for j in best]
            scores += np.clip(score, 0, 1).tolist()
        return names, scores


def predict(docs: DataFrame, profiles: dict[str, list[int]], doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # size * languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(shared.value, size)
        for b in batches:
            names, scores = known.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows outside the fold, applied to all."""
    profiles = learn(docs.filter(bucket("doc_id", 4) != 2))
    return predict(docs, profiles).select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
