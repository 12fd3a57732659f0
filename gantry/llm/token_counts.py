"""Token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

`Rollup` stores batches of signed per-document changes, already added up to one row per
(source, lang, tokenizer): an insert adds a document's tokens, a delete subtracts them,
and a revised count is a delete of the old and an insert of the new one. Totals are the
sum of all committed batches. A batch is written under its id and counts once its
`_SUCCESS` marker is there, so committing an id again changes nothing, and a batch that
was cut off leaves nothing that counts and can be sent again. `compact` folds committed
batches into one and remembers their ids.

Texts are counted exactly as the tokenizer encodes them. Chunks between single spaces
(`" word"`) tokenise independently under the vocabulary's split pattern, so each task
keeps the counts of distinct chunks; texts with other runs of white space around such a
boundary are encoded whole.

Defined results: a null text has no tokens, as an empty one. Null sources and languages
are groups of their own. Documents with the same id are separate documents. Texts of
any length are counted whole; there are no ties. An empty table gives an empty rollup. Extra
columns are not read, and kept by `count_tokens` but for one called `n_tokens`.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import mapped

KEYS = ("source", "lang", "tokenizer")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TABLE = 500_000


class Counter:
    """Number of tokens of a text."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first: dict[str, int] = {}
        self.rest: dict[str, int] = {}

    def _learn(self, part: str, lead: str, table: dict[str, int]) -> int:
        """Tokens of a chunk; a count no text can reach if it doesn't stand for itself."""
        n = -(1 << 60) if not part or part[0].isspace() or part[-1].isspace() else len(self.coder.encode_ordinary(lead + part))
        if len(table) >= _TABLE:
            table.clear()
        if len(part) <= 200:
            table[part] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        head, *parts = text.split(" ")
        get = self.rest.get
        total = self.first[head] if head in self.first else self._learn(head, "", self.first)
        for p in parts:
            n = get(p)
            total += self._learn(p, " ", self.rest) if n is None else n
        return total if total >= 0 else len(self.coder.encode_ordinary(text))


@functools.lru_cache(maxsize=4)
def _counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` without its text and with n_tokens."""
    keep = [c for c in docs.columns if c.lower() not in (text.lower(), "n_tokens")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for b in batches:
            n = [counter.count(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return mapped(docs, run, schema)


def deltas(changes: DataFrame, sign: str = "sign") -> DataFrame:
    """Changes added up by key: n_docs and n_tokens. sign is 1 for an insert and -1 for a delete.

    The partial sums are taken before the shuffle, so a hot source costs one row a task.
    """
    return changes.groupBy(*KEYS).agg(F.sum(F.col(sign).cast("long")).alias("n_docs"), F.sum(F.col(sign) * F.col("n_tokens")).alias("n_tokens"))


def revise(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes that replace counted documents by their revised counts."""
    cols = [*KEYS, "n_tokens"]
    return old.select(*cols, F.lit(-1).alias("sign")).unionByName(new.select(*cols, F.lit(1).alias("sign")))


class Rollup:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hdfs = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hdfs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hdfs.Path(f"{self.path}/{name}")

    def _folders(self) -> list[str]:
        root = self._hdfs.Path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n for n in names if n.startswith(("batch=", "base=")) and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    def _frames(self, names: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch string"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _live(self) -> list[str]:
        """Committed folders, without batches that the last compaction holds."""
        names = self._folders()
        bases = [n for n in names if n.startswith("base=")]
        if not bases:
            return names
        last = max(bases, key=lambda n: int(n[5:]))
        inside = {r["batch"] for r in self._frames([last]).filter("batch is not null").select("batch").distinct().collect()}
        return [last, *(n for n in names if n.startswith("batch=") and n[6:] not in inside)]

    def _ids(self, names: list[str]) -> set[str]:
        """Ids of the batches in these folders."""
        out = {n[6:] for n in names if n.startswith("batch=")}
        for n in names:
            if n.startswith("base="):
                out |= {r["batch"] for r in self._frames([n]).filter("batch is not null").select("batch").distinct().collect()}
        return out

    def committed(self) -> set[str]:
        return self._ids(self._live())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes once; False if it was committed before.

        The batch is written aside and renamed, so of two writers of one id one counts.
        """
        if not batch or "/" in batch:
            raise ValueError("a batch needs an id without slashes")
        if batch in self.committed():
            return False
        aside = f"writing-{uuid.uuid4().hex}"
        deltas(changes).withColumn("batch", F.lit(None).cast("string")).write.parquet(f"{self.path}/{aside}")
        final = self._at(f"batch={batch}")
        if self._fs.exists(final) and not self._fs.exists(self._at(f"batch={batch}/_SUCCESS")):
            self._fs.delete(final, True)  # what a writer that was cut off left
        moved = not self._fs.exists(final) and self._fs.rename(self._at(aside), final)
        late = self._at(f"batch={batch}/{aside}")  # a folder that came in between takes the renamed one into itself
        if moved and self._fs.exists(late):
            self._fs.delete(late, True)
            moved = False
        if self._fs.exists(self._at(aside)):
            self._fs.delete(self._at(aside), True)
        return moved

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups without documents and tokens go."""
        return self._totals(self._live())

    def _totals(self, names: list[str]) -> DataFrame:
        rows = self._frames(names).filter("batch is null")
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """One folder instead of many: totals, and the ids of the batches in them."""
        names = self._live()  # the totals and the ids of the same folders, whatever is committed meanwhile
        bases = [int(n[5:]) for n in self._folders() if n.startswith("base=")]
        marks = self.spark.createDataFrame([(b,) for b in sorted(self._ids(names))], "batch string").selectExpr("cast(null as string) source", "cast(null as string) lang", "cast(null as string) tokenizer", "0L n_docs", "0L n_tokens", "batch")
        self._totals(names).withColumn("batch", F.lit(None).cast("string")).unionByName(marks).write.parquet(f"{self.path}/base={max(bases, default=0) + 1}")
        for n in names:
            self._fs.delete(self._at(n), True)
