"""Exact dedup with a cuckoo-filter index of live digests.

Texts are equal when they agree after deleting `[\\x20\\x09-\\x0D]`. Digests are dealt
to index partitions by value; each partition holds a cuckoo filter whose buckets keep,
beside the short fingerprint, the content that a hit is verified against (the whole
SHA-256 of the text), with its survivor and number of live copies. An insertion that finds
no free slot grows the table and re-inserts the stored keys, and a deletion takes a
document out of its key. Where the survivor itself was deleted, the key's live documents
are looked at again for the next one, those of such keys only.

`LiveDigests` keeps the signed changes of all batches in a shared folder, so an index
outlives a query: later batches are added to it, by id and once each.

Copies are combined before the shuffle, so a digest that a third of all rows share
arrives as a few partial counts. The survivor joins back to the rows by a sort-merge
join on digests, whose hot partitions adaptive execution splits; texts aren't shuffled.

Defined results: null counts as empty, and empty texts are equal to one another. Of
equal texts the longest (code points of the original) stays, then the smallest id, a null
one last, then the row that comes first in its file (`common.keyed`), so that one row of
each group stays, whatever the ids. Texts of any length are read whole; an empty table
gives an empty result. Columns other than the id and text are not read by
`find_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import ROW, Scratch, cut, ident, keyed, mapped, shown, without

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
SLOTS, MAX_KICKS, FIRST_BUCKETS = 4, 200, 256
#: Rows for each index partition, which bounds an index's memory at any size of the table.
PARTITION_ROWS = 250_000


class CuckooIndex:
    """Cuckoo filter over digests with stored keys: exact insert, delete and lookup.

    `entries[b]` holds up to SLOTS items `[fingerprint, key, survivor, count]`, and
    survivor is the best (largest) tuple inserted for that key, or None after it was
    deleted and until a better one than all deleted comes.
    """

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.mask = (1 << max(1, math.ceil(math.log2(max(2, buckets))))) - 1
        self.entries: list[list[list]] = [[] for _ in range(self.mask + 1)]
        self.size = self.grown = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "big") | 1 << 16
        one = int.from_bytes(key[8:16], "big") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 >> 3 & self.mask)

    def lookup(self, key: bytes) -> list | None:
        mark, one, two = self._places(key)
        for b in (one, two):
            for e in self.entries[b]:
                if e[0] == mark and e[1] == key:  # the filter hits, then the stored key decides
                    return e
        return None

    def insert(self, key: bytes, survivor: tuple[int, ...], count: int = 1) -> bool:
        """True if the key is new."""
        e = self.lookup(key)
        if e:
            e[2], e[3] = e[2] and max(e[2], survivor), e[3] + count
            return False
        self._place([0, key, survivor, count])
        self.size += 1
        return True

    def _place(self, e: list) -> None:
        homeless = self._kick(e)
        while homeless:
            homeless = self._grow(homeless)

    def _kick(self, e: list) -> list | None:
        e[0], one, two = self._places(e[1])
        for b in (one, two):
            if len(self.entries[b]) < SLOTS:
                self.entries[b].append(e)
                return None
        b = one
        for i in range(MAX_KICKS):
            row = self.entries[b]
            row[i % SLOTS], e = e, row[i % SLOTS]
            b = self._other(b, e[0])
            if len(self.entries[b]) < SLOTS:
                self.entries[b].append(e)
                return None
        return e

    def _grow(self, extra: list) -> list | None:
        """Twice the buckets, filled from the stored keys; what still found no place."""
        old = [e for row in self.entries for e in row] + [extra]
        self.mask = self.mask * 2 + 1
        self.entries = [[] for _ in range(self.mask + 1)]
        self.grown += 1
        left = [x for x in map(self._kick, old) if x]
        for x in left[1:]:
            self._place(x)
        return left[0] if left else None

    def delete(self, key: bytes, count: int = 1, gone: tuple[int, ...] | None = None) -> bool:
        """Take `count` documents, the best of them `gone`, out of a key; the key goes with its last. False if it isn't live."""
        e = self.lookup(key)
        if not e:
            return False
        e[3] -= count
        if e[2] is not None and gone is not None and gone >= e[2]:
            e[2] = None
        if e[3] <= 0:
            for b in self._places(key)[1:]:
                self.entries[b] = [x for x in self.entries[b] if x is not e]
            self.size -= 1
        return True

    def items(self) -> Iterator[list]:
        return (e for row in self.entries for e in row)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sha (32 bytes: SHA-256 of the text without white space), cp (code points of the text), and the row's keys of a `keyed` table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = pc.fill_null(b.column("text"), "")
            sha = [hashlib.sha256(x.translate(None, WHITE)).digest() for x in col.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sha, pa.binary()), pc.cast(pc.utf8_length(col), pa.int64()), *(b.column(c) for c in ROW)], ["doc_id", "sha", "cp", *ROW])

    return mapped(docs.select(ident(doc_id).alias("doc_id"), F.col(text).alias("text"), *ROW), run, f"doc_id long, sha binary, cp long, {ROW[0]} long, {ROW[1]} long")


#: A document's place among equal texts: the largest stays. Complements turn the order of ids round.
_RANK = ("cp", *(f"low_{c}" for c in ("doc_id", *ROW)))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("sha", "n", "cp", *[F.bitwise_not(c).alias(f"low_{c}") for c in ("doc_id", *ROW)])


def index(changes: DataFrame, partitions: int) -> DataFrame:
    """Live digests of signed changes (sha, cp, doc_id, keys, n): sha, keep_id, keys of the row that stays, group_size.

    n is the number of copies to insert, or below zero to delete. Each partition feeds
    its own cuckoo index, insertions before deletions.
    """
    ranked = _ranked(changes)
    salt = F.pmod("low_doc_id", F.lit(16))
    combined = ranked.groupBy("sha", salt.alias("salt"), (F.col("n") > 0).alias("adds")).agg(F.max(F.struct(*_RANK)).alias("best"), F.sum("n").alias("n"))
    dealt = combined.select("sha", "n", "adds", "best.*").repartition(partitions, "sha").sortWithinPartitions(F.desc("adds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = CuckooIndex()
        for b in batches:
            for sha, n, *rank in zip(*(b.column(c).to_pylist() for c in ("sha", "n", *_RANK))):
                if n > 0:
                    held.insert(sha, tuple(rank), n)
                elif n < 0:
                    held.delete(sha, -n, tuple(rank))
        rows: list[list] = []
        for e in held.items():
            rows.append(e)
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    live = mapped(dealt, run, "sha binary, n long, " + ", ".join(f"{c} long" for c in _RANK))
    if not changes.filter("n < 0").isEmpty():
        # keys whose survivor went: the best of what is left of them
        live = cut(live, "live")
        open_ = live.filter("cp is null").select("sha", "n")
        left = ranked.join(open_.select("sha"), "sha", "left_semi").groupBy("sha", *_RANK).agg(F.sum("n").alias("left")).filter("left > 0")
        best = left.groupBy("sha").agg(F.max(F.struct(*_RANK)).alias("best")).select("sha", "best.*")
        live = live.filter("cp is not null").unionByName(open_.join(best, "sha"))
    return live.select("sha", F.bitwise_not("low_doc_id").alias("keep_id"), *[F.bitwise_not(f"low_{c}").alias(f"keep_{c}") for c in ROW], F.col("n").alias("group_size"))


def _batch(rows: list[list]) -> pa.RecordBatch:
    ranks = [[e[2][k] if e[2] else None for e in rows] for k in range(len(_RANK))]
    return pa.RecordBatch.from_arrays([pa.array([e[1] for e in rows], pa.binary()), pa.array([e[3] for e in rows], pa.int64()), *(pa.array(r, pa.int64()) for r in ranks)], ["sha", "n", *_RANK])


def _partitions(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / PARTITION_ROWS))


class LiveDigests:
    """An index that is kept between batches, as signed changes by batch id in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hdfs = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hdfs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def apply(self, batch: str, docs: DataFrame, sign: int = 1, doc_id: str = "doc_id", text: str = "text") -> bool:
        """Insert the documents, or with sign -1 delete them (known by id and text); False if that batch was applied before."""
        if not batch or "/" in batch:
            raise ValueError("a batch needs an id without slashes")
        final = self._hdfs.Path(f"{self.path}/batch={batch}")
        if self._fs.exists(final):
            return False
        rows = digests(docs.select(doc_id, text, *[F.lit(0).cast("long").alias(c) for c in ROW]), doc_id, text).withColumn("n", F.lit(sign).cast("long"))
        aside = f"{self.path}/_{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        if self._fs.rename(self._hdfs.Path(aside), final) and not self._fs.exists(self._hdfs.Path(f"{self.path}/batch={batch}/{aside.rsplit('/', 1)[-1]}")):
            return True
        self._fs.delete(self._hdfs.Path(f"{self.path}/batch={batch}/{aside.rsplit('/', 1)[-1]}"), True)
        self._fs.delete(self._hdfs.Path(aside), True)
        return False

    def live(self) -> DataFrame:
        """sha, keep_id, group_size of every digest with a live document."""
        schema = f"doc_id long, sha binary, cp long, {ROW[0]} long, {ROW[1]} long, n long"
        names = [s.getPath().toString() for s in self._fs.listStatus(self._hdfs.Path(self.path)) if s.getPath().getName().startswith("batch=")] if self._fs.exists(self._hdfs.Path(self.path)) else []
        if not names:
            return self.spark.createDataFrame([], "sha binary, keep_id long, group_size long")
        changes = self.spark.read.schema(schema).parquet(*names)
        return index(changes, _partitions(self.spark, changes.count())).select("sha", shown("keep_id").alias("keep_id"), "group_size")


def _judged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of a `keyed` table: doc_id, keys, sha, keep_id, group_size, kept."""
    rows = cut(digests(docs, doc_id, text), "digests")
    live = index(rows.withColumn("n", F.lit(1).cast("long")), _partitions(docs.sparkSession, rows.count()))
    own = (F.col("doc_id") == F.col("keep_id")) & (F.col(ROW[0]) == F.col(f"keep_{ROW[0]}")) & (F.col(ROW[1]) == F.col(f"keep_{ROW[1]}"))
    return rows.join(live, "sha").select("doc_id", *ROW, "sha", "keep_id", "group_size", own.alias("kept"))


def find_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _judged(keyed(docs), doc_id, text)
    return rows.select(shown("doc_id").alias("doc_id"), shown("keep_id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: all columns of one row of each group of equal texts."""
    rows = keyed(docs)
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.keep(cut(_judged(rows, doc_id, text).filter("not kept").select(*ROW), "gone"))
    return without(rows, gone)
