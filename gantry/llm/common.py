"""Shared helpers: tables, the shared folder, Arrow batches and vectorised hashing.

Hashes are 64-bit and seeded by constants, so every executor and every retry of a
task computes the same values.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U64 = np.uint64
#: Text bytes handled at once by the numpy kernels.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`.

    Where it is unset a temporary folder is set, but only in local mode; on a
    cluster that would be a machine-local folder, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="gantry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there.

    A lost executor costs no recomputation of what lies before the cut. An open `Scratch`
    of this thread deletes the table; without one it stays for as long as its result may
    be read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if Scratch.open():
        Scratch.open()[-1].made.append(path)
    return out


class Scratch:
    """Deletes the tables that `cut` makes while it is open, but for those it is told to keep.

    Open scopes are a thread's own, so queries in several threads don't touch each other's.

    with Scratch(spark) as s:
        out = s.keep(cut(...))
    """

    _here = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    @classmethod
    def open(cls) -> list[Scratch]:
        if not hasattr(cls._here, "scopes"):
            cls._here.scopes = []
        return cls._here.scopes

    def __enter__(self) -> Scratch:
        Scratch.open().append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """A table made by `cut` that outlives this scope; a scope around it takes it over."""
        self.made.remove(df.cut_path)
        outer = Scratch.open()[: Scratch.open().index(self)]
        if outer:
            outer[-1].made.append(df.cut_path)
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scope that nothing reads any more."""
        for df in tables:
            self.made.remove(df.cut_path)
            self.delete(df)

    def delete(self, df: DataFrame) -> None:
        self._delete(df.cut_path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *error: object) -> None:
        Scratch.open().remove(self)
        for name in self.made:
            self._delete(name)


#: Rows whose keys may be broadcast, some 30 bytes each; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: What names a row: a hash of its file's path, and its place there.
ROW = ("__gantry_file", "__gantry_row")


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with two more columns (`ROW`) that name each row, the same ones in every scan.

    Ids may be missing or repeated, so decisions about rows can't be applied by them. A
    table that isn't a plain scan of Parquet files is written to the shared folder first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName().split(" ")[0] != "LogicalRelation" and plan.getClass().getSimpleName() != "LogicalRelation" or not all(f.endswith(".parquet") for f in docs.inputFiles()):
        docs = cut(docs, "rows")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a `keyed` table, without their keys, that aren't in `gone` (a written table of keys).

    Few enough keys are broadcast, so that texts stay where they are.
    """
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone.select(*ROW), list(ROW), "left_anti").drop(*ROW)


NO_ID = (1 << 63) - 1


def ident(col: str | Column) -> Column:
    """The id as a bigint; a null one counts as the largest, so that rows without id meet in joins and never come first."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("long"), F.lit(NO_ID).cast("long"))


def shown(col: str) -> Column:
    """An id made by `ident`, null again where there was none."""
    return F.nullif(F.col(col), F.lit(NO_ID).cast("long"))


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def tidy() -> None:
    """Give memory that a task no longer needs back to the system: its worker lives on for other stages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


_held: dict[tuple, object] = {}


def held(make: Callable[[str], object], name: str) -> object:
    """`make(name)`, kept in this worker for the tasks of queries that ask for it (`mapped` with `keeps`)."""
    key = (make, name)
    if key not in _held:
        _held.clear()
        _held[key] = make(name)
    return _held[key]


def forget() -> None:
    """Give back what earlier queries `held` in this worker."""
    if _held:
        _held.clear()
        tidy()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, keeps: bool = False, piece: int = BATCH_BYTES) -> DataFrame:
    """`mapInArrow`, in pieces of at most `piece` bytes (or one row), whose worker is tidied after each task.

    Whole texts can be long, and a batch is held by the executor and its worker. So a
    session that hands Python larger batches is set to `BATCH_BYTES`, which no result depends
    on. What an earlier query `held` in the worker goes first, unless this one `keeps` such things.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(setting, None) != str(BATCH_BYTES):
        df.sparkSession.conf.set(setting, BATCH_BYTES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = max(1, -(-b.nbytes // piece))
            step = max(1, -(-b.num_rows // n))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)

    def run_tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from run(pieces(batches))
        finally:
            tidy()

    return df.mapInArrow(run_tidy, schema)


def bucket(col: str, n: int) -> Column:
    """crc32 of the column as text (null: empty), modulo n: the fold rule of the learned operators."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def text_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts take about `limit` bytes: (first row, end row, UTF-8 bytes, offsets).

    A text longer than the limit gets a run of its own. Null counts as empty.
    """
    col = batch.column(column)
    if col.null_count:
        col = pc.fill_null(col, "")
    large = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start, n = 0, len(col)
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        end = min(end, n)
        yield start, end, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x.copy()
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit constants."""
    return mix64((np.arange(1, n + 1, dtype=_U64) + _U64(seed) * _U64(1 << 32)) * _U64(0x9E3779B97F4A7C15)) | _U64(1)


_BASE = int(0xD6E8FEB86659FD93)
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = constants(256, 7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            out = np.ones(1, _U64)
            step = base
            while len(out) < size:
                out = np.concatenate([out, out * _U64(step)])
                step = step * step % (1 << 64)
            _powers[key] = out
    return _powers["p"][:n], _powers["q"][:n]


def prefix_hash(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums for `range_hash`."""
    p, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, _U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * p[: len(raw)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end, equal for equal bytes wherever they stand."""
    _, q = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * q[starts] + (ends - starts).astype(_U64) * _U64(0x9E3779B97F4A7C15))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased: hashes, row numbers, starts, ends."""
    n = len(raw)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[raw]
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = solid[1:-1][inner]
    last[inner - 1] = solid[1:-1][inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = range_hash(prefix_hash(raw, True), starts, ends)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows, starts, ends


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a row, in order, and each row's offsets into them.

    A row of 1 to k-1 words has one shingle, its whole sequence; a row without words none.
    """
    weights = constants(k, 11)
    counts = np.bincount(rows, minlength=n_rows).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes)
    if n >= k:
        h = np.full(n - k + 1, _U64(k))
        for i in range(k):
            h += mix64(hashes[i : n - k + 1 + i] + _U64(i)) * weights[i]
        keep = rows[: n - k + 1] == rows[k - 1 :]
        h, at = mix64(h[keep]), rows[: n - k + 1][keep]
    else:
        h, at = np.zeros(0, _U64), np.zeros(0, rows.dtype)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), _U64)
        for j, r in enumerate(short):
            part = hashes[begin[r] : begin[r + 1]]
            total = _U64(len(part))
            with np.errstate(over="ignore"):
                for i, x in enumerate(part):
                    total += mix64(np.array([x + _U64(i)]))[0] * weights[i]
            extra[j] = total
        h, at = np.concatenate([h, mix64(extra)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n_rows))]).astype(np.int64)


def distinct_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new offsets."""
    parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for r in range(len(offsets) - 1):
        x = np.sort(values[offsets[r] : offsets[r + 1]])
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        parts.append(x)
        sizes[r] = len(x)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def word_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The shingle set of each text as a sorted array."""
    out: list[np.ndarray] = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["t"])
    for a, b, raw, off in text_slices(batch, "t"):
        h, rows, _, _ = words(raw, off)
        s, so = shingles(h, rows, b - a, k)
        s, so = distinct_rows(s, so)
        out += [s[so[i] : so[i + 1]] for i in range(b - a)]
    return out


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
