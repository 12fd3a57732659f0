"""SentencePiece encoding and decoding by a distinct-chunk table.

When no piece of a model holds a whitespace marker after another character, no merge
can cross the start of a run of markers. A text then falls into chunks (a run of
markers and the characters up to the next run) that segment independently, so each
distinct chunk is segmented once and the ids are joined back by position.

Defined results: null counts as an empty text, which has no ids and decodes to an
empty text. Repeated rows and ids are kept as they are; an empty table gives an empty
table. Other columns pass through `encode`, which replaces columns called `ids`,
`n_tokens` and `decoded`. Texts are never cut: a chunk may be as long as its text.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gantry.llm.common import held, mapped, sha256_hex

MARK = "▁"
#: The table is emptied beyond this many chunks (or characters in them), which bounds a worker's memory.
TABLE_CHUNKS, TABLE_CHARS = 200_000, 4_000_000
#: Characters of texts cut into chunks at once (or one text).
TEXT_CHARS = 250_000
#: Bytes of documents encoded at once where the ids themselves are returned, which take three times as much.
ENCODE_BYTES = 2 << 20
_RUN = re.compile(" +[^ ]*")


class ChunkTable:
    """Ids and decoded text of each distinct chunk seen so far."""

    def __init__(self, model_file: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers: chunks don't segment independently")
        # a prefix that stays in front when decoding, so that a chunk keeps its own leading space
        self.front = self.sp.encode("x")
        self.blank = self.sp.piece_to_id(MARK)
        if self.sp.encode("x  y \tz") != self.front + self.sp.encode(" y") + self.sp.encode("\tz"):
            raise ValueError("this model's normaliser changes white space: chunks don't segment independently")
        self.ids: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # chunks that decode to something else than themselves
        self.chars = 0

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks without their first marker. An empty text has none."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" in parts:
            parts = [x[1:] for x in _RUN.findall(" " + text)]
        return parts

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.ids, self.odd, self.chars = {}, {}, 0
        new = [c for c in chunks if c not in self.ids]
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            coded = self.sp.encode(part, num_threads=1)
            coded = [c if p else [self.blank] for p, c in zip(part, coded)]
            self.ids.update(zip(part, [str(c)[1:-1] for c in coded]))
            self.chars += sum(map(len, part))
            # each chunk's ids are decoded once; most give the chunk again, so only the others are kept
            for p, b in zip(part, self.sp.decode([self.front + c for c in coded], num_threads=1)):
                if b != f"x {p}":
                    self.odd[p] = b[1:]

    def encode(self, parts: list[str]) -> str:
        """The ids, in decimal and joined by commas."""
        ids = self.ids
        return ",".join([ids[p] for p in parts]).replace(" ", "")

    def decode(self, parts: list[str]) -> str:
        """What the ids of these chunks decode to, joined by position."""
        if not parts:
            return ""
        if self.odd and not self.odd.keys().isdisjoint(parts):
            return "".join([self.odd.get(p, " " + p) for p in parts])[1:]
        return " ".join(parts)


def _coded(texts: list[str | None], model_file: str) -> Iterator[tuple[str, int, str]]:
    """(ids, number of ids, decoded text) of each text, `TEXT_CHARS` at a time."""
    table = held(ChunkTable, model_file)
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size < TEXT_CHARS):
            size += len(texts[end] or "")
            end += 1
        gc.disable()  # the table holds no cycles, and walking it again and again is slow
        try:
            parts = [table.chunks(t or "") for t in texts[start:end]]
            table.learn(set().union(*parts))
            done = []
            for p in parts:
                ids = table.encode(p)
                done.append((ids, ids.count(",") + 1 if p else 0, table.decode(p)))
        finally:
            gc.enable()
        yield from done
        start = end


def encode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """`docs` with `n_tokens` (bigint), `ids` (array of int) and `decoded` (string)."""
    keep = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "decoded")]
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = list(_coded(part.column(text).to_pylist(), model_file))
                ids = pc.cast(pc.if_else(pa.array([n == 0 for _, n, _ in rows], pa.bool_()), pa.scalar([], pa.list_(pa.string())), pc.split_pattern(pa.array([i for i, _, _ in rows], pa.string()), ",")), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([n for _, n, _ in rows], pa.int64()), ids, pa.array([d for _, _, d in rows], pa.string())], schema.names)

    return mapped(docs, run, schema, keeps=True, piece=ENCODE_BYTES)


def decode(frame: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """`frame` with `decoded`: the library's text for each row's ids (null: empty)."""
    keep = [c for c in frame.columns if c.lower() != "decoded"]
    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = held(ChunkTable, model_file).sp
        for b in batches:
            texts = [sp.decode(x) if x else "" for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], schema.names)

    return mapped(frame, run, schema, keeps=True)


def digests(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens and the SHA-256 of the ids (decimal, comma-joined) and of the decoded text."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, left, right = [], [], []
            for ids, n, back in _coded(b.column(text).to_pylist(), model_file):
                counts.append(n)
                left.append(sha256_hex(ids.encode()))
                right.append(sha256_hex(back.encode()))
            yield pa.RecordBatch.from_arrays([b.column(doc_id), pa.array(counts, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], schema.names)

    return mapped(docs.select(doc_id, text), run, schema, keeps=True)
