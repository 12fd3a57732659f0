"""Byte-level BPE vocabularies: distributed pre-token counts, then the merge loop on counts.

Counting is relational and covers every row. The merge loop runs in the tasks of one barrier
stage: each keeps its share of the distinct pre-tokens as one array of ids, and its share of the
pairs' counts. A round takes the most frequent pairs as long as none of them touches another, so
that together they do what one after the other would do; tasks exchange candidates and changes of
counts. The driver gets the merges only. `merge_rules` states the same on one machine.
"""

from __future__ import annotations

import heapq
import json
import secrets
import socket
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pre-tokeniser's pattern and the special tokens, in order.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = ("<s>", "<pad>", "</s>", "<unk>", "<mask>")
#: Candidates that a task offers in a round.
OFFER = 64
#: Tasks of the merge stage at most: each hears of every other one's changes.
MAX_TASKS = 64


def pretokens(text: Column) -> Column:
    """Pre-tokens of a stripped text with a leading space: array of strings."""
    stripped = F.regexp_replace(text, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.concat(F.lit(" "), stripped), F.lit("(?U)" + PATTERN), F.lit(0)))


def pretoken_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """token, n over all rows."""
    return rows.select(F.explode(pretokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where it prints, else from 256 on."""
    plain = [b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return dict(sorted(out.items()))


def merge_rules(counts: dict[str, int], size: int) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(vocabulary, merges) from pre-token counts: the most frequent pair first, ties by lowest ids."""
    letters = byte_alphabet()
    words = sorted((tuple(letters[b] for b in w.encode()), n) for w, n in counts.items())
    vocabulary = {t: i for i, t in enumerate((*SPECIAL, *sorted({c for w, _ in words for c in w})))}
    pieces = [list(w) for w, _ in words]
    freq = [n for _, n in words]
    totals: Counter = Counter()
    where: defaultdict = defaultdict(set)
    for i, w in enumerate(pieces):
        for p in zip(w, w[1:]):
            totals[p] += freq[i]
            where[p].add(i)
    key = lambda p: (-totals[p], vocabulary[p[0]], vocabulary[p[1]], p)
    heap = [key(p) for p in totals]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(vocabulary) < size:
        top = heapq.heappop(heap)
        pair = top[3]
        if totals[pair] <= 0:
            continue
        if -top[0] != totals[pair]:
            heapq.heappush(heap, key(pair))
            continue
        new = pair[0] + pair[1]
        merges.append(pair)
        vocabulary.setdefault(new, len(vocabulary))
        touched = set()
        for i in where.pop(pair):
            w = pieces[i]
            for p in zip(w, w[1:]):
                totals[p] -= freq[i]
                touched.add(p)
            out, j = [], 0
            while j < len(w):
                if j + 1 < len(w) and (w[j], w[j + 1]) == pair:
                    out.append(new)
                    j += 2
                else:
                    out.append(w[j])
                    j += 1
            pieces[i] = out
            for p in zip(out, out[1:]):
                totals[p] += freq[i]
                where[p].add(i)
                touched.add(p)
        for p in touched:
            if totals[p] > 0:
                heapq.heappush(heap, key(p))
    return vocabulary, merges


def together(offers: list[tuple[int, int, int]], known: Callable[[int, int], bool], room: int) -> list[tuple[int, int]]:
    """The first pairs of `offers` (-count, left, right; sorted) that are the next merges in this order.

    A merge (c, d) changes the counts of pairs that end in c or begin with d, and what it creates is
    no more frequent than those: while no pair on the way is one, the order stands. What a merge of
    two equal tokens or one into a token that is `known` already raises has no such bound, so they
    come last.
    """
    firsts: set[int] = set()
    seconds: set[int] = set()
    out = []
    for _, a, b in offers:
        if a in seconds or b in firsts or room == 0:
            break
        old = known(a, b)
        if old and out:
            break
        out.append((a, b))
        if old or a == b:
            break
        firsts.add(a)
        seconds.add(b)
        room -= 1
    return out


class _Share:
    """A task's words as ids from 1 on, with a 0 before, between and after them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, ids: np.ndarray):
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        self.ids = np.concatenate((np.zeros(1, np.int32), ids[np.frombuffer(b"".join(w + b"\xff" for w in words), np.uint8)]))
        self.word = np.concatenate((np.zeros(1, np.int32), np.repeat(np.arange(len(words), dtype=np.int32), lengths)))
        self.counts = counts
        self.rounds = 0

    def pairs(self, at: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """(left << 32 | right, signed counts) of neighbours at places."""
        a, b = self.ids[at], self.ids[at + 1]
        there = (a != 0) & (b != 0)
        return a[there].astype(np.int64) << 32 | b[there], self.counts[self.word[at[there]]] * sign

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        step = 1 << 20
        return _summed([_summed([self.pairs(np.arange(i, min(i + step, len(self.ids) - 1)), 1)]) for i in range(0, len(self.ids) - 1, step)])

    def merge(self, merged: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Merge pairs (left, right, new id), of which none overlaps another; the changes of counts."""
        pairs = np.array(sorted((a << 32 | b, new) for a, b, new in merged), np.int64)
        first = np.zeros(max(int(self.ids.max()), int(max(a for a, _, _ in merged))) + 1, bool)
        first[[a for a, _, _ in merged]] = True
        at = np.flatnonzero(first[self.ids])
        at = at[at < len(self.ids) - 1]
        keys = self.ids[at].astype(np.int64) << 32 | self.ids[at + 1]
        place = np.minimum(np.searchsorted(pairs[:, 0], keys), len(pairs) - 1)
        hit = pairs[place, 0] == keys
        at, place = at[hit], place[hit]
        if any(a == b for a, b, _ in merged) and len(at):  # of a run of one id, every other place from its left
            start = np.concatenate(([True], np.diff(at) != 1))
            run = np.maximum.accumulate(np.where(start, at, 0))
            kept = (at - run) % 2 == 0
            at, place = at[kept], place[kept]
        if not len(at):
            return _summed([])
        before = self.pairs(np.unique(np.concatenate((at - 1, at, at + 1))), -1)
        self.ids[at] = pairs[place, 1]
        stays = np.ones(len(self.ids), bool)
        stays[at + 1] = False
        self.ids, self.word = self.ids[stays], self.word[stays]
        now = at - np.arange(len(at))
        after = self.pairs(np.unique(np.concatenate((now - 1, now))), 1)
        self.rounds += 1
        if self.rounds % 32 == 0:  # words of one token are done
            done = np.flatnonzero((self.ids[1:-1] != 0) & (self.ids[:-2] == 0) & (self.ids[2:] == 0)) + 1
            stays = np.ones(len(self.ids), bool)
            stays[done], stays[done + 1] = False, False
            self.ids, self.word = self.ids[stays], self.word[stays]
        return _summed([before, after])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in parts]])
    values = np.concatenate([np.zeros(0, np.int64), *[v for _, v in parts]])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    sums = np.add.reduceat(values, first) if len(first) else values
    return keys[first][sums != 0], sums[sums != 0]


class _Totals:
    """Counts of the pairs that a task owns, most frequent first, ties by lowest ids."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []

    def add(self, keys: np.ndarray, changes: np.ndarray) -> None:
        for k, c in zip(keys.tolist(), changes.tolist()):
            n = self.counts.get(k, 0) + c
            if n:
                self.counts[k] = n
                heapq.heappush(self.heap, (-n, k))
            else:
                del self.counts[k]
        if len(self.heap) > 3 * len(self.counts) + 1024:
            self.heap = [(-n, k) for k, n in self.counts.items()]
            heapq.heapify(self.heap)

    def best(self, n: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        while self.heap and len(out) < n:
            top = heapq.heappop(self.heap)
            if self.counts.get(top[1]) == -top[0] and (not out or out[-1] != top):
                out.append(top)
        for top in out:
            heapq.heappush(self.heap, top)
        return out


def _merged(words: list[bytes], counts: np.ndarray, size: int, max_words: int | None, me: int, tasks: int, gather: Callable[[bytes], list[bytes]]) -> Iterator[tuple[str, str]]:
    """Merges of all tasks' words, the same in each task; `gather` hands a message to all of them. First ("", number of words) and the alphabet as ("", letter)."""
    heard = gather(len(words).to_bytes(8, "big") + bytes({b for w in words for b in w}))
    n = sum(int.from_bytes(m[:8], "big") for m in heard)
    yield "", str(n)
    if max_words is not None and n > max_words:
        return
    letters = byte_alphabet()
    used = {letters[b]: b for m in heard for b in m[8:]}
    yield from (("", t) for t in sorted(used))
    tokens = ["", *SPECIAL, *sorted(used)]
    number = {t: i for i, t in enumerate(tokens)}
    ids = np.zeros(256, np.int32)
    for t, b in used.items():
        ids[b] = number[t]
    share, totals = _Share(words, counts, ids), _Totals()
    words.clear()
    changes = share.all_pairs()
    while len(tokens) - 1 < size:
        for m in gather(changes[0].tobytes() + changes[1].tobytes()):
            keys, values = np.frombuffer(m, np.int64).reshape(2, -1)
            mine = (keys ^ keys >> 32) % tasks == me
            totals.add(keys[mine], values[mine])
        offered = [np.frombuffer(m, np.int64).reshape(-1, 2).tolist() for m in gather(np.array(totals.best(OFFER), np.int64).tobytes())]
        least = min((tuple(o[-1]) for o in offered if len(o) == OFFER), default=None)  # beyond, a task may have more
        offers = sorted((c, k >> 32, k & 0xFFFFFFFF) for o in offered for c, k in o if least is None or (c, k) <= least)
        batch, fresh = [], set()
        for a, b in together(offers, lambda a, b: tokens[a] + tokens[b] in number, size - len(tokens) + 1):
            new = tokens[a] + tokens[b]
            if new in fresh:  # two ways to one token: the second in its own round
                break
            if new not in number:
                fresh.add(new)
            batch.append((a, b, new))
        if not batch:
            return
        merged = []
        for a, b, new in batch:
            if new not in number:
                number[new] = len(tokens)
                tokens.append(new)
            merged.append((a, b, number[new]))
            yield tokens[a], tokens[b]
        changes = share.merge(merged)


def _received(link: socket.socket) -> bytes:
    def take(n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            part = link.recv(min(n - len(out), 1 << 20))
            if not part:
                raise ConnectionError("a task of the merge stage has ended")
            out += part
        return bytes(out)

    return take(int.from_bytes(take(8), "big"))


def _exchange(task: BarrierTaskContext) -> Callable[[bytes], list[bytes]]:
    """A function that hands a message to all tasks of the stage and returns all of theirs.

    Spark's own allGather takes a second a call; it is used once, for the address of the first
    task, to which the others keep a connection.
    """
    infos, me = task.getTaskInfos(), task.partitionId()
    if len(infos) == 1:
        return lambda m: [m]
    server = socket.create_server(("", 0), backlog=len(infos)) if me == 0 else None
    said = task.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")[0].split()
    port, word = int(said[0]), said[1].encode()
    send = lambda link, m: link.sendall(len(m).to_bytes(8, "big") + m)
    if server is None:
        hub = socket.create_connection((infos[0].address.rsplit(":", 1)[0], port), 60)
        hub.settimeout(3600)
        send(hub, word + me.to_bytes(4, "big"))

        def ask(m: bytes) -> list[bytes]:
            send(hub, m)
            return [_received(hub) for _ in infos]

        return ask
    server.settimeout(60)
    links: dict[int, socket.socket] = {}
    while len(links) < len(infos) - 1:
        link, _ = server.accept()
        link.settimeout(3600)
        first = _received(link)
        if first[:-4] == word:
            links[int.from_bytes(first[-4:], "big")] = link
    server.close()

    def serve(m: bytes) -> list[bytes]:
        every = [m, *(_received(links[k]) for k in sorted(links))]
        packed = b"".join(len(x).to_bytes(8, "big") + x for x in every)
        for link in links.values():
            link.sendall(packed)
        return every

    return serve


def learn(rows: DataFrame, size: int = 10_000, text: str = "text", kind: str = "byte-bpe", max_words: int | None = None) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(vocabulary, merges) of all rows. max_words: more distinct pre-tokens are an error."""
    if kind != "byte-bpe":
        raise ValueError(f"tokeniser type {kind!r} is not supported: byte-bpe is")
    context = rows.sparkSession.sparkContext._jsc.sc()
    tasks = max(1, min(MAX_TASKS, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        words: list[bytes] = []
        counts = [np.zeros(0, np.int64)]
        for b in batches:
            words += b.column(0).cast(pa.binary()).to_pylist()
            counts.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        out = list(_merged(words, np.concatenate(counts), size, max_words, task.partitionId(), tasks, _exchange(task)))
        if task.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), *(pa.array([o[i] for o in out], pa.string()) for i in (0, 1))], ["place", "left", "right"])

    dealt = pretoken_counts(rows, text).repartition(tasks)
    found = sorted(dealt.mapInArrow(run, "place int, left string, right string", barrier=True).collect())
    if max_words is not None and int(found[0]["right"]) > max_words:
        raise ValueError(f"more than {max_words} distinct pre-tokens: raise max_words")
    vocabulary = {t: i for i, t in enumerate((*SPECIAL, *[r["right"] for r in found[1:] if not r["left"]]))}
    merges = [(r["left"], r["right"]) for r in found[1:] if r["left"]]
    for a, b in merges:
        vocabulary.setdefault(a + b, len(vocabulary))
    return vocabulary, merges


def save(vocabulary: dict[str, int], merges: list[tuple[str, str]], path: str) -> None:
    """The vocabulary as one JSON document on the driver."""
    added = [{"id": vocabulary[t], "content": t, "special": True} for t in SPECIAL]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": "1.0", "added_tokens": added, "model": {"type": "BPE", "vocab": vocabulary, "merges": [list(m) for m in merges]}}, f, ensure_ascii=False)
