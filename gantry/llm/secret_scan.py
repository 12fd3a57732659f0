"""Secret scans: fixed patterns, and password guess cost in credential contexts.

Base spans come from three patterns. The method then looks at values that stand where
a credential would (after words such as `passphrase` or `login` and a separator, and
in the user part of a URL) and estimates by dynamic programming how many guesses the
cheapest description of the value takes: a segmentation into dictionary words, dates,
repeats, keyboard walks and brute-force spans, each with its own number of guesses.
Values whose estimate reaches a threshold become spans of kind `guess`; for values of
letters alone it is a higher one, as a word of plain prose that no dictionary holds looks
like them. A base span always stays; a guess span that would overlap one of them is left out.

The estimate is the least over all segmentations, at a cost linear in the value's length:
a brute-force span or a keyboard walk costs so much for each further character, so it is a
state of its own; words, dates and repeated blocks have a bounded length; a run of one
character costs the logarithm of its length, and only the first places of the run can be
where a cheapest segmentation starts it. Values are never cut.

Defined results: null counts as an empty text, which has no spans. Spans count code
points and ends are exclusive. Texts and values of any length are read whole. Rows are
independent, so repeated rows and ids give repeated results and an empty table an empty
result; of segmentations of the same cost the first found is reported. Other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import sha256_hex, mapped

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
# as the open-ended patterns with their least lengths, since a run of these characters is matched whole or not at all
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|credentials?|secret|token|api[_ -]?key|private[_ -]?key|access[_ -]?key|client[_ -]?secret|bearer|login|pin)["']?\s{0,4}(?:[:=]|=>|\x20is\x20)\s{0,4}["']?([^\s"'<>,;]+)""", re.IGNORECASE | re.ASCII)
_URL = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:([^\s/@]+)@", re.IGNORECASE | re.ASCII)
_HINT = re.compile(r"pass|pwd|credential|secret|token|key|bearer|login|pin|://", re.IGNORECASE)

#: Common passwords and words of credential values, most frequent first: the rank is the number of guesses.
WORDS = (
    "password 123456 qwerty admin welcome letmein dragon monkey master login princess sunshine shadow football baseball superman batman trustno1 iloveyou "
    "hello secret access flower freedom whatever root user test guest default changeme pass summer winter spring autumn love money computer internet "
    "server database public private example sample demo temp token key api auth bearer basic none null true false value string your my the and for of in "
    "to is on with that this not you from are was have has will one all can be de la le les des et que para con por una der die das und ein nicht mit "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "red blue green black white orange purple yellow silver gold house mouse horse tiger lion eagle apple banana coffee pizza star sun moon earth water fire "
    "michael jordan jennifer hunter thomas robert daniel andrew joshua matthew ashley nicole jessica charlie george harley ranger buster soccer hockey "
    "company office system service account manager support security network windows linux oracle cisco google amazon prod dev stage staging local host"
).split()
_RANK = {w: i + 2 for i, w in reversed(list(enumerate(WORDS)))}
_LONGEST = max(map(len, WORDS))
_LEET = str.maketrans("013457@$!", "oieastasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])}
_NEXT |= {(b, a) for a, b in _NEXT} | {(a, b) for up, low in zip(_ROWS, _ROWS[1:]) for a, b in zip(up[1:] if up[0] == "`" else up, low)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c.isascii() else 100


#: What one more segment costs, a character of a walk after its first, and a block that comes again.
STEP, WALK_STEP, AGAIN = 0.5, 0.25, 1.1
_WALK = math.log10(47 * 4)


def load_words(path: str) -> dict[str, int]:
    """Ranks of a word list with one word a line, most frequent first; the rank is the number of guesses."""
    with open(path, encoding="utf-8") as f:
        words = [w for w in map(str.strip, f) if w]
    return {w.lower(): i + 2 for i, w in reversed(list(enumerate(words)))}


def word_cost(part: str, rank: dict[str, int]) -> float | None:
    """log10 of the guesses of a dictionary word, as it stands or with digits for letters; a little more for capitals."""
    low = part.lower()
    found = [math.log10(rank[w]) + more for w, more in ((low, 0.0), (low.translate(_LEET), 0.3)) if w in rank]
    return min(found) + 0.3 * (low != part) if found else None


def date_ends(value: str, start: int) -> list[tuple[int, float]]:
    """Ends of the dates that begin at a place, with log10 of their guesses."""
    ends = {e for e in range(start + 4, min(len(value), start + 10) + 1) if _DATE.fullmatch(value, start, e)}
    return [(e, math.log10(36500 if e - start > 4 else 120)) for e in sorted(ends)]


def guess_cost(value: str, words: dict[str, int] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for `value` and the segmentation that needs fewest: (kind, start, end).

    Each segment costs log10 of its own guesses and STEP; a brute-force span one alphabet
    choice for each character; a repeat the character and how often it comes.
    """
    rank = _RANK if words is None else words
    longest = _LONGEST if words is None else max(map(len, words), default=0)
    n, far = len(value), math.inf
    low = value.lower()
    low = low if len(low) == n else value
    best: list[float] = [0.0] + [far] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute, walk_one, walk_two, walk = (far, 0), (far, 0), (far, 0), (far, 0)  # cost and start of a span that reaches here
    run = 0

    def offer(end: int, cost: float, kind: str, start: int) -> None:
        if cost < best[end] - 1e-12:
            best[end], back[end] = cost, (kind, start)

    for i in range(n):
        here = best[i]
        # words, dates and blocks begin here; spans of characters go on to i + 1
        for end in range(i + 1, min(n, i + longest) + 1):
            c = word_cost(value[i:end], rank)
            if c is not None:
                offer(end, here + c + STEP, "word", i)
        if value[i].isdigit():
            for end, c in date_ends(value, i):
                offer(end, here + c + STEP, "date", i)
        for size in range(2, min(12, i, n - i) + 1):
            if value[i - size : i] == value[i : i + size]:
                offer(i + size, here + AGAIN, "repeat", i)
        alphabet = math.log10(_alphabet(value[i]))
        brute = min(brute, (here + STEP, i))
        brute = brute[0] + alphabet, brute[1]
        offer(i + 1, brute[0], "brute", brute[1])
        near = i > 0 and (low[i - 1], low[i]) in _NEXT
        more = min(walk, walk_two)
        walk = (more[0] + WALK_STEP, more[1]) if near else (far, 0)
        walk_two = (walk_one[0] + WALK_STEP, walk_one[1]) if near else (far, 0)
        walk_one = here + STEP + _WALK, i
        offer(i + 1, walk[0], "walk", walk[1])
        if i and value[i] != value[i - 1]:
            run = i
        for start in range(run, min(i - 1, run + max(12, longest) + 1)):
            offer(i + 1, best[start] + alphabet + math.log10(i + 1 - start) + STEP, "repeat", start)
    parts, end = [], n
    while end:
        kind, start = back[end]
        parts.append((kind, start, end))
        end = start
    return best[n], parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, base: list[tuple[int, int, int]], threshold: float, of_letters: float, least: int, words: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """Values in credential contexts whose guess cost reaches `threshold`, or if they are letters alone `of_letters` (log10)."""
    if not _HINT.search(text):
        return []
    out = []
    for pattern in (_CONTEXT, _URL):
        for m in pattern.finditer(text):
            a, b = m.span(1)
            while b > a and text[b - 1] in ".:)]}!?":
                b -= 1
            value = text[a:b]
            if b - a < least or any(s < b and a < e for s, _, e in base):
                continue
            if guess_cost(value, words)[0] >= (of_letters if value.isalpha() else threshold):
                out.append((a, 3, b))
    return sorted(set(out))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 8.0, of_letters: float = 20.0, least: int = 8, words: dict[str, int] | None = None) -> DataFrame:
    """Per document: doc_id, base and all spans: arrays of (kind, start, end). words: ranks of a dictionary (`load_words`), by default a short one."""
    span = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], []]
            for t in b.column("text").to_pylist():
                base = base_spans(t or "")
                both = sorted(base + guess_spans(t or "", base, threshold, of_letters, least, words))
                for out, spans in zip(rows, (base, both)):
                    out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, kind) for x in rows)], ["doc_id", "base", "spans"])

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, base {span}, spans {span}")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess."""

    def joined(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *map(counted, KINDS[:3]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_guess"))


def digest(text: str | None) -> str:
    """base_sha256 of one text."""
    return sha256_hex(_joined(base_spans(text or "")).encode())
