"""Small tables with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

WHITE = re.compile("[\x20\x09-\x0d]")
WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows() -> list[tuple]:
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(20_000))
    texts = [None, "", " ", "\n\t", "a", "One two", "one TWO", long, long, "ünïcödé ▁ text  with   runs ", "x" * 5000, "ab" * 700, " nbsp word", "日本語 テキスト", "password = hunter2hunter2 AKIA" + "A1" * 12, "same text here and there", "same text here and there"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s", None) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[15], (3, "another text of id three", "fr", "s", 1), (None, "no id", "en", "s", 5)]


def clashing(df):
    """The table with columns named as the operators' own."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in ("th", "ids", "n", "keep_id", "score", "kept", "label", "n_tokens", "sha", "hi", "lo", "spans", "decoded", "y", "node", "key")])


def shingles(text: str | None, k: int) -> set:
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows: list[tuple], k: int, percent: int) -> dict:
    """doc_id -> smallest id reachable, by comparing all pairs."""
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in up}


def family(seed: int, n: int, words: int, edits: float, first: int = 0) -> list[tuple]:
    """Near copies of one text, with up to a share of the words edited."""
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(500)]
    base = [r.choice(pool) for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, int(words * edits))):
            w[r.randrange(words)] = r.choice(pool) + "x" * r.randint(0, 3)
        out.append((first + i, " ".join(w)))
    return out
