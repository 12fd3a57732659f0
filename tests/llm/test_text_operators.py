"""Secret scans, SentencePiece, token counts and language identification against brute force and the libraries."""

from __future__ import annotations

import hashlib
import re

import pytest

from gantry.llm import language_id, queries, secret_scan, sentencepiece_codec, token_counts
from gantry.llm.common import table
from tests.compare import DATA
from tests.llm.fixtures import SCHEMA, odd_rows

SF = f"{DATA}/sf0.001"


def _base(text: str) -> tuple[list[tuple[int, int, str]], str]:
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found), ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_against_plain_patterns(spark):
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    for r in queries.op1_secret_scan(spark, SF).collect():
        found, joined = _base(rows[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_kelvin_sign_and_long_s_are_no_letters_of_a_key():
    assert secret_scan.base_spans("toKen=abcdefgh paſſword=abcdefgh") == []


@pytest.mark.parametrize("cheap, dear", [("password1", "pq7Xw0Zr1"), ("aaaaaaaaaa", "a8Kz0qLm2B"), ("qwertyuiop", "q0wZeXr1tY"), ("19840215", "84k1z0q2"), ("abcabcabc", "abcxyzqpw")])
def test_guess_cost_orders_values(cheap, dear):
    assert secret_scan.guess_cost(cheap)[0] < secret_scan.guess_cost(dear)[0]


def test_guess_cost_is_the_least_over_segmentations():
    words = {"red": 2, "sun": 3}
    cost, parts = secret_scan.guess_cost("redsunzq", words)
    assert [k for k, _, _ in parts] == ["word", "word", "brute"] and parts[0][1] == 0 and parts[-1][2] == 8
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
    assert cost <= secret_scan.guess_cost("redsunzq", {"zzzzzz": 2})[0]


def _least_cost(value: str, words: dict[str, int]) -> float:
    """The least cost over all segmentations, by trying each span with each kind."""
    import functools
    import math

    def kinds(a: int, b: int):
        part, m = value[a:b], b - a
        sizes = [math.log10(secret_scan._alphabet(c)) for c in part]
        yield sum(sizes) + 0.5, True
        c = secret_scan.word_cost(part, words)
        if c is not None:
            yield c + 0.5, False
        if secret_scan._DATE.fullmatch(part):
            yield math.log10(36500 if m > 4 else 120) + 0.5, False
        if m >= 3 and len(set(part)) == 1:
            yield sizes[0] + math.log10(m) + 0.5, False
        if m >= 3 and all((x, y) in secret_scan._NEXT for x, y in zip(part.lower(), part.lower()[1:])):
            yield secret_scan._WALK + 0.25 * (m - 1) + 0.5, False
        if 2 <= m <= 12 and value[a - m : a] == part and a >= m:
            yield 1.1, False

    @functools.cache
    def least(end: int) -> float:
        return min((least(a) + c for a in range(end) for c, _ in kinds(a, end)), default=0.0)

    return least(len(value))


def test_guess_cost_is_the_minimum():
    import random

    r = random.Random(7)
    words = {"password": 2, "pass": 3, "no": 4, "aa": 5, "qwe": 9, "dragon": 30}
    values = ["passwordfghj", "passsssss", "no1999no", "aaaa2000000", "abcabcabcabc", "qwertzxcvbnm", "P4ssw0rd!", "ddragonn", "aaaaaaaaaaaaaaaaaaaab", "121212121212"]
    parts = ["pass", "PASSWORD", "no", "aaa", "qwer", "fgh", "1999", "20010203", "ab", "abab", "0000", "x", "!", "7", "dragon", "é"]
    values += ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(400)]
    for v in values:
        cost, segments = secret_scan.guess_cost(v, words)
        assert cost == pytest.approx(_least_cost(v, words), abs=1e-9), v
        assert segments[0][1] == 0 and segments[-1][2] == len(v) and all(x[2] == y[1] for x, y in zip(segments, segments[1:]))


def test_letters_alone_need_more(spark):
    rows = [(1, "login: xkqzvbtrwplmhgd"), (2, "login: something")]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.summary(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "guess:7:22", 2: ""}


def test_token_totals_of_documents(spark):
    import base64
    from collections import Counter

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.tokenizer_file(spark, "byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, tokens = Counter(), Counter()
    for r in table(spark, SF, "documents").collect():
        docs[(r["source"], r["lang"])] += 1
        tokens[(r["source"], r["lang"])] += len(coder.encode_ordinary(r["text"] or ""))
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in queries.op7_token_counts(spark, SF).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}


def test_guess_spans_in_contexts(spark):
    rows = [(1, "login: tR7$kq9!vbX2 and more"), (2, "login: password"), (3, "password=tR7kq9vbX2"), (4, "see https://user:k8Zq2Lw0xR@host/x")]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.summary(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1] == "guess:7:19" and got[2] == "" and got[3].startswith("assign:0:") and got[4] == "guess:17:27"


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    model = queries.tokenizer_file(spark, "piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()] + [(r[0], r[1]) for r in odd_rows() if r[0] is not None]
    got = sentencepiece_codec.encode(spark.createDataFrame([(i, t, f"{i}/{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, place string"), model)
    want = {f"{i}/{n}": sp.encode(t or "") for n, (i, t) in enumerate(rows)}
    back = sentencepiece_codec.decode(got.select("place", "ids"), model)
    for r in got.join(back.select("place", sentencepiece_codec_col("decoded", "again")), "place").collect():
        assert r["ids"] == want[r["place"]] and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == sp.decode(want[r["place"]]) == r["again"]


def sentencepiece_codec_col(name: str, alias: str):
    from pyspark.sql import functions as F

    return F.col(name).alias(alias)


def test_token_counts_equal_the_library(spark):
    import base64

    import tiktoken

    vocabulary = queries.tokenizer_file(spark, "byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(odd_rows(), SCHEMA).select("doc_id", "text"))
    want = sorted((r["doc_id"] or -1, len(coder.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.count_tokens(docs, vocabulary).collect()) == want


def test_rollup_keeps_signed_batches_once(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, n_tokens long, sign int"
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    first = spark.createDataFrame([("a", "en", "t", 10, 1), ("a", "en", "t", 5, 1), ("b", None, "t", 7, 1)], schema)
    assert rollup.totals().count() == 0
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    rollup.commit("two", spark.createDataFrame([("b", None, "t", 7, -1)], schema))
    totals = lambda: {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert totals() == {("a", "en"): (2, 15)}
    old, new = (spark.createDataFrame([("a", "en", "t", n)], "source string, lang string, tokenizer string, n_tokens long") for n in (5, 6))
    rollup.commit("three", token_counts.revise(old, new))
    assert totals() == {("a", "en"): (2, 16)}
    rollup.compact()
    assert totals() == {("a", "en"): (2, 16)} and rollup.committed() == {"one", "two", "three"}
    assert not rollup.commit("two", first)


def test_cut_off_batch_does_not_count(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    rows = spark.createDataFrame([("a", "en", "t", 10, 1)], "source string, lang string, tokenizer string, n_tokens long, sign int")
    rollup.commit("one", rows)
    (tmp_path / "rollup" / "batch=one" / "_SUCCESS").unlink()
    assert rollup.totals().count() == 0 and rollup.commit("one", rows) and rollup.totals().first()["n_tokens"] == 10


def test_language_held_out_accuracy(spark):
    docs = table(spark, f"{DATA}/sf0.01", "documents")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_by_brute_force():
    """Profiles and distances from plain Python, for every text."""
    from collections import Counter

    def grams(text: str) -> list[str]:
        out: Counter = Counter()
        padded = re.sub(r"[^a-zà-ÿ]+", " ", f" {text.lower()} ")
        for k in (1, 2, 3):
            for i in range(len(padded) - k + 1):
                g = padded[i : i + k]
                if g.strip() and g.count(" ") <= (k > 1) + (k > 2) and "  " not in g:
                    out[g] += 1
        code = lambda g: [0x3FFF] * (3 - len(g)) + [0 if c == " " else ord(c) + 1 for c in g]
        return [g for g, _ in sorted(out.items(), key=lambda x: (-x[1], code(x[0])))][:20]

    texts = {"x": "the cat sat on the mat and the hat", "y": "der hund und die katze und der baum", "z": "été où là déjà été"}
    size, ranked = 20, {k: grams(v) for k, v in texts.items()}
    made = {}
    for k, v in texts.items():
        row, gram, n = language_id._grams([v.lower()])
        order = sorted(range(len(gram)), key=lambda i: (-int(n[i]), int(gram[i])))[:size]
        made[k] = [int(gram[i]) for i in order]
        assert len(made[k]) == len(ranked[k])
    profiles = language_id.Profiles(made, size)
    for text in ["the dog and the cat", "die katze", "là", "hat der", "123", ""]:
        own = grams(text)
        far = {k: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(own)) for k, p in ranked.items()}
        best = min(sorted(far), key=far.get) if own else "und"
        assert profiles.predict([text])[0] == [best]


def test_language_codes_leave_the_mark_of_absent_letters_free():
    assert int(language_id._codes().max()) < (1 << 14) - 1


def test_out_of_place_distance():
    profiles = language_id.Profiles({"x": [1, 2, 3], "y": [3, 2, 1]}, 3)
    assert profiles.ranks[list(profiles.grams).index(1)].tolist() == [0, 2]
