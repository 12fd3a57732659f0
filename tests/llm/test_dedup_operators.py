"""Exact and near dedup, decontamination and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gantry.llm import decontaminate, exact_dedup, near_dedup, queries, suffix_dedup
from gantry.llm.common import ROW, table
from tests.compare import DATA, connection, differences
from tests.llm.fixtures import components, family, shingles

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connection(SF), queries.ORACLE_SQL[name]) == ""


def test_cuckoo_index_against_a_dict():
    r = random.Random(1)
    index, plain = exact_dedup.CuckooIndex(2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(12_000):
        k = r.choice(keys)
        if r.random() < 0.6:
            assert index.insert(k, (r.randrange(9), 0)) == (k not in plain)
            plain[k] = plain.get(k, 0) + 1
        else:
            assert index.delete(k) == (k in plain)
            if k in plain:
                plain[k] -= 1
                if not plain[k]:
                    del plain[k]
    assert {e[1]: e[3] for e in index.items()} == plain and index.size == len(plain) and index.grown > 3
    assert all((index.lookup(k) is not None) == (k in plain) for k in keys)


def test_deleted_documents_leave_the_index(spark):
    rows = [(b"k" * 32, 5, 1, 1), (b"k" * 32, 9, 2, 1), (b"m" * 32, 1, 3, 1), (b"m" * 32, 1, 3, -1)]
    rows += [(b"n" * 32, 5, 1, 1), (b"n" * 32, 9, 2, 1), (b"n" * 32, 7, 4, 1), (b"n" * 32, 9, 2, -1)]  # the survivor goes
    changes = spark.createDataFrame([(*r, 0, 0) for r in rows], f"sha binary, cp long, doc_id long, n long, {ROW[0]} long, {ROW[1]} long")
    got = exact_dedup.index(changes, 2).collect()
    assert {(bytes(r["sha"]), r["keep_id"], r["group_size"]) for r in got} == {(b"k" * 32, 2, 2), (b"n" * 32, 4, 2)}


def test_index_between_batches(spark, tmp_path):
    held = exact_dedup.LiveDigests(spark, f"file://{tmp_path}/index")
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    live = lambda: {(r["keep_id"], r["group_size"]) for r in held.live().collect()}
    assert live() == set()
    first = docs((1, "a b"), (2, "ab"), (3, "other"), (None, "ab"))
    assert held.apply("one", first) and not held.apply("one", first) and live() == {(1, 3), (3, 1)}
    assert held.apply("two", docs((1, "a b"), (3, "other")), sign=-1) and live() == {(2, 2)}
    assert held.apply("three", docs((4, "a  b"), (3, "other"))) and live() == {(4, 3), (3, 1)}


def test_rows_are_kept_by_row_and_not_by_id(spark):
    """Rows that share an id with one that goes, or have none as it does, stay."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (3, text + " x"), (3, "a quite different text of some words"), (None, text + " y"), (None, "one more text that has no id"), (None, text), (1, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    rest = [(0, "one more text that has no id"), (3, "a quite different text of some words")]
    assert got(near_dedup.keep_one(docs)) == sorted([*rest, (1, text)])
    assert got(exact_dedup.keep_one(docs)) == sorted([*rest, (1, text), (3, text + " x"), (0, text + " y")])
    items = spark.createDataFrame([(7, "w1 w2 w3 w4 w5 w6 w7")], "item_id long, text string")
    assert got(decontaminate.remove_leaks(docs, items)) == sorted(rest)


@pytest.mark.parametrize("k, edits, block", [(2, 0.22, 4096), (2, 0.22, 8), (5, 0.09, 4096)])
def test_near_dedup_against_all_pairs(spark, monkeypatch, k, edits, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = [x for f, n in enumerate((30, 90, 150)) for x in family(f, 60, n, edits, 1000 * f)]
    rows += [(9000 + i, t) for i, t in enumerate([None, "", "one", "ONE", rows[0][1], rows[0][1] + " more"])]
    random.Random(3).shuffle(rows)
    want = components(rows, k, 80)
    got = near_dedup.find_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 20
    sizes = {i: len(shingles(t, k)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = {r["doc_id"]: r["component_id"] for r in queries.op5_near_dedup(spark, SF).collect()}
    assert got == components(rows, 2, 80)


def test_registers_estimate_similarity_and_merge():
    r = np.random.default_rng(0)
    shared, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b]))
    regs = near_dedup.registers(np.concatenate([x, y, np.sort(np.concatenate([shared, a, b]))]), np.array([0, 900, 1800, 2800]))
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    est = near_dedup.likelihood(np.array([900]), np.array([900]), np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]))[0]
    assert abs(est - 0.8) < 0.12


def test_containment_against_all_pairs(spark):
    r = random.Random(2)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 9, 20, 60, 200, 900, 30])]
    docs = []
    for d in range(40):
        w = [r.choice(words) for _ in range(r.randint(0, 1500))]
        for _, t in r.sample(items, 3):
            part = t.split()
            for _ in range(r.randint(0, max(1, len(part) // 12))):
                part[r.randrange(len(part))] = r.choice(words)
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((d, " ".join(w)))
    want = set()
    for d, text in docs:
        w = text.split()
        for i, item in items:
            n = min(5, len(item.split()))
            own, there = shingles(item, 5), {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if len(own & there) >= 0.8 * len(own):
                want.add((d, i, len(own & there), len(own)))
    for size in (decontaminate.BLOCK_BYTES, 500):
        got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=size)
        assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in got.collect()} == want
    assert len(want) > 60


def _repeats(texts: list[bytes], window: int) -> list[np.ndarray]:
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                m[i : i + window] = True
        out.append(m)
    return out


def _digests(rows: list[tuple], window: int) -> Counter:
    texts = [(t or "").encode() for _, t in rows]
    out = Counter()
    for (i, _), t, m in zip(rows, texts, _repeats(texts, window)):
        edges = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        out[(i, len(t), int(m.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, x in zip(t, m) if not x)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_sort_against_a_dict(seed):
    r = random.Random(seed)
    rnd = lambda n, a: bytes(r.choice(a) for _ in range(n))
    pool = [rnd(r.randint(50, 200), b"abc") for _ in range(5)]
    contexts = [(rnd(r.randint(0, 60), b"ab") + r.choice(pool) + rnd(r.randint(0, 60), b"ab"))[: r.randint(40, 200)] for _ in range(60)]
    seen = Counter(t[i : i + 40] for t in contexts for i in range(len(t) - 39))
    for bucket in (16, 256, 1 << 17):
        for t, mask in zip(contexts, suffix_dedup.repeated(contexts, 40, bucket)):
            assert mask.tolist() == [seen[t[i : i + 40]] > 1 for i in range(len(t) - 39)]


@pytest.mark.parametrize("limit, piece", [(6000, 4 << 20), (3, 300)])
def test_repeated_passages_against_a_dict(spark, monkeypatch, limit, piece):
    monkeypatch.setattr(suffix_dedup.resolve, "__defaults__", (suffix_dedup.BLOCK_BYTES, limit))
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    r = random.Random(limit)
    rnd = lambda n: "".join(r.choice("abcdef é") for _ in range(n))
    pool = [rnd(r.randint(30, 300)) for _ in range(6)]
    texts = ["".join(r.choice(pool + [rnd(r.randint(0, 80))] * 8) for _ in range(r.randint(0, 8))) for _ in range(60)]
    texts += ["a" * 500, "ab" * 300, "", "x" * 39, texts[3], "a" * 100]
    rows = [*enumerate(texts), (3, texts[5]), (70, None), (5, texts[5])]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), window=40, gram=8)
    assert Counter(tuple(x) for x in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == _digests(rows, 40)


def test_repeated_passages_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = queries.op8_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(x) for x in got) == _digests(rows, 200)
