"""Queries that read whole tables, against brute force on small ones."""

from __future__ import annotations

from collections import Counter

import pytest

from gantry.operators import tokeniser
from gantry.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """(folder, calls by program, parts by program): three orders whose lines have all three flags."""
    d = str(tmp_path_factory.mktemp("orders"))
    lines = {1: [1, 2, 3, 4], 9: [2, 5, 1], 3: [3, 6, 3, 2]}
    unknown = {6}
    rows = [(o, i + 1, p, 1, 1.0, 1.0, "1995-01-01", "ANR"[(o + i) % 3]) for o, ps in lines.items() for i, p in enumerate(ps)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string, l_returnflag string"
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p, "small x" if p in unknown else "big x") for p in range(1, 8)], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    name = lambda p: ("unk." if p in unknown else "sym.") + str(p)
    calls = {(o % 8, name(a), name(b)) for o, ps in lines.items() for a, b in zip(ps, ps[1:])}
    return d, calls, {(o % 8, name(p)) for o, ps in lines.items() for p in ps}


@pytest.mark.parametrize("name", ["local_cg", "onehop_cg", "callers_cg", "onehop_callers_cg"])
def test_all_lines_local(spark, orders, name):
    d, calls, _ = orders
    known = {c for c in calls if not c[2].startswith("unk.")}
    want = {(g, a, a, b) for g, a, b in known}
    if "callers" in name:
        want |= {(g, b, a, b) for g, a, b in known if not a.startswith("unk.")}
    if "onehop" in name:
        want |= {(g, a, b, c) for g, a, b in known for h, x, c in known if (h, x) == (g, b)}
    got = [tuple(r[c] for c in ("program", "func", "src", "dst")) for r in QUERIES[name](spark, d).collect()]
    assert Counter(got) == Counter(want)


def test_all_lines_other_graphs(spark, orders):
    d, calls, parts = orders
    known = {c for c in calls if not c[2].startswith("unk.")}
    run = lambda n: QUERIES[n](spark, d).collect()
    ends = {(g, x) for g, a, b in known for x in (a, b)}
    assert Counter((r["program"], r["name"]) for r in run("global_cg")) == Counter(parts)
    assert Counter((r["program"], r["name"]) for r in run("global_cg_pruned")) == Counter(ends)
    assert {(r["program"], r["name"]): (r["out_degree"], r["in_degree"]) for r in run("global_cg_degrees")} == {(g, x): (sum(c[:2] == (g, x) for c in known), sum((c[0], c[2]) == (g, x) for c in known)) for g, x in parts}
    assert {r["program"]: (r["n_nodes"], r["n_edges"]) for r in run("graph_sizes")} == {p: (sum(g == p for g, _ in parts), sum(c[0] == p for c in known)) for p in {g for g, _ in parts}}
    ids = {(r["program"], r["id"]): r["name"] for r in run("global_cg")}
    assert Counter((r["program"], ids[r["program"], r["id"]], ids[r["program"], r["to"]]) for r in run("global_cg_adjacency")) == Counter(known)
    nodes = {(g, x, x) for g, x in parts} | {(g, a, x) for g, a, b in known for x in (a, b)} | {(g, b, x) for g, a, b in known if not a.startswith("unk.") for x in (a, b)}
    assert Counter((r["program"], r["func"], r["name"]) for r in run("local_cg_nodes")) == Counter(nodes)
    assert {(r["program"], r["func"]): r["n_edges"] for r in run("local_cg_documents")} == {(g, x): sum(c[:2] == (g, x) for c in calls) for g, x in parts}


def brute_merges(counts: dict[str, int], size: int) -> dict[str, int]:
    """The vocabulary, with all pairs counted anew for each merge."""
    letters = tokeniser.byte_alphabet()
    words = [([letters[b] for b in w.encode()], n) for w, n in counts.items()]
    ids = {t: i for i, t in enumerate((*tokeniser.SPECIAL, *sorted({c for w, _ in words for c in w})))}
    while len(ids) < size:
        pairs = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                pairs[p] += n
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], ids[p[0]], ids[p[1]]))
        ids.setdefault(a + b, len(ids))
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == (a, b):
                    w[i : i + 2] = [a + b]
                i += 1
    return ids


def test_bpe_vocab_reads_documents(spark, tmp_path):
    text = "banana bandana aaaa aaaaa naïve 2024 20 ban; new newer newest banana"
    spark.createDataFrame([(1, text), (2, "newest bandana xyxyxy"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "qqq qqq")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = {r["token"]: r["n"] for r in tokeniser.pretoken_counts(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    got = {r["token"]: r["id"] for r in QUERIES["bpe_vocab"](spark, str(tmp_path)).collect()}
    assert got == brute_merges(counts, 10_000) and "q" not in got
    assert tokeniser.merge_rules(counts, 40)[0] == brute_merges(counts, 40)


def test_bpe_in_tasks_as_on_one_machine(spark):
    """Words of few letters, runs of one letter, equal counts, special tokens as texts and tokens that arise in two ways."""
    import random

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(40)) for letters in ("ab", "aab", "abcd", "éa", "xyz<s>") for _ in range(12)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "aaaaaaa aaaaa aaaa " * 9, "<s> <s> <mask> " * 30]], "text string")
    counts = {r["token"]: r["n"] for r in tokeniser.pretoken_counts(rows).collect()}
    for size in (25, 60, 400, 10_000):
        assert tokeniser.learn(rows, size) == tokeniser.merge_rules(counts, size)


def test_bpe_of_many_pretokens(spark):
    """More distinct pre-tokens than one machine used to take."""
    rows = spark.range(1_000_001).selectExpr("concat('n', translate(cast(id as string), '0123456789', 'abcdefghij')) as text")
    vocabulary, merges = tokeniser.learn(rows, 40)
    assert len(vocabulary) == 40 and merges[0] == ("Ġ", "n")


def test_files_sorted(spark, tmp_path):
    pages = [(i, f"http://h/{(i * 7) % 10}") for i in range(25)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["page_id"], r["url"]) for r in QUERIES["files_sorted"](spark, str(tmp_path)).collect()]
    assert got == sorted(pages, key=lambda p: (p[1], p[0]))


def _walks(successors: list[list[int]]) -> list[list[int]]:
    """From each node, depth first in order, ten nodes at most."""
    out = []
    for start in range(len(successors)):
        seen: list[int] = []

        def visit(node: int, seen=seen) -> None:
            if node in seen or len(seen) == 10:
                return
            seen.append(node)
            for s in successors[node]:
                visit(s)

        visit(start)
        out.append(seen)
    return out


def _lines_by_order(d: str) -> dict:
    from tests.compare import connection

    names = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
    out: dict = {}
    for r in connection(d).execute(f"SELECT {names} FROM lineitem ORDER BY {names}").fetchall():
        out.setdefault(r[0], []).append(r)
    return out


def test_dfs_walk_by_brute_force(spark):
    from tests.compare import DATA

    d = f"{DATA}/sf0.001"
    want = set()
    for o, lines in _lines_by_order(d).items():
        n = len(lines)
        for start, w in enumerate(_walks([[(i + 1) % n, r[2] % n] for i, r in enumerate(lines)])):
            want.add((o, start, " ".join(map(str, w))))
    assert {(r["l_orderkey"], r["start"], r["walk"]) for r in QUERIES["dfs_walk"](spark, d).collect()} == want


def test_walk_lines_by_brute_force(spark):
    from tests.compare import DATA

    d = f"{DATA}/sf0.001"
    texts = {(r["func_idx"], r["ord"]): r["text"] for r in QUERIES["instruction_lines"](spark, d).collect()}
    want = Counter()
    for o, lines in _lines_by_order(d).items():
        n = len(lines)
        edges = [[*([(i + 1) % n] if r[3] % 4 else []), *([r[2] % 9] if r[2] % 9 < n else [])] for i, r in enumerate(lines)]
        ends = [x for i, e in enumerate(edges) for x in (i, *e) if e]
        if n > 2:
            for start, w in enumerate(_walks(edges[: max(ends, default=-1) + 1])):
                for k, i in enumerate(w):
                    want[(o, start, k, texts[(o, i)])] += 1
    got = Counter((r["func_idx"], r["start"], r["ord"], r["text"]) for r in QUERIES["walk_lines"](spark, d).collect())
    assert got == want
