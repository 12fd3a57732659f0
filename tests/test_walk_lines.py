"""Lines along walks: edges and walks of whole batches against the expressions and a plain walk, and what the shuffle carries."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gantry.operators import corpus, graphs
from gantry.plans.catalog import QUERIES

BLOCK = "struct<offset:bigint,jump:bigint,fail:bigint,switchop:struct<cases:array<int>>,ops:array<struct<type:string,opcode:string,disasm:string,esil:string>>>"


def _plain(successors: list[list[int]], max_hops: int, strict: bool) -> list[list[int]]:
    out, hops = [], 0
    for start in range(len(successors)):
        seen, stack, walk, hops = set(), [start], [], hops if strict else 0
        while stack:
            node = stack.pop()
            if node in seen:
                continue
            if hops >= max_hops:
                hops = 0
                break
            seen.add(node)
            walk.append(node)
            hops += 1
            stack += reversed(successors[node])
        out.append(walk)
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_walks_in_slices(monkeypatch, strict):
    monkeypatch.setattr(corpus, "STARTS", 7)
    draw = random.Random(5)
    for _ in range(150):
        n, most, hops = draw.randint(0, 25), draw.choice([1, 2, 9, 40]), draw.choice([0, 1, 3, 10])
        successors = [[draw.randrange(n) for _ in range(draw.randint(0, most))] for _ in range(n)]
        assert corpus.walks(successors, hops, strict) == _plain(successors, hops, strict)


def _functions(spark):
    """Functions with equal offsets, targets outside, blocks without texts or edges, and a long chain."""
    draw, rows = random.Random(3), []
    for f in range(120):
        n = draw.choice([0, 1, 2, 3, 5, 12, 30]) if f else 3000
        blocks = []
        for i in range(n):
            offset = 100 + (draw.randrange(n) if f % 3 == 0 and f else i)
            target = lambda: draw.choice([-1, None, 7, 100 + draw.randrange(n)]) if f % 5 else -1  # noqa: B023, E731
            ops = [("mov", "", draw.choice(["mov eax, 0x12345", "nop x", "call sym.f", "", None]), draw.choice(["0x10,rax,=", ",", None])) for _ in range(draw.randint(0, 3))]
            blocks.append((offset, 101 + i if f == 0 else target(), target(), None, ops))
        rows.append((f % 4, f, f"f{f}", blocks))
    return spark.createDataFrame(rows, f"binary int, func_idx long, name string, blocks array<{BLOCK}>").repartition(3)


@pytest.mark.parametrize("kind, pairs, strict", [("instructions", False, False), ("instructions", True, False), ("esil", False, True), ("disasm", True, True)])
def test_walk_lines_of_odd_functions(spark, monkeypatch, kind, pairs, strict):
    monkeypatch.setattr(corpus, "LINES", 50)
    functions = _functions(spark).cache()
    texts = F.transform("blocks", lambda b: corpus.block_texts(b, kind))
    want: Counter = Counter()
    for r in functions.filter("size(blocks) > 2").select("*", texts.alias("texts"), graphs.cfg_edges(F.col("blocks")).alias("edges")).collect():
        successors: list[list[int]] = [[] for _ in range(max([max(e["src"], e["dst"]) + 1 for e in r["edges"]], default=0))]
        for e in r["edges"]:
            successors[e["src"]].append(e["dst"])
        for start, walk in enumerate(_plain(successors, 10, strict)):
            lines = [t for i in walk for t in r["texts"][i]]
            lines = [a + corpus.PAIR + b for a, b in zip(lines, lines[1:])] if pairs else lines
            want.update((r["binary"], r["func_idx"], r["name"], start, k, t) for k, t in enumerate(lines))
    got = corpus.walk_lines(functions, kind, 2, as_pairs=pairs, strict=strict)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 10_000
    functions.unpersist()


def test_the_shuffle_of_walk_lines_carries_numbers(spark):
    """Texts are made after it, and lines come out of Python as they are: no array is copied for each walk."""
    from tests.compare import DATA

    plan = QUERIES["walk_lines"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "posexplode" not in plan
    assert all("mov eax" not in line for line in plan.splitlines() if "collect_list" in line)


def test_guarded_patterns_rewrite_alike(spark):
    from gantry.functions import normalise

    draw, words = random.Random(9), ["0xffff1", "0x1f]", "0X12(", "0x12345.7", "case.0x", "str.a_b", "method x)", "fcn.1 a", "sym.imp.f", "-[obj.a]", "[reloc.x]", "loc.imp.a_b", "nop w", "mov", ", ", "  ", "é", "]", "(", "\n"]
    rows = [("".join(draw.choice(words) + draw.choice(["", " "]) for _ in range(draw.randint(0, 5))),) for _ in range(3000)] + [(None,)]
    both = spark.createDataFrame(rows, "t string").select(normalise.disasm(F.col("t"), True).alias("a"), F.get(normalise.disasm_array(F.array("t"), True), F.lit(0)).alias("b"))
    assert both.filter("not (a <=> b)").count() == 0
