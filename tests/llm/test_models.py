"""Toxicity and quality: exact neighbours, ordered grades, held-out accuracy; and the pipeline by brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gantry.llm import quality, queries, toxicity
from gantry.llm.common import table
from tests.compare import DATA
from tests.llm.fixtures import WHITE, components, shingles

SF = f"{DATA}/sf0.01"


def _cosines(index, terms, weights):
    out = np.zeros(len(index.ids))
    query = dict(zip(terms.tolist(), weights.tolist()))
    for i in range(len(out)):
        own = slice(index.begin[i], index.begin[i + 1])
        out[i] = sum(query.get(t, 0.0) * float(w) for t, w in zip(index.terms[own].tolist(), index.weights[own]))
    return out


@pytest.mark.parametrize("rest", [0.0, 0.05, 0.5])
def test_block_max_neighbours_are_exact(monkeypatch, rest):
    monkeypatch.setattr(toxicity, "REST", rest)
    r = np.random.default_rng(4)
    vectors = []
    for i in range(700):
        t = np.sort(r.choice(40, r.integers(0, 8), replace=False))
        w = (r.random(len(t)) + 0.01) ** 3
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    sizes = np.array([len(t) for t, _ in vectors])
    index = toxicity.BlockMaxIndex(np.arange(700), r.integers(0, 2, 700), np.ones(700), sizes, np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]), 40, block=16)
    for i in range(200):
        t, w = vectors[i]
        if not len(t):
            assert not len(index.nearest(t, w, 15)[0])
            continue
        cosines = _cosines(index, t, w)
        for without in (None, index.order[i]):
            at, near = index.nearest(t, w, 15, without)
            rest = cosines.copy()
            if without is not None:
                rest[without] = 0
            want = np.lexsort((np.arange(len(rest)), -np.round(rest, 9)))[:15]
            want = want[rest[want] > 1e-12]
            assert at.tolist() == want.tolist() and np.allclose(near, rest[want])


def test_toxicity_scores_by_brute_force(spark):
    """Whole scores: words, document frequencies, weights, cosines to every example, votes and curve, from plain Python."""
    rng = random.Random(5)
    pool = [f"v{i}" for i in range(120)]
    rows, marks = [], []
    for i in range(150):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) + (" nasty, Vile!" if bad and i % 3 else "")))
        if i % 3 != 1:
            marks.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "nothing known herein"), (903, "NASTY ÉTÉ vile")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    bags = {i: Counter(re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) for i, t in rows}
    label, n = dict(marks), len(rows)
    terms = {w for i in label for w in bags[i]}
    df = {w: sum(w in b for b in bags.values()) for w in terms}
    yes, no = ({w: sum(w in bags[i] for i, y in marks if y == k) for w in terms} for k in (1, 0))
    ny, nn = sum(label.values()), len(label) - sum(label.values())
    part = lambda k, e: k * math.log(k / e) if k else 0.0

    def weight(w):
        s = (yes[w] + no[w]) / (ny + nn)
        lr = 2 * (part(yes[w], ny * s) + part(no[w], nn * s) + part(ny - yes[w], ny * (1 - s)) + part(nn - no[w], nn * (1 - s)))
        return (math.log((1 + n) / (1 + df[w])) + 1) * max(lr, 0.0)

    def unit(bag):
        v = {w: (1 + math.log(c)) * weight(w) for w, c in bag.items() if w in terms}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    own = {i: unit(bags[i]) for i in label}

    def vote(bag, without=None):
        v = unit(bag)
        near = sorted(((sum(v.get(w, 0) * x for w, x in own[i].items()), i) for i in label if i != without), reverse=True)
        near = [(c, i) for c, i in near if c > 1e-9][:15]
        return (sum(label[i] / (1.05 - min(c, 1)) for c, i in near) / sum(1 / (1.05 - min(c, 1)) for c, _ in near), near) if near else (ny / (ny + nn), [])

    votes = [(vote(bags[i], i)[0], y) for i, y in sorted(label.items())]
    a, b = toxicity.fit_curve(np.array([v for v, _ in votes]), np.array([y for _, y in votes]), np.ones(len(votes)))
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    for i, bag in bags.items():
        v, near = vote(bag)
        if len(near) == 15 and sum(abs(c - near[-1][0]) < 1e-6 for c, _ in near) > 1:
            continue  # which of equal neighbours vote is the index's choice
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(a * v + b))), abs=2e-3)
        assert np.allclose([e["cosine"] for e in got[i]["evidence"]], [c for c, _ in near], atol=1e-5)
    assert got[903]["score"] > 0.5 > got[902]["score"] == got[900]["score"]


def test_toxicity_held_out(spark):
    labels = table(spark, SF, "labels")
    rows = queries.op6_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert right > 0.9 and np.mean(toxic) > np.mean(clean) + 0.3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_evidence_and_ties(spark):
    docs = spark.createDataFrame([(i, f"good plain text number {i}") for i in range(30)] + [(100 + i, f"vile nasty words {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(100 + i, 1) for i in range(30)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[105]["score"] > 0.9 > 0.1 > got[5]["score"] and all(e["doc_id"] >= 100 for e in got[105]["evidence"]) and len(got[105]["evidence"]) == 15


def test_toxicity_of_few_labels(spark):
    """Ten toxic examples, four with the marking word and six that read like clean ones, against 58 clean ones; and two of each."""
    docs = spark.createDataFrame([(i, f"plain story {'abcdefghij'[i % 10]} goes on") for i in range(58)] + [(100 + i, "story of one moron again" if i < 4 else f"plain story {'abcdefghij'[i]} goes on") for i in range(10)] + [(200, "what moron"), (201, "plain story z goes on")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(58)] + [(100 + i, 1) for i in range(10)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert got[200] > 0.5 > got[201] > 0
    tiny = labels.filter("doc_id in (1, 2, 100, 101)")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, tiny)).collect()}
    assert got[200] > got[201] > 0


def test_toxicity_of_labels_without_documents(spark):
    docs = spark.createDataFrame([(1, "plain"), (2, "story")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (50, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()} == {0.0}


def test_quality_held_out(spark):
    rows = queries.op9_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) / len(rows) > 0.9


def test_ordinal_grades_are_ordered(spark):
    r = np.random.default_rng(0)
    words = {0: "bad", 1: "fair", 2: "fine", 3: "great"}
    rows, grades = [], []
    for i in range(400):
        g = int(r.integers(0, 4))
        rows.append((i, " ".join([words[g]] * 3 + [f"w{x}" for x in r.integers(0, 50, 5)])))
        grades.append((i, g))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame(grades, "doc_id long, quality int"))
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    got = {x["doc_id"]: x for x in quality.score(docs, model, select=2).collect()}
    means = [np.mean([got[i]["expected_grade"] for i, g in grades if g == k]) for k in range(4)]
    assert (np.diff(means) > 0.3).all()
    assert np.mean([got[i]["kept"] == (g >= 2) for i, g in grades]) > 0.9


def test_quality_with_one_or_no_grade(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    one = quality.learn(docs, spark.createDataFrame([(1, 2)], "doc_id long, quality int"))
    assert [(r["expected_grade"], r["tail_probability"], r["kept"]) for r in quality.score(docs, one).collect()] == [(2.0, 1.0, True)] * 2
    none = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [(r["expected_grade"], r["tail_probability"], r["kept"]) for r in quality.score(docs, none).collect()] == [(None, 0.0, False)] * 2


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on what the one before kept, on the smallest tables."""
    import sentencepiece

    d = f"{DATA}/sf0.001"
    docs = table(spark, d, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "decontamination", "sentencepiece"]
    kept, columns = docs, docs.columns
    scores = {r["doc_id"]: r["score"] for r in queries.op6_toxicity(spark, d).collect()}
    items = [shingles(r["text"], 5) for r in table(spark, d, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] or "" for r in kept.collect()}
        kept = stage(spark, kept, d)
        assert kept.columns == columns
        after = {r["doc_id"]: r["text"] or "" for r in kept.collect()}
        kept = docs.join(spark.createDataFrame([(i,) for i in after], "doc_id long"), "doc_id", "left_semi")
        if name == "toxicity":
            want = {i for i in before if scores[i] < 0.5}
        elif name == "exact dedup":
            best: dict = {}
            for i, t in before.items():
                key = WHITE.sub("", t)
                if key not in best or (-len(t), i) < (-len(before[best[key]]), best[key]):
                    best[key] = i
            want = set(best.values())
        elif name == "near dedup":
            up = components(list(before.items()), 5, 80)
            want = {i for i in before if up[i] == i}
        else:
            want = {i for i, t in before.items() if not any(s and len(s & shingles(t, 5)) >= 0.8 * len(s) for s in items)}
        assert set(after) == want and all(after[i] == before[i] for i in after)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file(spark, "piece_bpe_32k.model"))
    for r in corpus_pipeline.STAGES[-1][1](spark, kept, d).collect():
        assert r["ids"] == sp.encode(r["text"] or "") and r["decoded"] == sp.decode(r["ids"])
    assert corpus_pipeline.run(spark, d).count() == kept.count() < docs.count()
