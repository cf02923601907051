"""Ranked search against scores worked out term by term."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from ridgemill.llm import lexical

DATA = Path("/root/testdata/sf0.001")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, k=10):
    """{(item_id, rank): (doc_id, score)}."""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = {}
    for item, terms in wanted.items():
        scores = []
        for place, (d, c) in enumerate(counts):
            n = sum(c.values())
            m = 100 - 90 + ((90 * n * n_docs) // total if total else 0)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, place))
        for rank, (score, none, d, _) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (None if none else d, -score)
    return out


def rows(result):
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in result.collect()}
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    return got


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "And", "ünd", "x1"]) if rng.random() < 0.4 else "w" + str(int(rng.paretovariate(0.6)) % 500)
    text = lambda most: rng.choice([" ", ", ", "\n-"]).join(word() for _ in range(rng.randint(1, most)))
    docs = [(i, text(rng.choice([5, 60, 400]))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(1000, docs[7][1]), (None, docs[7][1]), (2000, None), (2001, ""), (2002, " .,-\x7f"), (2003, "the " * 5000)]
    rng.shuffle(docs)
    items = [(i, text(30)) for i in range(25)] + [(3, docs[7][1]), (3, "w7 w8"), (None, "the w9"), (40, None), (41, ""), (42, "nowhere"), (43, docs[7][1]), (43, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"ITEMS": 4, "PAIRS": 50}, {"CELLS": 64, "HELD": 10, "DENSE": 2.0, "SENT": 0}, {"DENSE": 0.0, "TERMS": 3}])
def test_search_by_hand(spark, table, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    extra = table([(*r, 1) for r in docs], DOCS + ", score long").repartition(5)
    want = by_hand(docs, items)
    assert rows(lexical.search(extra, table(items, ITEMS))) == want and len(want) > 150
    assert rows(lexical.search(extra, table(items, ITEMS), k=1)) == {key: v for key, v in want.items() if key[1] == 1}


def test_empty_tables(spark, table):
    docs, items = table([(1, "a b")], DOCS), table([(1, "a")], ITEMS)
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(table([(1, None), (None, "")], DOCS), items).collect() == []
    assert rows(lexical.search(docs, items)) == by_hand([(1, "a b")], [(1, "a")])


def test_bounds_hold(spark, table):
    docs, items = corpus(5, 80)
    index, _, sums = lexical.build_index(table(docs, DOCS))
    counts = Counter()
    for r in index.collect():
        impact = [lexical.impacts(tf, r["m"]) for tf in r["tf"]]
        assert len(impact) == len(r["terms"]) == len(r["impacts"])
        assert all((b - 1) * lexical.STEP < i <= b * lexical.STEP for i, b in zip(impact, r["impacts"], strict=True))
        counts.update(r["terms"])
    assert sums == {"N": sum(bool(terms_of(t)) for _, t in docs), "L": sum(len(terms_of(t)) for _, t in docs)}
    assert sorted(counts.values()) == sorted(Counter(t for _, text in docs for t in set(terms_of(text))).values())


def test_best_keeps_all_that_may_win():
    rng = np.random.default_rng(0)
    best = lexical._Best(3, 4)
    item, uid, low = rng.integers(0, 3, 500), np.arange(500), rng.integers(0, 1000, 500)
    for part in np.array_split(np.arange(500), 20):
        best.learn(item[part], low[part])
        best.add(item[part], uid[part], low[part] + 50, low[part])
    kept = best.rows()
    for i in range(3):
        floor = np.sort(low[item == i])[-4]
        assert set(uid[(item == i) & (low + 50 >= floor)]) == set(kept[1][kept[0] == i])


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_op11_by_hand(spark):
    from ridgemill.llm.queries import op11_ranked_lexical_search

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert rows(op11_ranked_lexical_search(spark, str(DATA))) == by_hand(docs, items)
