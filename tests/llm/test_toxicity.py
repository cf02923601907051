"""The registered toxicity scores against a plain computation of the model and the scan."""

from __future__ import annotations

import math
import random
import re
import statistics
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ridgemill.llm import queries, toxicity

ODD = [(900, None), (901, ""), (902, " \t 12 .\n "), (903, "é"), (904, "word " * 200), (906, "vile\u0000rotten ok vile"), (None, "no id, vile")]


def words_of(text):
    return re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def forms_of(word):
    return [(0, word), *((size, word[:size]) for size in toxicity.STEMS if len(word) > size)]


def all_segments(scores):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])

    def search(lo, hi):
        best = max(((round(sums[j] - sums[i], 9), i - j, -i, i, j) for i in range(lo, hi) if scores[i] > 0 for j in range(i + 1, hi + 1)), default=(0,))
        return [] if best[0] <= 0 else [*search(lo, best[3]), (best[3], best[4], best[0]), *search(best[4], hi)]

    return search(0, len(scores))


def plain_scores(docs, labels):
    """(score, n_segments, worst_begin, worst_end) of each row."""
    taught = [(i, words_of(text), labels[i]) for i, text in docs if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    fold = lambda i: xxhash.xxh64(str(i), seed=42).intdigest() % toxicity.FOLDS
    n, total = (Counter(), Counter()), [0, 0]
    for i, words, label in taught:
        if fold(i):
            for form, k in Counter(f for w in words for f in forms_of(w)).items():
                n[label][form] += min(k, toxicity.REPEATS)
            total[label] += sum(min(k, toxicity.REPEATS) for k in Counter(words).values())
    weights = {}
    for form in n[0].keys() | n[1].keys():
        both = n[0][form] + n[1][form]
        a, b = (n[label][form] + toxicity.PRIOR * both for label in (1, 0))
        odds = math.log(a / (total[1] + toxicity.PRIOR * sum(total))) - math.log(b / (total[0] + toxicity.PRIOR * sum(total)))
        if both >= toxicity.LEAST and abs(odds) > toxicity.MARGIN * math.sqrt(1 / a + 1 / b):
            weights[form] = odds

    spread = [(odds - toxicity.DRIFT, n[0][form]) for form, odds in weights.items()]
    spread.append((-toxicity.DRIFT, max(1, total[0] - sum(k for _, k in spread))))
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(k * math.exp(mid * s) for s, k in spread) < sum(k for _, k in spread) else (low, mid)
    rate = high

    def found(words):
        return all_segments([max((weights.get(f, 0.0) for f in forms_of(w)), key=abs) - toxicity.DRIFT for w in words])

    calibration = [(found(words), len(words), label) for i, words, label in taught if not fold(i)]
    tops = [rate * max(s for _, _, s in segments) - math.log(m) for segments, m, label in calibration if segments and not label]
    scale = math.exp(statistics.median(tops)) * math.log(2) if tops else 1e-3

    def beyond(segments, m):
        return [(b, e, s, rate * s - math.log(scale * max(m, 1))) for b, e, s in segments if rate * s > math.log(scale * max(m, 1))]

    def strength(segments, m):
        return math.log1p(sum(x for _, _, _, x in beyond(segments, m)) / math.log(10))

    x = np.array([[strength(segments, m), 1.0] for segments, m, _ in calibration])
    y = np.array([label for _, _, label in calibration], float)
    w = np.zeros(2)
    for _ in range(400):  # half steps to the optimum of the ridged likelihood
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 0.5 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * w)
    out = []
    for _, text in docs:
        words = words_of(text)
        real = beyond(found(words), len(words))
        worst = max(real, key=lambda s: (s[2], -s[0]), default=(None, None))
        out.append((1 / (1 + math.exp(-(w[0] * strength(found(words), len(words)) + w[1]))), len(real), worst[0], worst[1]))
    return out


def test_registered_scores(spark, table, tmp_path):
    rng = random.Random(12)
    docs, labels = [], {}
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 50))]
        labels[i] = int(i % 5 == 0)
        if labels[i] and i % 10:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["Nasty,", "vile", "ROTTENNESS!", "rottenly"]) for _ in range(rng.randint(1, 8))]
        elif i % 40 == 1:
            words.append("vile")
        docs.append((i, " ".join(words)))
    docs += [*ODD, (907, docs[5][1])]
    table(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    table(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for (i, _), (score, n, begin, end) in zip(docs, plain_scores(docs, labels), strict=True):
        r = got[i]
        assert r["score"] == pytest.approx(score, abs=2e-5) and (r["n_segments"], r["worst_begin"], r["worst_end"]) == (n, begin, end)
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
    assert len({r["predicted"] for r in got.values()}) == 2 and any(r["n_segments"] > 0 for r in got.values())
