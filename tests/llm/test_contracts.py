"""The registered queries without SQL, against brute force over their tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from ridgemill.llm import ann, sharding, toxicity
from ridgemill.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(documents):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    encode = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode
    return {d: encode(text, add_special_tokens=False).ids for d, text in documents.items()}


def test_op2(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, str(DATA)).collect()}
    assert rows.keys() == documents.keys()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_op2_model_by_hand():
    """Weights and significance, from their formulas in plain Python."""
    rng = np.random.default_rng(3)
    toxic, clean = rng.integers(0, 60, 200).astype(float), rng.integers(0, 60, 200).astype(float)
    n_toxic, n_clean = int(toxic.sum()), int(clean.sum())
    got = toxicity.token_weights(toxic, clean, n_toxic, n_clean)
    prior = toxicity.PRIOR
    for t, c, w in zip(toxic, clean, got, strict=True):
        a, b = t + prior * (t + c), c + prior * (t + c)
        if t + c < toxicity.LEAST:
            assert w == 0
            continue
        odds = math.log(a / (n_toxic + prior * (n_toxic + n_clean))) - math.log(b / (n_clean + prior * (n_toxic + n_clean)))
        assert w == pytest.approx(odds if abs(odds) > toxicity.MARGIN * math.sqrt(1 / a + 1 / b) else 0.0)
    # the rate is the positive root of the score's moment equation
    scores, counts = np.array([-0.5, -0.05, 1.5, 3.0]), np.array([60.0, 930.0, 8.0, 2.0])
    rate = toxicity._rate(scores, counts)
    assert (counts * np.exp(rate * scores)).sum() / counts.sum() == pytest.approx(1)
    found = [(0, 2, 4.0), (5, 9, 7.0), (11, 12, 0.1)]
    chance = [0.02 * 30 * math.exp(-rate * s) for _, _, s in found]
    assert toxicity.significance(found, 30, rate, 0.02) == pytest.approx(sum(-math.log10(p) for p in chance if p < 1))


def test_op4(spark, ids):
    rows = QUERIES["op4_best_fit_packing"](spark, str(DATA)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for d, found in pieces.items():
        whole = [*ids[d], 2]
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found))) and len(found) == -(-len(whole) // 1024)
        at = 0
        for r in found:
            own = np.array(whole[at : at + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(own.tobytes())
            assert r["length"] == 1024 or r["piece"] == 0
            at += r["length"]
        assert at == len(whole)
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist() and sum(n for _, n in places) <= 1024
    least = math.ceil(sum(len(x) + 1 for x in ids.values()) / 1024)
    assert len(sequences) <= 1.02 * least + 2


def test_op8(spark, documents):
    shards = [f"shard-{k:03d}" for k in range(256)]
    filled = sharding.fill(shards)
    slot = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) % sharding.SLOTS
    got = {r["doc_id"]: (r["slot"], r["shard"]) for r in QUERIES["op8_sharding"](spark, str(DATA)).collect()}
    assert got == {d: (slot(d), shards[filled[slot(d)]]) for d in documents}


def test_op9(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    fine = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    names = np.array(sorted(fine))
    matrix = np.array([fine[i] for i in names])
    found = defaultdict(list)
    for r in QUERIES["op9_approximate_nearest_neighbours"](spark, str(DATA)).collect():
        found[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == {i for i in fine if i % 100 == 0}
    hits = total = 0
    for q, got in found.items():
        far = np.sqrt(((matrix - fine[q]) ** 2).sum(1))
        far[names == q] = np.inf
        exact = sorted(zip(far.tolist(), names.tolist(), strict=True))[:10]
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, len(exact) + 1))
        assert all(s == pytest.approx(np.sqrt(((fine[i] - fine[q]) ** 2).sum()), abs=1e-12) for _, s, i in got)
        hits += len({i for _, _, i in got} & {i for _, i in exact})
        total += len(exact)
    assert hits >= 0.9 * total


def test_op9_recall_over_many_lists(spark, table, monkeypatch):
    """20,000 vectors in as many lists as 640,000 would have."""
    monkeypatch.setattr(ann, "SHARE", 8)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 50)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 24))
    points = (centers[rng.integers(0, 60, 20_000)] + 0.4 * rng.normal(size=(20_000, 24))).round(6)
    df = table([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, vector array<double>")
    found = defaultdict(set)
    for r in ann.search(df, df.where("vec_id % 100 = 0"), 10).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q, got in found.items():
        far = ((points - points[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(got & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert len(found) == 200 and hits >= 0.9 * 2000


def test_op10(spark, ids):
    got = Counter((r["doc_id"], r["n_tokens"]) for r in QUERIES["op10_token_counts"](spark, str(DATA)).collect())
    assert got == Counter((d, len(x)) for d, x in ids.items())
