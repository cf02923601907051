"""Large groups of near copies: the blocks of operator 1 are bounded by rows too."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_llm import DOCS, brute_join

from ridgemill.llm import ngram_join, substring_dedup


def test_blocks_bound_rows(spark):
    members = spark.range(20_000).select(F.lit(1).alias("component"), F.lit(10).alias("step"), F.col("id").alias("doc_id"), F.lit(10).alias("n"))
    rows = members.join(ngram_join._cuts(members), ["component", "step"]).groupBy(F.pmod(F.xxhash64("doc_id"), "cuts")).count()
    assert rows.agg(F.max("count")).first()[0] <= 1.25 * 2000


def test_short_variants_cut_by_rows(table, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS", 40)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        own = base[: rng.choice([30, 40])]
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = ngram_join.ngram_join(table(rows, DOCS), 3, 80)
    assert sorted(tuple(r) for r in got.collect()) == brute_join(rows, 3, 80)


def test_many_short_variants_at_default_blocks(spark):
    """20,000 distinct sets of 40 shingles that share 36: one component."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(40)], F.concat(F.lit("x"), "id"), *[F.lit(f"v{i}") for i in range(3)]).alias("text"))
    got = ngram_join.ngram_join(docs).groupBy("n_shingles", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(40, 0, 20_000)]


def test_one_passage_in_many_documents(spark, table, monkeypatch):
    """1,000 documents on one passage, each with its own surroundings and some with a changed word."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 2_000)
    passage = [f"p{i}" for i in range(75)]
    rows = []
    for d in range(1_000):
        own = [f"d{d}w{i}" for i in range(20)]
        shared = list(passage)
        if d % 10 == 3:
            shared[d % 75] = "changed"
        rows.append((d, " ".join(own[:10] + shared + own[10:])))
    first, want = {}, {}
    for d, text in rows:
        w = text.split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone[i : i + 50] = [True] * 50
        want[d] = sum(gone)
    got = substring_dedup.dedup_passages(table(rows, "doc_id long, text string").repartition(7), 50)
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == want


def _on_one_template(rng, n, common, own, near):
    """Texts of `common` words that all have and `own` ones of their own; `near` more are changed copies of some."""
    base = [f"t{i}" for i in range(common)]
    rows = [[*base, *(f"u{d}w{i}" for i in range(own))] for d in range(n)]
    for k in range(near):
        copy = list(rows[k])
        copy[rng.randrange(common)] = f"y{k}"
        rows.append(copy)
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(d, " ".join(rows[k])) for d, k in enumerate(order)]


def test_texts_on_one_template_meet_no_blocks(table, monkeypatch):
    """The template's shingles are long columns, but fewer than DEPTH are among a
    text's first ones: all links are found, and no text is in a block."""
    seen = []
    linked = ngram_join._linked_blocks
    monkeypatch.setattr(ngram_join, "_linked_blocks", lambda members, *rest: seen.append(members.count()) or linked(members, *rest))
    rows = _on_one_template(random.Random(5), 150, 80, 22, 40)
    got = ngram_join.ngram_join(table(rows, DOCS), 3, 80)
    want = brute_join(rows, 3, 80)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({c for _, _, c in want}) == 150 and seen == [0]


def test_long_columns_of_every_number(table, monkeypatch):
    """From texts with few long columns to texts of little else, in every mixture of both."""
    monkeypatch.setattr(ngram_join, "ROWS", 40)
    rng = random.Random(8)
    rows = []
    for common, own in [(80, 22), (80, 20), (80, 18), (80, 14), (40, 2), (6, 1)]:
        rows += [text for _, text in _on_one_template(rng, 25, common, own, 12)]
    rows = list(enumerate(rows))
    for percent in (80, 90):
        got = ngram_join.ngram_join(table(rows, DOCS), 3, percent)
        assert sorted(tuple(r) for r in got.collect()) == brute_join(rows, 3, percent)


def test_many_unlinked_texts_on_one_template(spark):
    """20,000 texts that share 78 of 100 words and are linked to nothing."""
    own = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(22)])
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(f"t{i}") for i in range(78)], own).alias("text"))
    got = ngram_join.ngram_join(docs, 3, 80)
    assert got.where("component_id = doc_id").count() == 20_000 and got.count() == 20_000
