"""Token alignment against a plain one, byte by byte."""

from __future__ import annotations

import hashlib
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgemill.llm import token_alignment

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "  two  spaces \n\n and\ttabs "), (6, "naïve café 😀😀  x y 中文"), (7, "a▁b is told apart"), (7, "▁"), (8, "<|endoftext|> <s> </s> <0x41>"),
    (9, "same\x00byte 12345 don't"), (None, "no id"), (None, None), (10, "word " * 3000), (11, "x" * 300 + " " + "y" * 70), (4, "a"), (12, "\u0085next\x1cline ᠎"),
]


@pytest.fixture(scope="module")
def plain():
    """By the two libraries alone: the alignment of a text as (ids a, ids b, groups, links)."""
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    assert len(pre_tokenizers.ByteLevel.alphabet()) == 256
    table = token_alignment._byte_table()
    assert set(table) == set(pre_tokenizers.ByteLevel.alphabet())

    def of(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            return None
        owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = [(ids_a[i], ids_b[j]) for i, j in sorted(set(zip(owner_a, owner_b, strict=True)))]
        groups, at = [], (0, 0)
        for byte in range(len(owner_a)):
            last = byte + 1 == len(owner_a)
            if last or owner_a[byte] != owner_a[byte + 1] and owner_b[byte] != owner_b[byte + 1]:
                to = (owner_a[byte] + 1, owner_b[byte] + 1)
                groups.append(",".join(map(str, ids_a[at[0] : to[0]])) + "|" + ",".join(map(str, ids_b[at[1] : to[1]])))
                at = to
        return ids_a, ids_b, groups, links

    return of


def whole(docs, plain):
    aligned = [(d, plain(t)) for d, t in docs]
    counts = Counter(link for _, x in aligned if x for link in x[3])
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = [
        (d, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(counts[k] == top[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) if x else (d, 0, 0, 0, 0, 0, 0, "")
        for d, x in aligned
    ]
    return sorted(rows, key=repr), counts


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(alphabet="ab Zé.,'1\n\t ▁😀", max_size=25), st.text(max_size=12).filter(lambda t: not any("\ud800" <= c <= "\udfff" for c in t))), min_size=1, max_size=5))
def test_any_text(plain, texts):
    import numpy as np

    for text, got in zip(texts, token_alignment.aligner(A, B).documents(texts), strict=True):
        want = plain(text)
        if want is None:
            assert got is None
        else:
            keys = np.frombuffer(got[4], np.int64)
            assert (got[0], got[1], got[2], got[3]) == (len(want[0]), len(want[1]), len(want[2]), ";".join(want[2]))
            assert list(zip((keys & 0xFFFFFFFF).tolist(), (keys >> 32).tolist(), strict=True)) == want[3]


def encoded(known, monkeypatch):
    """The texts that go to the second vocabulary from now on."""
    seen, b = [], known.b

    class Seen:
        def encode(self, texts, **more):
            seen.extend(texts)
            return b.encode(texts, **more)

    monkeypatch.setattr(known, "b", Seen())
    return seen


def test_new_chunks_are_encoded_together(plain, monkeypatch):
    known = token_alignment.Aligner(A, B)
    seen = encoded(known, monkeypatch)
    texts = [" ".join(f"w{i}x{k % 700}, é{k}" for k in range(400)) + f"\n x{i}" for i in range(12)]
    got = known.documents(texts)
    chunks = len({c for t in texts for c in t.split(" ")})
    assert chunks > 5000 and sum(len(t.split(" ")) for t in seen) == chunks and len(seen) < chunks / 50
    texts += ["one ▁ is told apart " + texts[0], "ok " * 30 + "a  b \n c", "▁", " x"]
    got = known.documents(texts)
    for text, x in zip(texts, got, strict=True):
        want = plain(text)
        assert (x is None) == (want is None)
        assert x is None or (x[0], x[1], x[2], x[3], len(x[4])) == (len(want[0]), len(want[1]), len(want[2]), ";".join(want[2]), len(want[3]))


@pytest.mark.parametrize("limits", [{"MEMO": 60}, {"ROOM": 200}])
def test_frequent_chunks_stay_known(plain, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(token_alignment, name, value)
    known = token_alignment.Aligner(A, B)
    seen = encoded(known, monkeypatch)
    for i in range(8):
        texts = ["the often often the once" + "".join(f" n{i}q{k}" for k in range(50)) + " " + "x" * 70] * 2
        want = plain(texts[0])
        for x in known.documents(texts):
            assert (x[3], len(x[4])) == (";".join(want[2]), len(want[3]))
    words = [w for t in seen for w in t.split(" ")]
    assert [words.count(w) for w in ("the", "often")] == [1, 1]
    assert len(known) < 160 and known.n_links < 800


@pytest.mark.parametrize("limits", [{}, {"SHARD": 50, "GATHER": 40}, {"MEMO": 3}])
def test_align(spark, table, monkeypatch, plain, limits):
    for name, value in limits.items():
        monkeypatch.setattr(token_alignment, name, value)
    docs = ODD + [(100 + i, f"the {w} of thén, {w}ing") for i, w in enumerate("one two three four one one two".split())]
    got = token_alignment.align(table([(*r, 0) for r in docs], DOCS + ", n_a int").repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows, counts = whole(docs, plain)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == rows
    shards = token_alignment.count_shards(token_alignment.tokens_of(table(docs, DOCS), A, B))
    listed = shards.where("file is not null").orderBy("low").collect()
    assert all(x["high"] < y["low"] for x, y in zip(listed, listed[1:], strict=False)) and (len(listed) > 1) == ("SHARD" in limits)
    assert {(r["a_id"], r["b_id"]): r["n"] for r in token_alignment.pair_table(shards).collect()} == counts


def test_empty_tables(spark, table):
    assert token_alignment.align(table([], DOCS), A, B).collect() == []
    assert [tuple(r) for r in token_alignment.align(table([(1, None)], DOCS), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_op12(spark, plain):
    from ridgemill.llm.queries import op12_cross_tokenizer_alignment

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op12_cross_tokenizer_alignment(spark, str(DATA)).collect()), key=repr) == whole(docs, plain)[0]
