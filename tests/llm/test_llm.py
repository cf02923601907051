"""The ten operators against brute force, with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgemill.llm import ann, automaton, chat_format, components, decontaminate, ngram_join, packing, sharding, substring_dedup, textops, token_counts, tokens, toxicity, url_filter

DOCS = "doc_id long, text string"
SPACE = re.compile(r"[^\x20\x09-\x0d]+")
ODD = [(900, None), (901, ""), (902, " \t\n "), (903, "é"), (904, "word " * 3000), (905, "\u00a0x\u2003y"), (None, "no id"), (906, "same\u0000byte ok"), (906, "same\u0000byte ok")]


def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return {"ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def corpus(seed=1, n=60):
    """Documents with copies, near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeE") for _ in range(rng.randint(1, 3)))
    base = [[word() for _ in range(rng.randint(1, 160))] for _ in range(n)]
    passage = [word() for _ in range(70)]
    for i in range(0, n, 3):
        base[i] = base[i] + passage[: rng.randint(45, 70)] + [word()]
    for i in range(0, n, 4):
        near = list(base[i])
        near[rng.randrange(len(near))] = word()
        base.append(near)
    base += [list(base[2]), list(base[2]), list(base[5])]
    ids = list(range(len(base)))
    rng.shuffle(ids)
    return [(i, rng.choice([" ", "\n"]).join(w)) for i, w in zip(ids, base, strict=True)]


# --- kernels -----------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\u00a0\x00😀", max_size=30)), max_size=8))
def test_words(texts):
    import pyarrow as pa

    words = textops.split(pa.array(texts, pa.string()))
    got = [[bytes(words.data[words.starts[w] : words.ends[w]]).decode() for w in range(words.first[i], words.first[i + 1])] for i in range(len(texts))]
    assert got == [SPACE.findall(t or "") for t in texts]
    lower = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    flat = [lower(w) for t in got for w in t]
    hashes = words.hashes(lower=True)
    assert len({(a, b) for a, b in zip(flat, hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_components(table):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 3), (3, 1), *[(100 + i, 101 + i) for i in range(30)], *[(50, 60 + i) for i in range(20)]]
    got = {r["node"]: r["component"] for r in components.components(table(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{100 + i: 100 for i in range(31)}, 50: 50, **{60 + i: 50 for i in range(20)}}
    assert components.components(table([], "a long, b long")).count() == 0


# --- 1 --------------------------------------------------------------------------


def brute_join(rows, width, percent):
    sets = []
    for _, text in rows:
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[y] = x
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("width", "percent", "bucket"), [(3, 90, 16), (5, 80, 16), (3, 80, 2), (2, 50, 2)])
def test_ngram_join(table, monkeypatch, width, percent, bucket):
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    monkeypatch.setattr(ngram_join, "FREQUENT", bucket)
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    rows = [*corpus(), *[r for r in ODD if r[0] is not None]]
    got = ngram_join.ngram_join(table([(*r, 1, 2) for r in rows], DOCS + ", n_shingles int, component_id int"), width, percent)
    assert sorted(tuple(r) for r in got.collect()) == brute_join(rows, width, percent)


def test_ngram_join_long_column(table, monkeypatch):
    """A group of near copies that is cut into several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2000)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = ngram_join.ngram_join(table(rows, DOCS), 3, 90)
    assert sorted(tuple(r) for r in got.collect()) == brute_join(rows, 3, 90)


def test_ngram_join_without_ids_or_rows(table):
    got = ngram_join.ngram_join(table([(None, "a b c d"), (7, "a b c d"), (None, "z"), (None, None)], DOCS), 3, 90)
    assert sorted((r["n_shingles"], r["component_id"]) for r in got.collect() if r["component_id"]) == [(2, 7), (2, 7)] and got.count() == 4
    assert ngram_join.ngram_join(table([], DOCS)).count() == 0


# --- 2 --------------------------------------------------------------------------


def test_segments_are_all_maximal_ones():
    rng = random.Random(2)
    for _ in range(200):
        scores = np.array([rng.choice([-2, -1, -0.5, 0.5, 1, 3]) for _ in range(rng.randint(0, 12))], float)

        def search(lo, hi):
            best = max(((scores[i:j].sum(), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            return [*search(lo, best[3]), (best[3], best[4], best[0]), *search(best[4], hi)]

        got = toxicity.segments(scores)
        assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in search(0, len(scores))))
        assert [s for _, _, s in got] == pytest.approx([scores[b:e].sum() for b, e, _ in got])


def test_toxicity_held_out_accuracy(table):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    rows = []
    for i in range(1500):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["Nasty,", "vile", "rotten!"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = table([r[:2] for r in rows], DOCS)
    labels = table([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.teach(docs, labels)
    scored = toxicity.score(docs.union(table(ODD, DOCS)), model).withColumn("held_out", toxicity.held_out()).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    hits = Counter((truth[r["doc_id"]], int(r["score"] >= 0.7)) for r in held)
    assert hits[1, 1] >= 0.9 * (hits[1, 0] + hits[1, 1]) and hits[0, 1] <= 0.01 * hits[0, 0]
    assert all(0 <= r["score"] <= 1 for r in scored) and len(scored) == len(rows) + len(ODD)


def test_toxicity_without_labels(table):
    docs = table([(1, "a b"), (2, None)], DOCS)
    for labels in ([], [(1, 1)], [(2, None)]):
        got = toxicity.score(docs, toxicity.teach(docs, table(labels, "doc_id long, toxic int"))).collect()
        assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)


# --- 3 --------------------------------------------------------------------------


def test_decontamination(table):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.choice([1, 3, 4, 5, 9, 20, 60])))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "?!"), (None, "a b c"), (33, items[0][1]), (33, items[0][1])]
    docs = [*ODD, *corpus(3, 20)]
    for k, (i, text) in enumerate(items[:25]):
        words = text.split()
        hurt = [w if rng.random() > 0.03 else "zz" for w in words]
        docs.append((2000 + k, "Before, " * rng.randint(0, 400) + " ".join(hurt).upper() + ". After"))
    got = decontaminate.contaminated(table([(*d, "x") for d in docs], DOCS + ", item_id string"), table(items, "item_id long, text string"))
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, text in items:
        q = words(text)
        if i is None or not q:
            continue
        k = min(5, len(q))
        for d, body in docs:
            both = len(grams(q, k) & grams(words(body), k))
            if d is not None and both and 100 * both >= 80 * len(grams(q, k)):
                want.add((d, i, len(grams(q, k)), both))
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got.collect()} == want and len(want) > 20
    assert decontaminate.contaminated(table(docs, DOCS), table([], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(table([], DOCS), table(items, "item_id long, text string")).count() == 0


# --- 4 and 10 -------------------------------------------------------------------

TEXTS = [t for _, t in ODD] + ["plain text, it's fine", "a  b", " lead", "trail ", "x\n\ny", "tab\there", "<|endoftext|>", "q <|endoftext|>r<|endoftext|>", "1 22 333", "émigré ñandú 東京 words", "a\u00a0b c\u2003d", "\x1c e \x85f g"]


def test_ids_equal_the_tokenizers_library():
    public = pytest.importorskip("public_tokenizers")
    reference = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    mine = tokens.encoder(**vocabulary())
    for text in [t or "" for t in TEXTS] + [t for _, t in corpus()]:
        assert np.frombuffer(mine.special(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("size", [16, 128])
def test_packing(table, size):
    rows = [*ODD, *[(3000 + i, t) for i, t in enumerate(TEXTS)], *corpus(5)]
    mine = tokens.encoder(**vocabulary())
    got = packing.pack(table([(*r, 5) for r in rows], DOCS + ", length int"), end_id=2, size=size, **vocabulary()).collect()
    by_doc, sequences = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    copies = Counter(d for d, _ in rows)
    for d, text in rows:
        ids = mine.special(text or "") + (2).to_bytes(4, "little")
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
        assert sum(r["length"] for r in own) == copies[d] * len(ids) // 4
        assert all(r["length"] == size for r in own if r["piece"] > 0)
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // size) * 1.05 + 2
    assert packing.pack(table([], DOCS), end_id=2, size=size, **vocabulary()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_plan_uses_each_piece_once(lengths):
    histogram = np.bincount(np.array(lengths, dtype=np.int64), minlength=13)
    used = np.zeros(13, dtype=np.int64)
    for pattern, repeats in packing.plan(histogram, 12):
        assert repeats > 0 and sum(pattern) <= 12
        for length in pattern:
            used[length] += repeats
    assert used.tolist() == histogram.tolist()


@pytest.mark.parametrize("block", [7, 1000])
def test_token_counts(table, monkeypatch, block):
    monkeypatch.setattr(token_counts, "RUN", 3)
    rows = [*ODD, *[(3000 + i, t) for i, t in enumerate(TEXTS)], *corpus(5, 30)]
    files, order = token_counts.write_flat(table(rows, DOCS).repartition(3), **vocabulary())
    got = order.join(token_counts.count_tokens(token_counts.read_flat(files, block)), ["file", "place"])
    mine = tokens.encoder(**vocabulary())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter((d, len(mine.ordinary(t or "")) // 4) for d, t in rows)


@settings(max_examples=15, deadline=None)
@given(ids=st.lists(st.integers(0, 2), max_size=40), block=st.integers(1, 5))
def test_separator_scan(spark, ids, block):
    token_counts.RUN = 2
    parts = [(1, k, np.array(ids[i : i + block], token_counts.DTYPE).tobytes()) for k, i in enumerate(range(0, len(ids), block))]
    got = token_counts.count_tokens(spark.createDataFrame(parts or [(1, 0, b"")], "file long, block long, tokens binary"), separator=0)
    want, run = [], 0
    for i in ids:
        if i == 0:
            want.append(run)
            run = 0
        else:
            run += 1
    want += [run] * (run > 0)
    assert [r["n_tokens"] for r in got.orderBy("place").collect()] == want


def test_flat_files(spark, tmp_path):
    np.array([5, 6, 0, 7, 0, 0, 8], token_counts.DTYPE).tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_counts.count_tokens(token_counts.read_flat(token_counts.flat_files(spark, str(tmp_path / "*.bin")), block=2), separator=0)
    assert [r["n_tokens"] for r in got.orderBy("place").collect()] == [2, 1, 0, 1]


# --- 5 --------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=5), st.lists(st.integers(0, 3), max_size=14))
def test_suffix_automaton(added, query):
    machine = automaton.SuffixAutomaton()
    for codes in added:
        machine.add(codes)
    runs = {tuple(c[i:j]) for c in added for i in range(len(c)) for j in range(i, len(c) + 1)} | {()}
    assert machine.statistics(query) == [max(n for n in range(i + 2) if tuple(query[i + 1 - n : i + 1]) in runs) for i in range(len(query))]
    assert len(machine.depth) <= 2 * sum(map(len, added)) + 1


@pytest.mark.parametrize(("length", "shard"), [(50, 50_000), (4, 50_000), (13, 50_000), (13, 0), (50, 0), (50, 300), (4, 0)])
def test_substring_dedup(table, monkeypatch, length, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rows = [*corpus(7), *[r for r in ODD if r[0] is not None], (906, "same id " * 60), (907, "same id " * 60)]
    rows += [(910 + i, f"{'a b c ' * (20 + i)}{'x' * i} " + "a b c " * 9) for i in range(6)]
    first, texts = {}, {}
    for d, text in rows:
        w = SPACE.findall(text or "")
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, d), d)
    want = Counter()
    for d, text in rows:
        w = SPACE.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
        texts[d, text] = kept if any(gone) else text
    df = table([(*r, 0, "l", 3) for r in rows], DOCS + ", n_words int, lost string, at int").repartition(5)
    got = substring_dedup.dedup_passages(df, length, with_text=True).collect()
    assert {(r["lost"], r["at"]) for r in got} == {("l", 3)}
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert Counter((r["doc_id"], r["kept"]) for r in got) == Counter((d, texts[d, t]) for d, t in rows)
    assert substring_dedup.dedup_passages(table([], DOCS)).count() == 0
    nameless = substring_dedup.dedup_passages(table([(None, "a b c d e"), (4, "a b c d e")], DOCS), 4).collect()
    assert [r["n_removed"] for r in nameless] == [0, 0]


# --- 6 --------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark, table):
    rng = random.Random(8)
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "\\<|", "<|", "<\\\\|", "", None, "plain\n", "<|im_sep|>", "😀é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a<|b"]), rng.choice(nasty)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "assistant", "x"), (50, 0, "assistant", "r"), (50, 0, "assistant", "r"), (51, 0, "user", "only")]
    examples = chat_format.expand(table([(*r, 1) for r in rows], TURNS + ", example int"))
    for r in examples.collect():
        own = sorted([x for x in rows if x[0] == r["conv_id"]], key=lambda x: (x[1], x[2] or "", x[3] or ""))
        replies = [i for i, x in enumerate(own) if x[2] == "assistant"]
        if r["example"] < len(replies):
            text = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]]
            back = text.replace("<\\|", "<|").replace("\\\\", "\\")
            assert back == (own[replies[r["example"]]][3] or "")
            assert r["formatted"].count(chat_format.START) == replies[r["example"]] + 1
    got = {r["conv_id"]: r for r in chat_format.digests(examples).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        own = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1], x[2] or "", x[3] or ""))
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digests(chat_format.expand(table([], TURNS))).count() == 0


# --- 7 --------------------------------------------------------------------------


def glob_pattern(glob):
    return "^" + re.escape(glob).replace(r"\*\*", "[\\s\\S]*").replace(r"\*", "[^/]*") + "$"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab/*", min_size=0, max_size=40), min_size=1, max_size=6), st.lists(st.text(alphabet="ab/", max_size=50), min_size=1, max_size=12))
def test_automaton(globs, texts):
    globs = [re.sub(r"\*{2,}", "**", g) for g in globs]
    got = url_filter.Automaton([[g] for g in globs]).match([t.encode() for t in texts])
    want = [next((i for i, g in enumerate(globs) if re.match(glob_pattern(g), t)), -1) for t in texts]
    assert got.tolist() == want


def test_url_rules(table):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    urls = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "HTTP://A.Example.NET/en/1?q#f": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://net": ("net", "", None, "allow"), "http://x.org?/fr/": ("x.org", "", None, "allow"), "http://x.org/fr/#a": ("x.org", "/fr/", "org/fr/", "allow"),
        "x.net/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b.com/c.net/": ("b.com", "/c.net/", None, "allow"), "://net/": ("net", "/", "net/", "block"),
        "http://" + "a." * 3000 + "net/" + "p" * 5000: ("a." * 3000 + "net", "/" + "p" * 5000, "net/", "block"), "http://é.net/ü": ("é.net", "/ü", "net/", "block"),
    }
    rows = list(enumerate(urls)) + [(99, "http://a.net/x")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(table([(*r, "clash", 7) for r in rows], "page_id long, url string, host string, fits int"), rules).where("fits = 7").collect()}
    assert got == {i: urls[u] for i, u in rows}
    assert url_filter.judge(table([], "page_id long, url string"), rules).count() == 0
    assert url_filter.judge(table([(1, "http://a.net/")], "page_id long, url string"), []).first()["verdict"] == "allow"


# --- 8 --------------------------------------------------------------------------


def test_sharding(spark, table, tmp_path):
    shards = [f"s{i}" for i in range(7)]
    filled = sharding.fill(shards, 1009)
    counts = Counter(filled)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(shards[:-1], 1009)
    assert sum(a != b for a, b in zip(filled, fewer, strict=True)) < 2 * 1009 / 7
    # turns, by the definition: each shard's order is a permutation, and claims follow it
    order = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(h[:8], "little") % 1009, int.from_bytes(h[8:16], "little") % 1008 + 1
        order.append([(offset + j * skip) % 1009 for j in range(1009)])
    table_, turn = [-1] * 1009, 0
    while -1 in table_:
        table_[next(s for s in order[turn % 7] if table_[s] < 0)] = turn % 7
        turn += 1
    assert table_ == filled
    rows = [(1, "k"), (2, "k"), (3, None), (4, ""), (4, "")]
    got = sharding.assign(table([(*r, "old", "a", "b") for r in rows], "id long, key string, shard string, place string, __slot string"), "key", shards, 1009).collect()
    assert {(r["place"], r["__slot"]) for r in got} == {("a", "b")}
    want = lambda k: int(hashlib.md5((k or "").encode()).hexdigest()[:15], 16) % 1009
    assert Counter((r["id"], r["slot"], r["shard"]) for r in got) == Counter((i, want(k), shards[filled[want(k)]]) for i, k in rows)
    sharding.write_shards(table(rows, "id long, key string"), "key", shards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(shards, 1000)


# --- 9 --------------------------------------------------------------------------


def exact_neighbours(vectors, queries, k):
    out = {}
    for q, v in queries:
        found = sorted((float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum())), i) for i, w in vectors if i != q)
        out[q] = found[:k]
    return out


def test_neighbours_recall_and_odd_vectors(table):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 16))
    points = [(i, (centers[i % 12] + 0.5 * rng.normal(size=16)).tolist()) for i in range(3000)]
    odd = [(5001, None), (5002, []), (5003, [0.0] * 16), (5004, [float("nan")] + [1.0] * 15), (5005, [float("inf")] + [1.0] * 15), (5006, [1.0] * 3), (None, [1.0] * 16), (5007, [None] + [1.0] * 15)]
    copies = [(6000 + i, points[0][1]) for i in range(30)]
    rows = [*points, *odd, *copies, points[1]]
    schema = "vec_id long, vector array<double>"
    df = table([(*r, 0) for r in rows], schema + ", rank int")
    got = ann.search(df, df.where("vec_id % 50 = 0"), 10)
    by_query = {}
    for r in got.collect():
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    usable = list({i: v for i, v in [*points, *copies]}.items())
    exact = exact_neighbours(usable, [(i, v) for i, v in usable if i % 50 == 0], 10)
    assert by_query.keys() == exact.keys()
    hits = total = 0
    for q, found in by_query.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [(s, i) for _, s, i in found] == sorted((s, i) for _, s, i in found)
        hits += len({i for _, _, i in found} & {i for _, i in exact[q]})
        total += 10
    assert hits / total >= 0.9
    assert [i for _, _, i in sorted(by_query[0])][:10] == [6000 + i for i in range(10)]
    assert ann.search(table([], schema), table([], schema)).count() == 0
    few = ann.search(table(points[:4], schema), table(points[:1], schema)).collect()
    assert len(few) == 3
