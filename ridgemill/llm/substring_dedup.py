"""Removal of passages that also start in a document with a smaller id, by
suffix automata of reference shards.

A window is `length` consecutive words. A word goes if a window that covers it
equals a window of a document with a smaller doc_id.

Every document is reference for the later ones, so the reference grows with the
input and cannot be broadcast. Its shards are routed instead:

1. Of equal texts the smallest id stays; the others lose every word.
2. Equal windows have the same anchor, the smallest hash among their runs of
   GRAM words. Anchors that two or more different texts have are kept, and each
   run of windows with such an anchor, a stretch, goes to the anchor's shard.
3. Equal stretches of a shard are one row of a pre-aggregated table with the
   smallest id: the others go as a whole. The different ones are streamed in
   ascending order of doc_id through the shard's automaton, which holds those of
   smaller ids: where the matching statistic reaches `length`, a window ends
   that must go. Then the stretch is added.
4. A shard whose different stretches have more than SHARD_WORDS words is cut: by
   how far the anchor is from its window's start, in classes, each with a longer
   run that all windows of the class hold. Its pieces are stretches of that
   run's shard, and step 3 is repeated, down to classes of one place, where a
   shard is one window. Classes get a third as wide each time, so a stretch on
   the edge of a very common passage leaves a few pieces a round.
5. Documents are read once more and the maximal spans cut.

An automaton is bounded in words, hot stretches are met by pre-aggregation and
joins that can be split, and nothing is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemill.llm import textops
from ridgemill.llm.automaton import SuffixAutomaton
from ridgemill.llm.shared import discard, keep, unused

#: Words in a run that can be an anchor.
GRAM = 12
#: Words (at most) of the stretches that an automaton holds.
SHARD_WORDS = 50_000

PIECES = "key long, doc_id long, seq long, at int, n int, pos int, h long, codes binary"
SPANS = "doc_id long, seq long, at int, n int"


def sequence_hash(hashes: np.ndarray) -> int:
    """A 64-bit hash of a whole word sequence, as a signed number."""
    return int(textops.run_hashes(hashes, np.zeros(1, np.int64), np.array([len(hashes)])).view(np.int64)[0])


def window_anchors(hashes: np.ndarray, length: int) -> np.ndarray:
    """For each window of `length` words the smallest hash of a run in it."""
    low = textops.shingles(hashes, min(GRAM, length))
    width, span = 1, length - min(GRAM, length) + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return low


def _anchors(length: int):
    """A row for each text of a window or more: two hashes of it and its distinct anchors."""

    def run(batches):
        for batch in batches:
            for block in textops.blocks(batch):
                words = textops.split(block.column("text"))
                hashes = words.hashes()
                at = [(i, hashes[a:b]) for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)) if b - a >= length]
                if at:
                    yield pa.RecordBatch.from_arrays(
                        [block.column("doc_id").take(pa.array([i for i, _ in at])), pa.array([sequence_hash(own) for _, own in at], pa.int64()), pa.array([sequence_hash(textops.mix(own)) for _, own in at], pa.int64()), textops.lists([np.unique(window_anchors(own, length)) for _, own in at], pa.int64())],
                        names=["doc_id", "seq", "twin", "anchors"],
                    )

    return run


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    """Stretches as (keys, doc_id, seq, first windows, numbers of windows, places of the anchor, hashes, codes)."""
    counts = [len(x[0]) for x in parts]
    column = lambda i: np.concatenate([x[i] for x in parts])
    long = [column(0).view(np.int64), np.repeat([x[1] for x in parts], counts), np.repeat([x[2] for x in parts], counts), column(6).view(np.int64)]
    short = [column(i).astype(np.int32) for i in (3, 4, 5)]
    return pa.RecordBatch.from_arrays([*map(pa.array, [*long[:3], *short, long[3]]), pa.array([c for x in parts for c in x[7]], pa.binary())], names=["key", "doc_id", "seq", "at", "n", "pos", "h", "codes"])


def _stretches(length: int):
    """Each stretch of a wanted anchor: its first window, number of windows, the
    anchor's place in it, a hash and the 64-bit codes of its words."""
    gram = min(GRAM, length)

    def run(batches):
        for batch in batches:
            for block in textops.blocks(batch):
                words = textops.split(block.column("text"))
                hashes = words.hashes()
                column = block.column("anchors")
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
                ids, want = block.column("doc_id").to_pylist(), block.column("seq").to_pylist()
                out = []
                for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                    own = hashes[a:b]
                    if len(own) < length or sequence_hash(own) != want[i]:
                        continue
                    low = window_anchors(own, length)
                    edges = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
                    near = np.isin(low[edges], values[offsets[i] : offsets[i + 1]])
                    starts, ends = edges[near], np.append(edges[1:], len(low))[near]
                    grams = textops.shingles(own, gram)
                    places = [int((grams[s : s + length - gram + 1] == low[s]).argmax()) for s in starts.tolist()]
                    whole = own.astype("<u8")
                    codes = [whole[s : e + length - 1].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    out.append((low[starts], ids[i], want[i], starts, ends - starts, np.array(places, np.int64), textops.run_hashes(own, starts, ends + length - 1), codes))
                if out:
                    yield _rows(out)

    return run


def widths(length: int) -> list[int]:
    """Widths of the classes of each round that cuts."""
    out = [length - min(GRAM, length) + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // 3))
    return out[1:] or [1]


def _pieces(length: int, width: int, first: bool):
    """Stretches (of an anchor if `first`, else of a longer run) -> their pieces by classes of `width`."""
    gram = min(GRAM, length)
    widest = length - gram

    def run(batches):
        for batch in batches:
            out = []
            for doc, seq, at, n, pos, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "seq", "at", "n", "pos", "codes")), strict=True):
                values = textops.mix(np.frombuffer(raw, "<u8") + np.uint64(1))
                place = np.full(n, pos)
                if first and n > pos + 1:  # the anchor comes again: from there on the next one counts
                    grams = textops.shingles(values, gram)
                    again = np.flatnonzero(grams == grams[pos])
                    place = again[np.searchsorted(again, np.arange(n))]
                group = (place - np.arange(n)) // width
                starts = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (group[1:] != group[:-1])))
                ends = np.append(starts[1:], n)
                place, near = place[starts], group[starts] * width
                far = np.minimum(near + width - 1, widest)
                keys = textops.mix(textops.run_hashes(values, place - near, place - far + length) + near.astype(np.uint64))
                codes = [raw[8 * s : 8 * (e + length - 1)] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                out.append((keys, doc, seq, at + starts, ends - starts, place - starts, textops.run_hashes(values, starts, ends + length - 1), codes))
            if out:
                yield _rows(out)

    return run


class _Shard:
    """The stretches of one shard so far."""

    def __init__(self, key: int) -> None:
        self.key, self.automaton, self.doc = key, SuffixAutomaton(), None
        self.waiting: list[list[int]] = []
        self.empty = True

    def late(self, doc: int, codes: list[int], length: int) -> np.ndarray:
        """Windows of a stretch, from its start, that a smaller id's stretch holds."""
        if doc != self.doc:  # what the document before had is reference now
            for held in self.waiting:
                self.automaton.add(held)
                self.empty = False
            self.waiting, self.doc = [], doc
        self.waiting.append(codes)
        if self.empty:
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.array(self.automaton.statistics(codes)) >= length) - length + 1


def _later(length: int):
    """Stretches sorted by (key, doc_id, at) -> (doc_id, seq, at, n) of the runs of n windows that go."""

    def run(batches):
        shard = None
        for batch in batches:
            docs, seqs, places, counts = [], [], [], []
            for key, doc, seq, at, codes in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "seq", "at", "codes")), strict=True):
                if shard is None or shard.key != key:
                    shard = _Shard(key)
                late = shard.late(doc, np.frombuffer(codes, "<u8").tolist(), length)
                if len(late):
                    edges = np.flatnonzero(np.append(True, np.diff(late) > 1))
                    docs += [doc] * len(edges)
                    seqs += [seq] * len(edges)
                    places += (at + late[edges]).tolist()
                    counts += np.diff(np.append(edges, len(late))).tolist()
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(seqs, pa.int64()), pa.array(places, pa.int32()), pa.array(counts, pa.int32())], names=["doc_id", "seq", "at", "n"])

    return run


def _decide(stretches: DataFrame, length: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Step 3: the spans (SPANS) that go, and the stretches of shards to be cut, if any."""
    rows = keep(stretches)
    least = keep(rows.groupBy("key", "h").agg(F.min("doc_id").alias("lead"), F.max("n").alias("n")))
    sizes = least.groupBy("key").agg(F.count("*").alias("texts"), F.sum(F.col("n") + (length - 1)).alias("words")).where("texts > 1")
    sizes = keep(sizes)
    kinds = F.when(F.col("texts").isNull(), "clean").when(F.col("words") > SHARD_WORDS, "cut").otherwise("shard")
    told = keep(least.drop("n").join(sizes.hint("merge"), "key", "left").select("key", "h", "lead", kinds.alias("kind")))
    kind = F.when(F.col("doc_id") > F.col("lead"), "late").otherwise(F.col("kind"))
    marked = rows.join(told.hint("merge"), ["key", "h"]).withColumn("kind", kind).where("kind <> 'clean'")
    crowded = not sizes.where(F.col("words") > SHARD_WORDS).isEmpty()
    marked = keep(marked.select("key", "doc_id", "seq", "at", "n", "pos", "h", F.when(F.col("kind") != "late", F.col("codes")).alias("codes"), "kind"))
    for done in (rows, least, sizes, told):
        discard(done)
    # rows that repeat an id and its text have equal stretches
    open_ = marked.where("kind <> 'late'").dropDuplicates(["kind", "key", "h", "doc_id", "seq", "at"])
    shards = open_.where("kind = 'shard'").select("key", "doc_id", "seq", "at", "codes")
    found = shards.repartition("key").sortWithinPartitions("key", "doc_id", "at").mapInArrow(_later(length), SPANS)
    return [marked.where("kind = 'late'").select("doc_id", "seq", "at", "n"), found], open_.where("kind = 'cut'") if crowded else None


def _cut(length: int, with_text: bool, passed: list[str], lost_name: str):
    def run(batches):
        for batch in batches:
            for block in textops.blocks(batch):
                words = textops.split(block.column("text"))
                hashes = words.hashes()
                raw = words.data.tobytes()
                lost = block.column(lost_name).to_pylist()
                texts = block.column("text")
                n_words, n_removed, digests, kept_texts = [], [], [], []
                for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                    gone = np.zeros(b - a, bool)
                    if lost[i] and b - a >= length:
                        own = sequence_hash(hashes[a:b])
                        spans = [(x["at"], x["n"]) for x in lost[i] if x["seq"] == own]
                        if any(n is None for _, n in spans):
                            gone[:] = True
                        elif spans:
                            edges = np.zeros(b - a + 1, np.int64)
                            at, n = np.array(spans).T
                            np.add.at(edges, at, 1)
                            np.add.at(edges, at + n + length - 1, -1)
                            gone = np.cumsum(edges)[:-1] > 0
                    left = a + np.flatnonzero(~gone)
                    kept = b" ".join([raw[s:e] for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)])
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_texts.append(kept.decode() if gone.any() else texts[i].as_py())
                columns = {c: block.column(c) for c in passed} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
                if with_text:
                    columns["kept"] = pa.array(kept_texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def dedup_passages(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """`docs` with n_words, n_removed, kept_sha256 and, if `with_text`, kept added
    (replaced where they exist); text goes out only if `with_text`.

    Words are runs of non-space bytes, unchanged. kept_sha256 is that of the
    kept words joined by one space; `kept` is the text itself where nothing
    went, else the kept words joined by one space.

    Null and empty texts have no words (`kept` stays null or as it is). Windows
    are judged on the input, not on what is left. Repeats inside one document
    do not count, so rows that repeat a doc_id keep what only they share. Rows
    without doc_id are returned whole and are no source for others. All other
    columns pass through, whatever their names. No rows give no rows.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    named = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    texts = keep(named.mapInArrow(_anchors(length), "doc_id long, seq long, twin long, anchors array<long>"))
    leads = keep(texts.groupBy("seq", "twin").agg(F.min("doc_id").alias("doc_id")).withColumn("lead", F.lit(True)))
    marked = texts.join(leads.hint("merge"), ["seq", "twin", "doc_id"], "left")
    marked = keep(marked.select("doc_id", "seq", F.when(F.col("lead"), F.col("anchors")).alias("anchors")))
    discard(texts)
    discard(leads)

    anchors = marked.where("anchors is not null").select("doc_id", "seq", F.explode("anchors").alias("anchor"))
    # rows that repeat an id and its text are one text here, as min and max tell
    sources = anchors.groupBy("anchor").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).where("low <> high")
    repeated = keep(sources.select("anchor"))
    wanted = anchors.join(repeated.hint("merge"), "anchor", "left_semi").groupBy("doc_id", "seq").agg(F.collect_set("anchor").alias("anchors"))
    wanted = keep(wanted)
    discard(repeated)
    stretches = named.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "seq", "anchors").mapInArrow(_stretches(length), PIECES)

    spans, crowded = _decide(stretches, length)
    for k, width in enumerate(widths(length)):
        if crowded is None:
            break
        pieces = crowded.select("doc_id", "seq", "at", "n", "pos", "codes").mapInArrow(_pieces(length, width, k == 0), PIECES)
        more, crowded = _decide(pieces, length)
        spans += more
    discard(wanted)
    found = marked.where("anchors is null").select("doc_id", "seq", F.lit(0).alias("at"), F.lit(None).cast("int").alias("n"))
    for more in spans:
        found = found.unionByName(more)
    name = unused("lost", docs)
    lost = keep(found.groupBy("doc_id").agg(F.collect_set(F.struct("seq", "at", "n")).alias(name)))
    discard(marked)
    passed = [f for f in docs.schema.fields if with_text or f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed) + ", n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return docs.join(lost.hint("merge"), "doc_id", "left").mapInArrow(_cut(length, with_text, [f.name for f in passed], name), schema)
