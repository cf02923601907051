"""Cross-tokenizer alignment: which ids of two vocabularies stand for the same bytes.

Both vocabularies are read from paths given by the caller: A a byte-level BPE for
the tokenizers library, B a sentencepiece model that puts a space before the
text. A sees a space and the text, so both cover the same bytes. Where tokens of
both end at one byte, a group ends; two tokens are linked where their bytes
overlap. Neither vocabulary joins what stands on both sides of a space between
two other characters (A's space opens the next token, B has no piece with a space
after another character: this is checked), so texts are cut there, and each
chunk is encoded and aligned once and then remembered. The chunks of a block of
texts that are new are encoded some hundred at a time, as one text, and aligned
together; what is remembered lies in arrays, so that a block's texts are put
together from their chunks' numbers.

The corpus-wide count of a pair of ids takes three steps: `np.unique` of packed
int64 keys per partition, a global sort by ranges of keys in which runs of equal
keys are summed, and sorted shards of counts in the shared folder, which tasks
map into memory and search. No task holds the whole count table.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemill.llm.shared import discard, keep, qualified, shared_folder
from ridgemill.llm.textops import blocks
from ridgemill.llm.token_counts import _opened

#: Chunks that a worker remembers, and the longest of them; when there are more, it forgets the rare ones.
MEMO, CHUNK = 400_000, 64
#: Links that it remembers with them.
ROOM = 1 << 22
#: Chunks that are encoded as one text.
PACK = 100
#: Keys that a partition gathers before it sums those that are equal.
GATHER = 1 << 22
#: Rows of a range of the global sort, about the pairs of a shard.
SHARD = 1 << 20

_between = re.compile(r"(?<=\S) (?=\S)")
_uneven = re.compile(r" (?!\S)")
_loaded: dict[tuple[str, str], Aligner] = {}


def _byte_table() -> dict[str, int]:
    """The character that stands for a byte in a byte-level vocabulary: printable
    bytes stand for themselves, the others, in order, for U+0100 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... `counts[i]` of them, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _cut(text: str) -> list[str]:
    """The chunks of a text. A space that follows other white space and stands
    before another character opens a token of both vocabularies as well, so only
    spaces before white space, at an end or after a space forbid the plain cut."""
    if text.startswith(" ") or _uneven.search(text):
        return _between.split(text)
    return text.split(" ")


def _held(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """An array of which `used` items are in use, with `more` behind them."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.zeros(used + 2 * len(more), array.dtype)])
    array[used : used + len(more)] = more
    return array


class Aligner(dict):
    """Numbers the chunks that follow a space and remembers their alignments.

    numbers[:, i] are chunk i's n_a, n_b, n_groups and n_links (n_a is -1 where
    either vocabulary does not give its bytes back), groups[i] its groups, and
    links[starts[i]:][:n_links] a packed key, B's id in the upper half, per link.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        code = _byte_table()
        bytes_a = {i: bytes(code[c] for c in entry) if all(c in code for c in entry) else entry.encode() for entry, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        bytes_b = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)]
        if any(re.search("[^▁]▁", piece) for piece in pieces):
            raise ValueError("the second vocabulary joins words: its texts cannot be cut at spaces")
        self.bytes_a, self.size_a = self._entries([bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)])
        self.bytes_b, self.size_b = self._entries(bytes_b)
        ids = range(max(len(self.size_a), len(self.size_b)))
        self.words = np.array([f"{i}{after}" for after in ",|;" for i in ids], "S")
        self.word_size = np.char.str_len(self.words)
        self._forget()

    @staticmethod
    def _entries(entries: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """All entries' bytes and where each begins; their sizes."""
        sizes = np.array([len(x) for x in entries], np.int64)
        return (np.frombuffer(b"".join(entries), np.uint8), np.cumsum(sizes) - sizes), sizes

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.fresh.append(chunk)
        return number

    def _forget(self) -> None:
        """Keep the chunks that were used again, the most used ones, up to half of
        what there is room for."""
        self.fresh: list[str] = []
        if not self:
            self.numbers, self.starts, self.links, self.n_links = np.zeros((4, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            self.groups, self.uses = [], np.zeros(0, np.int64)
            return
        chunks = list(self)
        kept = np.flatnonzero(self.uses > 1)
        kept = kept[np.argsort(-self.uses[kept], kind="stable")][: MEMO // 2]
        kept = kept[np.cumsum(self.numbers[3, kept]) <= ROOM // 2]
        kept = np.array([i for i in kept.tolist() if len(chunks[i]) <= CHUNK], np.int64)
        self.clear()
        self.update(zip(map(chunks.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        self.links = self.links[_ranges(self.starts[kept], self.numbers[3, kept])]
        self.numbers, self.uses = self.numbers[:, kept], self.uses[kept] >> 1
        self.starts, self.n_links = np.cumsum(self.numbers[3]) - self.numbers[3], len(self.links)
        self.groups = list(map(self.groups.__getitem__, kept.tolist()))

    def _encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By vocabulary: all ids of the texts, a space before each, and how many each text has."""
        both = ([e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1))
        counts = [np.fromiter(map(len, ids), np.int64, len(ids)) for ids in both]
        return [(np.fromiter(chain.from_iterable(ids), np.int64, n.sum()), n) for ids, n in zip(both, counts, strict=True)]

    @staticmethod
    def _given_back(raw: np.ndarray, upto: np.ndarray, ids: np.ndarray, n: np.ndarray, entries, sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text, n of them, are byte by byte the text, which ends at upto in `raw`."""
        size = sizes[ids]
        total = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n))]
        said = entries[0][_ranges(entries[1][ids], size)]
        same = np.diff(total) == np.diff(upto, prepend=0)
        if same.all():
            return np.diff(np.append(0, np.cumsum(said != raw))[np.append(0, upto)]) == 0
        for k in np.flatnonzero(same):
            same[k] = np.array_equal(said[total[k] : total[k + 1]], raw[upto[k] - total[k + 1] + total[k] : upto[k]])
        return same

    def align(self, chunks: list[str], pack: int = PACK) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray]:
        """The alignments of chunks, a space before each: their numbers, groups,
        starts and links, as the class has them. `pack` chunks are encoded as one
        text; then none may have a space in it or white space before it."""
        numbers, groups, starts = np.zeros((4, len(chunks)), np.int64), [None] * len(chunks), np.zeros(len(chunks), np.int64)
        if not chunks:
            return numbers, groups, starts, starts
        raw = np.frombuffer(f" {' '.join(chunks)}".encode(), np.uint8)
        sizes = pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy() + 1
        heads = np.arange(0, len(chunks), pack)
        (ids_a, n_a), (ids_b, n_b) = self._encoded([" ".join(chunks[k : k + pack]) for k in heads.tolist()] if pack > 1 else chunks)
        upto = np.cumsum(np.add.reduceat(sizes, heads))
        fine = self._given_back(raw, upto, ids_a, n_a, self.bytes_a, self.size_a) & self._given_back(raw, upto, ids_b, n_b, self.bytes_b, self.size_b)
        if fine.all():
            return self._aligned(ids_a, ids_b, sizes)
        good = np.repeat(fine, np.diff(np.append(heads, len(chunks))))
        rows, rest = np.flatnonzero(good), np.flatnonzero(~good)
        parts = [(rows, *self._aligned(ids_a[np.repeat(fine, n_a)], ids_b[np.repeat(fine, n_b)], sizes[good]))]
        if pack > 1:
            parts.append((rest, *self.align([chunks[k] for k in rest.tolist()], 1)))
        else:
            numbers[0, rest] = -1
        before = 0
        for rows, found, said, at, links in parts:
            numbers[:, rows], starts[rows] = found, before + at
            before += len(links)
            for k, x in zip(rows.tolist(), said, strict=True):
                groups[k] = x
        return numbers, groups, starts, np.concatenate([links for *_, links in parts])

    def _aligned(self, ids_a: np.ndarray, ids_b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """`align` for chunks of `sizes` bytes, whose ends are ends of tokens in both, so that all are aligned as one."""
        ends_a, ends_b, totals = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]), np.append(0, np.cumsum(sizes))
        # per byte: how many tokens of A, of B and how many groups end up to there
        ended = np.zeros((3, totals[-1] + 1), np.int64)
        ended[0, ends_a] = ended[1, ends_b] = 1
        ended[2] = ended[0] & ended[1]
        common = np.flatnonzero(ended[2])
        last_a, last_b = ended[2, ends_a], ended[2, ends_b]
        np.cumsum(ended, axis=1, out=ended)
        first = ended[1, ends_a - self.size_a[ids_a]]
        linked = ended[1, ends_a - 1] - first + 1
        links = (ids_b[_ranges(first, linked)] << 32) | np.repeat(ids_a, linked)
        # each group's A ids, then its B ids, each with what follows it
        begins = np.append(0, common)
        word = np.empty(len(ids_a) + len(ids_b), np.int64)
        word[np.arange(len(ids_a)) + ended[1, begins[ended[2, ends_a - 1]]]] = ids_a + len(self.words) // 3 * last_a
        word[np.arange(len(ids_b)) + ended[0, begins[ended[2, ends_b - 1] + 1]]] = ids_b + len(self.words) // 3 * 2 * last_b
        said = self.words[word].view(np.uint8)
        said = said[said != 0].tobytes().decode()
        at_a = ended[0, totals]
        at_links = np.append(0, np.cumsum(linked))[at_a]
        to = np.append(0, np.cumsum(self.word_size[word]))[at_a + ended[1, totals]].tolist()
        numbers = np.append(np.diff(ended[:, totals], axis=1), [np.diff(at_links)], axis=0)
        return numbers, [said[x : y - 1] for x, y in zip(to, to[1:], strict=False)], at_links[:-1], links

    def _learn(self) -> None:
        """Align the chunks that were numbered last."""
        fresh, self.fresh, used = self.fresh, [], len(self.groups)
        plain = np.array([len(c) <= CHUNK and " " not in c and not c[:1].isspace() for c in fresh], bool)
        numbers, starts = np.zeros((4, len(fresh)), np.int64), np.zeros(len(fresh), np.int64)
        self.groups += [None] * len(fresh)
        for rows, pack in ((np.flatnonzero(plain), PACK), (np.flatnonzero(~plain), 1)):
            numbers[:, rows], groups, at, links = self.align([fresh[k] for k in rows.tolist()], pack)
            for k, said in zip((used + rows).tolist(), groups, strict=True):
                self.groups[k] = said
            starts[rows] = self.n_links + at
            self.links = _held(self.links, self.n_links, links)
            self.n_links += len(links)
        self.numbers, self.starts = np.append(self.numbers, numbers, axis=1), np.append(self.starts, starts)
        self.uses = np.append(self.uses, np.zeros(len(fresh), np.int64))

    def documents(self, texts: list[str | None]) -> list[tuple | None]:
        """The alignments of whole texts, (n_a, n_b, n_groups, groups, links); None for those without tokens."""
        if len(self) > MEMO or self.n_links > ROOM:
            self._forget()
        cut = [_cut(t) if t else [] for t in texts]
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        chunks = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64, n.sum())
        if self.fresh:
            self._learn()
        self.uses += np.bincount(chunks, minlength=len(self.uses))
        numbers, upto = self.numbers[:, chunks], np.append(0, np.cumsum(n))
        totals = np.append(np.zeros((4, 1), np.int64), np.cumsum(numbers, axis=1), axis=1)[:, upto]
        missing = np.diff(np.append(0, np.cumsum(numbers[0] < 0))[upto])
        links, ends = self.links[_ranges(self.starts[chunks], numbers[3])], totals[3].tolist()
        said, upto, sums, out = chunks.tolist(), upto.tolist(), np.diff(totals, axis=1).T.tolist(), []
        for k, (a, b, g, _) in enumerate(sums):
            if upto[k] == upto[k + 1]:
                out.append(None)
            elif missing[k]:  # whether its bytes come back is then a question of the whole text
                found, groups, _, own = self.align([texts[k]], 1)
                out.append((*found[:3, 0].tolist(), groups[0], own) if groups[0] is not None else None)
            else:
                out.append((a, b, g, ";".join(map(self.groups.__getitem__, said[upto[k] : upto[k + 1]])), links[ends[k] : ends[k + 1]]))
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]


def tokens_of(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, counts) of each
    row; keys are its packed pairs, each once, with their counts of links."""

    def run(batches):
        known = aligner(path_a, path_b)
        for batch in batches:
            for part in blocks(batch):
                rows = known.documents(part.column("text").to_pylist())
                pairs = [np.unique(r[4], return_counts=True) if r else (np.zeros(0, np.int64),) * 2 for r in rows]
                offsets = pa.array(np.cumsum([0, *(len(k) for k, _ in pairs)]).astype(np.int32))
                keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([k for k, _ in pairs]), pa.int64()))
                counts = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([n for _, n in pairs]).astype(np.int32), pa.int32()))
                numbers = [pa.array([r[i] if r else 0 for r in rows], pa.int64()) for i in range(3)]
                digest = pa.array([hashlib.sha256(r[3].encode()).hexdigest() if r else "" for r in rows])
                links = pa.array([len(r[4]) if r else 0 for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, links, digest, keys, counts], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "counts"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, counts array<int>")


def _partial(batches):
    """np.unique over all keys of a partition, a bounded number at a time."""
    held, gathered = [], 0

    def merged():
        return _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

    for batch in batches:
        keys = batch.column("keys").flatten().to_numpy()
        held.append(_summed(keys, batch.column("counts").flatten().to_numpy().astype(np.int64)))
        gathered += len(held[-1][0])
        if gathered > GATHER:
            held = [merged()]
            if len(held[0][0]) > GATHER // 2:  # as many distinct ones: pass them on
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["key", "n"])
            gathered = sum(len(k) for k, _ in held)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["key", "n"])


def count_shards(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """The counts of all pairs as files of sorted keys and their counts, int64,
    one per range of keys: (file, pairs, low, high), and beside them (b, top), the
    highest counts of B's ids in a range.

    A file is keys, then counts. Each attempt of a task writes a file of its own;
    only those of attempts that ended well are listed.
    """
    partial = keep(rows.select("keys", "counts").mapInArrow(_partial, "key long, n long"))
    ranges = max(1, -(-partial.count() // SHARD))
    folder = qualified(rows.sparkSession, folder or shared_folder(rows.sparkSession))

    def run(batches):
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        keys, counts = [], []  # summed as they come: a range holds each key few times
        for batch in batches:
            k, n = _summed(batch.column("key").to_numpy(), batch.column("n").to_numpy())
            if keys and len(k) and keys[-1][-1] == k[0]:
                counts[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                counts.append(n)
        if keys:
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            name = f"{uuid.uuid4().hex}.i64"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(keys.astype("<i8").tobytes())
                out.write(counts.astype("<i8").tobytes())
            b = keys >> 32
            heads = np.flatnonzero(np.diff(b, prepend=-1))
            tops, none = np.maximum.reduceat(counts, heads), [None] * len(heads)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}", *none], pa.string()), *(pa.array([x, *none], pa.int64()) for x in (len(keys), int(keys[0]), int(keys[-1]))), pa.array([None, *b[heads].tolist()], pa.int64()), pa.array([None, *tops.tolist()], pa.int64())],
                names=["file", "pairs", "low", "high", "b", "top"],
            )

    listed = keep(partial.repartitionByRange(ranges, "key").sortWithinPartitions("key").mapInArrow(run, "file string, pairs long, low long, high long, b long, top long"))
    discard(partial)
    return listed


def _mapped(file: str, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's keys and counts: mapped where the store is a file system, read where not."""
    if file.startswith("file:"):
        both = np.memmap(_opened(file)[1], "<i8", "r", shape=(2, pairs))
    else:
        store, path = _opened(file)
        with store.open_input_file(path) as source:
            both = np.frombuffer(source.read_buffer(), "<i8").reshape(2, pairs)
    return both[0], both[1]


def pair_table(shards: DataFrame) -> DataFrame:
    """(a_id, b_id, n) of all pairs that are linked anywhere, from `count_shards`."""

    def run(batches):
        for batch in batches:
            for file, pairs in zip(batch.column("file").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                keys, n = _mapped(file, pairs)
                for lo in range(0, pairs, 1 << 16):
                    k = np.asarray(keys[lo : lo + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(k & 0xFFFFFFFF), pa.array(k >> 32), pa.array(np.asarray(n[lo : lo + (1 << 16)]))], names=["a_id", "b_id", "n"])

    return shards.where("file is not null").select("file", "pairs").mapInArrow(run, "a_id long, b_id long, n long")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of
    each row of `docs` (doc_id, text); see the module's text.

    n_best are the links whose pair is as frequent in the corpus as any of its B
    id, count_sum adds up the corpus-wide counts over the links. A null or empty
    text, and one whose tokens do not give its bytes back, has zeros and ''. Rows
    without doc_id and rows that repeat one are rows of their own. Other columns
    are ignored; no rows give no rows.
    """
    rows = keep(tokens_of(docs, path_a, path_b))
    shards = count_shards(rows)
    # bounded by the vocabularies: at most a shard per 2**20 pairs of ids, and B's ids
    listed = [tuple(r) for r in shards.where("file is not null").select("file", "pairs", "low", "high").orderBy("low").collect()]
    tops = {r["b"]: r["top"] for r in shards.where("b is not null").groupBy("b").agg(F.max("top").alias("top")).collect()}
    best = np.zeros(max(tops, default=0) + 1, np.int64)
    best[list(tops)] = list(tops.values())
    sent = rows.sparkSession.sparkContext.broadcast((listed, best))

    def run(batches):
        (files, highest), opened = sent.value, {}
        highs = np.array([high for *_, high in files], np.int64)

        def counts_of(keys):
            n = np.zeros(len(keys), np.int64)
            cuts = np.searchsorted(keys, highs, "right")
            for k, (lo, hi) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
                if lo < hi:
                    if files[k][0] not in opened:
                        if not files[k][0].startswith("file:"):
                            opened.clear()  # read, not mapped: one at a time
                        opened[files[k][0]] = _mapped(*files[k][:2])
                    shard, counts = opened[files[k][0]]
                    n[lo:hi] = counts[np.searchsorted(shard, keys[lo:hi])]
            return n

        for batch in batches:
            keys, times = batch.column("keys"), batch.column("counts")
            flat, times = keys.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            once, place = np.unique(flat, return_inverse=True)
            n = counts_of(once)[place] if len(once) else once
            top = highest[flat >> 32] == n
            sums = [np.append(0, np.cumsum(x)) for x in (times * top, times * n)]
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
            more = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
            plain = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*plain, *more, batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
