"""Best-fit packing of documents into sequences, by patterns and least squares.

1. Each document becomes pieces of at most `size` tokens; its ids are found
   once, in Arrow tasks, and only lengths and checksums stay.
2. The histogram of piece lengths (at most `size` numbers, whatever the input)
   goes to the driver. Patterns of up to three lengths that fill a sequence
   exactly are enumerated; non-negative least squares fits their repeat counts
   to the histogram; counts are rounded as far as the histogram allows; what is
   left is packed best-fit by length class.
3. The plan says, for each length, which ranks take which place of which
   pattern. Pieces get their rank by counts per partition and length, and look
   up their place in the broadcast plan, whose rows are bounded by the number
   of lengths and patterns. No piece list meets in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgemill.llm.shared import keep
from ridgemill.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(ranks: str, pattern: str, end_id: int, size: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = encoder(ranks, pattern).special
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                begin, length = 0, (n - 1) % size + 1
                piece = 0
                while begin < n:
                    rows.append((doc, piece, begin, length, zlib.crc32(ids[4 * begin : 4 * (begin + length)])))
                    begin, length, piece = begin + length, size, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(size: int) -> np.ndarray:
    """Triples of lengths (descending, 0 for none) that add up to `size`."""
    out = [(size, 0, 0)]
    out += [(a, size - a, 0) for a in range((size + 1) // 2, size)]
    for a in range(-(-size // 3), size - 1):
        b = np.arange(max(1, -(-(size - a) // 2)), min(a, size - a - 1) + 1)
        out += [(a, int(x), int(size - a - x)) for x in b]
    return np.array(out, dtype=np.int64)


def fit(histogram: np.ndarray, triples: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x with least ``|A x - histogram|``, where A
    counts each pattern's lengths; by accelerated projected gradients, damped so
    that long pieces, which are the hardest to place, weigh more."""
    size = len(histogram) - 1
    weight = (np.arange(size + 1) / size + 0.1)[triples] * (triples > 0)
    target = histogram * (np.arange(size + 1) / size + 0.1)

    def product(x):
        out = np.zeros(size + 1)
        for k in range(3):
            out += np.bincount(triples[:, k], weights=x * weight[:, k], minlength=size + 1)
        return out

    x = np.ones(len(triples))
    for _ in range(20):  # the largest eigenvalue of A'A
        y = product(x)
        x = sum(y[triples[:, k]] * weight[:, k] for k in range(3))
        step = np.linalg.norm(x)
        x = x / step
    x = np.zeros(len(triples))
    ahead, t = x, 1.0
    for _ in range(rounds):
        error = product(ahead) - target
        new = np.maximum(0, ahead - sum(error[triples[:, k]] * weight[:, k] for k in range(3)) / step)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use each piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    out = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    triples = patterns(size)[1:]
    x = fit(left.astype(float), triples)
    order = np.argsort(-x, kind="stable")
    for rounding in (np.floor, np.rint):
        for k in order:
            want = int(rounding(x[k]))
            if want <= 0:
                continue
            lengths = tuple(int(v) for v in triples[k] if v)
            need = {v: lengths.count(v) for v in lengths}
            take = min([want, *(int(left[v]) // c for v, c in need.items())])
            if take > 0:
                for v, c in need.items():
                    left[v] -= take * c
                x[k] -= take
                out.append((lengths, take))
    out += best_fit(left, size)
    return out


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal bins move as one class."""
    open_bins: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []
    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):  # as many of this length as fit go into each new bin
                per = size // length
                full, rest = divmod(count, per)
                new = [((length,) * per, full)] * (full > 0) + [((length,) * rest, 1)] * (rest > 0)
                count = 0
                for lengths, repeats in new:
                    room = size - sum(lengths)
                    if not open_bins[room]:
                        bisect.insort(rooms, room)
                    open_bins[room].append([lengths, repeats])
                continue
            room = rooms[at]
            lengths, repeats = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
            used = min(count, repeats)
            count -= used
            for key, more in ((room, [lengths, repeats - used]), (room - length, [(*lengths, length), used])):
                if more[1]:
                    if not open_bins[key]:
                        bisect.insort(rooms, key)
                    open_bins[key].append(more)
    return [(tuple(lengths), repeats) for bins in open_bins.values() for lengths, repeats in bins]


def places(plan_rows: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank of each run of ranks, its first sequence and its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used = np.zeros(size + 1, dtype=np.int64)
    sequence = 0
    for lengths, repeats in plan_rows:
        offset = 0
        for length in lengths:
            runs[length].append((int(used[length]), sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, ranks: str, pattern: str, end_id: int, size: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    A document is its ids and then `end_id`; one longer than `size` is cut into
    pieces of `size`, of which the first may be shorter. Null and empty texts are
    the end id alone. Equal rows, also of one doc_id, and rows without doc_id are
    documents of their own. Other columns are ignored. No rows give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = texts.sparkSession

    def numbered(batches):
        part = TaskContext.get().partitionId()
        for batch in _cut(ranks, pattern, end_id, size)(batches):
            yield batch.append_column("part", pa.array(np.full(batch.num_rows, part, np.int64)))

    pieces = keep(texts.mapInArrow(numbered, PIECES + ", part long"))
    counts = keep(pieces.groupBy("part", "length").count())
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("count")).collect():
        histogram[row["length"]] = row["count"]
    table = spark.sparkContext.broadcast(places(plan(histogram, size), size))

    # ranks: the pieces of a length in earlier parts, then the place in the part
    before = counts.select("part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    local = pieces.withColumn("row", F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")))
    # both sides are dealt by part and length, so the merge moves no piece again
    ranked = local.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("row") - 1)

    def place(batches):
        runs = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                first, begins, offsets = runs[int(value)]
                run = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = begins[run] + rank[at] - first[run], offsets[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
