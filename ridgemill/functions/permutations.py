"""Reproducible permutation tables (perm_id, row_idx, src_idx), 0-based.

One table serves a whole run, so results do not depend on batches or
partitions. Shuffles are cumulative: each permutation starts from the last.
"""

from __future__ import annotations

import ctypes
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgemill.session import ship
from ridgemill.tables import keep

#: The 32-bit Mersenne Twister's constants.
STATE_SIZE, MIDDLE = 624, 397
TWIST_MASK = 2567483615
SEED_MULTIPLIER = 1812433253
TEMPER_B, TEMPER_C = 2636928640, 4022730752
DEFAULT_SEED = 4357

LIMIT = 0xFFFFFFFF

#: Draws taken, and tiles sent on, at a time.
DRAWS, TILES = 65536, 1024


def _seeded(seed: int) -> np.ndarray:
    """The generator's words before its first draw; seed 0 stands for the default seed."""
    words = [(seed & LIMIT) or DEFAULT_SEED]
    for i in range(1, STATE_SIZE):
        words.append((SEED_MULTIPLIER * (words[-1] ^ (words[-1] >> 30)) + i) & LIMIT)
    return np.array(words, dtype=np.uint32)


def _next(state: np.ndarray) -> np.ndarray:
    """The words that follow a state's."""

    def combine(high, low, far):
        y = (high & np.uint32(0x80000000)) | (low & np.uint32(0x7FFFFFFF))
        return far ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), np.uint32(TWIST_MASK), np.uint32(0))

    gap = STATE_SIZE - MIDDLE
    fresh = np.empty_like(state)
    following = np.append(state[1:], np.uint32(0))
    fresh[:gap] = combine(state[:gap], following[:gap], state[MIDDLE:])
    for lo in range(gap, STATE_SIZE - 1, gap):
        hi = min(lo + gap, STATE_SIZE - 1)
        fresh[lo:hi] = combine(state[lo:hi], following[lo:hi], fresh[lo - gap : hi - gap])
    fresh[-1:] = combine(state[-1:], fresh[:1], fresh[MIDDLE - 1 : MIDDLE])
    return fresh


def _tempered(state: np.ndarray) -> np.ndarray:
    y = state ^ (state >> np.uint32(11))
    y = y ^ ((y << np.uint32(7)) & np.uint32(TEMPER_B))
    y = y ^ ((y << np.uint32(15)) & np.uint32(TEMPER_C))
    return y ^ (y >> np.uint32(18))


#: Bits of the generator's state that count.
DEGREE = 32 * (STATE_SIZE - 1) + 1
#: Draws up to which it is moved ahead by drawing.
DRAWN = 1 << 21


@lru_cache(maxsize=1)
def _characteristic() -> int:
    """The polynomial over two elements, a bit per power, by which a step of the
    generator is a multiplication: that of the shortest linear recurrence of one of
    its bits (Berlekamp and Massey)."""
    state, bits = _seeded(0), []
    while len(bits) < 2 * DEGREE:
        state = _next(state)
        bits += (state & np.uint32(1)).tolist()
    now, last, length, since, recent = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits[: 2 * DEGREE]):
        recent = (recent << 1) | bit
        if not (now & recent).bit_count() & 1:
            since += 1
        elif 2 * length <= n:
            now, last, length, since = now ^ (last << since), now, n + 1 - length, 1
        else:
            now ^= last << since
            since += 1
        recent &= (1 << (DEGREE + 1)) - 1
    return int(format(now, f"0{length + 1}b")[::-1], 2)


def _squared(poly: int) -> int:
    """The square of a polynomial over two elements: each bit moves to twice its place."""
    return int("0".join(format(poly, "b")), 2)


def _power_of_step(steps: int) -> int:
    """x**steps modulo the characteristic polynomial."""
    modulus = _characteristic()
    size = modulus.bit_length()
    out = 1
    for bit in format(steps, "b"):
        out = _squared(out) << (bit == "1")
        while (over := out.bit_length() - size) >= 0:
            out ^= modulus << over
    return out


def _moved(state: np.ndarray, steps: int) -> np.ndarray:
    """The words of the generator `steps` draws later, but for the bits that no draw depends on."""
    poly = _power_of_step(steps)
    words, fresh = [state], state
    while sum(map(len, words)) < STATE_SIZE + DEGREE:
        fresh = _next(fresh)
        words.append(fresh)
    words, out = np.concatenate(words), np.zeros(STATE_SIZE, np.uint32)
    for k, bit in enumerate(reversed(format(poly, "b"))):
        if bit == "1":
            out ^= words[k : k + STATE_SIZE]
    return out


def twister(seed: int, skip: int = 0) -> Iterator[np.ndarray]:
    """Blocks of draws, the first `skip` draws left out; seed 0 stands for the default seed."""
    state = _seeded(seed)
    if skip > DRAWN:
        state, skip = _moved(state, skip), 0
    while True:
        state = _next(state)
        if skip >= STATE_SIZE:
            skip -= STATE_SIZE
            continue
        yield _tempered(state)[skip:]
        skip = 0


def _twister_draws(seed: int, skip: int = 0):
    """A function that takes the next draws, after the first `skip` ones."""
    blocks, held = twister(seed, skip), np.zeros(0, np.uint32)

    def take(count: int) -> np.ndarray:
        nonlocal held
        parts, have = [held], len(held)
        while have < count:
            parts.append(next(blocks))
            have += len(parts[-1])
        every = np.concatenate(parts)
        held = every[count:]
        return every[:count].astype(np.int64)

    return take


def _libc_draws(seed: int, skip: int = 0):
    libc = ctypes.CDLL(None)
    libc.srand(ctypes.c_uint(seed & LIMIT))
    for _ in range(skip):
        libc.rand()
    return lambda count: np.fromiter((libc.rand() for _ in range(count)), np.int64, count)


METHODS = {"mt19937": (_twister_draws, LIMIT), "srand": (_libc_draws, 2147483647)}


def _fresh(n: int, count: int, seed: int, method: str, first: int = 0) -> Iterator[np.ndarray]:
    """`count` forward shuffles of 0..n-1, each by itself, from the `first` one's draws on."""
    draws, limit = METHODS[method]
    take = draws(seed, first * (n - 1))
    for _ in range(count):
        order = array("i", range(n))
        for lo in range(0, n - 1, DRAWS):
            i = np.arange(lo, min(lo + DRAWS, n - 1))
            j = i + take(len(i)) // (limit // (n - i) + 1)
            for a, b in enumerate(j.tolist(), lo):
                order[a], order[b] = order[b], order[a]
        yield np.frombuffer(order, np.intc)


def shuffles(n: int, count: int, seed: int, method: str) -> Iterator[np.ndarray]:
    """`count` cumulative forward shuffles of 0..n-1: each rearranges the last."""
    order = np.arange(n, dtype=np.int32)
    for shuffle in _fresh(n, count, seed, method):
        order = order[shuffle]
        yield order


def _table(n: int, count: int, seed: int, method: str) -> np.ndarray:
    table = np.empty((count, n), dtype=np.int32)
    for row, order in zip(table, shuffles(n, count, seed, method), strict=True):
        row[:] = order
    return table


def mersenne_table(n: int, count: int, seed: int = 0) -> np.ndarray:
    """count x n source rows from the Mersenne Twister; the same everywhere."""
    return _table(n, count, seed, "mt19937")


def libc_table(n: int, count: int, seed: int = 0) -> np.ndarray:
    """count x n source rows from the C library's rand(): platform-dependent."""
    return _table(n, count, seed, "srand")


def _checked(n: int, count: int, method: str) -> str:
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"rng_method must be one of {sorted(METHODS)}")
    if n < 1 or count < 1:
        raise ValueError("a permutation table needs at least one row and one permutation")
    return method


def permutation_table(n: int, count: int, seed: int = 0, method: str = "mt19937") -> np.ndarray:
    return _table(n, count, seed, _checked(n, count, method))


#: The fewest numbers that a task draws.
LEAST = 1 << 18
ROWS = "perm_id int, src binary"


def _row(kinds, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for k, v in zip(kinds.values(), values, strict=True)], names=list(kinds))


def permutation_rows(spark: SparkSession, n: int, count: int, seed: int = 0, method: str = "mt19937") -> DataFrame:
    """The table as (perm_id, src): the source rows of a permutation as 32-bit integers.

    Shuffles are cumulative, but each is a fixed rearrangement of the one before:
    tasks find those of a run of permutations from the generator's state at their
    first draw, and put the rearrangements of the run after one another; one task
    does so with the runs' totals, one at a time; each run is then put after what
    came before it. The C library's generator cannot be moved ahead: its table is
    one run.
    """
    method = _checked(n, count, method)
    runs = 1 if method == "srand" else max(1, min(count, 4 * spark.sparkContext.defaultParallelism, n * count // LEAST))
    size = -(-count // runs)
    kinds = {"run": pa.int32(), "perm_id": pa.int32(), "src": pa.binary()}

    def own(batches):
        for batch in batches:
            for run in batch.column("id").to_pylist():
                order = np.arange(n, dtype=np.int32)
                first, last = run * size, min(count, (run + 1) * size)
                for k, shuffle in enumerate(_fresh(n, last - first, seed, method, first), first):
                    order = order[shuffle]
                    yield _row(kinds, run, k, order.tobytes())

    each = ship(spark).range(0, -(-count // size), 1, -(-count // size)).mapInArrow(own, "run int, perm_id int, src binary")
    if runs == 1:
        return each.select("perm_id", "src")
    each = keep(each)
    totals = each.where((F.col("perm_id") % size == size - 1) | (F.col("perm_id") == count - 1)).select("run", "src")

    def before(batches):
        order = np.arange(n, dtype=np.int32)
        for batch in batches:
            for run, total in zip(batch.column("run").to_pylist(), batch.column("src"), strict=True):
                yield _row(kinds, run, -1, order.tobytes())
                order = order[np.frombuffer(total.as_py(), np.int32)]

    earlier = totals.repartition(1).sortWithinPartitions("run").mapInArrow(before, "run int, perm_id int, src binary")

    def after(batches):
        for batch in batches:
            for k, src in zip(batch.column("perm_id").to_pylist(), batch.column("src"), strict=True):
                order = np.frombuffer(src.as_py(), np.int32)
                if k < 0:
                    start = order
                else:
                    yield _row({c: kinds[c] for c in ("perm_id", "src")}, k, start[order].tobytes())

    # a run is as many permutations as it has, whatever n: all go to one task
    return each.unionByName(earlier).repartition(-(-count // size), "run").sortWithinPartitions("run", "perm_id").mapInArrow(after, ROWS)


def permutation_tiles(spark: SparkSession, n: int, count: int, seed: int = 0, method: str = "mt19937", rows: int = 1024) -> DataFrame:
    """The table as (perm_id, tile, src): src are the source rows of `rows` rows
    from tile * rows on."""

    def run(batches):
        starts = range(0, n, rows)
        for batch in batches:
            for perm_id, src in zip(batch.column("perm_id").to_pylist(), batch.column("src"), strict=True):
                order = np.frombuffer(src.as_py(), np.int32)
                for lo in range(0, len(starts), TILES):
                    part = starts[lo : lo + TILES]
                    cut = order[part[0] : part[-1] + rows]
                    offsets = np.minimum(np.arange(len(part) + 1) * rows, len(cut)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cut, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([perm_id] * len(part), pa.int32()), pa.array(range(lo, lo + len(part)), pa.int32()), lists], names=["perm_id", "tile", "src"])

    return permutation_rows(spark, n, count, seed, method).mapInArrow(run, "perm_id int, tile int, src array<int>")


def permutation_frame(spark: SparkSession, n: int, count: int, seed: int = 0, method: str = "mt19937") -> DataFrame:
    """The table as (perm_id, row_idx, src_idx)."""
    rows = 1024
    cells = permutation_tiles(spark, n, count, seed, method, rows).select("perm_id", "tile", F.posexplode("src").alias("at", "src_idx"))
    return cells.select("perm_id", (F.col("tile") * rows + F.col("at")).alias("row_idx"), "src_idx")


def check_table(perms: DataFrame, n: int, count: int) -> None:
    """Raise unless `perms` is `count` permutations of n rows."""
    seen = perms.groupBy("perm_id").agg(F.count("*").alias("rows"), F.count_distinct("row_idx").alias("r"), F.count_distinct("src_idx").alias("s"), F.max(F.greatest("row_idx", "src_idx")).alias("top"))
    bad = seen.agg(F.count("*").alias("perms"), F.count_if((F.col("rows") != n) | (F.col("r") != n) | (F.col("s") != n) | (F.col("top") != n - 1)).alias("bad")).first()
    if bad["perms"] != count or bad["bad"]:
        raise ValueError(f"the table must hold {count} permutations of {n} rows")


def table_array(perms: DataFrame, n: int, count: int) -> np.ndarray:
    """A caller's table, checked by `check_table`, as count x n source rows. The
    caller of this has made sure that 4 * n * count bytes may be on the driver."""
    table = np.empty((count, n), dtype=np.int32)
    places = {r["perm_id"]: i for i, r in enumerate(perms.select("perm_id").distinct().orderBy("perm_id").collect())}  # `count` numbers
    for r in perms.groupBy("perm_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "src_idx"))).alias("c")).select("perm_id", "c.src_idx").toLocalIterator():
        table[places[r["perm_id"]]] = r["src_idx"]
    return table


def table_rows(perms: DataFrame) -> DataFrame:
    """A caller's table as `permutation_rows` has it, perm_id from 0."""
    numbered = perms.select("perm_id").distinct().select("perm_id", (F.row_number().over(Window.orderBy("perm_id")) - 1).alias("k"))  # as many rows as permutations
    sources = perms.groupBy("perm_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "src_idx"))).alias("c"))

    def run(batches):
        for batch in batches:
            for k, src in zip(batch.column("k").to_pylist(), batch.column("src"), strict=True):
                yield _row({"perm_id": pa.int32(), "src": pa.binary()}, k, src.values.to_numpy().astype(np.int32).tobytes())

    return sources.join(numbered, "perm_id").select(F.col("k").cast("int").alias("k"), F.col("c.src_idx").cast("array<int>").alias("src")).mapInArrow(run, ROWS)
