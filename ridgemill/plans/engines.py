"""Three ways to run the permutation test; all give the same numbers.

`relational` expresses everything as joins and aggregations. It generates
n_rand * cells products, so it is for small inputs and for inspection.

`blocked` sends the projection and the permutation table to every executor,
after a check of their size, and multiplies blocks of samples in Arrow tasks:
a sample is one row (its values by row_idx), so nothing but the rows of
responses is shuffled, and each task holds one block of samples at a time.

`tiled` is for projections and tables beyond that size. The projection's tiles,
the permutations and the groups of samples are pieces in the shared folder. A task
has a group of samples and a run of permutations, reads the pieces it needs, and
sums its products tile by tile; nothing is copied per group.

Whether a permuted coefficient is as far from 0 as the observed one is decided
alike in all of them, ties included: plain sums decide where they differ by more
than their rounding can, and whole-number sums (`functions.exact`) elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ridgemill.functions import exact
from ridgemill.functions.permutations import permutation_frame, permutation_rows, permutation_table, table_array, table_rows
from ridgemill.operators.significance import finalise
from ridgemill.operators.solve import projection_tiles, tile_rows
from ridgemill.plans.memory import require_memory
from ridgemill.sources.flat import Shelf, shelve
from ridgemill.tables import keep

#: Bytes that may be broadcast: projection (8 p n) and permutations (4 n n_rand).
BROADCAST_BYTES = 1 << 28
#: Samples multiplied at a time: n * BLOCK * 8 bytes.
BLOCK = 256
#: Cells of a group of samples of `tiled`, of the sums of its run of permutations, and of gathered rows of the projection.
TASK_CELLS = 1 << 23
#: Numbers of a permutation table that the driver makes itself.
SMALL = 1 << 19
#: Share of stored cells below which a block is multiplied as compressed columns.
SPARSE = 1 / 16


def vectors(y: DataFrame) -> DataFrame:
    """(sample, idx, val): one row per sample, its stored cells by row_idx, null
    as 0. A sample has one value per row of the matrix, or few, which bounds the
    row; the engines add up cells that repeat."""
    cells = F.array_sort(F.collect_list(F.struct(F.col("row_idx").cast("int").alias("i"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v"))))
    return y.groupBy("sample").agg(cells.alias("c")).select("sample", F.col("c.i").alias("idx"), F.col("c.v").alias("val"))


def _listed(y_vectors: DataFrame, stats: DataFrame | None) -> DataFrame:
    """The samples with center and scale, null where they stay as they are."""
    if stats is not None:
        return y_vectors.join(stats.select("sample", "center", "scale"), "sample", "left").select("sample", "idx", "val", "center", "scale")
    return y_vectors.select("sample", "idx", "val", F.lit(None).cast("double").alias("center"), F.lit(None).cast("double").alias("scale"))


class _Columns:
    """A block of samples as compressed columns: those of sample s are the cells
    starts[s]..starts[s + 1] of idx and val, by row; cells that repeat are added up
    in the order of their values. center and scale are 0 and 1 for columns that
    stay as they are."""

    def __init__(self, part: pa.RecordBatch, n: int) -> None:
        self.names, self.n = part.column("sample").to_pylist(), n
        idx, val = part.column("idx"), part.column("val")
        of = np.repeat(np.arange(part.num_rows), np.diff(idx.offsets.to_numpy()))
        idx, val = idx.flatten().to_numpy(), pc.fill_null(val.flatten(), 0.0).to_numpy(zero_copy_only=False)
        if len(idx) and (idx.min() < 0 or idx.max() >= n):
            raise ValueError(f"row_idx of y must be 0..{n - 1}")
        order = np.lexsort((val, idx, of))
        of, idx, val = of[order], idx[order], val[order]
        heads = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(idx, prepend=-1) != 0))
        self.val = np.add.reduceat(val, heads) if len(heads) else np.zeros(0)
        self.idx, of = idx[heads], of[heads]
        self.starts = np.searchsorted(of, np.arange(part.num_rows + 1))
        self.center = np.nan_to_num(part.column("center").to_numpy(zero_copy_only=False).astype(float))
        scale = part.column("scale").to_numpy(zero_copy_only=False).astype(float)
        self.scale = np.where(scale > 0, scale, 1.0)
        self.halved: tuple | None = None
        self.full: dict[int, np.ndarray] = {}
        self.room: np.ndarray | None = None

    def each(self, function, start=0.0) -> np.ndarray:
        """A ufunc's reduction over each sample's values."""
        out, some = np.full(len(self.names), start), np.diff(self.starts) > 0
        if some.any():
            out[some] = function.reduceat(np.abs(self.val), self.starts[:-1][some])
        return out

    def halves(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The whole numbers of the values and of the centers; 0 for samples that are not finite."""
        if self.halved is None:
            top = np.maximum(self.each(np.maximum), np.abs(self.center))
            fine = np.isfinite(top)
            power = exact.exponents(np.where(fine, top, 0))
            counts = np.diff(self.starts)
            val = np.where(np.repeat(fine, counts), self.val, 0)
            self.halved = (*exact.halves(val, np.repeat(power, counts), bits), *exact.halves(np.where(fine, self.center, 0), power, bits))
        return self.halved

    def take(self, chosen: np.ndarray, bits: int) -> _Columns:
        """Some of the samples, with their whole numbers."""
        out = object.__new__(_Columns)
        counts = np.diff(self.starts)[chosen]
        cells = np.repeat(self.starts[:-1][chosen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        first, second, c1, c2 = self.halves(bits)
        out.names, out.n, out.idx, out.val = [self.names[k] for k in chosen], self.n, self.idx[cells], self.val[cells]
        out.starts, out.center, out.scale = np.append(0, np.cumsum(counts)), self.center[chosen], self.scale[chosen]
        out.halved, out.full, out.room = (first[cells], second[cells], c1[chosen], c2[chosen]), {}, None
        return out

    def dense(self, val: np.ndarray) -> np.ndarray:
        """n x samples of `val`, one of this block's arrays of cells."""
        if id(val) not in self.full:
            out = np.zeros((self.n, len(self.names)))
            out[self.idx, np.repeat(np.arange(len(self.names)), np.diff(self.starts))] = val
            self.full[id(val)] = out
        return self.full[id(val)]

    def product(self, t: np.ndarray, order: np.ndarray | None, val: np.ndarray) -> np.ndarray:
        """features x samples: the columns of `val` times t (rows x features), whose rows are moved by `order`."""
        if len(self.idx) >= SPARSE * self.n * len(self.names):
            return (t if order is None else t[order]).T @ self.dense(val)
        out = np.zeros((len(self.names), t.shape[1]))
        step = max(1, TASK_CELLS // (8 * t.shape[1]))
        lo = 0
        while lo < len(self.names):  # samples whose gathered rows fit
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + step, "right")) - 1)
            a, b = self.starts[lo], self.starts[hi]
            at = self.idx[a:b] if order is None else order[self.idx[a:b]]
            if self.room is None or self.room.shape[0] < b - a:
                self.room = np.empty((b - a, t.shape[1]))
            rows = np.take(t, at, axis=0, out=self.room[: b - a], mode="clip")
            ends = (self.starts[lo : hi + 1] - a).tolist()
            for s, first, last in zip(range(lo, hi), ends[:-1], ends[1:], strict=True):
                np.dot(val[a + first : a + last], rows[first:last], out=out[s])
            lo = hi
        return out.T


def _slack(columns: _Columns, norms: np.ndarray, powers: np.ndarray, bits: int) -> np.ndarray:
    """How far two sums, or a sum and its whole-number form, may be apart by rounding alone."""
    n, center = columns.n, np.abs(columns.center)
    length = np.sqrt(columns.each(np.add) * columns.each(np.maximum)) + center * np.sqrt(n)
    terms = np.where(center > 0, n, np.diff(columns.starts)) + 8
    top = np.maximum(columns.each(np.maximum), center)
    with np.errstate(invalid="ignore"):
        return 8 * exact.UNIT * norms[:, None] * (terms * length) + np.ldexp(2.0 * top, powers[:, None] - 2 * bits + 2) * n


def _test(columns: _Columns, beta: np.ndarray, permuted, n_rand: int, slack: np.ndarray, decide) -> tuple[np.ndarray, ...]:
    """(s1, s2, hits) over `permuted`, pairs (k, coefficients before scaling); `decide`
    (k, samples) tells exactly, for those samples, which are as far out as observed."""
    far, scale = np.abs(beta), columns.scale
    odd = ~np.isfinite(far)
    s1, s2, hits = np.zeros_like(beta), np.zeros_like(beta), np.zeros(beta.shape, dtype=np.int64)
    for k, b in permuted:
        out = np.abs(b)
        with np.errstate(invalid="ignore"):
            gap = out - far
            sure = gap > slack
            near = (gap >= -slack) & ~sure
            hits += sure | odd & (out >= far)
            b = b / scale
            s1 += b
            s2 += b * b
        if near.any():
            some = np.flatnonzero(near.any(axis=0))
            hits[:, some] += near[:, some] & decide(k, some)
    return s1, s2, hits


def _collected(t: DataFrame, p: int, n: int) -> np.ndarray:
    """The projection's tiles as rows x features, on the driver, after a check of its size."""
    out, rows = np.zeros((n, p)), tile_rows(p)
    for batch in t.select("tile", "f", "val").toArrow().to_batches():
        held = batch.column("val")
        for tile, f, lo, hi in zip(batch.column("tile").to_pylist(), batch.column("f").to_pylist(), held.offsets[:-1].to_pylist(), held.offsets[1:].to_pylist(), strict=True):
            out[tile * rows : tile * rows + hi - lo, f] = held.values.slice(lo, hi - lo).to_numpy()
    return out


def _moves(spark, n: int, n_rand: int, seed: int, method: str, perms: DataFrame | None) -> np.ndarray:
    """n_rand x n: where each permutation puts the rows. Moving the rows of y by a
    permutation is moving the rows of the projection by its inverse."""
    if perms is not None:
        table = table_array(perms, n, n_rand)
    elif n * n_rand <= SMALL:
        table = permutation_table(n, n_rand, seed, method)
    else:
        table = np.empty((n_rand, n), np.int32)
        for batch in permutation_rows(spark, n, n_rand, seed, method).toArrow().to_batches():
            for k, src in zip(batch.column("perm_id").to_pylist(), batch.column("src"), strict=True):
                table[k] = np.frombuffer(src.as_buffer(), np.int32)
    moves = np.empty_like(table)
    np.put_along_axis(moves, table, np.arange(n, dtype=table.dtype)[None], axis=1)
    return moves


def blocked(x: DataFrame, y_vectors: DataFrame, lam: float, n_rand: int, n: int, seed: int, method: str, stats: DataFrame | None = None, perms: DataFrame | None = None, block_size: int = BLOCK, watch: Observation | None = None) -> DataFrame:
    """The result table from `vectors` rows; with `stats` (sample, center, scale) of
    centred and scaled columns. `perms` is a caller's permutation table,
    `block_size` the samples multiplied at a time. A block with few stored cells is
    multiplied as compressed columns, at a cost that follows their number."""
    spark = x.sparkSession
    features, tiles, tops = projection_tiles(x, lam, n)
    p, bits, powers = len(features), exact.width(n), exact.exponents(tops)
    require_memory(8 * p * n + 4 * n * n_rand, BROADCAST_BYTES)
    sent = spark.sparkContext.broadcast((_collected(tiles, p, n), _moves(spark, n, n_rand, seed, method, perms)))

    def run(batches):
        t, moves = sent.value
        sums, norms = t.sum(axis=0)[:, None], np.sqrt((t * t).sum(axis=0))
        whole: list[np.ndarray] = []  # the projection's whole numbers and their sums, made when first asked for

        def distance(columns, order):
            if not whole:
                whole.extend(exact.halves(t, powers, bits))
                whole.extend([whole[0].sum(axis=0)[:, None], whole[1].sum(axis=0)[:, None]])
            a1, a2, s1, s2 = whole
            b1, b2, c1, c2 = columns.halved
            high = columns.product(a1, order, b1) - s1 * c1
            low = columns.product(a1, order, b2) + columns.product(a2, order, b1) - (s1 * c2 + s2 * c1)
            return exact.far(high, low, bits)

        for batch in batches:
            for lo in range(0, batch.num_rows, block_size):
                columns = _Columns(batch.slice(lo, block_size), n)
                with np.errstate(invalid="ignore"):
                    beta = columns.product(t, None, columns.val) - sums * columns.center
                seen = {}

                def decide(k, some, columns=columns, seen=seen):
                    own = columns.take(some, bits)
                    fresh = [s for s in some.tolist() if s not in seen]
                    if fresh:
                        high, low = distance(columns.take(np.array(fresh), bits), None)
                        seen.update({s: (high[:, i], low[:, i]) for i, s in enumerate(fresh)})
                    there = tuple(np.stack([seen[s][half] for s in some.tolist()], axis=1) for half in (0, 1))
                    return exact.at_least(distance(own, moves[k]), there)

                def permuted(columns=columns):
                    for k, order in enumerate(moves):
                        with np.errstate(invalid="ignore"):
                            yield k, columns.product(t, order, columns.val) - sums * columns.center

                s1, s2, hits = _test(columns, beta, permuted(), n_rand, _slack(columns, norms, powers, bits), decide)
                yield _sums(features, columns, beta, s1, s2, hits)

    return finalise(_listed(y_vectors, stats).mapInArrow(run, SUMS), n_rand, watch)


SUMS = "feature string, sample string, beta double, s1 double, s2 double, hits long"


def _sums(features: list[str], columns: _Columns, beta: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
    """Rows of SUMS, features x samples, from coefficients before scaling."""
    who = [np.repeat(np.array(features, dtype=object), len(columns.names)), np.tile(np.array(columns.names, dtype=object), len(features))]
    return pa.RecordBatch.from_arrays([*(pa.array(w, pa.string()) for w in who), *(pa.array(c.ravel()) for c in (beta / columns.scale, *sums))], names=["feature", "sample", "beta", "s1", "s2", "hits"])


def fits(n: int, p: int, n_rand: int) -> bool:
    """Whether `blocked` may broadcast its projection and permutations."""
    return 8 * p * n + 4 * n * n_rand <= BROADCAST_BYTES


def _halved_cells(features: list[str], tiles: DataFrame, powers: np.ndarray, bits: int) -> DataFrame:
    """(row_idx, feature, t, a1, a2): the projection's cells and their whole numbers."""
    rows = tile_rows(len(features))

    def run(batches):
        names = np.array(features, dtype=object)
        for batch in batches:
            val, f = batch.column("val"), batch.column("f").to_numpy()
            sizes = np.diff(val.offsets.to_numpy())
            flat, of = val.flatten().to_numpy(), np.repeat(f, sizes)
            a1, a2 = exact.halves(flat, powers[of], bits)
            row = np.repeat(batch.column("tile").to_numpy() * rows - np.cumsum(sizes) + sizes, sizes) + np.arange(len(flat))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(names[of], pa.string()), pa.array(flat), pa.array(a1.astype(np.int64)), pa.array(a2.astype(np.int64))], names=["row_idx", "feature", "t", "a1", "a2"])

    return tiles.select("tile", "f", "val").mapInArrow(run, "row_idx int, feature string, t double, a1 long, a2 long")


def _halved_samples(listed: DataFrame, n: int, bits: int, cells: bool) -> DataFrame:
    """The samples' cells (sample, src_idx, y, b1, b2), or the samples themselves
    (sample, center, scale, c1, c2, fine)."""

    def run(batches):
        for batch in batches:
            columns = _Columns(batch, n)
            b1, b2, c1, c2 = columns.halves(bits)
            names = np.array(columns.names, dtype=object)
            if cells:
                of = np.repeat(names, np.diff(columns.starts))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(columns.idx, pa.int32()), pa.array(columns.val), pa.array(b1.astype(np.int64)), pa.array(b2.astype(np.int64))], names=["sample", "src_idx", "y", "b1", "b2"])
            else:
                fine = np.isfinite(np.maximum(columns.each(np.maximum), np.abs(columns.center)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(columns.center), pa.array(columns.scale), pa.array(c1.astype(np.int64)), pa.array(c2.astype(np.int64)), pa.array(fine)], names=["sample", "center", "scale", "c1", "c2", "fine"])

    return listed.mapInArrow(run, "sample string, src_idx int, y double, b1 long, b2 long" if cells else "sample string, center double, scale double, c1 long, c2 long, fine boolean")


def relational(x: DataFrame, y_vectors: DataFrame, lam: float, n_rand: int, n: int, perms: DataFrame, stats: DataFrame | None = None, watch: Observation | None = None) -> DataFrame:
    """The result table from `vectors` rows, as joins and aggregations."""
    features, tiles, tops = projection_tiles(x, lam, n)
    bits = exact.width(n)
    t = _halved_cells(features, tiles, exact.exponents(tops), bits)
    listed = keep(_listed(y_vectors, stats))
    y = _halved_samples(listed, n, bits, cells=True)
    sums = [F.sum(F.col("t") * F.col("y")).alias("value"), F.sum(F.col("a1") * F.col("b1")).alias("high"), F.sum(F.col("a1") * F.col("b2") + F.col("a2") * F.col("b1")).alias("low")]
    whole = t.groupBy("feature").agg(F.sum("t").alias("s"), F.sum("a1").alias("s1"), F.sum("a2").alias("s2"))
    grid = whole.crossJoin(_halved_samples(listed, n, bits, cells=False))  # as many cells as the result

    def corrected(cells, keys):
        both = grid.join(cells, ["feature", "sample"], "left") if "perm_id" not in keys else grid.crossJoin(perms.select("perm_id").distinct()).join(cells, keys, "left")
        c = lambda name, zero: F.coalesce(F.col(name), F.lit(zero))
        value = c("value", 0.0) - F.col("s") * F.col("center")
        high = c("high", 0).cast("long") - F.col("s1") * F.col("c1")
        low = c("low", 0).cast("long") - (F.col("s1") * F.col("c2") + F.col("s2") * F.col("c1"))
        carried, rest = high + F.shiftright(low, bits), low.bitwiseAND(F.lit((1 << bits) - 1))
        borrowed = (carried < 0) & (rest > 0)
        far = F.struct(F.when(carried < 0, -carried - borrowed.cast("long")).otherwise(carried).alias("high"), F.when(borrowed, F.lit(1 << bits) - rest).otherwise(rest).alias("low"))
        return both.select(*keys, value.alias("raw"), (value / F.col("scale")).alias("value"), far.alias("far"), "fine")

    observed = corrected(t.join(y, t["row_idx"] == y["src_idx"]).groupBy("feature", "sample").agg(*sums), ["feature", "sample"])
    moved = perms.join(y, "src_idx").join(t, "row_idx").groupBy("perm_id", "feature", "sample").agg(*sums)
    permuted = corrected(moved, ["perm_id", "feature", "sample"])
    both = permuted.join(observed.select("feature", "sample", F.col("value").alias("beta"), F.col("raw").alias("raw0"), F.col("far").alias("far0")), ["feature", "sample"])
    plain = ~F.isnan("raw") & ~F.isnan("raw0") & (F.abs("raw") >= F.abs("raw0"))
    hit = F.when(F.col("fine"), F.col("far") >= F.col("far0")).otherwise(plain)
    b = F.col("value")
    return finalise(both.groupBy("feature", "sample", "beta").agg(F.sum(b).alias("s1"), F.sum(b * b).alias("s2"), F.count_if(hit).alias("hits")), n_rand, watch)


def _tile_pieces(tiles: DataFrame, p: int) -> DataFrame:
    """(key, data): a tile of the projection, rows x features."""

    def run(batches):
        at, held = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.ascontiguousarray(np.array(held).T).tobytes()], pa.binary())], names=["key", "data"])

        for batch in batches:
            for tile, val in zip(batch.column("tile").to_pylist(), batch.column("val"), strict=True):
                if tile != at:
                    if held:
                        yield out()
                    at, held = tile, []
                held.append(val.values.to_numpy())
        if held:
            yield out()

    return tiles.select("tile", "f", "val").repartition("tile").sortWithinPartitions("tile", "f").mapInArrow(run, "key long, data binary")


def _group_pieces(listed: DataFrame, groups: int) -> DataFrame:
    """(key, data): a group of samples, as an Arrow table."""

    def run(batches):
        at, held = None, []

        def out():
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["key", "data"])

        for batch in batches:
            grp = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi:
                    if grp[lo] != at:
                        if held:
                            yield out()
                        at, held = int(grp[lo]), []
                    held.append(batch.slice(lo, hi - lo).select(["sample", "idx", "val", "center", "scale"]))
        if held:
            yield out()

    grp = F.pmod(F.xxhash64("sample"), F.lit(groups)).cast("int").alias("grp")
    return listed.select(grp, "*").repartition("grp").sortWithinPartitions("grp", "sample").mapInArrow(run, "key long, data binary")


def tiled(x: DataFrame, y_vectors: DataFrame, lam: float, n_rand: int, n: int, seed: int, method: str, stats: DataFrame | None = None, perms: DataFrame | None = None, block_size: int = BLOCK, watch: Observation | None = None) -> DataFrame:
    """As `blocked`, at sizes where neither the projection nor the permutation
    table may be held whole. A task holds one group of samples (n times as many
    cells) and the sums of its run of permutations."""
    spark = x.sparkSession
    features, tiles, tops = projection_tiles(x, lam, n)
    p, rows, bits, powers = len(features), tile_rows(len(features)), exact.width(n), exact.exponents(tops)
    listed = keep(_listed(y_vectors, stats))
    groups = max(1, -(-listed.count() // max(1, min(block_size, TASK_CELLS // n))))
    widest = max(1, min(block_size, TASK_CELLS // n)) * 2  # samples fall into groups by hash
    chunk = max(1, min(TASK_CELLS // (p * widest), -(-n_rand * groups // spark.sparkContext.defaultParallelism), n_rand))
    chunks = -(-n_rand // chunk)
    orders = permutation_rows(spark, n, n_rand, seed, method) if perms is None else table_rows(perms)
    shelves = [Shelf(shelve(d)) for d in (_tile_pieces(tiles, p), orders.selectExpr("perm_id as key", "src as data"), _group_pieces(listed, groups))]
    sent = spark.sparkContext.broadcast(shelves)

    def run(batches):
        by_tile, by_perm, by_group = sent.value
        places = sorted(by_tile.places)

        def tile(at):
            return by_tile.read(at, "<f8").reshape(-1, p)

        for batch in batches:
            for job in batch.column("id").to_pylist():
                group, first = job // chunks, job % chunks * chunk
                data = by_group.read(group, "u1")
                if data is None:
                    continue
                columns = _Columns(pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks().to_batches()[0], n)
                y, last = columns.dense(columns.val), min(n_rand, first + chunk)
                beta, moved = np.zeros((p, len(columns.names))), np.zeros((last - first, p, len(columns.names)))
                sums, norms = np.zeros((p, 1)), np.zeros(p)
                with np.errstate(invalid="ignore"):
                    for at in places:
                        t, lo = tile(at), at * rows
                        sums += t.sum(axis=0)[:, None]
                        norms += (t * t).sum(axis=0)
                        beta += t.T @ y[lo : lo + len(t)]
                        for k in range(first, last):
                            moved[k - first] += t.T @ y[by_perm.read(k, "<i4")[lo : lo + len(t)]]
                    beta -= sums * columns.center
                    moved -= sums * columns.center
                slack = _slack(columns, np.sqrt(norms), powers, bits)
                whole = {}

                def distance(wanted, columns=columns):
                    """{k: pairs} of the samples wanted for each permutation (None: as observed)."""
                    own = {k: columns.take(some, bits) for k, some in wanted.items()}
                    out = {k: [np.zeros((p, len(c.names))), np.zeros((p, len(c.names)))] for k, c in own.items()}
                    s1, s2 = np.zeros((p, 1)), np.zeros((p, 1))
                    for at in places:
                        a1, a2 = exact.halves(tile(at), powers, bits)
                        lo = at * rows
                        s1 += a1.sum(axis=0)[:, None]
                        s2 += a2.sum(axis=0)[:, None]
                        for k, c in own.items():
                            src = slice(lo, lo + len(a1)) if k is None else by_perm.read(k, "<i4")[lo : lo + len(a1)]
                            b1, b2 = c.dense(c.halved[0])[src], c.dense(c.halved[1])[src]
                            out[k][0] += a1.T @ b1
                            out[k][1] += a1.T @ b2 + a2.T @ b1
                    return {k: exact.far(h - s1 * own[k].halved[2], m - (s1 * own[k].halved[3] + s2 * own[k].halved[2]), bits) for k, (h, m) in out.items()}

                undecided = {}
                for k in range(first, last):  # all that need whole numbers, so that tiles are read once more and not once for each
                    with np.errstate(invalid="ignore"):
                        near = (np.abs(np.abs(moved[k - first]) - np.abs(beta)) <= slack).any(axis=0)
                    if near.any():
                        undecided[k] = np.flatnonzero(near)
                for some in _few(undecided, max(1, TASK_CELLS // (4 * n))):
                    there = distance({None: (every := np.unique(np.concatenate(list(some.values()))))})[None]
                    for k, pairs in distance(some).items():
                        at = np.searchsorted(every, some[k])
                        whole[k] = exact.at_least(pairs, (there[0][:, at], there[1][:, at]))
                s1, s2, hits = _test(columns, beta, enumerate(moved, first), n_rand, slack, lambda k, some, whole=whole: whole[k])
                yield _sums(features, columns, beta, s1, s2, hits)

    jobs = groups * chunks
    parts = spark.range(0, jobs, 1, jobs).mapInArrow(run, SUMS)
    whole = parts.groupBy("feature", "sample").agg(F.max("beta").alias("beta"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("hits").alias("hits"))
    return finalise(whole, n_rand, watch)


def _few(wanted: dict, most: int):
    """Parts of a dictionary of arrays whose arrays hold about `most` values together."""
    part, size = {}, 0
    for k, some in wanted.items():
        if part and size + len(some) > most:
            yield part
            part, size = {}, 0
        part[k] = some
        size += len(some)
    if part:
        yield part


__all__ = ["blocked", "fits", "permutation_frame", "relational", "tiled", "vectors"]
