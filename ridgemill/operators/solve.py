"""The regularised normal equations: Gram matrix, factor, projection, products.

All arithmetic runs in tasks, on blocks. The rows of x are cut into tiles, a tile's
cells are a dense array while a task works on it. Features are cut into blocks of
BLOCK_FEATURES: the Gram matrix is a table of its lower blocks, to which each task
adds what its tiles give; the factor is made block column by block column, each
from the last one's remainder; the projection T = (X'X + lambda I)^-1 X' is
solved tile by tile against the blocks of the factor, which are sent to the tasks
up to FACTOR_BYTES and stream past groups of tiles beyond. The driver sees one
diagonal block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemill.model import RidgeError, Status
from ridgemill.tables import discard, keep

#: Features of a block; its numbers take 8 * BLOCK_FEATURES**2 bytes.
BLOCK_FEATURES = 512
#: Most rows of a tile, and cells of its dense form.
TILE_ROWS, TILE_CELLS = 1024, 1 << 20
#: Cells of Gram blocks that a task gathers over its tiles; a wider matrix is passed on tile by tile.
GATHER = 1 << 24
#: Bytes of a factor that is sent to the tasks, and tiles in a group that a larger one streams past.
FACTOR_BYTES, GROUP = 1 << 26, 8
#: Names up to which they are sent to the tasks for numbering.
NAMES = 100_000


def features_of(x: DataFrame) -> list[str]:
    """The features of x in order; their number is that of a matrix's rows."""
    return [r["feature"] for r in x.select("feature").distinct().orderBy("feature").collect()]


def tile_rows(p: int) -> int:
    """Rows of a tile of `p` features, a multiple of 8."""
    return max(8, min(TILE_ROWS, TILE_CELLS // max(p, 1)) // 8 * 8)


def tiles(x: DataFrame, features: list[str]) -> DataFrame:
    """(tile, row_idx, f, value): the cells of x, those of a tile together."""
    names = x.sparkSession.createDataFrame(list(enumerate(features)), "f int, feature string")
    names = F.broadcast(names) if len(features) <= NAMES else names
    rows = tile_rows(len(features))
    cells = x.where("value is not null").join(names, "feature").select(F.floor(F.col("row_idx") / rows).cast("int").alias("tile"), F.col("row_idx").cast("int").alias("row_idx"), "f", F.col("value").cast("double").alias("value"))
    return cells.repartition("tile").sortWithinPartitions("tile", "row_idx", "f", "value")


def _designs(batches, rows: int, p: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each tile and its dense rows x features; cells that repeat add up. All tiles
    have the same shape, so that equal rows of x take equal steps."""
    tile, design = None, None
    for batch in batches:
        at, row, f, value = (batch.column(c).to_numpy() for c in ("tile", "row_idx", "f", "value"))
        if len(row) and row.min() < 0:
            raise ValueError("row_idx of x must not be negative")
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if at[lo] != tile:
                if tile is not None:
                    yield tile, design
                tile, design = int(at[lo]), np.zeros((rows, p))
            np.add.at(design, (row[lo:hi] - tile * rows, f[lo:hi]), value[lo:hi])
    if tile is not None:
        yield tile, design


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *(a.size for a in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([a.ravel() for a in arrays]) if arrays else np.zeros(0)))


def _blocks(batch: pa.RecordBatch, column: str = "val") -> list[np.ndarray]:
    """The values of each row of a list column, without copying."""
    held = batch.column(column)
    ends, flat = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


BLOCKS = "i int, j int, val array<double>"


def gram_blocks(cells: DataFrame, p: int) -> DataFrame:
    """(i, j, val), i >= j: the lower blocks of X'X. A task sums those of its tiles
    before they are shuffled, by block, and summed in the order of their tiles."""
    size, rows = BLOCK_FEATURES, tile_rows(p)
    count = -(-p // size)
    spans = [slice(i * size, min(p, (i + 1) * size)) for i in range(count)]
    gather = p * p <= 2 * GATHER

    def partial(batches):
        sums, first = {}, None

        def out(tile, blocks):
            keys = sorted(blocks)
            for k in range(0, len(keys), 8):
                some = keys[k : k + 8]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([j for _, j in some], pa.int32()), pa.array([tile] * len(some), pa.int32()), _lists([blocks[key] for key in some])], names=["i", "j", "tile", "val"])

        for tile, design in _designs(batches, rows, p):
            first = tile if first is None else first
            if gather:
                for i in range(count):
                    for j in range(i + 1):
                        own = design[:, spans[i]].T @ design[:, spans[j]]
                        sums[i, j] = sums[i, j] + own if (i, j) in sums else own
            else:
                for i in range(count):
                    yield from out(tile, {(i, j): design[:, spans[i]].T @ design[:, spans[j]] for j in range(i + 1)})
        yield from out(first, sums)

    def total(batches):
        key, held = None, None
        for batch in batches:
            for i, j, val in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), _blocks(batch), strict=True):
                if (i, j) != key:
                    if key is not None:
                        yield _one(*key, held)
                    key, held = (i, j), np.array(val)
                else:
                    held += val
        if key is not None:
            yield _one(*key, held)

    parts = cells.mapInArrow(partial, "i int, j int, tile int, val array<double>")
    return parts.repartition("i", "j").sortWithinPartitions("i", "j", "tile").mapInArrow(total, BLOCKS)


def _one(i: int, j: int, val: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), _lists([val])], names=["i", "j", "val"])


def gram(x: DataFrame) -> DataFrame:
    """(f1, f2, value) of X'X, every pair of features."""
    x = keep(x.select("row_idx", "feature", "value"))
    features = features_of(x)
    p, size = len(features), BLOCK_FEATURES

    def cells(batches):
        names = np.array(features, dtype=object)
        for batch in batches:
            for i, j, val in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), _blocks(batch), strict=True):
                a, b = names[i * size : (i + 1) * size], names[j * size : (j + 1) * size]
                for f1, f2, v in ((a, b, val.reshape(len(a), len(b))), (b, a, val.reshape(len(a), len(b)).T)) if i != j else ((a, b, val.reshape(len(a), len(b))),):
                    for k, name in enumerate(f1):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(f2), pa.string()), pa.array(f2, pa.string()), pa.array(np.ascontiguousarray(v[k]))], names=["f1", "f2", "value"])

    return gram_blocks(tiles(x, features), p).mapInArrow(cells, "f1 string, f2 string, value double")


def regularise(g: DataFrame, lam: float) -> DataFrame:
    return g.withColumn("value", F.when(F.col("f1") == F.col("f2"), F.col("value") + F.lit(float(lam))).otherwise(F.col("value")))


def _diagonal(lam: float):
    """The factor of a diagonal block, with the status of the attempt."""

    def run(batches):
        for batch in batches:
            for val in _blocks(batch):
                size = round(len(val) ** 0.5)
                full = np.array(val).reshape(size, size) + lam * np.eye(size)
                status, lower = Status.OK, np.zeros((0, 0))
                if not np.isfinite(full).all():
                    status = Status.SOLVE_FAILED
                else:
                    try:
                        lower = np.linalg.cholesky(full)
                    except np.linalg.LinAlgError:
                        status = Status.NOT_POSITIVE_DEFINITE
                yield pa.RecordBatch.from_arrays([pa.array([int(status)], pa.int32()), _lists([lower])], names=["status", "val"])

    return run


def factor(blocks: DataFrame, p: int, lam: float) -> DataFrame | dict[tuple[int, int], np.ndarray]:
    """The lower triangular factor of (X'X + lambda I), given the lower blocks of
    X'X: its blocks as a table, or by place where they take up to FACTOR_BYTES.

    Raises RidgeError where the matrix is not positive definite or not finite.
    """
    size = BLOCK_FEATURES
    count = -(-p // size)
    width = lambda i: min(p, (i + 1) * size) - i * size
    spark, found, rest = blocks.sparkSession, [], blocks
    rest = keep(rest) if count > 1 else rest
    for k in range(count):
        head = rest.where((F.col("i") == k) & (F.col("j") == k)).mapInArrow(_diagonal(lam), "status int, val array<double>").toArrow()
        status = Status(head.column("status")[0].as_py()) if head.num_rows else Status.NOT_POSITIVE_DEFINITE
        if status != Status.OK:
            raise RidgeError(status)
        corner = np.array(head.column("val").combine_chunks().values.to_numpy()).reshape(width(k), width(k))
        if count == 1:
            return {(0, 0): corner}
        sent, wide = spark.sparkContext.broadcast(corner), width(k)

        def column(batches):
            """Blocks below the corner, solved against it."""
            inverse = np.linalg.solve(sent.value, np.eye(wide))
            for batch in batches:
                for i, val in zip(batch.column("i").to_pylist(), _blocks(batch), strict=True):
                    yield _one(i, k, sent.value if i == k else val.reshape(-1, wide) @ inverse.T)

        def remainder(batches):
            """What later columns are left with."""
            for batch in batches:
                for i, j, val, left, right in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), *(_blocks(batch, c) for c in ("val", "left", "right")), strict=True):
                    yield _one(i, j, val.reshape(len(left) // wide, -1) - left.reshape(-1, wide) @ right.reshape(-1, wide).T)

        panel = keep(rest.where(F.col("j") == k).mapInArrow(column, BLOCKS))
        found.append(panel)
        if k + 1 < count:
            own = panel.where(F.col("i") > k)
            left = own.select("i", F.col("val").alias("left"))
            right = own.select(F.col("i").alias("j"), F.col("val").alias("right"))
            after = keep(rest.where(F.col("j") > k).join(left, "i").join(right, "j").select("i", "j", "val", "left", "right").mapInArrow(remainder, BLOCKS))
            discard(rest)
            rest = after
    lower = found[0]
    for panel in found[1:]:
        lower = lower.unionByName(panel)
    if 4 * p * (p + size) > FACTOR_BYTES:
        return lower
    table = lower.toArrow()
    blocks = [v.values.to_numpy() for v in table.column("val").combine_chunks()]
    return {(i, j): np.array(v).reshape(width(i), width(j)) for i, j, v in zip(table.column("i").to_pylist(), table.column("j").to_pylist(), blocks, strict=True)}


TILES = "tile int, f int, top double, val array<double>"


def _projected(tile: int, values: np.ndarray, used: int) -> Iterator[pa.RecordBatch]:
    """Rows of TILES, a number of features at a time."""
    values = values[:, :used]
    step = max(1, (1 << 17) // max(used, 1))
    for lo in range(0, len(values), step):
        part = np.ascontiguousarray(values[lo : lo + step])
        top = np.abs(part).max(axis=1) if used else np.zeros(len(part))
        yield pa.RecordBatch.from_arrays([pa.array([tile] * len(part), pa.int32()), pa.array(range(lo, lo + len(part)), pa.int32()), pa.array(top), _lists(list(part))], names=["tile", "f", "top", "val"])


def projection_tiles(x: DataFrame, lam: float, n: int) -> tuple[list[str], DataFrame, np.ndarray]:
    """The features of x, T as (tile, f, top, val), the values of feature number f
    over the rows of a tile and the largest of them, and each feature's largest
    value. A tile without cells of x is left out: its values are 0.

    Raises RidgeError where T cannot be found.
    """
    features = features_of(x)
    if not features:
        raise RidgeError(Status.BAD_DIMENSIONS)
    p, rows, size = len(features), tile_rows(len(features)), BLOCK_FEATURES
    count = -(-p // size)
    cells = tiles(x, features)
    lower = factor(gram_blocks(cells, p), p, float(lam))
    spans = [slice(i * size, min(p, (i + 1) * size)) for i in range(count)]

    def inverted(block):
        return np.linalg.solve(block, np.eye(len(block)))

    if isinstance(lower, dict):
        sent = x.sparkSession.sparkContext.broadcast(lower)

        def run(batches):
            blocks = sent.value
            corners = [inverted(blocks[i, i]) for i in range(count)]
            for tile, design in _designs(batches, rows, p):
                t = np.ascontiguousarray(design.T)
                for i in range(count):
                    for j in range(i):
                        t[spans[i]] -= blocks[i, j] @ t[spans[j]]
                    t[spans[i]] = corners[i] @ t[spans[i]]
                for i in reversed(range(count)):
                    for j in range(i + 1, count):
                        t[spans[i]] -= blocks[j, i].T @ t[spans[j]]
                    t[spans[i]] = corners[i].T @ t[spans[i]]
                yield from _projected(tile, t, min(rows, n - tile * rows))

        t = keep(cells.mapInArrow(run, TILES))
    else:
        t = keep(_streamed(cells, lower, p, n, spans, inverted))
    tops = np.zeros(p)
    for r in t.groupBy("f").agg(F.max("top").alias("top")).collect():  # a number per feature
        tops[r["f"]] = r["top"]
    if not np.isfinite(tops).all():
        raise RidgeError(Status.SOLVE_FAILED)
    return features, t, tops


def _streamed(cells: DataFrame, lower: DataFrame, p: int, n: int, spans: list[slice], inverted) -> DataFrame:
    """T, by groups of tiles past which all blocks of the factor stream twice: by
    rows for the forward solve, then by rows from the last one back."""
    rows, count = tile_rows(p), len(spans)
    groups = -(-(-(-n // rows)) // GROUP)
    grp = F.floor(F.col("tile") / GROUP).cast("int").alias("grp")
    none = lambda kind: F.lit(None).cast(kind)
    own = cells.select(grp, F.lit(0).alias("phase"), F.col("tile").alias("i"), F.lit(0).alias("j"), "row_idx", "f", "value", none("array<double>").alias("val"))
    each = lower.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "i", "j", "val")
    parts = own
    for phase, at in ((1, F.col("i")), (2, -F.col("i"))):
        parts = parts.unionByName(each.select("grp", F.lit(phase).alias("phase"), at.cast("int").alias("i"), "j", none("int").alias("row_idx"), none("int").alias("f"), none("double").alias("value"), "val"))

    def run(batches):
        group, held = None, {}

        def out():
            for tile, t in sorted(held.items()):
                yield from _projected(tile, t, min(rows, n - tile * rows))
            held.clear()

        for batch in batches:
            grps, phases, first, second = (batch.column(c).to_numpy() for c in ("grp", "phase", "i", "j"))
            cuts = [0, *(np.flatnonzero((np.diff(grps) != 0) | (np.diff(phases) != 0) | ((np.diff(first) != 0) | (phases[1:] > 0))) + 1).tolist(), len(grps)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if grps[lo] != group:
                    yield from out()
                    group = grps[lo]
                i, j = int(abs(first[lo])), int(second[lo])
                if phases[lo] == 0:
                    t = held.setdefault(i, np.zeros((p, rows)))
                    row, f, value = (batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("row_idx", "f", "value"))
                    np.add.at(t, (f.astype(np.int64), row.astype(np.int64) - i * rows), value)
                    continue
                block = batch.column("val").slice(lo, 1).flatten().to_numpy().reshape(-1, spans[j].stop - spans[j].start)
                corner = inverted(block) if i == j else None
                for t in held.values():
                    if phases[lo] == 1:  # row i: what earlier rows explain goes, then its corner
                        t[spans[i]] = corner @ t[spans[i]] if i == j else t[spans[i]] - block @ t[spans[j]]
                    elif i == j:
                        t[spans[i]] = corner.T @ t[spans[i]]
                    else:  # row i is solved: earlier rows lose its part
                        t[spans[j]] -= block.T @ t[spans[i]]
        yield from out()

    # a corner comes after its row's other blocks on the way forward, before them on the way back
    last = F.when(F.col("phase") == 2, -F.col("j")).otherwise(F.col("j"))
    return parts.repartition("grp").sortWithinPartitions("grp", "phase", "i", last, "row_idx", "f", "value").mapInArrow(run, TILES)


def t_cells(features: list[str], t: DataFrame) -> DataFrame:
    """(feature, row_idx, value) of T from its tiles."""
    rows = tile_rows(len(features))

    def run(batches):
        names = np.array(features, dtype=object)
        for batch in batches:
            for tile, f, val in zip(batch.column("tile").to_pylist(), batch.column("f").to_pylist(), _blocks(batch), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([names[f]] * len(val), pa.string()), pa.array(tile * rows + np.arange(len(val)), pa.int32()), pa.array(val)], names=["feature", "row_idx", "value"])

    return t.select("tile", "f", "val").mapInArrow(run, "feature string, row_idx int, value double")


def projection(x: DataFrame, lam: float) -> DataFrame:
    """(feature, row_idx, value) of T."""
    x = keep(x.select("row_idx", "feature", "value"))  # read several times
    n = (x.agg(F.max("row_idx")).first()[0] or 0) + 1
    features, t, _ = projection_tiles(x, lam, n)
    return t_cells(features, t)


def row_sums(t: DataFrame) -> DataFrame:
    """(feature, value): sums of T over rows."""
    return t.groupBy("feature").agg(F.sum("value").alias("value"))


def product(t: DataFrame, y: DataFrame) -> DataFrame:
    """(feature, sample, value) of T Y; cells that share no row are left out."""
    left = t.select("row_idx", "feature", F.col("value").alias("t"))
    right = y.select("row_idx", "sample", F.col("value").alias("y"))
    return left.join(right, "row_idx").groupBy("feature", "sample").agg(F.sum(F.col("t") * F.col("y")).alias("value"))


def fill_cells(cells: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """Every (feature, sample), 0 where `cells` has none."""
    grid = features.select("feature").distinct().crossJoin(samples.select("sample").distinct())
    return grid.join(cells, ["feature", "sample"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
