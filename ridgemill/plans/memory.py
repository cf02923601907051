"""Memory estimates and the choice of batches, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgemill.model import RidgeError, Status

#: Shares of free memory for the guard, for keeping one batch, and for a chosen batch.
GUARD_SHARE, AUTO_SHARE, CHOSEN_SHARE = 0.9, 0.8, 0.6
MOST_SAMPLES = 100
#: Fixed value: bytes that any run takes.
OVERHEAD = 64 * 1024 * 1024


def required_bytes(n: Column, p: Column, m: Column, n_rand: Column, nnz: Column, sparse: Column, batch: Column) -> Column:
    """Bytes of a run over n rows, p features, m samples; 0 for invalid dimensions."""
    n, p, m, r, z = (c.cast("long") for c in (n, p, m, n_rand, nnz))
    b = F.when((batch <= 0) | (batch > m), m).otherwise(batch.cast("long"))
    z = F.when(z > 0, z).otherwise(F.lit(1).cast("long"))
    half = lambda c: F.floor(c / 2)
    common = 8 * n * p + 8 * p * p + 16 * p * n + 4 + 4 * n + 8 * F.greatest(p * p, p * n) + half(8 * F.greatest(n * p, p * b))
    random = r > 0
    dense = 8 * n * b + 8 * p * b + F.when(random, 8 * p * n + 40 * p * b).otherwise(0)
    thin = 12 * z + 4 * (m + 1) + 8 * n * p + 16 * p * b + F.when(random, 8 * n * p + 48 * p * b + half(8 * z) + F.floor(8 * p * b / 4)).otherwise(0)
    total = common + F.when(sparse, thin).otherwise(dense) + F.when(random, 24 * p * m).otherwise(0) + OVERHEAD
    valid = (n > 0) & (p > 0) & (m > 0) & (r >= 0)
    return F.when(valid, total).otherwise(0).cast("long")


def estimate(shapes: DataFrame) -> DataFrame:
    """`shapes` (n, p, m, n_rand, nnz, sparse, batch) with required_bytes."""
    return shapes.withColumn("required_bytes", required_bytes(*(F.col(c) for c in ("n", "p", "m", "n_rand", "nnz", "sparse", "batch"))))


def auto_batch(estimates: DataFrame) -> DataFrame:
    """`estimates` (m, required_bytes, free_bytes) with batch_size: 0, all samples
    at once, where they take up to 80 % of free memory."""
    chosen = F.floor(F.col("m") * CHOSEN_SHARE * F.col("free_bytes") / F.greatest("required_bytes", F.lit(1)))
    fits = F.col("required_bytes") <= AUTO_SHARE * F.col("free_bytes")
    return estimates.withColumn("batch_size", F.when(fits, 0).otherwise(F.least(F.greatest(F.lit(1), chosen), F.lit(MOST_SAMPLES), F.col("m"))).cast("long"))


def guard(estimates: DataFrame) -> DataFrame:
    """`estimates` with status: 0, or that of too little memory."""
    over = F.col("required_bytes") > GUARD_SHARE * F.col("free_bytes")
    return estimates.withColumn("status", F.when(over, int(Status.MEMORY)).otherwise(int(Status.OK)))


def clamp_batch(batch: Column, m: Column) -> Column:
    """A batch size above m, or below 0, means all samples at once (0)."""
    return F.when((batch > m) | (batch < 0), 0).otherwise(batch)


def candidates(shapes: DataFrame, shares: tuple[int, ...] = (1, 2, 4, 8, 16), sizes: tuple[int, ...] = (10, 5, 1), budget: float = CHOSEN_SHARE) -> DataFrame:
    """`shapes` with free_bytes -> the largest candidate batch that fits the budget,
    1 where none does. Candidates: m over `shares`, and `sizes` up to m."""
    tries = F.array_distinct(F.array(*[F.greatest(F.lit(1), F.floor(F.col("m") / s)).cast("long") for s in shares], *[F.least(F.lit(s).cast("long"), F.col("m").cast("long")) for s in sizes]))
    keys = shapes.columns
    each = shapes.withColumn("try", F.explode(tries))
    need = required_bytes(*(F.col(c) for c in ("n", "p", "m", "n_rand", "nnz", "sparse")), F.col("try"))
    return each.withColumn("ok", need <= budget * F.col("free_bytes")).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("try"))), F.lit(1).cast("long")).alias("batch_size"))


#: Shares of all samples, sizes and share of free memory of the search for large runs.
LARGE_SHARES, LARGE_SIZES, LARGE_BUDGET = (1, 2, 4, 8), (50, 25, 10, 5), 0.7


def large_candidates(shapes: DataFrame) -> DataFrame:
    """`shapes` with free_bytes -> the first candidate batch, in the order of
    LARGE_SHARES (rounded, halves to even) and LARGE_SIZES, that needs less than
    the budget; 1 where none does."""
    m = F.col("m").cast("long")
    tries = F.array(*[F.bround(F.col("m") / s).cast("long") for s in LARGE_SHARES], *[F.lit(s).cast("long") for s in LARGE_SIZES])
    need = lambda b: required_bytes(*(F.col(c) for c in ("n", "p", "m", "n_rand", "nnz", "sparse")), b)
    fits = F.filter(tries, lambda b: (b > 0) & (b <= m) & (need(b) < LARGE_BUDGET * F.col("free_bytes")))
    return shapes.withColumn("batch_size", F.coalesce(F.get(fits, F.lit(0)), F.lit(1).cast("long")))


def batch_plan(shapes: DataFrame) -> DataFrame:
    """`shapes` (m, batch) -> (m, batch, batch_id, first, last, width), 0-based and inclusive."""
    b = F.when((F.col("batch") <= 0) | (F.col("batch") > F.col("m")), F.col("m")).otherwise(F.col("batch")).cast("long")
    each = shapes.withColumn("b", b).withColumn("batch_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / F.col("b")).cast("long") - 1)))
    last = F.least((F.col("batch_id") + 1) * F.col("b"), F.col("m").cast("long")) - 1
    return each.select("m", "batch", "batch_id", (F.col("batch_id") * F.col("b")).alias("first"), last.alias("last"), (last - F.col("batch_id") * F.col("b") + 1).alias("width"))


def require_memory(table_bytes: int, budget: int) -> None:
    """Raise unless a table that goes to every executor fits its budget."""
    if table_bytes > budget:
        raise RidgeError(Status.MEMORY)
