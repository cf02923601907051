"""Alignment of matrices by row keys, and small transforms of long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgemill.tables import keep


def is_finite(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def common_keys(y: DataFrame, x: DataFrame, key: str = "row_key", order: str | None = None) -> DataFrame:
    """(row_key, row_idx): keys of both tables in the order of y's `order` column
    (its first place per key), else sorted. Null keys match nothing.

    Keys are dealt out in ranges and numbered within each; a range begins where
    those before it end, so no task sees all keys."""
    rank = F.min(order).alias("__order") if order else F.first(key).alias("__order")
    keys = y.where(F.col(key).isNotNull()).groupBy(key).agg(rank).join(x.select(key).distinct(), key, "left_semi")
    keys = keep(keys)  # dealing out in ranges reads them twice
    parts = keep(keys.repartitionByRange("__order", key).select(key, "__order", F.spark_partition_id().alias("__part")))
    before = parts.groupBy("__part").count()  # one row per range
    before = before.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__order", key))
    return parts.join(F.broadcast(before), "__part").select(F.col(key), (F.col("__before") + place - 1).cast("int").alias("row_idx"))


def require_common(keys: DataFrame) -> DataFrame:
    if keys.isEmpty():
        raise ValueError("the tables have no row key in common")
    return keys


def subset_rows(matrix: DataFrame, keys: DataFrame, key: str = "row_key") -> DataFrame:
    """`matrix` cut to `keys`, with their row_idx."""
    return matrix.join(keys, key)


def align_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that both results have: (feature, sample, a, b) of column `value`."""
    return a.select("feature", "sample", F.col("value").alias("a")).join(b.select("feature", "sample", F.col("value").alias("b")), ["feature", "sample"])


def drop_background(result: DataFrame, name: str = "background") -> DataFrame:
    return result.where(F.col("feature") != name)


def running_sum(df: DataFrame, key: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """`df` with `name`: the sum of `amount` over the rows of the same key up to each
    row, in order. Rows are dealt out in ranges of key and order and summed within
    each; a range begins where those before it end, so that no task sees all rows of
    a frequent key. Rows that are equal in key and order have one order among them."""
    dealt = keep(df.withColumn("__amount", amount).repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part", F.col(key).alias("__key")).agg(F.sum("__amount").alias("__total"))  # of a key as many rows as it has ranges
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0))).withColumnRenamed("__part", "__range").drop("__total")
    own = F.sum("__amount").over(Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("__own", own)
    joined = placed.join(offsets, (F.col("__part") == F.col("__range")) & F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumn(name, F.col("__own") + F.col("__before")).select(*df.columns, name)


def make_unique(names: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """`names` with a column unique_name: the first of equal names stays, later
    ones get ``.1``, ``.2`` ... in order; a suffixed name that some row has as its
    own name is not used, the count goes on. Null names stay null."""
    one = F.lit(1).cast("long")
    numbered = running_sum(names, name, [order], one, "__n").withColumn("__n", F.col("__n") - 1)
    # the j-th taken suffix s of a name moves on all repeats from the (s - j + 1)-th one
    taken = names.select(F.col(name).alias("__taken")).distinct()
    used = taken.select(F.regexp_extract("__taken", r"(?s)^(.*)\.([0-9]+)$", 1).alias(name), F.expr("try_cast(regexp_extract(__taken, '(?s)^(.*)[.]([1-9][0-9]*)$', 2) as bigint)").alias("__s"))
    used = running_sum(used.where(F.col("__s").isNotNull()), name, ["__s"], one, "__j")
    moves = used.select(name, (F.col("__s") - F.col("__j") + 1).alias("__n"), F.lit(0).alias("__kind"))
    both = numbered.withColumn("__kind", F.lit(1)).unionByName(moves, allowMissingColumns=True)
    shifted = running_sum(both, name, ["__n", "__kind"], (1 - F.col("__kind")).cast("long"), "__shift").where("__kind = 1")
    suffix = (F.col("__n") + F.col("__shift")).cast("string")
    return shifted.withColumn("unique_name", F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("."), suffix))).select(*names.columns, "unique_name")


def finite_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(is_finite("a") & is_finite("b"))


def zero_non_finite(matrix: DataFrame, value: str = "value") -> DataFrame:
    return matrix.withColumn(value, F.when(is_finite(value), F.col(value)).otherwise(0.0))


def background(y: DataFrame, samples: int | None = None, name: str = "background") -> DataFrame:
    """A feature of row means of y. Null and NaN values do not count; for a sparse
    table give the number of samples, as its missing values are zeros."""
    value = F.nanvl("value", F.lit(None).cast("double"))
    mean = F.sum(value) / F.lit(samples) if samples else F.avg(value)
    return y.groupBy("row_idx").agg(mean.alias("value")).select("row_idx", F.lit(name).alias("feature"), "value")


def with_background(x: DataFrame, y: DataFrame, samples: int | None = None, name: str = "background") -> DataFrame:
    """x with the background feature, in place of one of that name."""
    own = x.where(F.col("feature") != name).select("row_idx", "feature", "value")
    mean = background(y, samples, name)
    rows = own.select("row_idx").distinct().join(mean, "row_idx", "left")
    return own.unionByName(rows.select("row_idx", F.lit(name).alias("feature"), F.coalesce("value", F.lit(0.0)).alias("value")))


def slice_samples(y: DataFrame, first: int, last: int, order: str = "sample_ord") -> DataFrame:
    """Samples `first`..`last` by 0-based order; reaches the scan as a filter."""
    return y.where(F.col(order).between(first, last))


def sparsify(y: DataFrame) -> DataFrame:
    return y.where((F.col("value") != 0) | F.isnan("value"))


def densify(y: DataFrame, rows: DataFrame, samples: DataFrame, column: str = "sample") -> DataFrame:
    """Every (row_idx, `column`) of the two lists, 0 where y has no value."""
    grid = rows.select("row_idx").distinct().crossJoin(samples.select(column).distinct())
    return grid.join(y.select("row_idx", column, "value"), ["row_idx", column], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
