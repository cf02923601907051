"""Column scaling. Each kind has its own rule for spread, gaps and constants.

Long tables (row_idx, sample, value). Statistics are one aggregation per column
(partial sums before the shuffle), joined back to the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgemill.model import SD_FLOOR
from ridgemill.operators.align import is_finite, zero_non_finite
from ridgemill.tables import keep


def _population(y: DataFrame, column: str) -> DataFrame:
    v = F.col("value")
    sums = y.groupBy(column).agg(F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.count(v).alias("nnz"))
    center = F.col("s1") / F.col("nnz")
    var = F.col("s2") / F.col("nnz") - center * center
    sd = F.sqrt(F.when(F.isnan(var), var).otherwise(F.greatest(var, F.lit(0.0))))
    return sums.select(column, center.alias("center"), sd.alias("scale"), "nnz")


def population_stats(y: DataFrame, column: str = "sample") -> DataFrame:
    """(column, center, scale, nnz): mean and population spread from one-pass sums."""
    return _population(y, column)


def _apply(y: DataFrame, stats: DataFrame, column: str) -> DataFrame:
    wide = ~F.isnan("scale") & (F.col("scale") > SD_FLOOR)
    return y.join(stats, column).withColumn("value", F.when(wide, (F.col("value") - F.col("center")) / F.when(wide, F.col("scale")))).withColumn("value", F.coalesce("value", F.lit(0.0))).select(*y.columns)


def zscore_population(y: DataFrame, column: str = "sample") -> DataFrame:
    """Mean 0 and population spread 1; columns of no spread, or with a NaN, become 0."""
    return _apply(y, _population(y, column), column)


def zscore_stored(y: DataFrame, column: str = "sample") -> DataFrame:
    """The same over the stored values of a sparse table alone; implicit zeros
    stay implicit, a single stored value becomes 0."""
    stats = _population(y, column).withColumn("scale", F.when(F.col("nnz") > 1, F.col("scale")).otherwise(0.0))
    return _apply(y, stats, column)


def zscore_sample(y: DataFrame, column: str = "sample") -> DataFrame:
    """Mean 0 and sample spread 1, from centred squares; no spread counts as 1, a
    column of one row stays as it is, a NaN makes its column NaN."""
    stats = y.groupBy(column).agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"), F.count("*").alias("n"))
    spread = F.when(F.isnan("scale"), F.col("scale")).when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    scaled = F.when(F.col("n") < 2, F.col("value")).otherwise((F.col("value") - F.col("center")) / spread)
    return y.join(stats, column).withColumn("value", scaled).select(*y.columns)


def zscore_pipeline(y: DataFrame, column: str = "sample") -> DataFrame:
    """Sample scaling that skips missing values; what is not finite becomes 0."""
    known = F.nanvl("value", F.lit(None).cast("double"))
    stats = y.groupBy(column).agg(F.avg(known).alias("center"), F.stddev_samp(known).alias("scale"))
    spread = F.when(F.col("scale") > 0, F.col("scale"))
    scaled = y.join(stats, column).withColumn("value", (known - F.col("center")) / spread).select(*y.columns)
    return zero_non_finite(scaled)


def centred_parts(y: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """A table that leaves zeros out as (cells, stats): ``(value - center) / scale``
    of all `n_rows` rows is what `zscore_pipeline` makes of the dense table.

    Null and NaN cells do not count and become the mean; of a column without
    spread nothing is left but zeros, with center 0.
    """
    known = F.nanvl("value", F.lit(None).cast("double"))
    sums = y.groupBy("sample").agg(F.count("*").alias("stored"), F.count(known).alias("k"), F.avg(known).alias("m"), F.var_pop(known).alias("v"))
    zeros = F.greatest(F.lit(n_rows) - F.col("stored"), F.lit(0))
    n = F.col("k") + zeros
    center = F.try_divide(F.coalesce(F.col("k") * F.col("m"), F.lit(0.0)), n)
    spread = F.sqrt(F.try_divide(F.col("k") * F.col("v") + F.try_divide(F.col("m") * F.col("m") * F.col("k") * zeros, n), n - 1))
    stats = sums.select("sample", center.alias("center"), spread.alias("scale"))
    wide = is_finite("center") & is_finite("scale") & (F.col("scale") > 0)
    stats = keep(stats.select("sample", F.when(wide, F.col("center")).otherwise(0.0).alias("center"), F.when(wide, F.col("scale")).alias("scale")))
    cells = y.join(stats, "sample").withColumn("value", F.when(F.col("scale").isNull(), 0.0).otherwise(F.coalesce(known, "center"))).select(*y.columns)
    return cells, stats


def scaled_row_means(cells: DataFrame, stats: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_idx, value): row means over all samples of the scaled table whose parts
    are `cells` and `stats`, for every row of `rows`."""
    wide = stats.where("scale is not null")
    shift = stats.agg(F.coalesce(F.sum(F.col("center") / F.col("scale")), F.lit(0.0)).alias("shift"), F.count("*").alias("m"))  # one row
    sums = cells.join(wide, "sample").groupBy("row_idx").agg(F.sum(F.col("value") / F.col("scale")).alias("s"))
    return rows.select("row_idx").join(sums, "row_idx", "left").join(F.broadcast(shift)).select("row_idx", ((F.coalesce("s", F.lit(0.0)) - F.col("shift")) / F.col("m")).alias("value"))


def column_correction(beta: Column, row_sum: Column, mu: Column | None, sigma: Column | None) -> Column:
    """Coefficients as if the response columns had been centred by mu and divided
    by sigma (not positive: by 1), without densifying them."""
    out = beta if mu is None else beta - row_sum * mu
    return out if sigma is None else out / F.when(sigma > 0, sigma).otherwise(1.0)
