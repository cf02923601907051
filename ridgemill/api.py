"""Entry points: ridge, ridge_lowlevel and infer.

Inputs are long tables with row_idx (see `ridgemill.model`), or with row_key
where `infer` aligns them first.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ridgemill.functions.permutations import check_table, permutation_frame
from ridgemill.model import RidgeError, RidgeRun, Status
from ridgemill.operators import align, scale
from ridgemill.plans.engines import BLOCK, blocked, fits, relational, tiled, vectors
from ridgemill.tables import keep

#: Products (permutations x rows x features x samples) from which blocks are used.
BLOCKED_FROM = 50_000_000


def _check(x: DataFrame, y: DataFrame, lam: float, n_rand: int) -> None:
    for name, df, columns in (("x", x, {"row_idx", "feature", "value"}), ("y", y, {"row_idx", "sample", "value"})):
        if missing := columns - set(df.columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
    if lam < 0:
        raise RidgeError(Status.NEGATIVE_LAMBDA)
    if n_rand <= 0:
        raise RidgeError(Status.NO_PERMUTATIONS)


def ridge(
    x: DataFrame, y: DataFrame, lam: float = 5e5, n_rand: int = 1000, seed: int = 0, rng_method: str = "mt19937", engine: str | None = None,
    samples: DataFrame | None = None, n_rows: int | None = None, stats: DataFrame | None = None, perms: DataFrame | None = None, block_size: int = BLOCK, watch: Observation | None = None,
) -> DataFrame:
    """(feature, sample, beta, se, zscore, pvalue): ridge coefficients of every
    response column and their two-sided row-permutation test.

    x (row_idx, feature, value) and y (row_idx, sample, value) share their rows;
    y may leave zeros out. `samples` lists all samples where y may miss some;
    `n_rows` is the number of rows where neither table shows the last one.
    `stats` (sample, center, scale) gives the test of centred, scaled columns.
    `engine` is ``relational``, ``blocked`` (``tiled`` where its broadcast would
    be too large) or ``tiled``; None chooses by size, and all give the same
    numbers: ties of coefficients are decided exactly. `perms` (perm_id, row_idx, src_idx) is a permutation table of the
    caller, which is checked, in place of the generated one; `block_size` is the
    number of samples that a task of the last two multiplies at a time; `watch`
    counts negative variances (negative_variances) as the result is made. No
    intercept is fitted. Null and missing values count as 0, cells that repeat
    add up, and NaN in a column gives z = 0 and the smallest p for it. No
    samples give no rows.
    """
    _check(x, y, lam, n_rand)
    if block_size < 1:
        raise ValueError("block_size must be at least 1")
    spark = x.sparkSession
    x = keep(x.select("row_idx", "feature", "value"))  # read several times
    if n_rows is None:
        n_rows = (x.select("row_idx").union(y.select("row_idx")).agg(F.max("row_idx")).first()[0] or 0) + 1
    if perms is not None:
        perms = keep(perms.select("perm_id", "row_idx", "src_idx"))
        check_table(perms, n_rows, n_rand)
    if engine is None:
        p, m = x.agg(F.count_distinct("feature")).first()[0], (samples or y).agg(F.approx_count_distinct("sample")).first()[0]
        engine = "blocked" if n_rand * n_rows * p * m > BLOCKED_FROM else "relational"
    if engine not in ("relational", "blocked", "tiled"):
        raise ValueError("engine must be relational, blocked or tiled")
    rows = vectors(y)
    if samples is not None:
        rows = samples.select("sample").distinct().join(rows, "sample", "left").select("sample", F.coalesce("idx", F.array().cast("array<int>")).alias("idx"), F.coalesce("val", F.array().cast("array<double>")).alias("val"))
    if engine == "relational":
        perms = keep(permutation_frame(spark, n_rows, n_rand, seed, rng_method)) if perms is None else perms
        return relational(x, rows, lam, n_rand, n_rows, perms, stats, watch)
    run = blocked if engine == "blocked" and fits(n_rows, x.agg(F.count_distinct("feature")).first()[0], n_rand) else tiled
    return run(x, rows, lam, n_rand, n_rows, seed, rng_method, stats, perms, block_size, watch)


def ridge_lowlevel(x: DataFrame, y: DataFrame, lam: float = 1.0, n_rand: int = 1000, sparse: bool = False, batch_size: int = 0, **options) -> RidgeRun:
    """`ridge` that reports a status instead of raising it: the run's result is
    None unless its status is OK, and a warning tells why. A sparse y without
    any value has bad dimensions, a dense one is legal.

    `batch_size` is the number of samples that a task multiplies at a time; 0,
    or with a warning more than there are samples, leaves it to the engine,
    which takes as many as a task's memory allows. Once the result has been made,
    `RidgeRun.check` warns of negative variances."""
    top = x.agg(F.max("row_idx")).first()[0] if x is not None else None
    p = x.agg(F.count_distinct("feature")).first()[0] if x is not None else 0
    run = RidgeRun(None, Status.OK, 0 if top is None else top + 1, p, lam, n_rand, sparse)
    try:
        if x is None or y is None:
            raise RidgeError(Status.NULL_INPUT)
        if sparse and y.isEmpty():
            raise RidgeError(Status.BAD_DIMENSIONS)
        if batch_size > 0:
            samples = options.get("samples")
            m = (y if samples is None else samples).agg(F.count_distinct("sample")).first()[0]
            if batch_size > m:
                run.warnings.append(f"batch_size {batch_size} is larger than the number of samples, {m}")
                warnings.warn(run.warnings[-1], stacklevel=2)
            else:
                options["block_size"] = batch_size
        run.watch = options.setdefault("watch", Observation())
        run.result = ridge(x, y, lam, n_rand, **options)
    except RidgeError as error:
        run.status = error.status
        run.warnings.append(run.message)
        warnings.warn(run.message, stacklevel=2)
    return run


def infer(
    expression: DataFrame, signature: DataFrame, lam: float = 1e4, n_rand: int = 1000, add_background: bool = False, scale_method: str | None = None,
    background_position: str = "after_scale", n_samples: int | None = None, order: str | None = None, **options,
) -> DataFrame:
    """The whole chain over keyed tables: expression (row_key, sample, value) and
    signature (row_key, feature, value) are cut to their common keys, numbered
    (by expression's `order` column, else by key), optionally scaled per column
    (``scale_method="column"``) and given a background feature, and tested.

    Cells that a table leaves out are zeros, for scaling too: its means and
    spreads are over all common keys, and its scaled zeros are not stored but
    corrected for after the product. Null and NaN cells of a scaled table do not
    count and have the mean. With a sparse expression table give `n_samples` for
    the mean of an unscaled background. Raises ValueError without a common key.
    """
    if scale_method not in (None, "column"):
        raise ValueError("scale_method must be None or 'column'")
    if background_position not in ("after_scale", "before_scale"):
        raise ValueError("background_position must be after_scale or before_scale")
    keys = align.require_common(keep(align.common_keys(expression, signature, order=order)))
    n = keys.count()
    options.setdefault("n_rows", n)
    y = align.subset_rows(expression, keys).select("row_idx", "sample", "value")
    x = align.subset_rows(signature, keys).select("row_idx", "feature", "value")
    if add_background and background_position == "before_scale":
        x = align.with_background(x, y, n_samples)
    if scale_method == "column":
        x = keep(x.withColumn("value", F.coalesce("value", F.lit(float("nan")))))  # a null is no zero
        x = scale.zscore_pipeline(align.densify(x, keys, x, "feature"), "feature")
        y, options["stats"] = scale.centred_parts(y, n)
        y = keep(y)
        if add_background and background_position == "after_scale":
            x = align.with_background(x, scale.scaled_row_means(y, options["stats"], keys), 1)
    elif add_background and background_position == "after_scale":
        x = align.with_background(x, y, n_samples)
    return ridge(x, y, lam, n_rand, **options)
