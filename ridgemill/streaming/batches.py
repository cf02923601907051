"""Column batches: tests over sources that are read a range of samples at a time.

Every batch uses one permutation table (same seed), so the result equals that of
one run over all samples, whatever the batch size.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgemill.api import ridge
from ridgemill.model import RESULT
from ridgemill.session import ship
from ridgemill.sources.batch_sink import BatchSink, clear, published
from ridgemill.tables import keep, qualified, shared_folder

#: A reader gives the long table (row_idx, sample, value) of samples first..last, 0-based.
Reader = Callable[[int, int], DataFrame]


def check_rows(part: DataFrame, n_rows: int, what: str, complete: bool = False) -> int:
    """The number of samples of `part`; an error where a row is not one of 0..n_rows - 1
    and, if it must be `complete`, where one of those is in no cell."""
    seen = part.agg(F.min("row_idx").alias("low"), F.max("row_idx").alias("high"), F.count_distinct("sample").alias("samples"), *([F.count_distinct("row_idx").alias("rows")] if complete else [])).first()
    if seen["low"] is not None and (seen["low"] < 0 or seen["high"] >= n_rows):
        raise ValueError(f"{what} has rows {seen['low']}..{seen['high']}, expected 0..{n_rows - 1}")
    if complete and seen["rows"] != n_rows:
        raise ValueError(f"{what} has cells in {seen['rows']} rows, expected {n_rows}")
    return seen["samples"]


def resolve(spark: SparkSession, source: DataFrame | str | Reader, n_samples: int | None = None, n_rows: int | None = None, complete: bool = False) -> tuple[DataFrame | Reader, int]:
    """A table or reader, and its number of samples. Tables, and Parquet paths,
    have columns (row_idx, sample, sample_ord, value) and, if `n_rows` is given,
    no other rows than those."""
    if isinstance(source, str):
        source = spark.read.parquet(source)
    if isinstance(source, DataFrame):
        if missing := {"row_idx", "sample", "sample_ord", "value"} - set(source.columns):
            raise ValueError(f"the source lacks {sorted(missing)}")
        if n_rows is not None:
            check_rows(source, n_rows, "the source", complete)
        return source, n_samples or (source.agg(F.max("sample_ord")).first()[0] or 0) + 1
    if n_samples is None:
        raise ValueError("a reader needs n_samples")
    return source, n_samples


def read_batch(source: Reader, first: int, last: int, n_rows: int | None = None, complete: bool = False) -> DataFrame:
    """One batch of a reader, checked: its columns, as many samples as asked for
    (one without values has a cell of 0) and, if `n_rows` is given, its rows."""
    part = source(first, last)
    if missing := {"row_idx", "sample", "value"} - set(part.columns):
        raise ValueError(f"the reader's table lacks {sorted(missing)}")
    samples = check_rows(part, n_rows or 1 << 31, "the reader's table", complete)
    if samples != last - first + 1:
        raise ValueError(f"the reader gave {samples} samples for {first}..{last}, expected {last - first + 1}")
    return part


def ridge_batch(
    x: DataFrame, source: DataFrame | str | Reader, lam: float = 5e5, n_rand: int = 1000, batch_size: int = 5000, n_samples: int | None = None, output: str | None = None,
    resume: bool = False, complete: bool = False, **options,
) -> DataFrame | dict:
    """`ridge` by batches of samples, with a column batch_id.

    A table or path is one job: the batch of a sample follows from sample_ord,
    and Spark's tasks are the batches. A reader is called batch by batch, and each
    batch is written before the next is asked for. With `output` the result goes to
    Parquet partitioned by batch_id and a description is returned: a batch is
    published as a whole or not at all (`BatchSink`). An output that is there is
    replaced or, with `resume`, completed: the batches that a run with the same
    parameters has published are neither read nor computed again. With `complete`
    every row must have a cell in the source, or in each batch of a reader.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    spark = x.sparkSession
    x = keep(x.select("row_idx", "feature", "value"))  # read by every batch
    n = options.setdefault("n_rows", (x.agg(F.max("row_idx")).first()[0] or 0) + 1)
    source, m = resolve(spark, source, n_samples, n, complete)
    batches, p = -(-m // batch_size), x.agg(F.count_distinct("feature")).first()[0]
    table = isinstance(source, DataFrame)
    if table:
        orders = source.groupBy("sample").agg(F.min("sample_ord").alias("sample_ord"))
        batch = F.floor(F.col("sample_ord") / batch_size).cast("int").alias("batch_id")
        named = orders.select("sample", batch)
        if output is None:
            return ridge(x, source.select("row_idx", "sample", "value"), lam, n_rand, **options).join(named, "sample")
    folder = qualified(spark, output or shared_folder(spark))
    told = json.dumps([n, p, m, batch_size, float(lam), n_rand, options.get("seed", 0), options.get("rng_method", "mt19937")])
    done = published(folder, told) if resume else clear(folder)
    spark.dataSource.register(BatchSink)
    publish = lambda df: ship(spark) and df.write.format(BatchSink.name()).mode("append").option("folder", folder).option("told", told).save()
    if table:
        left = keep(named.where(~F.col("batch_id").isin(sorted(done))) if done else named)
        if len(done) < batches:
            part = source.join(left.select("sample"), "sample", "left_semi").select("row_idx", "sample", "value")
            publish(ridge(x, part, lam, n_rand, **options).join(left, "sample"))
    else:
        for b in range(batches):
            if b not in done:
                first, last = b * batch_size, min(m, (b + 1) * batch_size) - 1
                publish(ridge(x, read_batch(source, first, last, n, complete), lam, n_rand, **options).withColumn("batch_id", F.lit(b)))
    if output:
        return {"path": output, "p": p, "m": m, "num_batches": batches}
    return spark.read.schema(f"{RESULT}, batch_id int").parquet(folder)


def ridge_stream(x: DataFrame, stream: DataFrame, output: str, checkpoint: str, lam: float = 5e5, n_rand: int = 1000, n_rows: int | None = None, **options):
    """A started streaming query: samples that arrive as rows (sample, idx, val)
    (see `engines.vectors`) are tested as they come, and appended to Parquet."""
    from ridgemill.plans.engines import blocked

    rows = n_rows or x.agg(F.max("row_idx")).first()[0] + 1
    result = blocked(x, stream, lam, n_rand, rows, options.get("seed", 0), options.get("rng_method", "mt19937"))
    return result.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
