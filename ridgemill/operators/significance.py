"""Permutation statistics, final scores, summaries and comparisons."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ridgemill.model import SE_FLOOR
from ridgemill.operators.align import is_finite
from ridgemill.tables import discard, keep


def permuted_product(t: DataFrame, y: DataFrame, perms: DataFrame) -> DataFrame:
    """(perm_id, feature, sample, value): T times y with its rows permuted."""
    left = t.select("row_idx", "feature", F.col("value").alias("t"))
    moved = perms.join(y.select(F.col("row_idx").alias("src_idx"), "sample", F.col("value").alias("y")), "src_idx")
    return moved.join(left, "row_idx").groupBy("perm_id", "feature", "sample").agg(F.sum(F.col("t") * F.col("y")).alias("value"))


def permutation_stats(observed: DataFrame, permuted: DataFrame) -> DataFrame:
    """(feature, sample, beta, s1, s2, hits): sums over permutations and how often
    a permuted coefficient is at least as far from 0. NaN is never as far."""
    b = F.col("value")
    hit = ~F.isnan(b) & ~F.isnan("beta") & (F.abs(b) >= F.abs("beta"))
    both = permuted.join(observed.select("feature", "sample", F.col("value").alias("beta")), ["feature", "sample"])
    return both.groupBy("feature", "sample", "beta").agg(F.sum(b).alias("s1"), F.sum(b * b).alias("s2"), F.count_if(hit).alias("hits"))


#: Fixed value: variances below it are no rounding errors of 0 and deserve a warning.
NEGATIVE = -1e-10


def finalise(stats: DataFrame, n_rand: int, watch: Observation | None = None) -> DataFrame:
    """(feature, sample, beta, se, zscore, pvalue) from sums over n_rand permutations.
    `watch` counts the negative variances, which become 0, as the result is made."""
    r = F.lit(float(n_rand))
    mean = F.col("s1") / r
    var = F.col("s2") / r - mean * mean
    if watch is not None:
        stats = stats.observe(watch, F.count_if(var < NEGATIVE).alias("negative_variances"))
    se = F.sqrt(F.when(F.isnan(var), var).otherwise(F.greatest(var, F.lit(0.0))))
    scored = stats.select("feature", "sample", "beta", mean.alias("mean"), se.alias("se"), "hits")
    wide = ~F.isnan("se") & (F.col("se") > SE_FLOOR)
    z = F.when(wide, (F.col("beta") - F.col("mean")) / F.when(wide, F.col("se"))).otherwise(0.0)
    p = F.least(F.lit(1.0), (F.col("hits") + 1) / F.lit(n_rand + 1.0))
    return scored.select("feature", "sample", "beta", "se", z.alias("zscore"), p.alias("pvalue"))


#: Parts of an interval of values, and values of one that are looked at one by one.
BINS, FEW = 1024, 4096


def order_statistics(values: DataFrame, wanted: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks of each measure in (measure, v), which is read
    several times and holds neither null nor NaN.

    The interval that holds a rank is cut into BINS parts; of those that hold a
    wanted rank the smallest and largest values are the next intervals. All
    intervals are refined in one pass, until they hold one value, or few values. The
    driver sees counts of parts and at most FEW values of an interval."""
    found, open_ = {}, {}
    ends = values.where(F.abs("v") < float("inf")).groupBy("measure").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    below = values.groupBy("measure").agg(F.count("*").alias("n"), F.count_if(F.col("v") == float("-inf")).alias("minus"), F.count_if(F.col("v") == float("inf")).alias("plus"))
    for r in below.join(ends, "measure", "left").collect():  # a row per measure
        inner = set()
        for rank in wanted.get(r["measure"], ()):
            if rank < r["minus"]:
                found[r["measure"], rank] = float("-inf")
            elif rank >= r["n"] - r["plus"]:
                found[r["measure"], rank] = float("inf")
            else:
                inner.add(rank)
        if inner:
            open_[r["measure"], r["low"], r["high"]] = (r["minus"], r["n"] - r["minus"] - r["plus"], inner)
    while open_:
        for key in [k for k in open_ if k[1] == k[2]]:
            for rank in open_.pop(key)[2]:
                found[key[0], rank] = key[1]
        listed = list(open_)
        if not listed:
            break
        inside = [(F.col("measure") == m) & F.col("v").between(low, high) for m, low, high in listed]
        pick = lambda choices: F.coalesce(*[F.when(is_in, F.lit(c)) for is_in, c in zip(inside, choices, strict=True)])
        parts = values.select(pick(range(len(listed))).alias("k"), "v", pick([low for _, low, _ in listed]).alias("low"), pick([high for *_, high in listed]).alias("high")).where("k is not null")
        few = [k for k, key in enumerate(listed) if open_[key][1] <= FEW]
        if few:
            own = {k: [] for k in few}
            for r in parts.where(F.col("k").isin(few)).select("k", "v").collect():
                own[r["k"]].append(r["v"])
            for k, seen in own.items():
                before, _, ranks = open_.pop(listed[k])
                seen.sort()
                found.update({(listed[k][0], rank): seen[rank - before] for rank in ranks})
        if len(few) < len(listed):
            bin_ = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)
            counts = parts.where(~F.col("k").isin(few)) if few else parts
            seen = {}
            for r in counts.groupBy("k", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("k", "bin").collect():
                seen.setdefault(r["k"], []).append(r)
            for k, bins in seen.items():
                before, _, ranks = open_.pop(listed[k])
                for r in bins:
                    own = {rank for rank in ranks if before <= rank < before + r["n"]}
                    if own:
                        open_[listed[k][0], r["low"], r["high"]] = (before, r["n"], own)
                    before += r["n"]
    return found


def six_numbers(result: DataFrame) -> DataFrame:
    """(measure, min, q1, median, mean, q3, max) of beta and pvalue, NaN and null left
    out; quantiles lie between the values at the ranks around (n - 1) q."""
    each = result.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.nanvl(F.col(c), F.lit(None).cast("double")).alias("v")) for c in ("beta", "pvalue")])).alias("m")).select("m.*").where("v is not null")
    each = keep(each)
    whole = {r["measure"]: r for r in each.groupBy("measure").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max")).collect()}
    shares = (0.25, 0.5, 0.75)
    ranks = {m: {rank for q in shares for rank in (math.floor((r["n"] - 1) * q), math.ceil((r["n"] - 1) * q))} for m, r in whole.items()}
    at = order_statistics(each, ranks)

    def quantile(m, q):
        place = (whole[m]["n"] - 1) * q
        low, high = at[m, math.floor(place)], at[m, math.ceil(place)]
        return low if low == high else low + (place - math.floor(place)) * (high - low)

    rows = [(m, r["min"], quantile(m, 0.25), quantile(m, 0.5), r["mean"], quantile(m, 0.75), r["max"]) for m, r in whole.items()]
    discard(each)
    return result.sparkSession.createDataFrame(rows, "measure string, min double, q1 double, median double, mean double, q3 double, max double")


def significant(result: DataFrame, levels: tuple[float, ...] = (0.1, 0.05, 0.01, 0.001)) -> DataFrame:
    """(level, hits): cells whose p-value is below each level."""
    counts = result.agg(*[F.count_if(F.col("pvalue") < level).alias(f"c{i}") for i, level in enumerate(levels)])
    rows = F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"c{i}").alias("hits")) for i, level in enumerate(levels)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def correlation(pairs: DataFrame, threshold: float) -> DataFrame:
    """(n, correlation, passed) of columns a and b over cells finite in both. Two
    constants that agree within 1e-9 correlate fully; one constant gives NaN;
    fewer than two cells give null and do not pass."""
    fine = pairs.where(is_finite("a") & is_finite("b"))
    s = fine.agg(F.count("*").alias("n"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"), F.max(F.abs(F.col("a") - F.col("b"))).alias("gap"), F.covar_samp("a", "b").alias("cov"))
    flat_a, flat_b = F.col("sa") < 1e-10, F.col("sb") < 1e-10
    value = F.when(F.col("n") < 2, F.lit(None).cast("double")).when(flat_a & flat_b & (F.col("gap") < 1e-9), 1.0).when(flat_a | flat_b, F.lit(float("nan"))).otherwise(F.try_divide("cov", F.col("sa") * F.col("sb")))
    return s.select("n", value.alias("correlation")).withColumn("passed", F.coalesce(~F.isnan("correlation") & (F.col("correlation") >= threshold), F.lit(False)))


def parity(pairs: DataFrame) -> DataFrame:
    """(gap, verdict): largest difference; PASS below 1e-9, NEAR below 1e-6, else FAIL."""
    gap = F.max(F.when(F.isnan("a") | F.isnan("b"), float("nan")).otherwise(F.abs(F.col("a") - F.col("b"))))
    return pairs.agg(gap.alias("gap")).select("gap", verdict(F.col("gap")).alias("verdict"))


def verdict(gap: Column) -> Column:
    known = gap.isNotNull() & ~F.isnan(gap)
    return F.when(known & (gap < 1e-9), "PASS").when(known & (gap < 1e-6), "NEAR").otherwise("FAIL")


def summary_text(result: DataFrame) -> str:
    """Six numbers of coefficients and p-values, and counts of significant cells, as text."""
    lines = ["measure      min       q1   median     mean       q3      max"]
    for r in six_numbers(result).orderBy("measure").collect():  # two rows
        lines.append(f"{r['measure']:<7}" + "".join(f" {r[c]:8.4g}" for c in ("min", "q1", "median", "mean", "q3", "max")))
    lines += [f"p < {r['level']:g}: {r['hits']}" for r in significant(result).collect()]
    return "\n".join(lines)


def _peak_mb(spark: SparkSession, reset: bool = False) -> float:
    """The most heap used since the last reset, of the driver's JVM and, as far as
    executors have reported it, of the largest executor."""
    pools = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    heap = [p for p in pools if p.getType().toString() == "Heap memory"]
    if reset:
        for pool in heap:
            pool.resetPeakUsage()
        return 0.0
    own = sum(p.getPeakUsage().getUsed() for p in heap)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    peaks = [executors.apply(k).peakMemoryMetrics() for k in range(executors.size())]
    return max([own, *(p.get().getMetricValue("JVMHeapMemory") for p in peaks if p.isDefined())]) / 2**20


def run_metadata(result: DataFrame, dataset: str, n_rand: int, lam: float, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Run `result`, once: the table, written to the shared folder, and one row that
    describes the run, with the seconds it took, the most memory that was used and
    the cells, features and samples it gave."""
    spark, watch = result.sparkSession, Observation()
    _peak_mb(spark, reset=True)
    began = time.monotonic()
    kept = keep(result.observe(watch, F.count(F.lit(1)).alias("cells")))
    seconds, peak = time.monotonic() - began, _peak_mb(spark)
    counts = kept.agg(F.count_distinct("sample").alias("n_samples"), F.count_distinct("feature").alias("n_features"))
    fixed = {"dataset": dataset, "execution_time_sec": seconds, "peak_memory_mb": peak, "n_rand": n_rand, "lambda": float(lam), "n_rows": n_rows, "n_cells": watch.get["cells"]}
    return kept, counts.select(*[F.lit(v).alias(k) for k, v in fixed.items()], "n_features", "n_samples")
