"""Named queries over the test tables, each with its DuckDB equivalent.

X is nation x customer segment (average balance), Y nation x order priority
(average price), both with n_nationkey as row_idx. Sparse tables are user x
(event type, day) and nation x (order priority, month). Tests scale columns first
and use lambda 10, 100 permutations, seed 0, and all of X's features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgemill import api, sql
from ridgemill.functions.permutations import permutation_frame
from ridgemill.operators import align, scale, significance, solve
from ridgemill.plans import memory
from ridgemill.sources.matrices import read_cells, read_long, union_metadata, write_measures, write_wide
from ridgemill.streaming.batches import ridge_batch
from ridgemill.tables import keep, shared_folder

CATALOGUE: dict = {}
LAMBDA, N_RAND, N = sql.LAMBDA, sql.N_RAND, sql.N


def query(oracle: str | None = None):
    def add(function):
        CATALOGUE[function.__name__] = (function, oracle)
        return function

    return add


def r6(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + F.lit(0.0)).alias(name or column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def x_raw(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("feature")).agg(F.avg("c_acctbal").alias("value"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("row_idx"))
    grid = rows.crossJoin(F.broadcast(c.select("feature").distinct()))  # 25 rows by 5 segments
    return grid.join(c, (grid["row_idx"] == c["n"]) & (grid["feature"] == c["feature"]), "left").select("row_idx", grid["feature"], F.coalesce("value", F.lit(0.0)).alias("value"))


def y_raw(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.groupBy(F.col("c_nationkey").cast("int").alias("row_idx"), F.col("o_orderpriority").alias("sample")).agg(F.avg("o_totalprice").alias("value"))


def y_sparse(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("int").alias("row_idx"), F.concat_ws("-", "event_type", F.dayofmonth("ts")).alias("sample")).agg(F.sum("value").alias("value"))


def y_priced(spark, sf_dir, *parts: Column) -> DataFrame:
    """nation x (order priority, `parts`): the sum of prices, in units of 100,000."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sample = F.concat_ws("-", "o_orderpriority", *parts).alias("sample")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").cast("int").alias("row_idx"), sample).agg((F.sum("o_totalprice") / 100000).alias("value"))


def y_months(spark, sf_dir) -> DataFrame:
    return y_priced(spark, sf_dir, F.year("o_orderdate"), F.month("o_orderdate"))


def x_scaled(spark, sf_dir) -> DataFrame:
    return scale.zscore_sample(x_raw(spark, sf_dir), "feature")


def y_scaled(spark, sf_dir) -> DataFrame:
    return scale.zscore_sample(y_raw(spark, sf_dir))


def shown(result: DataFrame, *keys: str) -> DataFrame:
    return result.select(*keys, "feature", "sample", r6("beta"), r6("se"), r6("zscore"), F.round("pvalue", 9).alias("pvalue"))


def tested(spark, sf_dir, engine: str = "relational") -> DataFrame:
    return api.ridge(x_scaled(spark, sf_dir), y_scaled(spark, sf_dir), LAMBDA, N_RAND, engine=engine, n_rows=N)


# --- alignment ---------------------------------------------------------------

_KEYS = """
yk AS (SELECT DISTINCT n_name AS row_key FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <= 3),
xk AS (SELECT DISTINCT n_name AS row_key FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey >= 1),
keys AS (SELECT row_key, (row_number() OVER (ORDER BY row_key) - 1)::INT AS row_idx FROM yk SEMI JOIN xk USING (row_key))
"""


def _keyed(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    y = c.join(n.where("n_regionkey <= 3"), c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("row_key"), F.col("c_mktsegment").alias("sample"), F.col("c_acctbal").alias("value"))
    x = s.join(n.where("n_regionkey >= 1"), s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("row_key"), F.col("s_acctbal").alias("value"))
    return y.groupBy("row_key", "sample").agg(F.avg("value").alias("value")), x.groupBy("row_key").agg(F.avg("value").alias("value"))


@query(f"WITH {_KEYS} SELECT row_key, row_idx FROM keys")
def key_intersect(spark, sf_dir):
    y, x = _keyed(spark, sf_dir)
    return align.common_keys(y, x)


@query(f"WITH {_KEYS} SELECT row_key, row_idx, c_mktsegment AS sample, round(avg(c_acctbal), 6) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN keys ON row_key = n_name GROUP BY ALL")
def row_subset(spark, sf_dir):
    y, x = _keyed(spark, sf_dir)
    return align.subset_rows(y, align.common_keys(y, x)).select("row_key", "row_idx", "sample", r6("value"))


_A = "SELECT s_nationkey::VARCHAR AS feature, (s_suppkey % 7)::VARCHAR AS sample, sum(s_acctbal) AS v FROM supplier WHERE s_nationkey < 15 GROUP BY ALL"
_B = "SELECT c_nationkey::VARCHAR AS feature, (c_custkey % 9)::VARCHAR AS sample, sum(c_acctbal) AS v FROM customer WHERE c_nationkey > 4 GROUP BY ALL"


def _two_results(spark, sf_dir, partial: bool = True):
    """Sums by nation and number; if `partial`, of nations that only partly overlap."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    if partial:
        s, c = s.where("s_nationkey < 15"), c.where("c_nationkey > 4")
    a = s.groupBy(F.col("s_nationkey").cast("string").alias("feature"), (F.col("s_suppkey") % 7).cast("string").alias("sample")).agg(F.sum("s_acctbal").alias("value"))
    b = c.groupBy(F.col("c_nationkey").cast("string").alias("feature"), (F.col("c_custkey") % 9).cast("string").alias("sample")).agg(F.sum("c_acctbal").alias("value"))
    return a, b


@query(f"SELECT feature, sample, round(a.v, 4) AS a, round(b.v, 4) AS b FROM ({_A}) a JOIN ({_B}) b USING (feature, sample)")
def align_two_axis(spark, sf_dir):
    return align.align_results(*_two_results(spark, sf_dir)).select("feature", "sample", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(sql.over("SELECT row_idx, feature, round(value, 6) AS value FROM x0"))
def drop_background(spark, sf_dir):
    x = align.with_background(x_raw(spark, sf_dir), y_raw(spark, sf_dir))
    return align.drop_background(x).select("row_idx", "feature", r6("value"))


@query("""
WITH named AS (SELECT p_partkey AS ord, p_brand || CASE WHEN p_partkey % 11 = 0 THEN '.1' ELSE '' END AS name FROM part),
seen AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) - 1 AS n FROM named),
used AS (SELECT name, count(*) AS n FROM named GROUP BY name),
tries AS (SELECT name, unnest(range(1, n + (SELECT count(*) FROM used))) AS k FROM used),
free AS (SELECT t.name, t.k, row_number() OVER (PARTITION BY t.name ORDER BY t.k) AS n FROM tries t ANTI JOIN used u ON u.name = t.name || '.' || t.k)
SELECT s.ord, s.name, CASE WHEN s.n = 0 THEN s.name ELSE s.name || '.' || f.k END AS unique_name
FROM seen s LEFT JOIN free f ON f.name = s.name AND f.n = s.n""")
def make_unique(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat("p_brand", F.when(F.col("p_partkey") % 11 == 0, ".1").otherwise("")).alias("name"))
    return align.make_unique(names).select("ord", "name", "unique_name")


_ODD = "CASE event_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE value END"


def _odd(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    return e.select("event_id", F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(F.col("value")).alias("value"), (-F.col("value")).alias("b"))


@query(f"SELECT event_id, a, b FROM (SELECT event_id, {_ODD} AS a, -value AS b FROM events) WHERE isfinite(a) AND isfinite(b)")
def finite_mask(spark, sf_dir):
    return align.finite_pairs(_odd(spark, sf_dir).withColumnRenamed("value", "a"))


@query(f"SELECT event_id, CASE WHEN isfinite(v) THEN v ELSE 0 END AS value FROM (SELECT event_id, {_ODD} AS v FROM events)")
def nonfinite_to_zero(spark, sf_dir):
    return align.zero_non_finite(_odd(spark, sf_dir)).select("event_id", "value")


@query(sql.over("SELECT row_idx, 'background' AS feature, round(avg(value), 6) AS value FROM y0 GROUP BY row_idx"))
def background_feature(spark, sf_dir):
    return align.background(y_raw(spark, sf_dir)).select("row_idx", "feature", r6("value"))


@query(sql.over("SELECT row_idx, sample, sample_ord, round(value, 6) AS value FROM (SELECT *, (dense_rank() OVER (ORDER BY sample) - 1)::INT AS sample_ord FROM y0) WHERE sample_ord BETWEEN 1 AND 3"))
def column_slice(spark, sf_dir):
    return align.slice_samples(_ordered(y_raw(spark, sf_dir)), 1, 3).select("row_idx", "sample", "sample_ord", r6("value"))


def _ordered(y: DataFrame) -> DataFrame:
    names = y.groupBy().agg(F.array_sort(F.collect_set("sample")).alias("names"))  # order priorities: five
    return y.crossJoin(names).withColumn("sample_ord", (F.array_position("names", F.col("sample")) - 1).cast("int")).drop("names")


@query("SELECT * FROM (SELECT user_id AS row_idx, event_type AS sample, round(sum(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END), 6) AS value FROM events GROUP BY ALL) WHERE value <> 0")
def sparsify(spark, sf_dir):
    y = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("row_idx"), F.col("event_type").alias("sample")).agg(F.sum(F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0)).alias("value"))
    return align.sparsify(y).select("row_idx", "sample", r6("value"))


@query(sql.over("SELECT r.row_idx, s.sample, round(coalesce(y.value, 0), 6) AS value FROM (SELECT DISTINCT row_idx FROM sparse0) r CROSS JOIN (SELECT DISTINCT sample FROM sparse0) s LEFT JOIN sparse0 y USING (row_idx, sample)"))
def densify(spark, sf_dir):
    y = y_sparse(spark, sf_dir)
    return align.densify(y, y, y).select("row_idx", "sample", r6("value"))


# --- scaling -----------------------------------------------------------------


@query(sql.over("SELECT row_idx, sample, round(CASE WHEN sd > 1e-10 THEN (value - m) / sd ELSE 0 END, 6) + 0.0 AS value FROM (SELECT *, sqrt(greatest(s2 / n - m * m, 0)) AS sd FROM (SELECT *, avg(value) OVER w AS m, sum(value * value) OVER w AS s2, count(value) OVER w AS n FROM y0 WINDOW w AS (PARTITION BY sample)))"))
def zscore_pop(spark, sf_dir):
    return scale.zscore_population(y_raw(spark, sf_dir)).select("row_idx", "sample", r6("value"))


@query(sql.over("SELECT row_idx, sample, round(CASE WHEN n > 1 AND sd > 1e-10 THEN (value - m) / sd ELSE 0 END, 6) + 0.0 AS value FROM (SELECT *, sqrt(greatest(s2 / n - m * m, 0)) AS sd FROM (SELECT *, avg(value) OVER w AS m, sum(value * value) OVER w AS s2, count(value) OVER w AS n FROM sparse0 WINDOW w AS (PARTITION BY sample)))"))
def zscore_sparse_nz(spark, sf_dir):
    return scale.zscore_stored(y_sparse(spark, sf_dir)).select("row_idx", "sample", r6("value"))


@query(sql.over(f"SELECT row_idx, sample, {sql.r6('value')} FROM ys"))
def zscore_sample(spark, sf_dir):
    return y_scaled(spark, sf_dir).select("row_idx", "sample", r6("value"))


@query(f"""
WITH c AS (SELECT user_id AS row_idx, event_type AS sample, avg(value) AS value FROM events GROUP BY ALL),
o AS (SELECT row_idx, sample, CASE WHEN row_idx % 9 = 0 THEN NULL WHEN sample = 'view' THEN 5 ELSE value END AS value FROM c)
SELECT row_idx, sample, coalesce(round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6), 0) + 0.0 AS value FROM o WINDOW w AS (PARTITION BY sample)""")
def zscore_pipeline(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("row_idx"), F.col("event_type").alias("sample")).agg(F.avg("value").alias("value"))
    odd = c.withColumn("value", F.when(F.col("row_idx") % 9 == 0, float("nan")).when(F.col("sample") == "view", 5.0).otherwise(F.col("value")))
    return scale.zscore_pipeline(odd).select("row_idx", "sample", r6("value"))


_STATS = "st AS (SELECT sample, avg(value) AS center, stddev_samp(value) AS scale FROM y0 GROUP BY sample), raw_beta AS (SELECT feature, sample, sum(t.value * y0.value) AS value FROM t JOIN y0 USING (row_idx) GROUP BY ALL), csum AS (SELECT feature, sum(value) AS c FROM t GROUP BY feature)"


@query(sql.over("SELECT feature, sample, round((value - c * center) / scale, 6) + 0.0 AS value FROM raw_beta JOIN csum USING (feature) JOIN st USING (sample)", _STATS))
def beta_colnorm(spark, sf_dir):
    y = y_raw(spark, sf_dir)
    t = solve.projection(x_scaled(spark, sf_dir), LAMBDA)
    stats = y.groupBy("sample").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"))
    cells = solve.product(t, y).join(solve.row_sums(t).withColumnRenamed("value", "c"), "feature").join(stats, "sample")
    return cells.select("feature", "sample", r6(scale.column_correction(F.col("value"), F.col("c"), F.col("center"), F.col("scale")), "value"))


# --- linear algebra ------------------------------------------------------------

_GRAM = "SELECT a.feature AS f1, b.feature AS f2, round(sum(a.value * b.value){extra}, 6) + 0.0 AS value FROM xs a JOIN xs b USING (row_idx) GROUP BY ALL"


@query(sql.over(_GRAM.format(extra="")))
def gram(spark, sf_dir):
    return solve.gram(x_scaled(spark, sf_dir)).select("f1", "f2", r6("value"))


@query(sql.over(_GRAM.format(extra=" + any_value(CASE WHEN a.feature = b.feature THEN 10 ELSE 0 END)")))
def gram_ridge(spark, sf_dir):
    return solve.regularise(solve.gram(x_scaled(spark, sf_dir)), LAMBDA).select("f1", "f2", r6("value"))


@query(sql.over(f"SELECT feature, row_idx, {sql.r6('value')} FROM t"))
def projection_t(spark, sf_dir):
    return solve.projection(x_scaled(spark, sf_dir), LAMBDA).select("feature", "row_idx", r6("value"))


@query(sql.over(f"SELECT feature, sample, {sql.r6('value')} FROM beta"))
def ridge_beta(spark, sf_dir):
    return solve.product(solve.projection(x_scaled(spark, sf_dir), LAMBDA), y_scaled(spark, sf_dir)).select("feature", "sample", r6("value"))


_THIN = "thin_beta AS MATERIALIZED (SELECT f.feature, s.sample, coalesce(b.value, 0) AS value FROM (SELECT DISTINCT feature FROM t) f CROSS JOIN (SELECT DISTINCT sample FROM months) s LEFT JOIN (SELECT feature, sample, sum(t.value * months.value) AS value FROM t JOIN months USING (row_idx) GROUP BY ALL) b USING (feature, sample))"


@query(sql.over(f"SELECT feature, sample, {sql.r6('value')} FROM thin_beta", _THIN))
def ridge_beta_sparse(spark, sf_dir):
    y = y_months(spark, sf_dir)
    t = solve.projection(x_scaled(spark, sf_dir), LAMBDA)
    return solve.fill_cells(solve.product(t, y), t, y).select("feature", "sample", r6("value"))


@query(sql.over("SELECT feature, round(sum(value), 6) + 0.0 AS value FROM t GROUP BY feature"))
def t_rowsum(spark, sf_dir):
    return solve.row_sums(solve.projection(x_scaled(spark, sf_dir), LAMBDA)).select("feature", r6("value"))


# --- permutations and scores ------------------------------------------------------


@query(f"WITH RECURSIVE {sql.TWISTER} SELECT perm_id, row_idx, src_idx FROM perms")
def perm_table(spark, sf_dir):
    """Permutations of the nations."""
    return permutation_frame(spark, table(spark, sf_dir, "nation").count(), N_RAND)


@query()
def libc_perm(spark, sf_dir):
    return permutation_frame(spark, table(spark, sf_dir, "nation").count(), 10, method="srand")


def _permuted(spark, sf_dir):
    t = solve.projection(x_scaled(spark, sf_dir), LAMBDA)
    y = y_scaled(spark, sf_dir)
    return solve.product(t, y), significance.permuted_product(t, y, permutation_frame(spark, N, N_RAND))


@query(sql.tested(f"SELECT perm_id, feature, sample, {sql.r6('value')} FROM moved"))
def perm_beta(spark, sf_dir):
    return _permuted(spark, sf_dir)[1].select("perm_id", "feature", "sample", r6("value"))


@query(sql.tested(f"SELECT feature, sample, {sql.r6('beta')}, {sql.r6('s1')}, {sql.r6('s2')}, hits::BIGINT AS hits FROM sums"))
def perm_stats(spark, sf_dir):
    return significance.permutation_stats(*_permuted(spark, sf_dir)).select("feature", "sample", r6("beta"), r6("s1"), r6("s2"), "hits")


@query(sql.tested(sql.RESULT))
def ridge_full(spark, sf_dir):
    return shown(tested(spark, sf_dir))


@query(sql.tested(sql.RESULT))
def ridge_full_blocked(spark, sf_dir):
    return shown(tested(spark, sf_dir, "blocked"))


_THIN_TEST = sql.TEST.format(y="months", beta="thin_beta", t="t").replace("moved AS MATERIALIZED (", "met AS (", 1).replace("sums AS (", "moved AS MATERIALIZED (SELECT p.perm_id, b.feature, b.sample, coalesce(met.value, 0) AS value, coalesce(met.e, 0) AS e FROM thin_beta b CROSS JOIN (SELECT DISTINCT perm_id FROM perms) p LEFT JOIN met USING (perm_id, feature, sample)),\nsums AS (", 1)


@query(sql.over(sql.RESULT, sql.TWISTER, _THIN, _THIN_TEST))
def ridge_full_sparse(spark, sf_dir):
    return shown(api.ridge(x_scaled(spark, sf_dir), y_months(spark, sf_dir), LAMBDA, N_RAND, engine="blocked", n_rows=N))


@query(sql.tested(sql.RESULT.replace("SELECT feature", "SELECT ((dense_rank() OVER (ORDER BY sample) - 1) // 2)::INT AS batch_id, feature")))
def ridge_batched(spark, sf_dir):
    return shown(ridge_batch(x_scaled(spark, sf_dir), _ordered(y_scaled(spark, sf_dir)), LAMBDA, N_RAND, batch_size=2, engine="blocked", n_rows=N), "batch_id")


_INFER = f"""
named AS MATERIALIZED (SELECT n_nationkey AS k, (row_number() OVER (ORDER BY n_name) - 1)::INT AS row_idx FROM nation SEMI JOIN y0 ON y0.row_idx = n_nationkey),
grid AS (SELECT n.row_idx, s.sample, coalesce(y0.value, 0.0) AS value FROM named n CROSS JOIN (SELECT DISTINCT sample FROM y0) s LEFT JOIN y0 ON y0.row_idx = n.k AND y0.sample = s.sample),
iy AS MATERIALIZED (SELECT row_idx, sample, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM grid WINDOW w AS (PARTITION BY sample)),
ix AS MATERIALIZED (
  SELECT n.row_idx, feature, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM x0 JOIN named n ON x0.row_idx = n.k WINDOW w AS (PARTITION BY feature)
  UNION ALL SELECT row_idx, 'background', avg(value) FROM iy GROUP BY row_idx),
{sql.solved("ix", 6, "it")}
ibeta AS MATERIALIZED (SELECT feature, sample, sum(it.value * iy.value) AS value FROM it JOIN iy USING (row_idx) GROUP BY ALL)
"""


@query(sql.tested(sql.RESULT, "iy", "ibeta", _INFER, t="it"))
def infer_pipeline(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("row_idx"), F.col("n_name").alias("row_key"))
    y, x = y_raw(spark, sf_dir).join(names, "row_idx"), x_raw(spark, sf_dir).join(names, "row_idx")
    return shown(api.infer(y.drop("row_idx"), x.drop("row_idx"), LAMBDA, N_RAND, add_background=True, scale_method="column", engine="blocked"))


# --- summaries and comparisons -------------------------------------------------------

_SIX = "SELECT '{c}' AS measure, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max FROM result"


@query(sql.tested(_SIX.format(c="beta") + " UNION ALL " + _SIX.format(c="pvalue")))
def summary_stats(spark, sf_dir):
    s = significance.six_numbers(tested(spark, sf_dir, "blocked"))
    return s.select("measure", *[F.round(c, 6).alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")])


@query(sql.tested("SELECT level::DOUBLE AS level, (SELECT count(*) FROM result WHERE pvalue < level)::BIGINT AS hits FROM (VALUES (0.1::DOUBLE), (0.05), (0.01), (0.001)) v(level)"))
def significance_counts(spark, sf_dir):
    return significance.significant(tested(spark, sf_dir, "blocked"))


@query(f"SELECT count(*) AS n, round(corr(a.v, b.v), 6) AS correlation, corr(a.v, b.v) >= 0.1 AS passed FROM ({_A.replace(' WHERE s_nationkey < 15', '')}) a JOIN ({_B.replace(' WHERE c_nationkey > 4', '')}) b USING (feature, sample)")
def corr_check(spark, sf_dir):
    c = significance.correlation(align.align_results(*_two_results(spark, sf_dir, partial=False)), 0.1)
    return c.select("n", F.round("correlation", 6).alias("correlation"), "passed")


@query(sql.tested("""SELECT count(*) AS n, round(sum(a.zscore), 5) + 0.0 AS total,
  CASE WHEN max(abs(a.zscore - b.zscore)) < 1e-9 THEN 'PASS' WHEN max(abs(a.zscore - b.zscore)) < 1e-6 THEN 'NEAR' ELSE 'FAIL' END AS verdict
FROM result a JOIN (SELECT feature, sample, any_value(beta.value - w.mean) / any_value(w.sd) AS zscore FROM beta JOIN (SELECT feature, sample, avg(value) AS mean, stddev_pop(value) AS sd FROM moved GROUP BY ALL) w USING (feature, sample) GROUP BY ALL) b USING (feature, sample)"""))
def parity_check(spark, sf_dir):
    a, b = (r.select("feature", "sample", F.col("zscore").alias("value")) for r in (tested(spark, sf_dir), tested(spark, sf_dir, "blocked")))
    pairs = keep(align.align_results(a, b))
    totals = pairs.agg(F.count("*").alias("n"), (F.round(F.sum("b"), 5) + F.lit(0.0)).alias("total"))
    return significance.parity(pairs).select("verdict").join(totals)  # a row each


# --- files, readers and batches -------------------------------------------------------


@query(sql.over("SELECT row_idx::VARCHAR AS row_key, sample, round(value, 6) AS value FROM y0"))
def delimited_matrix(spark, sf_dir):
    """Dense table -> delimited file set -> long table."""
    path = shared_folder(spark)
    write_wide(y_raw(spark, sf_dir).select(F.col("row_idx").cast("string").alias("feature"), "sample", F.col("value").alias("beta")), path, sep="\t")
    return read_long(spark, path).where("value is not null").select("row_key", "sample", r6("value"))


@query(sql.tested(sql.RESULT))
def measure_files(spark, sf_dir):
    """The four measures and a row of metadata, written and read back."""
    path, keys = shared_folder(spark), ["feature", "sample"]
    write_measures(keep(tested(spark, sf_dir, "blocked")), path)
    parts = [read_cells(spark, f"{path}/{m}").withColumnRenamed("value", m) for m in ("beta", "se", "zscore", "pvalue")]
    return shown(parts[0].join(parts[1], keys).join(parts[2], keys).join(parts[3], keys))


@query(sql.tested("SELECT 'orders' AS dataset, true AS timed, true AS weighed, 100 AS n_rand, 10.0::DOUBLE AS lambda, 25 AS n_rows, count(*) AS n_cells, count(DISTINCT feature) AS n_features, count(DISTINCT sample) AS n_samples FROM result"))
def run_metadata(spark, sf_dir):
    """A measured run. How long it took and how much memory differs each time: the SQL compares that they were measured, and the counts."""
    _, told = significance.run_metadata(tested(spark, sf_dir, "blocked"), "orders", N_RAND, LAMBDA, N)
    return told.select("dataset", (F.col("execution_time_sec") > 0).alias("timed"), (F.col("peak_memory_mb") > 1).alias("weighed"), "n_rand", "lambda", "n_rows", "n_cells", "n_features", "n_samples")


_BATCHES = sql.RESULT.replace("SELECT feature", "SELECT ((dense_rank() OVER (ORDER BY sample) - 1) // 2)::INT AS batch_id, feature")


@query(sql.tested(_BATCHES))
def batches_of_path(spark, sf_dir):
    """A Parquet path as source, a Parquet sink for each batch's rows."""
    source = keep(_ordered(y_scaled(spark, sf_dir)))
    said = ridge_batch(x_scaled(spark, sf_dir), source.kept_path, LAMBDA, N_RAND, batch_size=2, engine="blocked", n_rows=N, output=shared_folder(spark))
    return shown(spark.read.parquet(said["path"]), "batch_id")


@query(sql.tested(_BATCHES))
def batches_of_reader(spark, sf_dir):
    """A reader as source, its batches appended to the sink one by one."""
    source = keep(_ordered(y_scaled(spark, sf_dir)))
    said = ridge_batch(x_scaled(spark, sf_dir), lambda first, last: align.slice_samples(source, first, last), LAMBDA, N_RAND, batch_size=2, n_samples=5, engine="blocked", n_rows=N, output=shared_folder(spark))
    return shown(spark.read.parquet(said["path"]), "batch_id")


@query(sql.tested(sql.RESULT))
def ridge_stats(spark, sf_dir):
    """The test of scaled columns from the unscaled ones and their statistics."""
    y = y_raw(spark, sf_dir)
    stats = y.groupBy("sample").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"))
    return shown(api.ridge(x_scaled(spark, sf_dir), y, LAMBDA, N_RAND, engine="blocked", n_rows=N, stats=stats))


@query(sql.tested(sql.RESULT))
def ridge_lowlevel(spark, sf_dir):
    """A caller's permutation table, and two samples at a time."""
    run = api.ridge_lowlevel(x_scaled(spark, sf_dir), y_scaled(spark, sf_dir), LAMBDA, N_RAND, batch_size=2, engine="blocked", n_rows=N, perms=permutation_frame(spark, N, N_RAND))
    return shown(run.result)


_NULLS = """
yn AS MATERIALIZED (SELECT row_idx, sample, CASE WHEN row_idx % 6 = 1 THEN NULL ELSE value END AS value FROM ys UNION ALL SELECT row_idx, sample, value / 2 FROM ys WHERE row_idx % 4 = 2),
nbeta AS MATERIALIZED (SELECT feature, sample, sum(t.value * yn.value) AS value FROM t JOIN yn USING (row_idx) GROUP BY ALL)
"""


def _nulls(spark, sf_dir) -> DataFrame:
    y = y_scaled(spark, sf_dir)
    return y.withColumn("value", F.when(F.col("row_idx") % 6 != 1, F.col("value"))).unionByName(y.where("row_idx % 4 = 2").withColumn("value", F.col("value") / 2))


@query(sql.tested(sql.RESULT, "yn", "nbeta", _NULLS))
def ridge_nulls(spark, sf_dir):
    """Null and repeated cells, in blocks."""
    return shown(api.ridge(x_scaled(spark, sf_dir), _nulls(spark, sf_dir), LAMBDA, N_RAND, engine="blocked", n_rows=N))


@query(sql.tested(sql.RESULT, "yn", "nbeta", _NULLS))
def ridge_nulls_relational(spark, sf_dir):
    return shown(api.ridge(x_scaled(spark, sf_dir), _nulls(spark, sf_dir), LAMBDA, N_RAND, engine="relational", n_rows=N))


#: All orders by priority and day of the month, some of which a nation has none of.
_SPARSE_INFER = "daily AS MATERIALIZED (SELECT c.c_nationkey::INT AS row_idx, o.o_orderpriority || '-' || day(o.o_orderdate) AS sample, sum(o.o_totalprice) / 100000 AS value FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL)," + _INFER.replace("FROM y0) s LEFT JOIN y0 ON", "FROM daily) s LEFT JOIN daily y0 ON")


@query(sql.tested(sql.RESULT, "iy", "ibeta", _SPARSE_INFER, t="it"))
def infer_sparse(spark, sf_dir):
    """An expression table that leaves zeros out, scaled as if it did not."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("row_idx"), F.col("n_name").alias("row_key"))
    y, x = y_priced(spark, sf_dir, F.dayofmonth("o_orderdate")).join(names, "row_idx"), x_raw(spark, sf_dir).join(names, "row_idx")
    return shown(api.infer(y.drop("row_idx"), x.drop("row_idx"), LAMBDA, N_RAND, add_background=True, scale_method="column", engine="blocked"))


# --- planning -----------------------------------------------------------------

_SHAPES = "shapes AS (SELECT p_partkey AS id, p_partkey * 13 AS n, p_partkey % 40 AS p, p_size * 10 AS m, (p_partkey % 3) * 100 AS n_rand, p_partkey * 5 AS nnz, p_partkey % 2 = 0 AS sparse, p_partkey % 7 AS batch, 66000000 + p_partkey * 1000 AS free_bytes FROM part)"


def _need(batch: str) -> str:
    b = f"(CASE WHEN {batch} <= 0 OR {batch} > m THEN m ELSE {batch} END)"
    common = f"8*n*p + 8*p*p + 16*p*n + 4 + 4*n + 8*greatest(p*p, p*n) + (8*greatest(n*p, p*{b})) // 2"
    dense = f"8*n*{b} + 8*p*{b} + CASE WHEN n_rand > 0 THEN 8*p*n + 40*p*{b} ELSE 0 END"
    thin = f"12*greatest(nnz, 1) + 4*(m + 1) + 8*n*p + 16*p*{b} + CASE WHEN n_rand > 0 THEN 8*n*p + 48*p*{b} + (8*greatest(nnz, 1)) // 2 + (8*p*{b}) // 4 ELSE 0 END"
    return f"(CASE WHEN n > 0 AND p > 0 AND m > 0 THEN {common} + CASE WHEN sparse THEN {thin} ELSE {dense} END + CASE WHEN n_rand > 0 THEN 24*p*m ELSE 0 END + 67108864 ELSE 0 END)::BIGINT"


def _shapes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k * 13).alias("n"), (k % 40).alias("p"), (F.col("p_size") * 10).alias("m"), ((k % 3) * 100).alias("n_rand"), (k * 5).alias("nnz"), (k % 2 == 0).alias("sparse"), (k % 7).alias("batch"), (66000000 + k * 1000).alias("free_bytes"))


@query(f"WITH {_SHAPES} SELECT id, {_need('batch')} AS required_bytes FROM shapes")
def memory_estimate(spark, sf_dir):
    return memory.estimate(_shapes(spark, sf_dir)).select("id", "required_bytes")


@query(f"WITH {_SHAPES}, e AS (SELECT *, {_need('batch')} AS required_bytes FROM shapes) SELECT id, (CASE WHEN required_bytes <= 0.8::DOUBLE * free_bytes THEN 0 ELSE least(greatest(1, floor(m * 0.6::DOUBLE * free_bytes / greatest(required_bytes, 1))), 100, m) END)::BIGINT AS batch_size FROM e")
def auto_batch(spark, sf_dir):
    return memory.auto_batch(memory.estimate(_shapes(spark, sf_dir))).select("id", "batch_size")


@query(f"WITH {_SHAPES}, e AS (SELECT *, {_need('batch')} AS required_bytes FROM shapes) SELECT id, (CASE WHEN required_bytes > 0.9::DOUBLE * free_bytes THEN -100 ELSE 0 END)::INT AS status FROM e")
def memory_guard(spark, sf_dir):
    return memory.guard(memory.estimate(_shapes(spark, sf_dir))).select("id", "status")


@query(f"""WITH {_SHAPES}, big AS (SELECT * REPLACE (free_bytes * 3 AS free_bytes) FROM shapes),
tries AS (SELECT *, unnest([m, m // 2, m // 4, m // 8, m // 16, least(10, m), least(5, m), 1]) AS b0 FROM big), each AS (SELECT *, greatest(1, b0) AS b FROM tries)
SELECT id, coalesce(max(CASE WHEN {_need('b')} <= 0.6::DOUBLE * free_bytes THEN b END), 1)::BIGINT AS batch_size FROM each GROUP BY id""")
def batch_candidates(spark, sf_dir):
    return memory.candidates(_shapes(spark, sf_dir).withColumn("free_bytes", F.col("free_bytes") * 3)).select("id", "batch_size")


@query(f"""WITH {_SHAPES}, big AS (SELECT * REPLACE (free_bytes * 3 AS free_bytes) FROM shapes),
tries AS (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k, unnest([m, round_even(m / 2, 0)::BIGINT, round_even(m / 4, 0)::BIGINT, round_even(m / 8, 0)::BIGINT, 50, 25, 10, 5]) AS b FROM big)
SELECT id, coalesce(arg_min(b, k) FILTER (b > 0 AND b <= m AND {_need('b')} < 0.7::DOUBLE * free_bytes), 1)::BIGINT AS batch_size FROM tries GROUP BY id""")
def large_batch_candidates(spark, sf_dir):
    return memory.large_candidates(_shapes(spark, sf_dir).withColumn("free_bytes", F.col("free_bytes") * 3)).select("id", "batch_size")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 90 > p_size OR p_partkey % 90 < 0 THEN 0 ELSE p_partkey % 90 END AS batch_size FROM part")
def clamp_batch(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), memory.clamp_batch(F.col("p_partkey") % 90, F.col("p_size")).alias("batch_size"))


@query("""WITH s AS (SELECT (p_size * 10)::BIGINT AS m, p_partkey % 90 AS batch FROM part), c AS (SELECT *, CASE WHEN batch <= 0 OR batch > m THEN m ELSE batch END AS b FROM s),
e AS (SELECT m, batch, b, unnest(range(0, (m + b - 1) // b)) AS batch_id FROM c)
SELECT m, batch, batch_id, batch_id * b AS first, least((batch_id + 1) * b, m) - 1 AS last, least((batch_id + 1) * b, m) - batch_id * b AS width FROM e""")
def batch_plan(spark, sf_dir):
    return memory.batch_plan(table(spark, sf_dir, "part").select((F.col("p_size") * 10).cast("long").alias("m"), (F.col("p_partkey") % 90).alias("batch")))


@query("SELECT n_name AS dataset, n_nationkey::VARCHAR AS n_rows, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region")
def metadata_union(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset"), F.col("n_nationkey").cast("string").alias("n_rows"))
    b = table(spark, sf_dir, "region").select(F.col("r_name").alias("dataset"), F.lit("region").alias("note"))
    return union_metadata([a, b])


# --- users x hours ------------------------------------------------------------------
# Without SQL, which would have to draw as many numbers as there are users for each
# permutation; tests compare with NumPy.


def x_users(spark, sf_dir) -> DataFrame:
    """user x hour of the day (average value), for the users of `y_sparse`."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("int").alias("row_idx"), F.hour("ts").cast("string").alias("feature")).agg(F.avg("value").alias("value"))


@query()
def ridge_beta_sparse_all(spark, sf_dir):
    y = y_sparse(spark, sf_dir)
    t = solve.projection(x_users(spark, sf_dir), LAMBDA)
    return solve.fill_cells(solve.product(t, y), t, y).select("feature", "sample", r6("value"))


@query()
def ridge_full_sparse_all(spark, sf_dir):
    return shown(api.ridge(x_users(spark, sf_dir), y_sparse(spark, sf_dir), LAMBDA, N_RAND, engine="blocked"))


__all__ = ["CATALOGUE"]
