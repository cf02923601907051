"""The permutation test against NumPy, golden numbers and its own invariants."""

from __future__ import annotations

import numpy as np
import pytest

from ridgemill import api
from ridgemill.functions.permutations import check_table, libc_table, mersenne_table, permutation_frame, permutation_table, twister
from ridgemill.model import RidgeError, Status
from ridgemill.operators import scale, solve
from ridgemill.plans.engines import vectors
from ridgemill.streaming.batches import ridge_batch, ridge_stream

GOLDEN_X = [[1, 2], [2, 1], [3, 5], [4, 3], [5, 8], [6, 4]]
GOLDEN_Y = [[1, 0], [3, 2], [2, 0], [5, 1], [4, 0], [7, 3]]


def long(spark, matrix, column, names, order=False):
    rows = [(i, n, j, float(matrix[i][j])) for i in range(len(matrix)) for j, n in enumerate(names)]
    df = spark.createDataFrame(rows, f"row_idx int, {column} string, {column}_ord int, value double")
    return df if order else df.drop(f"{column}_ord")


def cells(result):
    return {(r["feature"], r["sample"]): (r["beta"], r["se"], r["zscore"], r["pvalue"]) for r in result.collect()}


def close(a, b, gap=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=0, atol=gap, equal_nan=True, err_msg=str(k))


def numpy_ridge(x, y, lam, n_rand, seed=0):
    t = np.linalg.solve(x.T @ x + lam * np.eye(x.shape[1]), x.T)
    beta = t @ y
    moved = np.array([t @ y[p] for p in mersenne_table(len(x), n_rand, seed)])
    mean = moved.mean(0)
    se = np.sqrt(np.maximum((moved**2).mean(0) - mean**2, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.where(se > 1e-12, (beta - mean) / se, 0)
    return beta, se, z, ((np.abs(moved) >= np.abs(beta)).sum(0) + 1) / (n_rand + 1)


def random_case(spark, n=30, p=4, m=6, seed=5):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, p)), rng.normal(size=(n, m))
    return x, y, long(spark, x, "feature", [f"f{i}" for i in range(p)]), long(spark, y, "sample", [f"s{i}" for i in range(m)])


def test_golden_twister_and_tables():
    assert next(twister(0))[:5].tolist() == [4293858116, 699692587, 1213834231, 4068197670, 994957275]
    assert mersenne_table(5, 4).tolist() == [[4, 1, 2, 0, 3], [1, 2, 3, 4, 0], [3, 4, 0, 1, 2], [4, 2, 1, 0, 3]]
    assert mersenne_table(8, 2).tolist() == [[7, 2, 3, 0, 4, 6, 1, 5], [6, 4, 1, 3, 0, 7, 5, 2]]
    assert mersenne_table(1, 3).tolist() == [[0], [0], [0]]
    assert all(sorted(row) == list(range(9)) for row in libc_table(9, 5).tolist())


def test_twister_agrees_with_numpy_past_one_block():
    state = np.random.MT19937()
    state._legacy_seeding(7)
    blocks = twister(7)
    mine = np.concatenate([next(blocks), next(blocks), next(blocks)])
    assert mine.tolist() == [int(v) for v in state.random_raw(len(mine))]


def test_table_checks(spark):
    perms = permutation_frame(spark, 6, 3)
    check_table(perms, 6, 3)
    with pytest.raises(ValueError):
        check_table(perms, 6, 4)
    with pytest.raises(ValueError):
        check_table(perms.where("row_idx > 0"), 6, 3)
    with pytest.raises(ValueError):
        permutation_table(4, 2, method="other")


@pytest.mark.parametrize("engine", ["relational", "blocked"])
def test_golden_ridge(spark, engine):
    x, y = long(spark, GOLDEN_X, "feature", ["f1", "f2"]), long(spark, GOLDEN_Y, "sample", ["s1", "s2"])
    got = cells(api.ridge(x, y, 1, 10, engine=engine))
    assert got["f1", "s1"] == pytest.approx((1.41439206, 0.562405785, 1.503201874, 0.181818182), abs=1e-8)
    assert got["f2", "s1"] == pytest.approx((-0.369727047, 0.473656139, -1.337360754, 0.818181818), abs=1e-8)
    assert got["f1", "s2"][:3] == pytest.approx((0.746898263, 0.332030047, 1.586600407), abs=1e-8)


def test_engines_and_numpy_agree(spark):
    x, y, xl, yl = random_case(spark)
    want = numpy_ridge(x, y, 7.0, 40)
    table = {(f"f{i}", f"s{j}"): tuple(float(w[i, j]) for w in want) for i in range(4) for j in range(6)}
    for engine in ("relational", "blocked"):
        close(cells(api.ridge(xl, yl, 7.0, 40, engine=engine)), table)


def test_batches_and_stream_equal_one_run(spark, tmp_path):
    x, y, xl, _ = random_case(spark, m=7)
    yl = long(spark, y, "sample", [f"s{i}" for i in range(7)], order=True)
    whole = cells(api.ridge(xl, yl, 5.0, 20, engine="blocked"))
    batched = ridge_batch(xl, yl, 5.0, 20, batch_size=3, engine="blocked")
    assert {r["batch_id"] for r in batched.collect()} == {0, 1, 2}
    close(cells(batched), whole)
    told = ridge_batch(xl, lambda a, b: yl.where(f"sample_ord between {a} and {b}"), 5.0, 20, batch_size=3, n_samples=7, output=str(tmp_path / "out"), engine="blocked")
    assert told["num_batches"] == 3 and told["m"] == 7
    close(cells(spark.read.parquet(str(tmp_path / "out"))), whole)
    vectors(yl).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample string, idx array<int>, val array<double>").parquet(str(tmp_path / "in"))
    ridge_stream(xl, stream, str(tmp_path / "streamed"), str(tmp_path / "state"), 5.0, 20, 30).awaitTermination()
    close(cells(spark.read.parquet(str(tmp_path / "streamed"))), whole)
    with pytest.raises(ValueError):
        ridge_batch(xl, lambda a, b: yl, 5.0, 20, n_samples=None)
    with pytest.raises(ValueError):
        ridge_batch(xl, lambda a, b: yl, 5.0, 20, batch_size=2, n_samples=7)


def test_sparse_equals_dense(spark):
    x, y, xl, _ = random_case(spark)
    y[np.random.default_rng(1).random(y.shape) < 0.6] = 0
    yl = long(spark, y, "sample", [f"s{i}" for i in range(6)])
    for engine in ("relational", "blocked"):
        close(cells(api.ridge(xl, yl.where("value <> 0"), 3.0, 15, engine=engine, n_rows=30)), cells(api.ridge(xl, yl, 3.0, 15, engine=engine)))


def test_column_correction_equals_scaled_columns(spark):
    x, y, xl, yl = random_case(spark)
    stats = yl.groupBy("sample").agg({"value": "avg"}).withColumnRenamed("avg(value)", "center").join(yl.groupBy("sample").agg({"value": "stddev_samp"}).withColumnRenamed("stddev_samp(value)", "scale"), "sample")
    scaled = cells(api.ridge(xl, scale.zscore_sample(yl), 3.0, 15, engine="relational"))
    for engine in ("relational", "blocked"):
        close(cells(api.ridge(xl, yl, 3.0, 15, engine=engine, stats=stats)), scaled)


def test_zero_and_nan_columns(spark):
    x, y, xl, _ = random_case(spark, m=2)
    y[:, 0] = 0
    y[3, 1] = np.nan
    yl = long(spark, y, "sample", ["zero", "nan"])
    for engine in ("relational", "blocked"):
        got = cells(api.ridge(xl, yl, 3.0, 9, engine=engine))
        assert got["f0", "zero"] == (0, 0, 0, 1)
        assert np.isnan(got["f0", "nan"][:2]).all() and got["f0", "nan"][2:] == (0, 0.1)


def test_large_lambda_shrinks(spark):
    _, _, xl, yl = random_case(spark)
    assert max(abs(v[0]) for v in cells(api.ridge(xl, yl, 1e12, 5, engine="blocked")).values()) < 1e-9


def test_errors_and_status(spark):
    _, _, xl, yl = random_case(spark, m=1)
    for bad, status in (({"lam": -1}, Status.NEGATIVE_LAMBDA), ({"n_rand": 0}, Status.NO_PERMUTATIONS)):
        with pytest.raises(RidgeError) as e:
            api.ridge(xl, yl, **bad)
        assert e.value.status == status
    flat = long(spark, [[0.0, 1.0]] * 5, "feature", ["a", "b"])
    with pytest.warns(UserWarning):
        run = api.ridge_lowlevel(flat, yl.where("row_idx < 5"), 0.0, 5)
    assert run.status == Status.NOT_POSITIVE_DEFINITE and run.result is None and "status" not in run.describe()
    with pytest.warns(UserWarning):
        assert api.ridge_lowlevel(xl, yl.limit(0), 1.0, 5, sparse=True).status == Status.BAD_DIMENSIONS
    assert api.ridge_lowlevel(xl, yl, 1.0, 5, engine="blocked").result.count() == 4


def test_infer(spark):
    x, y, xl, yl = random_case(spark)
    keyed = lambda df: df.selectExpr("concat('k', lpad(row_idx, 3, '0')) as row_key", *[c for c in df.columns if c != "row_idx"])
    got = cells(api.infer(keyed(yl), keyed(xl.where("row_idx >= 10")), 2.0, 12, add_background=True, scale_method="column", engine="blocked"))
    ys = y[10:]
    ys = (ys - ys.mean(0)) / ys.std(0, ddof=1)
    xs = x[10:]
    xs = np.column_stack([(xs - xs.mean(0)) / xs.std(0, ddof=1), ys.mean(1)])
    want = numpy_ridge(xs, ys, 2.0, 12)
    names = [f"f{i}" for i in range(4)] + ["background"]
    close(got, {(f, f"s{j}"): tuple(float(w[i, j]) for w in want) for i, f in enumerate(names) for j in range(6)})
    with pytest.raises(ValueError):
        api.infer(keyed(yl.where("row_idx < 5")), keyed(xl.where("row_idx > 5")))
    with pytest.raises(ValueError):
        api.infer(keyed(yl), keyed(xl), scale_method="row")


def test_blocked_engine_does_not_shuffle_vectors(spark, tmp_path):
    from ridgemill.plans.engines import blocked

    _, _, xl, yl = random_case(spark)
    vectors(yl).write.parquet(str(tmp_path / "v"))
    plan = blocked(xl, spark.read.parquet(str(tmp_path / "v")), 1.0, 5, 30, 0, "mt19937")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_gram_keeps_symmetry(spark):
    x, _, xl, _ = random_case(spark)
    got = {(r["f1"], r["f2"]): r["value"] for r in solve.gram(xl).collect()}
    for i in range(4):
        for j in range(4):
            assert got[f"f{i}", f"f{j}"] == pytest.approx((x.T @ x)[i, j])
