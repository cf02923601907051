"""What the engines, entry points and readers owe each other."""

from __future__ import annotations

import numpy as np
import pytest
from test_ridge import cells, close, long, numpy_ridge, random_case

from ridgemill import api
from ridgemill.functions.permutations import permutation_frame
from ridgemill.model import Status
from ridgemill.operators import align
from ridgemill.streaming.batches import read_batch, ridge_batch

NAMES = [f"f{i}" for i in range(4)]


@pytest.mark.parametrize("engine", ["relational", "blocked", "tiled"])
def test_nulls_repeats_and_nan(spark, engine):
    x, y, xl, _ = random_case(spark, m=3)
    rows = [(i, f"s{j}", None if (i + j) % 5 == 0 else float(y[i, j])) for i in range(30) for j in range(3)]
    rows += [(i, "s1", 0.25) for i in range(0, 30, 4)] + [(3, "bad", float("nan")), (4, "none", None)]
    table = spark.createDataFrame(rows, "row_idx int, sample string, value double")
    x[2, 1] += 0.5
    x[5, 0] = 0
    xl = xl.where("not (row_idx = 5 and feature = 'f0')").unionByName(spark.createDataFrame([(2, "f1", 0.5), (5, "f0", None)], xl.schema))
    dense = np.zeros((30, 5))
    for i, s, v in rows:
        dense[i, ("s0", "s1", "s2", "bad", "none").index(s)] += 0 if v is None else v
    want = numpy_ridge(x, dense, 2.0, 20)
    got = cells(api.ridge(xl, table, 2.0, 20, engine=engine))
    for j, s in enumerate(("s0", "s1", "s2")):
        for i, f in enumerate(NAMES):
            np.testing.assert_allclose(got[f, s], [w[i, j] for w in want], atol=1e-9)
    assert all(got[f, "none"] == (0, 0, 0, 1) for f in NAMES)
    assert all(np.isnan(got[f, "bad"][:2]).all() and got[f, "bad"][2:] == (0, 1 / 21) for f in NAMES)


def test_infer_scales_a_sparse_table_like_its_dense_form(spark):
    x, y, xl, _ = random_case(spark, m=6)
    y[np.random.default_rng(2).random(y.shape) < 0.5] = 0
    y[:, 5] = 3.0
    dense = long(spark, y, "sample", [f"s{i}" for i in range(6)])
    keyed = lambda df: df.selectExpr("concat('k', lpad(row_idx, 3, '0')) as row_key", *[c for c in df.columns if c != "row_idx"])
    run = lambda t: cells(api.infer(keyed(t), keyed(xl), 2.0, 12, add_background=True, scale_method="column", engine="blocked"))
    with np.errstate(invalid="ignore"):
        ys = np.where(y.std(0) > 0, (y - y.mean(0)) / y.std(0, ddof=1), 0)
    xs = np.column_stack([(x - x.mean(0)) / x.std(0, ddof=1), ys.mean(1)])
    want = numpy_ridge(xs, ys, 2.0, 12)
    table = {(f, f"s{j}"): tuple(float(w[i, j]) for w in want) for i, f in enumerate([*NAMES, "background"]) for j in range(6)}
    close(run(dense), table)
    close(run(align.sparsify(dense)), table)


def test_lowlevel_shape_batches_and_permutations(spark):
    _, _, xl, yl = random_case(spark)
    one = api.ridge_lowlevel(xl.where("row_idx = 0"), yl.where("row_idx = 0"), 1.0, 3, engine="blocked")
    assert (one.status, one.n_rows, one.n_features) == (Status.OK, 1, 4)
    whole = cells(api.ridge(xl, yl, 2.0, 10, engine="blocked"))
    batched = api.ridge_lowlevel(xl, yl, 2.0, 10, batch_size=4, engine="blocked", perms=permutation_frame(spark, 30, 10))
    close(cells(batched.result), whole, 1e-12)
    with pytest.warns(UserWarning, match="larger than the number of samples"):
        clamped = api.ridge_lowlevel(xl, yl, 2.0, 10, batch_size=7, engine="blocked")
    close(cells(clamped.result), whole, 1e-12)
    for engine in ("relational", "tiled"):
        close(cells(api.ridge(xl, yl, 2.0, 10, engine=engine, perms=permutation_frame(spark, 30, 10))), whole)
    with pytest.raises(ValueError, match="permutations of"):
        api.ridge(xl, yl, 2.0, 10, perms=permutation_frame(spark, 30, 9))


def test_readers_are_held_to_their_range_and_rows(spark):
    _, y, xl, _ = random_case(spark)
    table = long(spark, y, "sample", [f"s{i}" for i in range(6)], order=True)
    good = lambda first, last: align.slice_samples(table, first, last)
    assert read_batch(good, 1, 3, 30).count() == 90
    for bad in (lambda a, b: good(a, b - 1), lambda a, b: good(a, b + 1), lambda a, b: good(a, b).withColumn("row_idx", good(a, b)["row_idx"] + 1)):
        with pytest.raises(ValueError):
            read_batch(bad, 1, 3, 30)
    with pytest.raises(ValueError, match="expected 0..29"):
        ridge_batch(xl, table.withColumn("row_idx", table["row_idx"] + 1), 1.0, 3, batch_size=4)


def test_keys_are_numbered_over_ranges(spark):
    y = spark.range(1000).selectExpr("concat('k', lpad(id, 4, '0')) as row_key", "1000 - id as place")
    x = y.where("place % 3 = 0").select("row_key")
    by_key = {r["row_key"]: r["row_idx"] for r in align.common_keys(y, x).collect()}
    assert by_key == {k: i for i, k in enumerate(sorted(by_key))} and len(by_key) == 333
    by_place = {r["row_key"]: r["row_idx"] for r in align.common_keys(y, x, order="place").collect()}
    assert by_place == {k: i for i, k in enumerate(sorted(by_place, reverse=True))}


def test_a_killed_run_is_resumed(spark, tmp_path):
    _, y, xl, _ = random_case(spark)
    table = long(spark, y, "sample", [f"s{i}" for i in range(6)], order=True)
    out, asked = str(tmp_path / "out"), []

    def reader(first, last, broken=True):
        asked.append(first)
        if broken and first == 4:
            raise RuntimeError("killed")
        return align.slice_samples(table, first, last)

    run = lambda source, **options: ridge_batch(xl, source, 2.0, 10, batch_size=2, n_samples=6, output=out, engine="blocked", **options)
    with pytest.raises(RuntimeError, match="killed"):
        run(reader)
    assert {r["batch_id"] for r in spark.read.parquet(out).select("batch_id").collect()} == {0, 1}
    asked.clear()
    assert run(lambda a, b: reader(a, b, broken=False), resume=True)["num_batches"] == 3 and asked == [4]
    whole = cells(api.ridge(xl, table, 2.0, 10, engine="blocked"))
    close(cells(spark.read.parquet(out)), whole, 1e-12)
    asked.clear()
    run(reader, resume=True)  # nothing is left to do
    assert asked == [] and spark.read.parquet(out).count() == 24
    with pytest.raises(ValueError, match="other parameters"):
        ridge_batch(xl, reader, 3.0, 10, batch_size=2, n_samples=6, output=out, engine="blocked", resume=True)
    run(table)  # replaces
    close(cells(spark.read.parquet(out)), whole, 1e-12)
    run(table, resume=True)
    assert spark.read.parquet(out).count() == 24
    with pytest.raises(ValueError, match="expected 30"):
        run(table.where("row_idx <> 3"), complete=True)


def test_a_batch_whose_tasks_fail_is_not_published(spark, tmp_path):
    from ridgemill.sources.batch_sink import BatchSink, published

    out = f"file://{tmp_path}/out"
    spark.dataSource.register(BatchSink)
    rows = spark.range(8, numPartitions=4).selectExpr("cast(id % 3 as int) as batch_id", "id as v")
    write = lambda df: df.write.format("ridge_batches").mode("append").option("folder", out).option("told", "x").save()
    with pytest.raises(Exception, match="stop"):
        write(rows.selectExpr("batch_id", "if(v = 7, raise_error('stop'), v) as v"))
    assert published(out, "x") == set()
    write(rows.where("batch_id <> 1"))
    write(rows.where("batch_id <> 1"))  # the same batches again: once
    assert published(out, "x") == {0, 2} and sorted(r["v"] for r in spark.read.parquet(out).collect()) == [0, 2, 3, 5, 6]


def test_runs_tell_of_negative_variances(spark):
    _, _, xl, yl = random_case(spark)
    run = api.ridge_lowlevel(xl, yl, 2.0, 10, engine="blocked")
    assert run.result.count() == 24 and run.result.collect() and run.check() == 0


@pytest.mark.parametrize("engine", ["relational", "blocked", "tiled"])
def test_rows_outside_of_the_matrix_are_errors(spark, engine):
    _, _, xl, yl = random_case(spark, m=1)
    moved = lambda df: df.withColumn("row_idx", df["row_idx"] - 1)
    for x, y in ((moved(xl), yl), (xl, moved(yl))):
        with pytest.raises(Exception, match="row_idx of"):
            api.ridge(x, y, 2.0, 4, engine=engine, n_rows=30).collect()
    with pytest.raises(Exception, match="row_idx of y must be 0..19"):
        api.ridge(xl.where("row_idx < 20"), yl, 2.0, 4, engine=engine, n_rows=20).collect()
