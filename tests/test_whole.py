"""Queries over whole tables and all features, against NumPy."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from test_ridge import cells, numpy_ridge

from ridgemill import catalogue
from ridgemill.catalogue import CATALOGUE, LAMBDA, N_RAND
from ridgemill.functions.permutations import mersenne_table

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def run(spark, name):
    return CATALOGUE[name][0](spark, str(DATA))


def matrix(df, column):
    """Values by row and name, 0 where the table has none."""
    rows = df.collect()
    names = sorted({r[column] for r in rows})
    out = np.zeros((max(r["row_idx"] for r in rows) + 1, len(names)))
    for r in rows:
        out[r["row_idx"], names.index(r[column])] = r["value"]
    return out, names


def expected(x, y, features, samples):
    want = numpy_ridge(x, y, LAMBDA, N_RAND)
    return {(f, s): tuple(float(w[i, j]) for w in want) for i, f in enumerate(features) for j, s in enumerate(samples)}


def agree(got, want):
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=0, atol=2e-6, err_msg=str(k))


def values(df, column):
    return {(r["feature"], r[column]): (r["value"],) for r in df.collect()}


def test_every_row_takes_part(spark):
    """All parts and events, whose tables hold more than the older queries read."""
    names = run(spark, "make_unique").collect()
    assert len(names) == spark.read.parquet(f"{DATA}/part.parquet").count() and len({r["unique_name"] for r in names}) == len(names)
    events = spark.read.parquet(f"{DATA}/events.parquet")
    total = events.agg({"value": "sum"}).first()[0]
    assert run(spark, "densify").agg({"value": "sum"}).first()[0] == pytest.approx(total)
    days = run(spark, "zscore_sparse_nz").count()
    assert days == events.selectExpr("user_id", "event_type", "day(ts)").distinct().count()
    part = spark.read.parquet(f"{DATA}/part.parquet").selectExpr("p_size * 10 as m", "p_partkey % 90 as b").collect()
    assert run(spark, "batch_plan").count() == sum(-(-r["m"] // (r["b"] if 0 < r["b"] <= r["m"] else r["m"])) for r in part)


def test_sparse_ridge_over_all_users(spark):
    x, features = matrix(catalogue.x_users(spark, str(DATA)), "feature")
    y, samples = matrix(catalogue.y_sparse(spark, str(DATA)), "sample")
    want = expected(x, y, features, samples)
    agree(cells(run(spark, "ridge_full_sparse_all")), want)
    agree(values(run(spark, "ridge_beta_sparse_all"), "sample"), {k: v[:1] for k, v in want.items()})


def test_ridge_on_all_features(spark):
    x, features = matrix(catalogue.x_scaled(spark, str(DATA)), "feature")
    y, samples = matrix(catalogue.y_scaled(spark, str(DATA)), "sample")
    assert len(features) == 5
    want = expected(x, y, features, samples)
    for name in ("ridge_full", "ridge_full_blocked", "ridge_batched"):
        agree(cells(run(spark, name)), want)
    only = {k: v[:1] for k, v in want.items()}
    agree(values(run(spark, "ridge_beta"), "sample"), only)
    agree(values(run(spark, "beta_colnorm"), "sample"), only)
    t = np.linalg.solve(x.T @ x + LAMBDA * np.eye(5), x.T)
    agree(values(run(spark, "projection_t"), "row_idx"), {(f, r): (t[i, r],) for i, f in enumerate(features) for r in range(25)})
    assert {r["feature"]: r["value"] for r in run(spark, "t_rowsum").collect()} == pytest.approx(dict(zip(features, t.sum(1), strict=True)), abs=2e-6)
    moved = {(r["perm_id"], r["feature"], r["sample"]): r["value"] for r in run(spark, "perm_beta").collect()}
    table = mersenne_table(25, N_RAND)
    assert moved == pytest.approx({(k, f, s): v for k in range(N_RAND) for f, line in zip(features, t @ y[table[k]], strict=True) for s, v in zip(samples, line, strict=True)}, abs=2e-6)
    stats = run(spark, "perm_stats").collect()
    assert {(r["feature"], r["sample"]): (r["hits"] + 1) / (N_RAND + 1) for r in stats} == pytest.approx({k: v[3] for k, v in want.items()})
    p = np.array([v[3] for v in want.values()])
    assert {r["level"]: r["hits"] for r in run(spark, "significance_counts").collect()} == {k: (p < k).sum() for k in (0.1, 0.05, 0.01, 0.001)}
    six = {r["measure"]: r for r in run(spark, "summary_stats").collect()}
    assert six["pvalue"]["median"] == pytest.approx(np.median(p), abs=2e-6)
    assert run(spark, "parity_check").first()["verdict"] == "PASS"


def test_infer_on_all_features_and_measures(spark):
    names = {r["n_nationkey"]: r["n_name"] for r in spark.read.parquet(f"{DATA}/nation.parquet").collect()}
    order = sorted(range(25), key=names.get)
    x, features = matrix(catalogue.x_scaled(spark, str(DATA)), "feature")
    y, samples = matrix(catalogue.y_scaled(spark, str(DATA)), "sample")
    kept = [i for i in order if i in {r["row_idx"] for r in catalogue.y_raw(spark, str(DATA)).select("row_idx").distinct().collect()}]
    cut, y = catalogue.x_raw(spark, str(DATA)), y[kept]
    x = matrix(cut, "feature")[0][kept]
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    # the mean of a row is over its stored cells
    stored = {(r["row_idx"], r["sample"]) for r in catalogue.y_raw(spark, str(DATA)).collect()}
    counts = np.array([sum((i, s) in stored for s in samples) for i in kept])
    x = np.column_stack([x, y.sum(1) / counts])
    agree(cells(run(spark, "infer_pipeline")), expected(x, y, [*features, "background"], samples))
