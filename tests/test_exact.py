"""Ties: decided alike, and as exact arithmetic decides them, by every engine."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_ridge import cells, long, numpy_ridge

from ridgemill import api
from ridgemill.functions import exact
from ridgemill.functions.permutations import mersenne_table
from ridgemill.operators import solve

ENGINES = ["relational", "blocked", "tiled"]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 10**7), st.lists(st.tuples(st.integers(-(2**52), 2**52), st.integers(-(2**52), 2**52)), min_size=2, max_size=2))
def test_pairs_compare_like_the_sums_they_stand_for(n, pairs):
    bits = exact.width(n)
    (a, b), (c, d) = pairs
    value = lambda h, m: abs(h * 2**bits + m)
    far = [exact.far(np.array([float(h)]), np.array([float(m)]), bits) for h, m in pairs]
    assert exact.at_least(far[0], far[1])[0] == (value(a, b) >= value(c, d))
    assert all(int(h[0]) * 2**bits + int(low[0]) == value(*pair) and 0 <= low[0] < 2**bits for (h, low), pair in zip(far, pairs, strict=True))


def test_halves_are_whole_and_near():
    rng = np.random.default_rng(0)
    for n in (1, 25, 2000, 10**6):
        bits = exact.width(n)
        v = rng.normal(size=500) * 10.0 ** rng.integers(-3, 3, 500)
        power = exact.exponents(np.abs(v).max())
        a, b = exact.halves(v, power, bits)
        assert (a == np.rint(a)).all() and np.abs(a).max() <= 2**bits and np.abs(b).max() <= 2 ** (bits - 1)
        assert np.abs(np.ldexp(a, power - bits) + np.ldexp(b, power - 2 * bits) - v).max() <= 2.0 ** (power - 2 * bits)
        assert n * 2 ** (2 * bits) <= 2**53


def tied_case(spark, n=30, p=3):
    """Columns whose coefficients permutations bring back: few cells, equal cells, constants, two values."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, p))
    x[10:20] = x[:10]  # equal rows
    y = np.zeros((n, 9))
    y[4, 0] = 0.1
    y[[3, 7], 1] = 0.3, 0.3
    y[[3, 7, 9], 2] = 0.1, 0.2, 0.7
    y[:, 3] = 0.1
    y[rng.random(n) < 0.5, 4] = 1 / 3
    y[[1, 2, 5, 8], 5] = 0.1, -0.1, 0.1, -0.1
    y[:, 7] = rng.normal(size=n)
    y[6, 8] = np.inf
    names = ["one", "two", "three", "flat", "either", "signs", "none", "dense", "inf"]
    return x, y, long(spark, x, "feature", [f"f{i}" for i in range(p)]), long(spark, y, "sample", names), names


def exact_hits(t, y, center, table):
    """Hits in fractions, with T as doubles."""
    rows = [[Fraction(v) for v in row] for row in t.tolist()]
    out = {}
    for j in range(y.shape[1]):
        column = [Fraction(v) - Fraction(center[j]) for v in y[:, j].tolist()]
        for i, row in enumerate(rows):
            far = abs(sum(a * b for a, b in zip(row, column, strict=True)))
            out[i, j] = sum(abs(sum(a * column[k] for a, k in zip(row, order, strict=True))) >= far for order in table)
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_ties_are_exact_in_every_engine(spark, scaled):
    x, y, xl, yl, names = tied_case(spark)
    stats = spark.createDataFrame([(s, 0.1 * k, 0.5 * k) for k, s in enumerate(names)], "sample string, center double, scale double") if scaled else None
    stored = yl.where("value <> 0").repartition(7)
    options = {"samples": yl.select("sample").distinct(), "n_rows": 30, "stats": stats}
    got = {engine: cells(api.ridge(xl, stored, 2.0, 60, engine=engine, **options)) for engine in ENGINES}
    p = {engine: {k: v[3] for k, v in found.items()} for engine, found in got.items()}
    assert p["relational"] == p["blocked"] == p["tiled"]
    t = np.zeros((3, 30))
    for r in solve.projection(xl, 2.0).collect():
        t[int(r["feature"][1:]), r["row_idx"]] = r["value"]
    assert (t[:, 10:20] == t[:, :10]).all()
    fine = y[:, :8]
    hits = exact_hits(t, fine, [0.1 * k if scaled else 0.0 for k in range(8)], mersenne_table(30, 60))
    for (i, j), n in hits.items():
        assert p["blocked"][f"f{i}", names[j]] == (n + 1) / 61, (i, names[j])
    assert all(p["blocked"][f"f{i}", "flat"] == p["blocked"][f"f{i}", "none"] == 1 for i in range(3))


@pytest.mark.parametrize("limits", [{}, {"BLOCK_FEATURES": 64}, {"BLOCK_FEATURES": 64, "FACTOR_BYTES": 0, "GROUP": 2, "TILE_ROWS": 64}, {"BLOCK_FEATURES": 100, "GATHER": 10, "FACTOR_BYTES": 0}])
def test_three_hundred_features(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(solve, name, value)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(340, 300)), rng.normal(size=(340, 4))
    xl = spark.createDataFrame([(i, f"f{j:03d}", v) for i, row in enumerate(x.tolist()) for j, v in enumerate(row)], "row_idx int, feature string, value double")
    with np.errstate(all="ignore"):
        t = np.zeros((300, 340))
        for r in solve.projection(xl, 5.0).collect():
            t[int(r["feature"][1:]), r["row_idx"]] = r["value"]
    # a check that needs no factor of its own: (X'X + lambda I) T = X'
    residual = np.einsum("ij,jk->ik", np.einsum("ki,kj->ij", x, x), t) + 5.0 * t - x.T
    assert np.abs(residual).max() < 1e-9
    if not limits:
        names = ["a", "b", "c", "d"]
        got = cells(api.ridge(xl, long(spark, y, "sample", names), 5.0, 12))
        beta = np.einsum("ij,jk->ik", t, y)
        moved = np.array([np.einsum("ij,jk->ik", t, y[order]) for order in mersenne_table(340, 12)])
        hits = (np.abs(moved) >= np.abs(beta)).sum(0)
        assert all(got[f"f{i:03d}", s][0] == pytest.approx(beta[i, j], abs=1e-10) and got[f"f{i:03d}", s][3] == (hits[i, j] + 1) / 13 for i in range(300) for j, s in enumerate(names))


def test_gram_has_no_join_of_cells(spark):
    x = spark.range(6).selectExpr("cast(id as int) as row_idx", "'f' || (id % 3) as feature", "cast(id as double) as value")
    features = solve.features_of(x)
    plan = solve.gram_blocks(solve.tiles(x, features), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # the numbering of features
    got = {(r["f1"], r["f2"]): r["value"] for r in solve.gram(x).collect()}
    assert got == {(f"f{i}", f"f{j}"): float(i * i + (i + 3) ** 2) if i == j else 0.0 for i in range(3) for j in range(3)}


def test_not_positive_definite_in_a_later_block(spark, monkeypatch):
    from ridgemill.model import RidgeError, Status

    monkeypatch.setattr(solve, "BLOCK_FEATURES", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 5))
    x[:, 4] = 0
    xl = long(spark, x, "feature", [f"f{i}" for i in range(5)])
    with pytest.raises(RidgeError) as e:
        solve.projection(xl, 0.0)
    assert e.value.status == Status.NOT_POSITIVE_DEFINITE
    x[3, 4] = np.nan
    with pytest.raises(RidgeError) as e:
        solve.projection(long(spark, x, "feature", [f"f{i}" for i in range(5)]), 1.0)
    assert e.value.status == Status.SOLVE_FAILED


@pytest.mark.parametrize(("n", "count"), [(25, 100), (1, 3), (2, 5), (10_000, 200)])
def test_permutations_from_many_tasks(spark, monkeypatch, n, count):
    from ridgemill.functions import permutations

    monkeypatch.setattr(permutations, "LEAST", 100)
    rows = permutations.permutation_rows(spark, n, count, 11)
    table = np.zeros((count, n), np.int32)
    for r in rows.collect():
        table[r["perm_id"]] = np.frombuffer(r["src"], np.int32)
    assert (table == mersenne_table(n, count, 11)).all()


def test_moving_the_generator_ahead(monkeypatch):
    from ridgemill.functions import permutations

    monkeypatch.setattr(permutations, "DRAWN", 0)
    reference = np.random.MT19937()
    reference._legacy_seeding(5)
    for skip, gone in ((1, 1), (700, 699), (10**7, 10**7 - 700)):
        reference.random_raw(gone, output=False)
        state = reference.state
        assert next(permutations.twister(5, skip))[:100].tolist() == [int(v) for v in reference.random_raw(100)]
        reference.state = state


def test_numpy_still_agrees(spark):
    x, y, xl, yl, names = tied_case(spark)
    want = numpy_ridge(x, y[:, 7:8], 2.0, 30)
    for engine in ENGINES:
        got = cells(api.ridge(xl, yl.where("sample = 'dense'"), 2.0, 30, engine=engine))
        for i in range(3):
            np.testing.assert_allclose(got[f"f{i}", "dense"], [w[i, 0] for w in want], atol=1e-10)
