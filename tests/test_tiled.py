"""The tiled engine, which takes what the blocked one may not broadcast."""

from __future__ import annotations

import numpy as np
import pytest
from test_ridge import cells, close, long, numpy_ridge, random_case

from ridgemill import api
from ridgemill.functions.permutations import libc_table, mersenne_table, permutation_frame, permutation_tiles
from ridgemill.operators import solve
from ridgemill.plans import engines


@pytest.fixture
def small(monkeypatch):
    """Tiles of 7 rows, blocks of about 2 samples, chunks of a few permutations."""
    monkeypatch.setattr(engines, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(solve, "TILE_ROWS", 8)
    monkeypatch.setattr(engines, "TASK_CELLS", 60)


@pytest.mark.parametrize("engine", ["blocked", "tiled"])
def test_beyond_the_broadcast_limit(spark, small, engine):
    x, y, xl, yl = random_case(spark)
    want = numpy_ridge(x, y, 7.0, 40)
    table = {(f"f{i}", f"s{j}"): tuple(float(w[i, j]) for w in want) for i in range(4) for j in range(6)}
    close(cells(api.ridge(xl, yl, 7.0, 40, engine=engine)), table)


def test_large_inputs_choose_an_engine_that_ends(spark, small, monkeypatch):
    monkeypatch.setattr(api, "BLOCKED_FROM", 10)
    x, y, xl, yl = random_case(spark)
    want = numpy_ridge(x, y, 7.0, 40)
    assert cells(api.ridge(xl, yl, 7.0, 40))["f1", "s2"] == pytest.approx(tuple(float(w[1, 2]) for w in want))


def test_sparse_scaled_and_odd_columns(spark, small, monkeypatch):
    x, y, xl, _ = random_case(spark)
    y[np.random.default_rng(1).random(y.shape) < 0.6] = 0
    y[:, 0] = 0
    y[3, 1] = np.nan
    yl = long(spark, y, "sample", [f"s{i}" for i in range(6)])
    stats = spark.createDataFrame([(f"s{i}", 0.5 * i, float(i)) for i in range(6)], "sample string, center double, scale double")
    options = {"samples": yl.select("sample").distinct(), "n_rows": 30, "stats": stats}
    stored, some = yl.where("value <> 0"), xl.where("row_idx not between 8 and 15")  # a tile without cells of x
    got = cells(api.ridge(some, stored, 3.0, 15, engine="tiled", **options))
    monkeypatch.setattr(engines, "BROADCAST_BYTES", 1 << 30)
    close(got, cells(api.ridge(some, stored, 3.0, 15, engine="blocked", **options)))


def test_tiles_of_permutations(spark):
    for method, table in (("mt19937", mersenne_table), ("srand", libc_table)):
        want = table(25, 3).tolist()
        rows = sorted(permutation_tiles(spark, 25, 3, 0, method, rows=4).collect(), key=lambda r: (r["perm_id"], r["tile"]))
        assert [sum((r["src"] for r in rows if r["perm_id"] == k), []) for k in range(3)] == want
    want = mersenne_table(2500, 2).tolist()
    assert {(r["perm_id"], r["row_idx"]): r["src_idx"] for r in permutation_frame(spark, 2500, 2).collect()} == {(k, i): v for k in range(2) for i, v in enumerate(want[k])}
