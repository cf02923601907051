"""Alignment, scaling, comparison, planning and files."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from ridgemill import environment
from ridgemill.operators import align, scale, significance
from ridgemill.plans import memory
from ridgemill.sources import matrices

CELLS = "row_idx int, sample string, value double"


def values(df):
    return {(r["row_idx"], r["sample"]): r["value"] for r in df.collect()}


def test_scaling_kinds(table):
    y = table([(0, "a", 1.0), (1, "a", 2.0), (2, "a", 6.0), (0, "flat", 2.0), (1, "flat", 2.0), (2, "flat", 2.0), (0, "nan", 1.0), (1, "nan", math.nan), (2, "nan", 4.0), (0, "one", 7.0)], CELLS)
    pop, stored, samp, pipe = (values(f(y)) for f in (scale.zscore_population, scale.zscore_stored, scale.zscore_sample, scale.zscore_pipeline))
    a = np.array([1.0, 2.0, 6.0])
    assert [pop[i, "a"] for i in range(3)] == pytest.approx(list((a - 3) / a.std()))
    assert [samp[i, "a"] for i in range(3)] == pytest.approx(list((a - 3) / a.std(ddof=1)))
    assert all(k[i, "flat"] == 0 for k in (pop, stored, samp, pipe) for i in range(3))
    assert all(pop[i, "nan"] == 0 for i in range(3)) and all(math.isnan(samp[i, "nan"]) for i in range(3))
    assert pipe[1, "nan"] == 0 and pipe[0, "nan"] == pytest.approx(-pipe[2, "nan"])
    assert stored[0, "one"] == 0 and samp[0, "one"] == 7 and pipe[0, "one"] == 0


def test_keys_and_background(table):
    y = table([("b", 0), ("a", 1), ("c", 2), ("b", 3), (None, 4)], "row_key string, ord int")
    x = table([("a",), ("b",), ("z",), (None,)], "row_key string")
    assert [(r["row_key"], r["row_idx"]) for r in align.common_keys(y, x, order="ord").orderBy("row_idx").collect()] == [("b", 0), ("a", 1)]
    assert [r["row_key"] for r in align.common_keys(y, x).orderBy("row_idx").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        align.require_common(align.common_keys(y, x.where("row_key = 'z'")))
    m = table([(0, "s", 1.0), (0, "t", 3.0), (1, "s", math.nan), (1, "t", 5.0)], CELLS)
    f = table([(0, "f", 1.0), (1, "f", 2.0), (0, "background", 9.0)], "row_idx int, feature string, value double")
    got = {(r["row_idx"], r["feature"]): r["value"] for r in align.with_background(f, m).collect()}
    assert got == {(0, "f"): 1.0, (1, "f"): 2.0, (0, "background"): 2.0, (1, "background"): 5.0}
    assert {r["value"] for r in align.background(m, samples=4).collect()} == {1.0, 1.25}


def test_make_unique(table):
    rng = random.Random(3)
    names = [rng.choice(["a", "b", "a.1", "a.2", "b.1", "a.x"]) for _ in range(60)]
    got = align.make_unique(table(list(enumerate(names)), "ord int, name string"))
    out = [r["unique_name"] for r in got.orderBy("ord").collect()]
    taken, seen, want, last = set(names), set(), [], {}
    for n in names:
        if n not in seen:
            seen.add(n)
            want.append(n)
        else:
            k = last.get(n, 0) + 1
            while f"{n}.{k}" in taken:
                k += 1
            last[n] = k
            want.append(f"{n}.{k}")
    assert out == want


def test_a_frequent_name_is_no_single_task(spark, table):
    names = ["a"] * 3000 + [f"a.{k}" for k in range(1, 400, 3)] + [None, None, "a.x", "a.01"]
    random.Random(4).shuffle(names)
    out = align.make_unique(table([(i, n, "kept") for i, n in enumerate(names)], "ord int, name string, other string"))
    assert out.columns == ["ord", "name", "other", "unique_name"]
    got = [r["unique_name"] for r in out.orderBy("ord").collect()]
    assert len(got) == len(names) and got.count(None) == 2 and len(set(got)) == len(names) - 1
    free = (f"a.{k}" for k in range(1, 5000) if f"a.{k}" not in set(names))
    first = names.index("a")
    assert got == [n if n != "a" or i == first else next(free) for i, n in enumerate(names)]


def test_sparse_and_dense(table):
    y = table([(0, "s", 1.0), (1, "t", 0.0), (1, "s", math.nan)], CELLS)
    assert len(values(align.sparsify(y))) == 2
    dense = values(align.densify(y, y, y))
    assert len(dense) == 4 and dense[0, "t"] == 0


def test_comparisons(table):
    p = lambda rows: table(rows, "a double, b double")
    one = significance.correlation(p([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5), (math.nan, 1.0), (None, 1.0)]), 0.99).first()
    assert one["n"] == 3 and one["correlation"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]) and one["passed"]
    assert significance.correlation(p([(2.0, 2.0), (2.0, 2.0)]), 0.9).first()["correlation"] == 1
    assert math.isnan(significance.correlation(p([(2.0, 1.0), (2.0, 3.0)]), 0.9).first()["correlation"])
    few = significance.correlation(p([(2.0, 1.0)]), 0.9).first()
    assert few["correlation"] is None and not few["passed"]
    for gap, verdict in ((1e-10, "PASS"), (1e-7, "NEAR"), (0.1, "FAIL"), (math.nan, "FAIL")):
        assert significance.parity(p([(1.0, 1.0), (0.0, gap)])).first()["verdict"] == verdict


def test_summary(table):
    r = table([("f", "s", float(i), 0.0, 0.0, i / 100) for i in range(1, 12)] + [("f", "t", math.nan, 0.0, 0.0, 1.0)], "feature string, sample string, beta double, se double, zscore double, pvalue double")
    six = {x["measure"]: x for x in significance.six_numbers(r).collect()}
    assert six["beta"]["q1"] == pytest.approx(np.quantile(np.arange(1, 12), 0.25)) and six["beta"]["mean"] == 6
    assert {x["level"]: x["hits"] for x in significance.significant(r).collect()} == {0.1: 9, 0.05: 4, 0.01: 0, 0.001: 0}
    text = significance.summary_text(r)
    assert "beta" in text and "p < 0.05: 4" in text
    kept, told = significance.run_metadata(r, "d", 5, 2, 30)
    meta = told.first().asDict()
    assert meta["n_samples"] == 2 and meta["lambda"] == 2.0 and meta["dataset"] == "d" and meta["n_cells"] == kept.count() == 12
    assert 0 < meta["execution_time_sec"] < 60 and meta["peak_memory_mb"] > 1


def test_memory(table):
    shape = "n long, p long, m long, n_rand long, nnz long, sparse boolean, batch long"
    rows = memory.estimate(table([(10, 3, 7, 5, 0, False, 0), (0, 3, 7, 5, 0, False, 0), (10, 3, 7, 0, 11, True, 99)], shape)).collect()
    n, p, m = 10, 3, 7
    common = 8 * n * p + 8 * p * p + 16 * p * n + 4 + 4 * n + 8 * max(p * p, p * n) + 8 * max(n * p, p * m) // 2
    assert sorted(r["required_bytes"] for r in rows) == sorted([common + 8 * n * m + 8 * p * m + 8 * p * n + 40 * p * m + 24 * p * m + 2**26, 0, common + 12 * 11 + 4 * 8 + 8 * n * p + 16 * p * m + 2**26])
    free = table([(200, 1000, 2000), (200, 1000, 1100), (50, 10**9, 10)], "m long, required_bytes long, free_bytes long")
    assert sorted(r["batch_size"] for r in memory.auto_batch(free).collect()) == [0, 1, 100]
    assert sorted(r["status"] for r in memory.guard(free).collect()) == [-100, -100, 0]
    plan = memory.batch_plan(table([(140, 33)], "m long, batch long")).orderBy("batch_id").collect()
    assert [r["width"] for r in plan] == [33, 33, 33, 33, 8]


def test_files(spark, table, tmp_path):
    for sep, name in (("\t", "a.tsv"), (",", "b.csv")):
        (tmp_path / name).write_text(sep.join(["gene", "s 1", "s.2"]) + "\n" + sep.join(["g1", "1.5", "NA"]) + "\n" + sep.join(["g1", "2", "3"]) + "\n")
        with pytest.warns(UserWarning):
            got = matrices.read_long(spark, str(tmp_path / name))
        assert sorted(((r["row_key"], r["sample"], r["value"]) for r in got.collect()), key=str) == sorted([("g1", "s 1", 1.5), ("g1", "s.2", None), ("g1", "s 1", 2.0), ("g1", "s.2", 3.0)], key=str)
    result = table([("f", "s", 1.0, 2.0, 3.0, 0.5), ("f", "t", 4.0, 5.0, 6.0, 0.25)], "feature string, sample string, beta double, se double, zscore double, pvalue double")
    matrices.write_measures(result, str(tmp_path / "out"), table([(1,)], "n int"))
    back = {r["sample"]: r["value"] for r in matrices.read_cells(spark, str(tmp_path / "out" / "pvalue")).collect()}
    assert back == {"s": 0.5, "t": 0.25}
    np.save(tmp_path / "m.npy", np.array([[1.0, 2.0]]))
    assert matrices.read_npy(spark, str(tmp_path / "m.npy"), ["f"], ["s", "t"]).count() == 2
    assert matrices.union_metadata([table([(1,)], "a int"), table([(2,)], "b int")]).columns == ["a", "b"]


def test_range_source(spark):
    spark.dataSource.register(matrices.reader_of(lambda first, last: np.arange(first, last + 1)[None, :] * np.ones((3, 1))))
    df = spark.read.format("matrix_ranges").option("rows", 3).option("columns", 7).option("step", 3).load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 21 and df.agg({"value": "sum"}).first()[0] == 63


def test_environment(spark):
    assert environment.check_available(spark)["available"] and not environment.check_available(None)["available"]
    assert environment.devices(spark).columns == ["device_id", "name", "memory_mb", "memory_gb"]
    assert environment.memory_info(spark)["total_memory"] > 0
    assert environment.set_async_mode(True) is False and environment.set_async_mode(False) is True
    assert environment.set_memory_options(False) is True and environment.set_memory_options(True) is False


def test_ranges_are_pruned(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def columns(first, last):
        with open(asked, "a") as out:
            out.write(f"{first} {last}\n")
        return np.arange(first, last + 1)[None, :] * np.ones((3, 1))

    for first, last, ranges, total in ((25, 41, ["25 34", "35 41"], 17 * 33 * 3), (7, 7, ["7 7"], 21), (98, None, ["98 99"], 591), (5, 4, [], None)):
        open(asked, "w").close()
        assert matrices.read_ranges(spark, columns, 3, 100, 10, first, last).agg({"value": "sum"}).first()[0] == total
        assert sorted(set(open(asked).read().split("\n")) - {""}) == ranges
    whole = matrices.read_ranges(spark, columns, 3, 100, 10)
    matrices.lay_out(whole, str(tmp_path / "y"), 10)
    read = spark.read.parquet(str(tmp_path / "y"))
    part = align.slice_samples(read, 25, 41)
    assert part.count() == 51 and "sample_ord" in part._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert read.selectExpr("input_file_name() as f", "sample_ord").groupBy("f").agg({"sample_ord": "max"}).count() == 10


def test_wide_matrix_round_trip(spark, tmp_path):
    rows, columns = 2_000, 20_000
    cells = spark.range(rows * columns, numPartitions=16).selectExpr(f"concat('f', cast(id / {columns} as int)) as feature", f"concat('s', id % {columns}) as sample", "case when id % 7 = 0 then null else cast(xxhash64(id) as double) / 1e18 end as beta")
    path = str(tmp_path / "wide")
    matrices.write_wide(cells, path)
    back = matrices.read_cells(spark, path)
    assert len(back._jdf.queryExecution().executedPlan().toString()) < 10_000
    digest = lambda df, value: df.selectExpr("count(*) as n", f"count({value}) as filled", f"sum(cast(xxhash64(feature, sample, {value}) as decimal(38, 0))) as all").first()
    assert tuple(digest(back, "value")) == tuple(digest(cells, "beta"))


def test_fields_of_any_kind(spark, table, tmp_path):
    result = table([('a,"b"', 'x,"y"', 1.5), ('a,"b"', "z", None), ("c\td", "z", math.inf), ("e", "z", math.nan), ("g", 'x,"y"', 1e-300)], "feature string, sample string, beta double")
    for sep in (",", "\t"):
        matrices.write_wide(result, str(tmp_path / "out"), sep=sep)
        back = {(r["feature"], r["sample"]): r["value"] for r in matrices.read_cells(spark, str(tmp_path / "out"), sep).collect()}
        assert len(back) == 8 and back['a,"b"', 'x,"y"'] == 1.5 and back['a,"b"', "z"] is None and back["c\td", "z"] == math.inf and math.isnan(back["e", "z"]) and back["g", 'x,"y"'] == 1e-300
    (tmp_path / "odd.csv").write_text("k,a,b,c\r\nr1,1_0,0x1, 2 \r\nr2,3\r\n")
    assert sorted((r["row_key"], r["sample"], r["value"]) for r in matrices.read_long(spark, str(tmp_path / "odd.csv")).collect() if r["value"] is not None) == [("r1", "c", 2.0), ("r2", "a", 3.0)]


@pytest.mark.parametrize(("bins", "few"), [(1024, 4096), (4, 3), (2, 0)])
def test_order_statistics(spark, monkeypatch, bins, few):
    monkeypatch.setattr(significance, "BINS", bins)
    monkeypatch.setattr(significance, "FEW", few)
    rng = np.random.default_rng(1)
    data = {"a": np.round(rng.normal(size=400), 1), "b": np.append(rng.normal(size=300) ** 7, [math.inf, -math.inf, -math.inf, 5e-324]), "flat": np.ones(9), "one": np.array([3.0])}
    values = spark.createDataFrame([(m, float(v)) for m, column in data.items() for v in column], "measure string, v double")
    wanted = {m: set(range(0, len(column), 1 + len(column) // 7)) | {len(column) - 1} for m, column in data.items()}
    found = significance.order_statistics(values, wanted)
    assert found == {(m, k): float(np.sort(data[m])[k]) for m, ranks in wanted.items() for k in ranks}


def test_negative_variances_are_told(spark, table):
    from pyspark.sql import Observation

    watch = Observation()
    sums = table([("f", "s", 1.0, 10.0, 9.0, 1), ("f", "t", 1.0, 10.0, 10.0, 1)], "feature string, sample string, beta double, s1 double, s2 double, hits long")
    got = {r["sample"]: r["se"] for r in significance.finalise(sums, 10, watch).collect()}
    assert got == {"s": 0.0, "t": 0.0} and watch.get == {"negative_variances": 1}
