"""Matrix files: delimited text and NumPy files to long tables, and back."""

from __future__ import annotations

import csv
import io
import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Cells in a batch of what is read.
CELLS = 65_536


def _header(spark: SparkSession, path: str, sep: str | None) -> tuple[str, str, list[str]]:
    """The first line of a delimited file or file set, its separator and its names.
    The separator None is a tab, or a comma where that gives one column."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} holds no header")
    if sep is None:
        sep = "\t" if len(_fields(line["value"], "\t")) > 1 else ","
    return line["value"], sep, _fields(line["value"], sep)


def _fields(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep)) if '"' in line else line.split(sep)


def _number(text: str) -> float | None:
    try:
        return None if "_" in text else float(text)
    except ValueError:
        return None


def _numbers(fields: list[str]) -> pa.Array:
    """Fields as doubles; null where one is no number."""
    try:
        return pc.cast(pa.array(fields, pa.string()), pa.float64())
    except pa.ArrowInvalid:
        return pa.array(map(_number, fields), pa.float64())


def read_long(spark: SparkSession, path: str, sep: str | None = None, column: str = "sample") -> DataFrame:
    """(row_key, `column`, value) of a delimited matrix (also compressed, also a set
    of files that each begin with the header): its first column holds row keys, its
    header names the others. Cells that are no numbers are null, those that a line
    lacks too; keys that repeat are kept, with a warning.

    Lines are parsed in tasks, by the names of the header, so that the plan does not
    grow with the number of columns; a task holds one line. Quoted fields may hold
    the separator, but no line break."""
    head, sep, (_, *names) = _header(spark, path, sep)
    lines = spark.read.text(path)

    def run(batches):
        columns = pa.array(names, pa.string())
        for batch in batches:
            for line in batch.column("value").to_pylist():
                if line == head:  # each file of a set has it
                    continue
                key, *fields = _fields(line, sep)
                fields = fields[: len(names)] + [""] * (len(names) - len(fields))
                for lo in range(0, len(names), CELLS):
                    some = columns.slice(lo, CELLS)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), some, _numbers(fields[lo : lo + CELLS])], names=["row_key", column, "value"])

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_fields(line, sep)[0] for line in batch.column("value").to_pylist() if line != head], pa.string())], names=["row_key"])

    if not lines.mapInArrow(keys, "row_key string").groupBy("row_key").count().where("count > 1").isEmpty():
        warnings.warn("row keys repeat", stacklevel=2)
    return lines.mapInArrow(run, f"row_key string, `{column}` string, value double")


def _line(fields: list[str], sep: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="").writerow(fields)
    return out.getvalue()


def write_wide(result: DataFrame, path: str, measure: str = "beta", sep: str = ",") -> None:
    """One delimited file set: a row per feature, a column per sample, empty where
    there is no cell; each file begins with the header.

    A feature's cells meet in a task, which assembles its line by the places of the
    names in the header; a task holds one line and the header, as does whoever
    reads the files."""
    names = [r["sample"] for r in result.select("sample").distinct().orderBy("sample").collect()]

    def run(batches):
        known, feature, values, begun = pa.array(names, pa.string()), None, None, False

        def out():
            cells = pc.fill_null(pc.cast(pa.array(values, pa.float64(), mask=~given), pa.string()), "").to_pylist()
            lines = [_line(["Feature", *names], sep)] * (not begun) + [sep.join([_line([feature or ""], sep), *cells])]
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

        for batch in batches:
            keys = pc.dictionary_encode(batch.column("feature"))
            code = keys.indices.to_numpy(zero_copy_only=False)
            place = pc.index_in(batch.column("sample"), known).to_numpy(zero_copy_only=False)
            value = batch.column("value")
            full = value.is_valid().to_numpy(zero_copy_only=False)
            value = pc.fill_null(value, 0.0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                now = keys.dictionary[int(code[lo])].as_py()
                if values is None or now != feature:
                    if values is not None:
                        yield out()
                        begun = True
                    feature, values, given = now, np.zeros(len(names)), np.zeros(len(names), bool)
                values[place[lo:hi]], given[place[lo:hi]] = value[lo:hi], full[lo:hi]
        if values is not None:
            yield out()

    cells = result.select(F.coalesce(F.col("feature"), F.lit("")).alias("feature"), "sample", F.col(measure).cast("double").alias("value"))
    cells.repartition("feature").sortWithinPartitions("feature").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_measures(result: DataFrame, folder: str, metadata: DataFrame | None = None) -> None:
    """The four measures as delimited file sets, and a row of metadata."""
    for measure in ("beta", "se", "zscore", "pvalue"):
        write_wide(result, f"{folder}/{measure}", measure)
    if metadata is not None:
        metadata.write.mode("overwrite").csv(f"{folder}/metadata", header=True)


def read_npy(spark: SparkSession, path: str, features: list[str], samples: list[str]) -> DataFrame:
    """(feature, sample, value) of a small p x m NumPy file on the driver, for fixtures."""
    values = np.load(path)
    if values.shape != (len(features), len(samples)):
        raise ValueError(f"the file holds {values.shape}, not {(len(features), len(samples))}")
    return spark.createDataFrame([(f, s, float(values[i, j])) for i, f in enumerate(features) for j, s in enumerate(samples)], "feature string, sample string, value double")


def read_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(feature, sample, value) of a coefficient file; its first column, number or text, names features."""
    return read_long(spark, path, sep).withColumnRenamed("row_key", "feature")


def union_metadata(tables: list[DataFrame]) -> DataFrame:
    """Tables one below the other; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


class MatrixRanges(DataSource):
    """``spark.read.format("matrix_ranges")``: long cells of a callable source, a
    partition per range of columns. Options: rows, columns, step, first, last; the callable
    (first, last) -> array of rows x (last - first + 1) is given to `reader_of`."""

    function = None

    @classmethod
    def name(cls) -> str:
        return "matrix_ranges"

    def schema(self) -> str:
        return "row_idx int, sample string, sample_ord int, value double"

    def reader(self, schema):
        columns = int(self.options["columns"])
        first, last = int(self.options.get("first", 0)), int(self.options.get("last", columns - 1))
        return _Ranges(type(self).function, int(self.options["rows"]), max(0, first), min(columns - 1, last), int(self.options.get("step", 1000)))


def reader_of(function) -> type[MatrixRanges]:
    """A data source class over `function`, to be registered with the session."""
    return type("MatrixRangesOf", (MatrixRanges,), {"function": staticmethod(function)})


def read_ranges(spark: SparkSession, function, rows: int, columns: int, step: int = 1000, first: int = 0, last: int | None = None) -> DataFrame:
    """The columns `first`..`last` of a callable source: it is asked for these alone,
    a range of up to `step` at a time.

    The range is an option of the table and no pushed filter: Spark keeps what a
    filter left with the loaded table, so that a second filter on it would read the
    first one's columns."""
    spark.dataSource.register(reader_of(function))
    options = {"rows": rows, "columns": columns, "step": step, "first": first, "last": columns - 1 if last is None else last}
    return spark.read.format(MatrixRanges.name()).options(**options).load()


class _Ranges(DataSourceReader):
    def __init__(self, function, rows: int, first: int, last: int, step: int) -> None:
        self.function, self.rows, self.first, self.last, self.step = function, rows, first, last, step

    def partitions(self):
        ranges = [(i, min(i + self.step - 1, self.last)) for i in range(self.first, self.last + 1, self.step)]
        return [InputPartition(r) for r in ranges] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        first, last = partition.value
        values = np.asarray(self.function(first, last), dtype=float)
        if values.shape != (self.rows, last - first + 1):
            raise ValueError(f"columns {first}..{last}: {values.shape} instead of {(self.rows, last - first + 1)}")
        step = max(1, CELLS // max(1, self.rows))
        for lo in range(0, values.shape[1], step):
            part = values[:, lo : lo + step]
            places = first + lo + np.arange(part.shape[1], dtype=np.int32)
            names = np.array([f"s{k + 1}" for k in places], dtype=object)
            columns = [np.tile(np.arange(self.rows, dtype=np.int32), len(places)), np.repeat(names, self.rows), np.repeat(places, self.rows), part.T.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row_idx", "sample", "sample_ord", "value"])


def lay_out(y: DataFrame, path: str, samples: int = 1000) -> None:
    """(row_idx, sample, sample_ord, value) as Parquet by ranges of sample_ord, so
    that a filter on it reads the files that hold its samples, about `samples` each."""
    files = -(-((y.agg(F.max("sample_ord")).first()[0] or 0) + 1) // samples)
    y.repartitionByRange(files, "sample_ord").sortWithinPartitions("sample_ord", "row_idx").write.mode("overwrite").parquet(path)
