"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; in a local session without that
    setting (as in tests) under a temporary folder, and elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ridgemill/{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with its scheme, that of Spark's default store if it has none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Spark's setting that removes a job's shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read from there.

    This cuts the lineage: a lost executor costs its tasks, not the work that
    led here, whose shuffle files go when the table is written. The table lives
    until `discard`, or as long as the shared folder does.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before) if before is not None else spark.conf.unset(FREE_SHUFFLES)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def discard(kept: DataFrame) -> None:
    """Delete a table made by `keep` that nothing will read again."""
    spark = kept.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept.kept_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *tables: DataFrame) -> str:
    """`name`, with as many underscores in front as no column of `tables` has."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
