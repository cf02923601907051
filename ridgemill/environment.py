"""What the session offers: availability, executors, memory, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_state = {"pool": True, "async": False}


def check_available(spark: SparkSession | None) -> dict:
    """{status, message, available} of a session."""
    if spark is None:
        return {"status": -1, "message": "no session", "available": False}
    stopped = spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped()
    return {"status": -10 if stopped else 0, "message": "the session has ended" if stopped else f"Spark {spark.version}, {spark.sparkContext.defaultParallelism} cores", "available": not stopped}


def memory_info(spark: SparkSession) -> dict:
    """{free_memory, total_memory} in bytes for storage, over all executors."""
    rows = _executors(spark)
    return {"free_memory": sum(r[2] for r in rows), "total_memory": sum(r[1] for r in rows)}


def _executors(spark: SparkSession) -> list[tuple[str, int, int]]:
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    out, entries = [], status.iterator()
    while entries.hasNext():
        entry = entries.next()
        out.append((entry._1(), entry._2()._1(), entry._2()._2()))
    return out


def devices(spark: SparkSession) -> DataFrame:
    """(device_id, name, memory_mb, memory_gb) of the executors."""
    rows = [(i, name, total / 2**20, round(total / 2**30, 2)) for i, (name, total, _) in enumerate(sorted(_executors(spark)))]
    return spark.createDataFrame(rows, "device_id int, name string, memory_mb double, memory_gb double")


def cleanup(spark: SparkSession) -> None:
    """Release cached tables."""
    spark.catalog.clearCache()


def set_memory_options(enable_pool: bool = True, allocation_size: int | None = None, release_threshold: int | None = None) -> bool:
    """Spark manages memory itself: this keeps the flag and returns the previous one."""
    previous, _state["pool"] = _state["pool"], bool(enable_pool)
    return previous


def set_async_mode(enable_async: bool) -> bool:
    """Spark plans lazily anyway: this keeps the flag and returns the previous one."""
    previous, _state["async"] = _state["async"], bool(enable_async)
    return previous
