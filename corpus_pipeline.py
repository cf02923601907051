"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`. `run` writes each result as Parquet in the
shared folder, gives it to the next stage and deletes it when that is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgemill.llm.decontaminate import contaminated
from ridgemill.llm.ngram_join import ngram_join
from ridgemill.llm.packing import pack
from ridgemill.llm.queries import TOXIC, vocabulary
from ridgemill.llm.shared import discard, keep
from ridgemill.llm.substring_dedup import dedup_passages
from ridgemill.llm.toxicity import score, teach
from ridgemill.session import ship

#: Rows of a stage cannot be told in SQL: a fitted model rejects documents.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on this corpus's labels, does not reject."""
    ship(spark)
    model = teach(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col("score") < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Groups are components of links of Jaccard 0.8 over five-word shingles. Of
    rows that repeat a kept doc_id one stays; rows without doc_id all stay.
    """
    ship(spark)
    groups = ngram_join(docs, width=5, percent=80)
    heads = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(heads.hint("merge"), "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "n_chars"))
    kept = named.withColumn("__row", first).where("__row = 1").drop("__row")
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 50 words or more that an earlier one has."""
    ship(spark)
    cut = dedup_passages(docs, length=50, with_text=True)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows without doc_id are not judged and stay."""
    ship(spark)
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    ship(spark)
    return pack(docs, end_id=2, size=1024, **vocabulary())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("passages", passages), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of `sf_dir`."""
    docs = keep(STAGES[0][1](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir))
    for _, stage in STAGES[1:-1]:
        last, docs = docs, keep(stage(spark, docs, sf_dir))
        discard(last)  # what it led to is written
    return STAGES[-1][1](spark, docs, sf_dir)
