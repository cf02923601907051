"""Benchmark decontamination: size-partitioned MinHash search for containment.

DataFrame functions only. The hash of a shingle is its place in one random
order. Each item keeps its smallest hashes as a bottom-k MinHash sketch, and
items are partitioned by size: a partition whose largest size is u has sketches
of ``u - ceil(t * u) + DEPTH`` hashes. A document with containment t lacks at
most ``n - ceil(t * n)`` of an item's n shingles, so it holds the rest of the
sketch, DEPTH hashes or more; a pair that shares fewer is discarded. Documents
have no sketch, as a short item leaves no trace in that of a long document:
all their shingles are looked up. Pairs that remain are verified by exact
shingle containment over the documents they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgemill.llm.shared import keep

#: Sketch rows (16 bytes each) up to which the sketch is broadcast; beyond, the
#: join shuffles.
BROADCAST_ROWS = 500_000
#: Hashes of a sketch that a contaminated document shares at least.
DEPTH = 3


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(rows: DataFrame, key: str) -> DataFrame:
    """(key, hs): the words of each row's text as hashes.

    The generator keeps the optimiser from computing the words once per shingle.
    """
    cut = rows.select(key, F.explode(F.array(words(F.col("text")))).alias("w"))
    return cut.select(key, F.explode(F.array(F.transform("w", lambda w: F.xxhash64(w)))).alias("hs"))


def shingle_hashes(width: int) -> Column:
    """Hashes of each run of `width` words of column hs; none where there are fewer."""
    starts = F.sequence(F.lit(1), F.size("hs") - (width - 1))
    return F.when(F.size("hs") >= width, F.transform(starts, lambda i: F.xxhash64(F.slice("hs", i, width)))).otherwise(F.array().cast("array<bigint>"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): the pairs in which a
    document holds at least `percent` of an item's distinct shingles.

    An item with fewer than `width` words is one shingle of all its words, and
    documents are searched for runs of that length. Items or documents that are
    null or hold no word take part in no pair. Rows that repeat an id count as
    one document or item with the shingles of all of them; rows without id take
    no part. Other columns are ignored. No items or no documents give no rows.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    items = hashed(benchmark.select("item_id", "text").where(F.col("item_id").isNotNull()), "item_id").where(F.size("hs") > 0)
    items = items.withColumn("width", F.least(F.size("hs"), F.lit(width)))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect()) or [width]  # `width` numbers at most
    own = F.coalesce(*[F.when(F.col("width") == k, shingle_hashes(k)) for k in widths])
    grams = items.select("item_id", "width", F.explode(own).alias("h")).distinct()
    sized = grams.withColumn("n_item", F.count("*").over(Window.partitionBy("item_id")))
    # the partition of an item: sizes from 2**k to 2**(k + 1) - 1
    part = sized.withColumn("high", 2 * F.pow(F.lit(2), F.floor(F.log2("n_item"))).cast("long") - 1)
    part = part.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "width")))
    lacking = lambda n: F.col(n) - F.ceil(F.col(n) * percent / 100)
    part = part.withColumn("kept", F.least("n_item", lacking("high") + DEPTH))
    part = keep(part.select("width", "h", "item_id", "n_item", "place", "kept", F.greatest(F.lit(1), F.col("kept") - lacking("n_item")).alias("least")))
    sketch = part.where("place <= kept").select("width", "h", "item_id", "least")
    hint = F.broadcast if part.count() <= BROADCAST_ROWS else (lambda df: df)

    def shingled(rows: DataFrame, kept: str) -> DataFrame:
        by = F.array(*[F.struct(F.lit(k).alias("width"), shingle_hashes(k).alias("all")) for k in widths])
        each = hashed(rows, "doc_id").select("doc_id", F.explode(by).alias("x"))
        return each.select("doc_id", F.col("x.width").alias("width"), F.explode(kept).alias("h"))

    searched = shingled(docs, "x.all").join(hint(sketch), ["width", "h"])
    # no test of a document's size here: it may be spread over rows that repeat its id
    met = searched.select("doc_id", "item_id", "least", "h").distinct().groupBy("doc_id", "item_id", "least").count()
    pairs = keep(met.where("count >= least").select("doc_id", "item_id"))

    verify = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    held = shingled(verify, "x.all").join(hint(part.select("width", "h", "item_id", "n_item")), ["width", "h"])
    shared = held.join(pairs, ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("h").alias("n_shared"))
    good = shared.where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return good.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
