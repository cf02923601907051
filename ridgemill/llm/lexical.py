"""Ranked lexical search over a two-level quantised index.

A term is a maximal run of ASCII letters and digits and of all other characters
beyond ASCII, with A-Z lower-cased; it is told by a 64-bit hash of its bytes. In a
document a term has an impact, an integer below 10**6 that grows with its
occurrences and falls with the document's length. The index holds, per document,
its terms and on the first level each impact as a byte, rounded upwards, on the
second what gives the impact itself.

A search takes its items in groups of bounded size. A first pass over the first
level gives every document an upper bound for every item, and the k best of a
task a lower bound; a document whose upper bound stays below the task's k-th
lower bound is left out, and then, of the rest, every one whose upper bound stays
below the k-th lower bound of all tasks. All others are scored exactly from the
second level. So no document that may be among the k best is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgemill.llm.shared import discard, keep
from ridgemill.llm.textops import blocks, lists, split

#: ASCII bytes outside letters and digits, which part terms.
PARTING = np.ones(256, dtype=bool)
PARTING[128:] = PARTING[48:58] = PARTING[65:91] = PARTING[97:123] = False
#: Impacts that share a byte.
STEP = 4096
#: Terms (8 bytes each) up to which an index is built of the given terms alone.
TERMS = 1 << 20
#: Items of a group, and their terms, which are broadcast: 20 bytes each.
ITEMS, PAIRS = 1024, 1 << 19
#: Cells of bounds that a task holds at a time; candidates after which it drops those below its k-th lower bound.
CELLS, HELD = 1 << 21, 1 << 18
#: Candidates up to which they are sent to the index; more of them meet it in a shuffle.
SENT = 500_000
#: Share of a group's items from which a term's bounds are a dense product.
DENSE = 1 / 32


def term_counts(texts: DataFrame, ids: list[str], among=None) -> DataFrame:
    """`ids` of `texts` with (n, terms, tf): the number of terms with repeats, and
    the distinct ones in order with their occurrences, if `among` is given (a
    broadcast sorted array) of those alone."""
    names = [*ids, "n", "terms", "tf"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches):
        known = among.value if among is not None else None
        for batch in batches:
            for part in blocks(batch):
                words = split(part.column("text"), PARTING)
                hashes = words.hashes(lower=True)
                n = np.diff(words.first)
                of = np.repeat(np.arange(part.num_rows), n)
                if known is not None:
                    found = np.searchsorted(known, hashes)
                    found[found == len(known)] = 0
                    hit = known[found] == hashes if len(known) else np.zeros(len(hashes), bool)
                    hashes, of = hashes[hit], of[hit]
                order = np.lexsort((hashes, of))
                hashes, of = hashes[order], of[order]
                heads = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (hashes[1:] != hashes[:-1]))) if len(of) else np.zeros(0, np.int64)
                tf = np.diff(np.append(heads, len(of)))
                cuts = np.searchsorted(of[heads], np.arange(1, part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ids), pa.array(n.astype(np.int64)), lists(np.split(hashes[heads], cuts), pa.int64()), lists(np.split(tf.astype(np.int32), cuts), pa.int32())], names=names
                )

    return texts.select(*ids, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}, n long, terms array<long>, tf array<int>")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item. Rows of one item_id, null
    included, are one item."""
    counts = term_counts(items, ["item_id"])
    return counts.select("item_id", F.explode("terms").alias("term")).distinct()


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """The index of `docs` (doc_id, text), the documents' frequency of its terms
    (term, df) and {"N", "L"}, the documents with a term and all terms with repeats.

    With `terms` (term), the index has these alone, as long as they are few enough
    to be sent; the counts are of whole texts either way. Index rows are (uid,
    doc_id, m, terms, impacts, tf): impacts is the first level, a byte per term.
    """
    among = None
    if terms is not None:
        rows = terms.select("term").distinct().limit(TERMS + 1).toPandas()["term"].to_numpy(np.int64)
        if len(rows) <= TERMS:
            among = docs.sparkSession.sparkContext.broadcast(np.sort(rows.view(np.uint64)))
    counted = keep(term_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], among).withColumn("uid", F.monotonically_increasing_id()))
    sums = counted.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first().asDict()
    df = keep(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))

    def run(batches):
        for batch in batches:
            tf, n = batch.column("tf"), batch.column("n").to_numpy()
            m = 10 + (90 * n * sums["N"]) // max(sums["L"], 1)
            sizes = pc.list_value_length(tf).to_numpy().astype(np.int64)
            impact = impacts(tf.flatten().to_numpy().astype(np.int64), np.repeat(m, sizes))
            level = (-(-impact // STEP)).astype(np.uint8)
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            first = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(level)])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(m), batch.column("terms"), first, tf], names=["uid", "doc_id", "m", "terms", "impacts", "tf"])

    rows = counted.where(F.size("terms") > 0).select("uid", "doc_id", "n", "terms", "tf")
    index = keep(rows.mapInArrow(run, "uid long, doc_id long, m long, terms array<long>, impacts binary, tf array<int>"))
    discard(counted)
    return index, df, sums


def impacts(tf, m):
    """The impact of a term that occurs `tf` times in a document of length class `m`."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weights(pairs: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """`pairs` (item_id, term) with w, the term's weight; terms of no document are left out."""
    w = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return pairs.join(df, "term").select(*pairs.columns, w.alias("w"))


class _Best:
    """Candidates of a task: for each of its items the documents whose upper bound
    reaches the k-th largest lower bound so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.low = k, np.zeros((items, k), np.int64)
        self.held, self.count = [], 0

    def floor(self) -> np.ndarray:
        """Per item, the least upper bound that still counts."""
        return np.maximum(self.low[:, 0], 1)

    def learn(self, item: np.ndarray, low: np.ndarray) -> None:
        """Take lower bounds of documents that were not taken before."""
        order = np.lexsort((-low, item))
        item, low = item[order], low[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        item, low, place = (x[place < self.k] for x in (item, low, place))
        fresh = np.zeros_like(self.low)
        fresh[item, place] = low
        self.low = np.sort(np.concatenate([self.low, fresh], axis=1), axis=1)[:, -self.k :]

    def add(self, *rows: np.ndarray) -> None:
        """Rows (item, uid, high, low)."""
        self.held.append(np.array(rows))
        self.count += len(rows[0])
        if self.count > HELD:
            rows = self.rows()
            self.held, self.count = [rows], rows.shape[1]

    def taken(self) -> pa.RecordBatch:
        """The rows held so far, which are then forgotten."""
        rows = self.rows()
        self.held, self.count = [], 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["item", "uid", "high", "low"])

    def rows(self) -> np.ndarray:
        every = np.concatenate(self.held, axis=1) if self.held else np.zeros((4, 0), np.int64)
        return every[:, every[2] >= self.floor()[every[0]]]


def _candidates(index: DataFrame, group: dict[str, np.ndarray], n_items: int, k: int) -> DataFrame:
    """(item, uid, high, low) of documents that may be among an item's k best: of
    each task those whose upper bound reaches the task's k-th lower bound."""
    terms, column = np.unique(group["term"], return_inverse=True)
    item, w = group["item"], group["w"]
    order = np.lexsort((item, column))
    sent = index.sparkSession.sparkContext.broadcast((terms, column[order], item[order], w[order]))

    def run(batches):
        terms, column, item, w = sent.value
        per_term = np.bincount(column, minlength=len(terms))
        starts = np.append(0, np.cumsum(per_term))[:-1]
        dense = np.flatnonzero(per_term > max(2, DENSE * n_items))
        place = np.full(len(terms), -1)
        place[dense] = np.arange(len(dense))
        table = np.zeros((len(dense), n_items))
        common = place[column] >= 0
        table[place[column[common]], item[common]] = w[common]
        best = _Best(n_items, k)
        each = max(1, CELLS // max(n_items, len(dense), 1))

        def products(of, col, value, rows):
            """Sums of w * value of postings (document, column, value) per document and item."""
            left = np.zeros((rows, len(dense)))
            often = place[col] >= 0
            left[of[often], place[col[often]]] = value[often]
            sums = (left @ table).ravel()  # whole numbers below 2**53: exact
            of, col, value = of[~often], col[~often], value[~often]
            times = per_term[col]
            at = np.repeat(starts[col] - np.cumsum(times) + times, times) + np.arange(times.sum())
            cells = np.repeat(of, times) * n_items + item[at]
            return (sums + np.bincount(cells, np.repeat(value, times) * w[at], minlength=len(sums))).astype(np.int64).reshape(rows, n_items)

        for batch in batches:
            for lo in range(0, batch.num_rows, each):
                part = batch.slice(lo, each)
                sizes = pc.list_value_length(part.column("terms")).to_numpy().astype(np.int64)
                hashes = part.column("terms").flatten().to_numpy()
                col = np.searchsorted(terms, hashes)
                col[col == len(terms)] = 0
                hit = terms[col] == hashes
                q = np.frombuffer(b"".join(part.column("impacts").to_pylist()), np.uint8)[hit].astype(np.int64)
                of, col, uid = np.repeat(np.arange(part.num_rows), sizes)[hit], col[hit], part.column("uid").to_numpy()
                high = STEP * products(of, col, q, part.num_rows)
                may = high >= best.floor()
                docs = np.flatnonzero(may.any(axis=1))
                if not len(docs):
                    continue
                new = np.full(part.num_rows, -1)
                new[docs] = np.arange(len(docs))
                own = new[of] >= 0
                low = products(new[of[own]], col[own], np.maximum(STEP * (q[own] - 1) + 1, 0), len(docs))
                d, i = np.nonzero(may[docs])
                best.learn(i, low[d, i])
                high = high[docs]
                still = high[d, i] >= best.floor()[i]
                d, i = d[still], i[still]
                best.add(i, uid[docs[d]], high[d, i], low[d, i])
                if best.count > HELD // 2:  # many that are as good: they need not be held
                    yield best.taken()
        yield best.taken()

    return index.select("uid", "terms", "impacts").mapInArrow(run, "item long, uid long, high long, low long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of `docs`
    (doc_id, text) for each item of `items` (item_id, text), all with a score
    above 0 if fewer, equal scores by ascending doc_id.

    Every row is a document, rows without doc_id (last among equal scores) and
    those that repeat one included; items of one item_id, null included, are one
    item. Null and empty texts have no terms: such documents are never found and
    such items find nothing. Other columns are ignored. No rows on either side
    give no rows.
    """
    spark = docs.sparkSession
    pairs = keep(item_terms(items))
    index, df, sums = build_index(docs, pairs.select("term"))
    weighed = weights(pairs, df, sums["N"]).where("w > 0")
    # items are numbered through a window over few rows, one per item
    sizes = weighed.groupBy("item_id").agg(F.count("*").alias("size"))
    order = Window.orderBy(F.col("item_id").asc_nulls_last())
    numbered = sizes.withColumn("item", F.row_number().over(order) - 1).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    group = F.greatest(F.floor(F.col("item") / ITEMS), F.floor((F.col("upto") - 1) / PAIRS)).cast("int")
    numbers = numbered.select(F.col("item_id").alias("its"), F.col("item").cast("long").alias("item"), group.alias("grp"))
    weighed = keep(weighed.join(numbers, F.col("item_id").eqNullSafe(F.col("its"))).drop("its"))
    groups = [r["grp"] for r in weighed.select("grp").distinct().orderBy("grp").collect()]
    every = None
    for g in groups:
        rows = weighed.where(F.col("grp") == g).select("item", "term", "w").toPandas()
        group = {c: rows[c].to_numpy(np.int64) for c in rows}
        first = int(group["item"].min())
        group["item"] = group["item"] - first
        bounds = keep(_candidates(index, group, int(group["item"].max()) + 1, k).withColumn("item", F.col("item") + first))
        every = bounds if every is None else every.unionByName(bounds)
    if every is None:
        every = spark.createDataFrame([], "item long, uid long, high long, low long")
    by_low = Window.partitionBy("item").orderBy(F.col("low").desc(), "uid")
    kth = every.withColumn("place", F.row_number().over(by_low)).where(F.col("place") <= k).groupBy("item").agg(F.count("*").alias("n"), F.min("low").alias("kth"))
    left = keep(every.join(kth, "item").where((F.col("n") < k) | (F.col("high") >= F.col("kth"))).select("item", "uid"))
    left = F.broadcast(left) if left.count() <= SENT else left
    # exact scores: each document's terms that its items have
    postings = index.join(left, "uid").select("item", "uid", "doc_id", "m", F.explode(F.arrays_zip("terms", "tf")).alias("p"))
    impact = F.expr("1000000000L * p.tf div (1000L * p.tf + 8 * m)")
    held = weighed.select("item", "item_id", F.col("term").alias("t"), "w")
    scored = postings.select("item", "uid", "doc_id", F.col("p.terms").alias("t"), impact.alias("impact")).join(held, ["item", "t"]).groupBy("item", "item_id", "uid", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "uid")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
