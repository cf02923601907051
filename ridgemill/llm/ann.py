"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample and split until no list holds much
more than its share. Each vector is posted to its nearest centroid and, near a
boundary, to others whose distance is within a ratio of the nearest one's,
leaving out centroids that lie closer to a chosen one than to the vector. A
query walks a neighbour graph over the centroids, which fits in memory, and
takes the lists whose centroid distance is within a ratio of its nearest; only
those lists are read, by a shuffle join on the list, in blocks of bounded size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgemill.llm.shared import keep

#: Vectors per list, and lists at most.
SHARE, LISTS = 128, 16_384
#: Vectors (at most) on which centroids are fitted: this many, or PER_LIST for
#: each list, so 65,536 at most. That is the documented bound.
SAMPLE, PER_LIST = 20_000, 4
#: Boundary vectors: ratio to the nearest centroid, and lists per vector.
REPLICA_RATIO, REPLICAS = 1.15, 4
#: Queries: ratio to the nearest centroid, lists per query (this many, or that
#: share of all lists if it is more), and vectors wanted per neighbour.
QUERY_RATIO, QUERY_LISTS, QUERY_SHARE, WANTED = 1.6, 64, 1 / 16, 40
#: Rows of a list, and queries of it, that meet in one task.
BLOCK, QUERY_BLOCK = 4096, 4096
#: Neighbours of a centroid in the graph, and width of the walk beyond the lists of a query.
DEGREE, BEAM = 16, 1.5


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, for ranking only."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(a: np.ndarray, b: np.ndarray, k: int = 1) -> np.ndarray:
    """Places in `b` of the k nearest rows for each row of `a`, nearest first; a
    block of rows at a time."""
    out = np.empty((len(a), k), dtype=np.int64)
    step = max(1, 4_000_000 // len(b))
    for lo in range(0, len(a), step):
        far = distances(a[lo : lo + step], b)
        first = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(b) else np.repeat(np.arange(len(b))[None], len(far), axis=0)
        out[lo : lo + step] = np.take_along_axis(first, np.argsort(np.take_along_axis(far, first, axis=1), axis=1, kind="stable"), axis=1)
    return out


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds, then lists of over twice their share are halved."""
    rng = np.random.default_rng(7)
    lists = max(1, min(lists, len(sample)))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centroids)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    most = max(2.0, 2 * len(sample) / lists)
    for _ in range(6):
        near = nearest(sample, centroids)[:, 0]
        counts = np.bincount(near, minlength=len(centroids))
        heavy = np.flatnonzero(counts > most)
        if not len(heavy):
            break
        new = []
        for c in heavy:
            own = sample[near == c]
            axis = np.linalg.svd(own - own.mean(0), full_matrices=False)[2][0]
            side = (own - own.mean(0)) @ axis > 0
            if side.any() and not side.all():
                new += [own[side].mean(0), own[~side].mean(0)]
            else:
                new.append(centroids[c])
        centroids = np.concatenate([np.delete(centroids, heavy, axis=0), np.array(new)])
    return centroids


class Graph:
    """A neighbour graph over centroids, walked best first."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        n = len(centroids)
        near = nearest(centroids, centroids, min(DEGREE + 1, n))
        near = [row[row != i][:DEGREE] for i, row in enumerate(near)]
        self.lists = max(QUERY_LISTS, int(n * QUERY_SHARE))
        links = [set(row.tolist()) for row in near]
        for i, row in enumerate(near):
            for j in row.tolist():
                links[j].add(i)
        rng = np.random.default_rng(11)
        for i in range(n):  # a few long links join what the near ones leave apart
            links[i] |= {int(j) for j in rng.choice(n, min(4, n), replace=False) if j != i}
        self.links = [np.array(sorted(x), dtype=np.int64) for x in links]
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))

    def walk(self, query: np.ndarray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """About `width` nearest centroids and their distances, nearest first."""
        width = width or int(BEAM * self.lists)
        seen = np.zeros(len(self.centroids), bool)
        seen[self.entry] = True
        found = [(float(d), int(i)) for d, i in zip(self._to(query, self.entry), self.entry, strict=True)]
        front = list(found)
        heapq.heapify(front)
        best = [(-d, i) for d, i in found]
        heapq.heapify(best)
        while front:
            d, i = heapq.heappop(front)
            if len(best) >= width and d > -best[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for dist, j in zip(self._to(query, new), new, strict=True):
                if len(best) < width or dist < -best[0][0]:
                    heapq.heappush(front, (float(dist), int(j)))
                    heapq.heappush(best, (-float(dist), int(j)))
                    if len(best) > width:
                        heapq.heappop(best)
        out = sorted((-d, i) for d, i in best)
        return np.array([i for _, i in out], dtype=np.int64), np.array([d for d, _ in out])

    def _to(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.centroids[at] - query) ** 2).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _post(shared):
    def run(batches):
        centroids = shared.value.centroids
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column("vector"))
            rows, lists = [], []
            for i, row in enumerate(nearest(points, centroids, min(2 * REPLICAS, len(centroids)))):
                near = centroids[row]
                far = np.sqrt(((near - points[i]) ** 2).sum(1))
                between = np.sqrt(distances(near, near))
                chosen = [0]
                for c in range(1, len(row)):
                    if len(chosen) == REPLICAS or far[c] > REPLICA_RATIO * far[0]:
                        break
                    if between[c, chosen].min() > far[c] * 0.5:
                        chosen.append(c)
                rows += [i] * len(chosen)
                lists += row[chosen].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("vector", "ids"))], names=["list", "vector", "ids"])

    return run


def _choose(shared, sizes, k: int):
    def run(batches):
        graph, counts = shared.value, sizes.value
        for batch in batches:
            rows, lists = [], []
            for i, query in enumerate(_matrix(batch.column("vector")) if batch.num_rows else []):
                near, far = graph.walk(query)
                held = np.cumsum(counts[near])
                # lists within the ratio, and more until there is enough to choose from
                take = max(int((far[: graph.lists] <= QUERY_RATIO * far[0]).sum()), int(np.searchsorted(held, WANTED * k)) + 1)
                rows += [i] * len(near[:take])
                lists += near[:take].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("query_id", "vector"))], names=["list", "query_id", "vector"])

    return run


def _nearest(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(key, queries: pd.DataFrame, posts: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(posts):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        points = np.array(posts["vector"].tolist(), dtype=np.float64)
        ids = posts["ids"].tolist()
        out = []
        for query_id, vector in zip(queries["query_id"], queries["vector"], strict=True):
            far = np.sqrt(((points - np.asarray(vector, dtype=np.float64)) ** 2).sum(1))
            limit = np.partition(far, min(k, len(far) - 1))[min(k, len(far) - 1)]
            found = [(query_id, i, far[j]) for j in np.flatnonzero(far <= limit) for i in ids[j] if i != query_id]
            out += sorted(found, key=lambda x: (x[2], x[1]))[:k]
        return pd.DataFrame(out, columns=names)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id,
    vector) among `vectors` (vec_id, vector) with another id.

    score is the Euclidean distance in double precision; nearest first, ties to
    the smaller vec_id. Vectors that are null, empty, zero, hold null or
    non-finite components, have no id, or not the most common length (of equal
    counts the smallest), take no part. Equal vectors are one point of the index
    with their k + 1 smallest ids, which is all that ties can ask for. Rows that
    repeat a vec_id and its vector count once. Other columns are ignored. No
    rows give no rows.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("vector").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))

    points = usable(vectors)
    lengths = points.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = lengths["n"] if lengths else 1
    points = points.where(F.size("vector") == size)
    first = Window.partitionBy("vector").orderBy("vec_id")
    kept = points.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    points = keep(kept.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    total = points.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    lists = int(min(LISTS, max(1, total // SHARE)))
    sample = points.select("vector").orderBy(F.xxhash64("vector")).limit(max(SAMPLE, PER_LIST * lists)).toPandas()
    shared = spark.sparkContext.broadcast(Graph(balanced_centroids(np.array(sample["vector"].tolist()), lists)))
    n_lists = len(shared.value.centroids)

    def sizes(rows: DataFrame, one) -> np.ndarray:
        counts = np.zeros(n_lists, dtype=np.int64)
        for row in rows.groupBy("list").agg(F.sum(one).alias("n")).collect():  # n_lists rows at most
            counts[row["list"]] = row["n"]
        return counts

    posts = keep(points.mapInArrow(_post(shared), "list long, vector array<double>, ids array<long>"))
    counts = sizes(posts, F.size("ids"))
    asked = usable(queries).where(F.size("vector") == size).distinct().withColumnRenamed("vec_id", "query_id")
    chosen = keep(asked.mapInArrow(_choose(shared, spark.sparkContext.broadcast(counts), k), "list long, query_id long, vector array<double>"))
    # a list is cut into blocks of its vectors and parts of its queries, and each block meets each part
    cuts = [(i, max(1, -(-int(c) // BLOCK)), max(1, -(-int(q) // QUERY_BLOCK))) for i, (c, q) in enumerate(zip(counts, sizes(chosen, F.lit(1)), strict=True))]
    cuts = F.broadcast(spark.createDataFrame(cuts, "list long, blocks int, parts int"))  # n_lists rows
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    posts = posts.join(cuts, "list").select("list", of("vector", "blocks").alias("block"), each("parts").alias("part"), "vector", "ids")
    chosen = chosen.join(cuts, "list").select("list", of("query_id", "parts").alias("part"), each("blocks").alias("block"), "query_id", "vector")

    found = chosen.groupBy("list", "block", "part").cogroup(posts.groupBy("list", "block", "part")).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
