"""Token counts by a separator scan over flat, unindexed token files.

A flat file is a sequence of token ids with an end-of-document id after each
document and no index. It is read by ranges of bytes, in blocks that know
nothing of documents.
Each block is searched for separators in one vector operation; it yields the
counts of the documents that end in it, of which the first is short of what
earlier blocks hold. A prefix scan over the blocks' totals (separators, tokens
since the last one) gives the missing tokens and each document's place. The
scan has two levels, within runs of RUN blocks and over the runs, so that one
long file is no single task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgemill.llm.shared import keep, qualified, shared_folder
from ridgemill.llm.tokens import SEPARATOR_ID, encoder

#: Tokens per block, two bytes each.
BLOCK = 262_144
#: Bytes of flat files that a task reads, on average.
TASK_BYTES = 1 << 26
#: Blocks per run of the scan.
RUN = 256
DTYPE = np.dtype("<u2")


def _opened(path: str):
    """The store of a path with a scheme, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_flat(docs: DataFrame, ranks: str, pattern: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Token files of `docs`, one per partition, in `folder` (by default a new one
    in the shared folder): (file, bytes) and the documents' order (file, place,
    doc_id).

    Ids are those of the whole text, control strings being ordinary text, as
    unsigned 16-bit integers, and the separator. Null and empty texts are a
    separator alone; rows without doc_id and repeated rows are documents too.
    Each attempt of a task writes a file of its own, and only those of attempts
    that ended well are listed, so a lost executor leaves no half file in the
    result. The folder must be in a store that Arrow can open.
    """
    folder = qualified(docs.sparkSession, folder or shared_folder(docs.sparkSession))

    def run(batches):
        encode = encoder(ranks, pattern).ordinary
        end = int(SEPARATOR_ID).to_bytes(4, "little")
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        name, place, size = f"{uuid.uuid4().hex}.u16", 0, 0
        kinds = pa.schema([("file", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()), ("bytes", pa.int64())])

        def rows(places, ids, sizes):
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], schema=kinds)

        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for text in batch.column("text"):
                    tokens = np.frombuffer(encode(text.as_py() or "") + end, "<u4").astype(DTYPE).tobytes()
                    out.write(tokens)
                    size += len(tokens)
                yield rows(list(range(place, place + len(ids))), ids, [None] * len(ids))
                place += len(ids)
        yield rows([None], [None], [size])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = keep(texts.mapInArrow(run, "file string, place long, doc_id long, bytes long"))
    return both.where("bytes > 0").select("file", "bytes"), both.where("place is not null").select("file", "place", "doc_id")


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files of a path; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_flat(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, block, tokens) of flat files (file, bytes) of little-endian unsigned
    16-bit ids: each block is one read of its range of bytes, wherever it runs."""
    step = 2 * block
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("bytes") / step) - 1)).alias("block")).where("bytes > 0")

    def run(batches):
        for batch in batches:
            for file, size, at in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "block")), strict=True):
                store, path = _opened(file)
                with store.open_input_file(path) as source:
                    tokens = source.read_at(min(step, size - at * step), at * step)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at], pa.int64()), pa.array([tokens], pa.binary())], names=["file", "block", "tokens"])

    # a list of ranges is small, but the work behind it is not: it is dealt out by bytes
    tasks = -(-(files.agg(F.sum("bytes")).first()[0] or 1) // TASK_BYTES)
    return ranges.repartition(tasks, "file", "block").mapInArrow(run, "file string, block long, tokens binary")


def _search(separator: int):
    def run(batches):
        for batch in batches:
            seps, lasts, counts = [], [], []
            for tokens in batch.column("tokens"):
                ids = np.frombuffer(tokens.as_py() or b"", DTYPE)
                at = np.flatnonzero(ids == separator)
                seps.append(len(at))
                lasts.append(len(ids) - (int(at[-1]) + 1 if len(at) else 0))
                counts.append((np.diff(at, prepend=-1) - 1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(seps, pa.int64()), pa.array(lasts, pa.int64()), pa.array(counts, pa.list_(pa.int64()))], names=["file", "block", "seps", "rest", "counts"])

    return run


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR_ID) -> DataFrame:
    """(file, place, n_tokens) of each document of flat token blocks (file,
    block, tokens), the separator not counted; place is from 0 in its file.

    Blocks of a file may be of any size and number and are taken in the order
    of `block`. Two separators in a row hold an empty document of 0 tokens. What
    follows the last separator is a document if there is any token in it. Null
    or empty blocks hold no tokens. No rows give no rows.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = keep(blocks.select("file", "block", "tokens").mapInArrow(_search(separator), f"file {kind}, block long, seps long, rest long, counts array<long>"))
    totals = found.select("file", "block", "seps", "rest", F.floor(F.col("block") / RUN).alias("run"))
    # tokens since the last separator before a block: the rests of the blocks from the last one with a separator on
    inner = Window.partitionBy("file", "run").orderBy("block")
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("sum", F.sum("rest").over(inner)).withColumn("opened", F.when(F.col("seps") > 0, F.col("sum") - F.col("rest")))
    local = totals.select(
        "file", "run", "block",
        F.coalesce(F.sum("seps").over(earlier), F.lit(0)).alias("seps_before"),
        (F.coalesce(F.sum("rest").over(earlier), F.lit(0)) - F.coalesce(F.last("opened", ignorenulls=True).over(earlier), F.lit(0))).alias("open_before"),
        (F.coalesce(F.max(F.when(F.col("seps") > 0, 1)).over(earlier), F.lit(0)) == 0).alias("open_run"),
    )
    runs = totals.groupBy("file", "run").agg(F.sum("seps").alias("seps"), F.sum("rest").alias("all"), F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("block"))).alias("opened"))
    outer = Window.partitionBy("file").orderBy("run")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("rest", F.col("all") - F.coalesce("opened", F.lit(0))).withColumn("sum", F.sum("rest").over(outer)).withColumn("mark", F.when(F.col("seps") > 0, F.col("sum") - F.col("rest")))
    runs = runs.select("file", "run", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("run_seps"), (F.coalesce(F.sum("rest").over(before), F.lit(0)) - F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(0))).alias("run_open"))
    scan = local.join(runs, ["file", "run"]).select("file", "block", (F.col("run_seps") + F.col("seps_before")).alias("first"), (F.col("open_before") + F.when(F.col("open_run"), F.col("run_open")).otherwise(0)).alias("carry"))
    placed = found.join(scan, ["file", "block"]).select("file", "first", "carry", F.posexplode("counts").alias("i", "n"))
    whole = placed.select("file", (F.col("first") + F.col("i")).alias("place"), (F.col("n") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    tails = found.join(scan, ["file", "block"]).groupBy("file").agg(F.max_by(F.struct((F.col("first") + F.col("seps")).alias("place"), (F.col("rest") + F.when(F.col("seps") == 0, F.col("carry")).otherwise(0)).alias("n_tokens")), "block").alias("t"))
    return whole.unionByName(tails.select("file", "t.place", "t.n_tokens").where("n_tokens > 0"))
