"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

The incidence matrix has a row per distinct shingle set and a column per
shingle; two rows link when 100 * overlap >= percent * union. Its product with
its transpose is never formed whole:

* Size-derived bounds first. A row of n shingles overlaps a partner in at least
  ``ceil(percent * n / 100)`` of them, so under any fixed order of the columns
  the first ``n - bound + DEPTH`` shingles of two linked rows share at least
  DEPTH. Only those columns enter the first product. The order is: shingles
  that few rows have, by hash, then the frequent ones, so that passages which
  many documents share stay out of it.
* Columns with up to BUCKET rows give their pairs; overlap counts accumulate per
  pair, and pairs below the bound are discarded before rows are fetched.
* Columns with more rows give no pairs. A row with fewer than DEPTH of them still
  shares short columns with whatever it links to, and its pairs need that many
  fewer of those. So texts with one passage in common, be they ever so many, are
  not compared with each other. The other rows form groups, which are cut into
  blocks of bounded rows and shingles by row size and hash. Blocks are
  multiplied in tasks (`_product`), which return a spanning forest of their
  links, not the links: first each with itself, then those pairs whose sizes are
  compatible and that may still join rows not known to be together.

The remaining pairs are verified on their whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgemill.llm import textops
from ridgemill.llm.components import components
from ridgemill.llm.shared import discard, keep

#: Common shingles that two linked rows must have among their first ones.
DEPTH = 4
#: A column with more rows is multiplied by blocks.
BUCKET = 16
#: A shingle in more rows counts as frequent. Only the order depends on it; as
#: BUCKET or less, it keeps frequent shingles out of the first product.
FREQUENT = BUCKET
#: Most frequent shingles of each of two counts, which are broadcast (8 bytes each).
MOST_FREQUENT = 1_000_000
#: Shingles in a block of rows.
BLOCK = 400_000
#: Rows in a block: a pair of blocks has a matrix of (2 * ROWS)**2 overlaps.
ROWS = 2_000


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for block in textops.blocks(batch):
            words = textops.split(block.column("text"))
            hashes = words.hashes(lower=True)
            rows = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield block, [np.unique(textops.shingles(r, width)) for r in rows]


def _bound(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _profile(width: int):
    """Size, two signatures and the shingles by hash of each row."""

    def run(batches):
        for block, sets in _sets(batches, width):
            sums, xors = [], []
            for s in sets:
                mixed = textops.mix(s ^ np.uint64(0x5851F42D4C957F2D))
                sums.append(int(mixed.sum(dtype=np.uint64)))
                xors.append(int(np.bitwise_xor.reduce(textops.mix(mixed))) if len(s) else 0)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _signed(sums), _signed(xors), textops.lists(sets, pa.int64())],
                names=["doc_id", "n_shingles", "sig_a", "sig_b", "tokens"],
            )

    return run


def _stored(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The shingles of each row of a table of them, by hash."""
    column = batch.column("tokens")
    at, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _among(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.searchsorted(hot, s)
    at[at == len(hot)] = 0
    return hot[at] == s if len(hot) else np.zeros(len(s), bool)


def _need(n: int, percent: int) -> int:
    """How many of a row's first columns enter the first product."""
    return min(n, n - _bound(n, percent) + DEPTH)


def _counts(percent: int, frequent=None):
    """(token, n): how many rows of a batch have a shingle, of the first ones by hash.

    With `frequent`: of those that a row's first columns may reach, given the share
    of frequent ones among its first, for the rows where one more may be unknown.
    """

    def reach(s: np.ndarray, size: int, hot: np.ndarray) -> int:
        known = int(_among(s[:size], hot).sum())
        lacks = _need(len(s), percent) - (size - known)
        if lacks * known < size - known or not lacks:
            return 0
        return len(s) if known == size else size + int(1.5 * lacks * size / (size - known)) + DEPTH

    def run(batches):
        for batch in batches:
            heads = []
            for s in _stored(batch):
                size = min(len(s), max(_need(len(s), percent), len(s) // 5 + DEPTH))
                heads.append(s[: size if frequent is None else reach(s, size, frequent.value)])
            tokens, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *heads]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return run


def _frequent(rows: DataFrame, percent: int):
    """A broadcast of shingles that more than FREQUENT rows have.

    First those that are frequent among the rows' first shingles by hash, then
    those that are so further on in the rows which have many of the former. Of
    each, at most MOST_FREQUENT are sent, the most frequent ones.
    """
    found, shared = np.zeros(0, np.uint64), None
    for _ in range(2):
        counted = rows.select("tokens").mapInArrow(_counts(percent, shared), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
        counted = keep(counted)
        most = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token")
        found = np.union1d(found, np.array([r.token for r in most.toLocalIterator()], dtype=np.int64).view(np.uint64))
        shared = rows.sparkSession.sparkContext.broadcast(found)
        discard(counted)
        if not len(found):
            break
    return shared


def _columns(percent: int, frequent):
    """The columns of the first product: (token, n, sig, doc_id)."""

    def run(batches):
        hot = frequent.value
        for batch in batches:
            sets = _stored(batch)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tokens, sizes, sigs, counts = [], [], [], []
            for s in sets:
                need = _need(len(s), percent)
                head = s[: 2 * need]
                rare = head[~_among(head, hot)][:need]
                if len(rare) < need and len(head) < len(s):
                    is_hot = _among(s, hot)
                    rare = np.concatenate([s[~is_hot], s[is_hot]])[:need]
                elif len(rare) < need:
                    rare = np.concatenate([rare, head[_among(head, hot)]])[:need]
                tokens.append(rare)
                counts.append(len(rare))
                sizes.append(len(s))
                sigs.append(textops.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else np.uint64(0))
            if sum(counts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int64), counts)), pa.array(np.repeat(np.array(sigs, np.uint64), counts).view(np.int64)), pa.array(np.repeat(ids, counts), pa.int64())],
                    names=["token", "n", "sig", "doc_id"],
                )

    return run


def _pairs(percent: int):
    """Rows sorted by (token, n, sig, doc_id) -> pairs of short columns, rows of long ones."""
    names = ["token", "a", "b", "na", "nb"]

    def out(token, a, b, na, nb):
        return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(na, pa.int64()), pa.array(nb, pa.int64())], names=names)

    def emit(token, n, doc, starts, ends, forced):
        sizes = ends - starts
        for size in np.unique(sizes[(sizes > 1) & (sizes <= BUCKET)]):
            at = starts[(sizes == size) & ~forced][:, None] + np.arange(size)
            i, j = np.triu_indices(size, 1)
            x, y = at[:, i].ravel(), at[:, j].ravel()
            fit = (100 * n[x] >= percent * n[y]) & (doc[x] != doc[y])
            x, y = x[fit], y[fit]
            if len(x):
                swap = doc[x] > doc[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                yield out(pa.nulls(len(x), pa.int64()), doc[x], doc[y], n[x], n[y])
        large = np.flatnonzero((sizes > BUCKET) | forced)
        if len(large):
            at = np.concatenate([np.arange(starts[k], ends[k]) for k in large])
            yield out(token[at], doc[at], pa.nulls(len(at), pa.int64()), n[at], pa.nulls(len(at), pa.int64()))

    def run(batches):
        held = [np.zeros(0, np.int64) for _ in range(4)]
        long_token = None
        for batch in batches:
            token, n, sig, doc = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("token", "n", "sig", "doc_id"), strict=True))
            if not len(token):
                continue
            first = np.ones(len(token), bool)
            first[1:] = (token[1:] != token[:-1]) | (n[1:] != n[:-1]) | (sig[1:] != sig[:-1])
            token, n, sig, doc = token[first], n[first], sig[first], doc[first]
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            ends = np.append(starts[1:], len(token))
            forced = np.zeros(len(starts), bool)
            forced[0] = long_token is not None and token[0] == long_token
            last = len(starts) - 1
            if forced[last] or ends[last] - starts[last] > BUCKET:  # goes on as a long column; its last row stays for the collapse of equal rows
                long_token, keep_from = token[starts[last]], ends[last] - 1
                forced[last] = True
                tail = [x[keep_from:] for x in (token, n, sig, doc)]
                ends[last] -= 1
                held = tail
            else:
                held = [x[starts[last] :] for x in (token, n, sig, doc)]
                starts, ends, forced = starts[:last], ends[:last], forced[:last]
            if len(starts):
                yield from emit(token, n, doc, starts, ends, forced)
        token, n, sig, doc = held
        if len(token):
            forced = np.array([long_token is not None and token[0] == long_token])
            yield from emit(token, n, doc, np.array([0]), np.array([len(token)]), forced)

    return run


def _product(percent: int):
    """Rows (doc_id, n, tokens) of one pair of blocks -> a spanning forest of their links."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        column = table.column("tokens").combine_chunks()
        lengths = np.diff(column.offsets.to_numpy())
        n = lengths.astype(np.int64)
        rows = np.repeat(np.arange(len(ids)), lengths)
        _, column_of, df = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
        overlap = np.zeros((len(ids), len(ids)), dtype=np.float32)
        order = np.argsort(column_of, kind="stable")
        rows, column_of = rows[order], column_of[order]
        wide = df > 8
        begin = np.concatenate([[0], np.cumsum(df)[:-1]])
        for size in np.unique(df[(df > 1) & ~wide]):
            at = begin[df == size][:, None] + np.arange(size)
            i, j = np.triu_indices(size, 1)
            np.add.at(overlap, (rows[at[:, i].ravel()], rows[at[:, j].ravel()]), 1)
        overlap = overlap + overlap.T
        chosen = np.flatnonzero(wide)
        for lo in range(0, len(chosen), 1024):
            part = chosen[lo : lo + 1024]
            dense = np.zeros((len(ids), len(part)), dtype=np.float32)
            for k, c in enumerate(part):
                dense[rows[begin[c] : begin[c] + df[c]], k] = 1
            overlap += dense @ dense.T
        links = np.empty(overlap.shape, bool)
        for lo in range(0, len(ids), 256):  # whole float64 intermediates would be twice the overlaps each
            part = overlap[lo : lo + 256]
            links[lo : lo + 256] = 100 * part >= percent * (n[lo : lo + 256, None] + n[None, :] - part)
        del overlap
        free = np.ones(len(ids), bool)
        a, b = [], []
        for seed in range(len(ids)):
            if free[seed]:
                free[seed] = False
                front = np.array([seed])
                while len(front):
                    front = np.flatnonzero(links[front].any(axis=0) & free)
                    free[front] = False
                    a += [ids[seed]] * len(front)
                    b += ids[front].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _overlaps(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column("ta"), batch.column("tb")
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv, rv = left.values.to_numpy(), right.values.to_numpy()
            good = []
            for i in range(batch.num_rows):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            at = np.flatnonzero(good)
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at))], names=["a", "b"])

    return run


def _light(longs: Column, n: Column, percent: int) -> Column:
    """Whether a row of n shingles, `longs` of whose first ones are long columns,
    shares a short column with whatever it links to."""
    return longs < F.least(F.lit(DEPTH), F.ceil(n * percent / 100))


def _candidates(pairs: DataFrame, longs: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of short columns (a, b, na, nb) whose overlap count reaches the bound.

    Two linked rows share `enough` of their first columns, long ones included. A
    pair can share no more long ones than the row that has fewer, so that many
    less suffice. Two rows that are not light meet in blocks for that.
    """
    enough = F.least(F.lit(DEPTH), F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent)))
    counted = pairs.groupBy("a", "b", "na", "nb").count().withColumn("missing", enough - F.col("count"))
    sides = [longs.select(F.col("doc_id").alias(c), F.col("longs").alias(f"longs_{c}")) for c in "ab"]
    few = counted.where("missing > 0").join(sides[0], "a").join(sides[1], "b").where(F.col("missing") <= F.least("longs_a", "longs_b"))
    few = few.where(_light(F.col("longs_a"), F.col("na"), percent) | _light(F.col("longs_b"), F.col("nb"), percent))
    return counted.where("missing <= 0").select("a", "b").union(few.select("a", "b")).distinct()


def _cuts(members: DataFrame, *by: str) -> DataFrame:
    """(component, step, *by, cuts): blocks for the rows of a step, by shingles and by rows."""
    return members.groupBy("component", "step", *by).agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / ROWS)).cast("int").alias("cuts"))


def _cell(step, side, cut) -> Column:
    return F.struct(step.alias("step"), F.lit(side).alias("side"), cut.alias("cut"))


def _pair_with(own: Column, step: Column, side: int):
    return lambda c: F.struct(F.least(own, _cell(step, side, c)).alias("x"), F.greatest(own, _cell(step, side, c)).alias("y"))


def _block_pairs() -> Column:
    """The block pairs of a row (step, side, cut): with the blocks of its own step
    and of the steps next to it, unless both are on the main side.

    `known` maps (step, side) to its number of blocks.
    """
    pairs = []
    for mine in (0, 1):
        for theirs in (0, 1):
            if mine and theirs:
                continue
            for beyond in (-1, 0, 1):
                step = F.col("step") + beyond
                count = F.coalesce(F.try_element_at("known", F.struct(step.alias("step"), F.lit(theirs).alias("side"))), F.lit(0))
                own = _cell(F.col("step"), mine, F.col("cut"))
                pairs.append(F.when((F.col("side") == mine) & (count > 0), F.transform(F.sequence(F.lit(0), count - 1), _pair_with(own, step, theirs))).otherwise(F.array()))
    return F.concat(*pairs)


def _linked_blocks(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join what the rows of `members` (component, step, doc_id,
    n) and `links` hold together.

    First each block is multiplied with itself. Of what that leaves, a group's
    largest linked class is its main side. Two rows of it need no comparison, as
    they are known to be together, so only the others' blocks meet all blocks:
    a group of near copies costs its rows times those outside its main class.
    """
    cut = members.join(keep(_cuts(members)).hint("merge"), ["component", "step"]).withColumn("cut", F.pmod(F.xxhash64("doc_id"), "cuts").cast("int"))
    blocks = cut.join(sets.hint("merge"), "doc_id").select("component", "step", "cut", "doc_id", "tokens")
    found = keep(components(links.union(blocks.groupBy("component", "step", "cut").applyInArrow(_product(percent), "a long, b long"))))

    named = members.join(found.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "root").hint("merge"), "doc_id", "left")
    named = keep(named.withColumn("root", F.coalesce("root", "doc_id")))
    main = named.groupBy("component", "root").count().groupBy("component").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    sided = named.join(keep(main).hint("merge"), "component").withColumn("side", (F.col("root") == F.col("main")).cast("int")).drop("root", "main")
    sided = keep(sided)
    cuts = keep(_cuts(sided, "side"))
    steps = [cuts.select("component", (F.col("step") - beyond).alias("step"), F.struct("step", "side").alias("k"), F.col("cuts").alias("v")) for beyond in (-1, 0, 1)]
    known = steps[0].union(steps[1]).union(steps[2]).groupBy("component", "step").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("known"))  # six entries at most
    spread = sided.join(keep(known).hint("merge"), ["component", "step"])
    spread = spread.withColumn("cut", F.pmod(F.xxhash64("doc_id"), F.element_at("known", F.struct("step", "side"))).cast("int"))
    spread = spread.select("doc_id", "component", F.explode(_block_pairs()).alias("block"))
    blocks = spread.join(sets.hint("merge"), "doc_id").select("component", "block", "doc_id", "tokens")
    forest = blocks.groupBy("component", "block").applyInArrow(_product(percent), "a long, b long")
    return found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(forest)


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text).

    A-Z are lower-cased and words are runs of non-space bytes. A row's set is
    its distinct shingles of `width` words, or its whole word sequence if it has
    fewer. Rows link when 100 * overlap >= percent * union; component_id is the
    smallest doc_id that links reach, the row itself included.

    Null and empty texts, and texts of spaces only: 0 shingles, linked with
    nothing. Equal sets always link and are one row of the product, so copies
    cost no pairs. Rows that repeat a doc_id stay rows of the result; they count
    as one document with the links of all its texts. Rows without doc_id are
    returned with the component of their set's smallest doc_id, null if there is
    none. Columns other than doc_id and text are ignored. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one reading of all texts gives their sets; those that are compared are made again, so that both are never stored at once
    first = keep(docs.mapInArrow(_profile(width), "doc_id long, n_shingles long, sig_a long, sig_b long, tokens array<long>"))
    profile = keep(first.drop("tokens"))
    classes = profile.where("n_shingles > 0").groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("rep"))

    named = first.where(F.col("doc_id").isNotNull()).select("doc_id", "tokens")
    columns = named.mapInArrow(_columns(percent, _frequent(first, percent)), "token long, n long, sig long, doc_id long")
    found = keep(columns.repartition("token").sortWithinPartitions("token", "n", "sig", "doc_id").mapInArrow(_pairs(percent), "token long, a long, b long, na long, nb long"))
    discard(first)

    long = found.where("token is not null").select("token", F.col("a").alias("doc_id"), F.col("na").alias("n"))
    longs = keep(long.groupBy("doc_id").agg(F.count("*").alias("longs")))
    pairs = keep(_candidates(found.where("token is null"), longs, percent))

    # the other rows have all their partners among the pairs
    heavy = long.join(longs, "doc_id").withColumn("light", _light(F.col("longs"), F.col("n"), percent))
    long = heavy.where("not light").select("token", "doc_id", "n")
    stars = keep(long.groupBy("token").agg(F.min("doc_id").alias("b")))
    grouped = components(long.join(stars.hint("merge"), "token").select(F.col("doc_id").alias("a"), "b"))
    members = long.select("doc_id", "n").distinct().join(grouped.withColumnRenamed("node", "doc_id"), "doc_id")
    members = keep(members.withColumn("step", F.floor(F.log(F.col("n") + F.lit(0.0)) / F.lit(-np.log(percent / 100)))))

    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).union(members.select("doc_id")).distinct()

    def tokens(batches):
        for block, rows in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), textops.lists(rows, pa.int64())], names=["doc_id", "tokens"])

    # the ids grow with the input: they are shuffled, not broadcast, at every size; texts are smaller than sets
    sets = keep(docs.where(F.col("doc_id").isNotNull()).join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(tokens, "doc_id long, tokens array<long>"))

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b")
    links = both.select("a", "b", "ta", "tb").mapInArrow(_overlaps(percent), "a long, b long")

    joined = components(_linked_blocks(members, sets, links, percent)).withColumnRenamed("node", "rep")
    # written, so that the merge with the rows of one large class can be split
    named_classes = keep(classes.join(joined, "rep", "left").select("sig_a", "sig_b", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    rows = profile.select("doc_id", "n_shingles", "sig_a", "sig_b").join(named_classes, ["sig_a", "sig_b", "n_shingles"], "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

