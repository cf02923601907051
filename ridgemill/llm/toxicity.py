"""Toxicity by maximum-scoring segments.

Each token has a score: its log-odds between labelled toxic and other
documents, under Dirichlet priors in proportion to its overall frequency, kept
only where it stands out from its standard error; every token costs DRIFT.
Since words are inflected, a word has several forms, itself and its openings of
STEMS bytes, and scores as the form that stands out most.
One linear scan per document finds all maximal-scoring segments. A segment's
score S in a text of m tokens has the extreme-value tail
``P(max >= S) = 1 - exp(-K m exp(-lambda S))``; lambda solves
``E[exp(lambda s)] = 1`` over the tokens of documents labelled 0, and K comes
from their best segments. The significances of a document's segments are
summed and mapped to a probability by a logistic fit on labelled documents that
had no part in the token counts.

Tokens are runs of ASCII letters and non-ASCII bytes, A-Z lower-cased, hashed
to BUCKETS counters: that bounds what the driver and each task hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemill.llm import textops
from ridgemill.llm.shared import keep

BUCKETS = 1 << 20
#: Weight of the prior, as a share of the counts.
PRIOR = 0.05
#: Lengths of a word's openings that count as forms of it, in bytes.
STEMS = (4, 6, 8)
#: Occurrences in a document that count, so that repeated lines do not decide.
REPEATS = 4
#: Occurrences (of both labels) from which a form is scored.
LEAST = 4
#: Standard errors by which a token's log-odds must differ from 0.
MARGIN = 4.0
#: What each token costs a segment.
DRIFT = 0.05
#: Labelled documents (at most) for the last fit, of two numbers each: the
#: documented bound of a sample; the token counts take all labelled documents.
CALIBRATION = 50_000
#: One in FOLDS labelled documents calibrates; the others are counted.
FOLDS = 4


@dataclass
class Model:
    weights: np.ndarray
    rate: float
    scale: float
    slope: float
    base: float
    empty: float


def _forms(words: textops.Words) -> np.ndarray:
    """Buckets of each word and of its openings, a row per form; BUCKETS where a
    word is no longer than the opening."""
    out = [(words.hashes(lower=True) & np.uint64(BUCKETS - 1)).astype(np.int64)]
    lengths = words.ends - words.starts
    for size in STEMS:
        longer = np.flatnonzero(lengths > size)
        sums = np.full(len(longer), size * 0x9E3779B9, dtype=np.uint64)
        for i in range(size):
            sums += textops.BYTE_CODES[textops.LOWER[words.data[words.starts[longer] + i]]] * textops.powers(size)[i]
        form = np.full(len(lengths), BUCKETS, dtype=np.int64)
        form[longer] = textops.mix(sums) & np.uint64(BUCKETS - 1)
        out.append(form)
    return np.array(out)


def _blocks(batches):
    for batch in batches:
        for block in textops.blocks(batch):
            words = textops.split(block.column("text"), textops.NO_LETTERS)
            yield block, words.first, _forms(words)


def _tally(batches):
    """(bucket, toxic, clean): occurrences by label, at most REPEATS of a document;
    bucket -1 has the sums over words, counted alike."""
    counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    words = np.zeros(2, dtype=np.int64)
    for block, first, forms in _blocks(batches):
        labels = block.column("toxic").to_numpy()
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            used, n = np.unique(forms[:, a:b], return_counts=True)
            counts[labels[i], used] += np.minimum(n, REPEATS)
            words[labels[i]] += np.minimum(np.unique(forms[0, a:b], return_counts=True)[1], REPEATS).sum()
    counts = counts[:, :BUCKETS]
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, used)), pa.array(np.append(words[1], counts[1, used])), pa.array(np.append(words[0], counts[0, used]))], names=["bucket", "toxic", "clean"])


def token_weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds with an informative Dirichlet prior, 0 where within MARGIN errors."""
    prior = PRIOR * (toxic + clean)
    a, b = toxic + prior, clean + prior
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(a / (n_toxic + PRIOR * (n_toxic + n_clean))) - np.log(b / (n_clean + PRIOR * (n_toxic + n_clean)))
        error = np.sqrt(1 / a + 1 / b)
        return np.where((toxic + clean >= LEAST) & (np.abs(odds) > MARGIN * error), odds, 0.0)


def token_scores(weights: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """The weight of each word's form that stands out most, less DRIFT."""
    each = weights[forms]
    return each[np.abs(each).argmax(axis=0), np.arange(each.shape[1])] - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) of a score sequence, by
    the linear-time list of candidates with left and right cumulative sums."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    found: list[list] = []
    for i in np.flatnonzero(scores > 0):
        left, right, begin, end = sums[i], sums[i + 1], i, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([begin, end, left, right, j])
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return [(int(b), int(e), float(r - lo)) for b, e, lo, r, _ in found]


def significance(found: list[tuple[int, int, float]], tokens: int, rate: float, scale: float) -> float:
    """Sum over segments of -log10 of their chance, those of one or more left out."""
    total = 0.0
    for _, _, score in found:
        total += max(0.0, rate * score - np.log(max(scale * max(tokens, 1), 1e-300))) / np.log(10)
    return total


def _rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1; where there is none, 1."""
    p = counts / counts.sum()
    if not (scores > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda r: np.log((p * np.exp(np.minimum(r * scores, 700))).sum())
    while value(high) < 0 and high < 1e3:
        low, high = high, high * 2
    low = max(low, 1e-6)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def fit(train: DataFrame) -> Model:
    """A model from labelled rows (doc_id, text, toxic).

    Rows without a label of 0 or 1 are ignored; null texts are empty. With
    labels of one kind only, or none, scores are the share of label 1 (0
    without rows).
    """
    rows = train.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    rows = keep(rows.withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(FOLDS))))
    sizes = {r["toxic"]: r["n"] for r in rows.where("fold > 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    tally = rows.where("fold > 0").select("text", "toxic").mapInArrow(_tally, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    table = tally.where(F.col("toxic") + F.col("clean") >= LEAST).toPandas()  # BUCKETS + 1 rows at most
    toxic, clean = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    toxic[table["bucket"]], clean[table["bucket"]] = table["toxic"], table["clean"]
    n_toxic, n_clean = toxic[-1], clean[-1]
    toxic[-1] = clean[-1] = 0
    weights = token_weights(toxic, clean, n_toxic, n_clean)
    marked = weights != 0
    plain = max(1.0, n_clean - clean[marked].sum())
    rate = _rate(np.append(weights[marked], 0.0) - DRIFT, np.append(clean[marked], plain)) if n_clean else 1.0

    shared = train.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def best(batches):
        for block, first, forms in _blocks(batches):
            scores = token_scores(shared.value, forms)
            found = [segments(scores[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("toxic"), pa.array(np.diff(first)), pa.array([[s for _, _, s in f] for f in found], pa.list_(pa.float64()))], names=["key", "toxic", "tokens", "scores"])

    sample = rows.where("fold = 0").select("key", "text", "toxic").mapInArrow(best, "key string, toxic int, tokens long, scores array<double>")
    held = sample.orderBy(F.xxhash64("key", "toxic"), "tokens", "scores").limit(CALIBRATION).toPandas()
    clean_rows = held[held["toxic"] == 0]
    # the median of rate * max - log(tokens) is log K - log(log 2)
    shifted = [rate * max(s) - np.log(max(n, 1)) for s, n in zip(clean_rows["scores"], clean_rows["tokens"], strict=True) if len(s)]
    scale = float(np.exp(np.median(shifted) + np.log(np.log(2)))) if shifted else 1e-3
    x = np.array([significance([(0, 0, v) for v in s], n, rate, scale) for s, n in zip(held["scores"], held["tokens"], strict=True)])
    slope, base = _logistic(np.log1p(x), held["toxic"].to_numpy(float))
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return Model(weights.astype(np.float32), rate, scale, slope, base, share)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a light ridge; (0, the share's logit) without both labels."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(np.unique(y)) < 2:
        return 0.0, float(np.log(share / (1 - share)))
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + 1e-3 * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(w[0]), float(w[1])


ADDED = ("score", "n_segments", "worst_begin", "worst_end")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score, n_segments, worst_begin and worst_end added (replaced
    where they exist).

    score is in 0..1, rounded to 6 digits; n_segments counts the significant
    segments, the worst one is given in tokens (null without one). Null and
    empty texts get the score of a text without any segment. Nothing but the
    text is an input of the score; repeated rows get equal scores.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.weights)
    rate, scale, slope, base = model.rate, model.scale, model.slope, model.base
    rows = docs.drop(*ADDED)
    kept = rows.columns

    def run(batches):
        for block, first, forms in _blocks(batches):
            each = token_scores(shared.value, forms)
            scores, counts, begins, ends = [], [], [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                found = segments(each[a:b])
                limit = np.log(max(scale * max(b - a, 1), 1e-300))
                real = [s for s in found if rate * s[2] > limit]
                x = np.log1p(significance(real, b - a, rate, scale))
                scores.append(round(float(1 / (1 + np.exp(-np.clip(slope * x + base, -30, 30)))), 6))
                counts.append(len(real))
                worst = max(real, key=lambda s: (s[2], -s[0]), default=(None, None))
                begins.append(worst[0])
                ends.append(worst[1])
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=[*kept, *ADDED])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, score double, n_segments long, worst_begin long, worst_end long")


def held_out() -> F.Column:
    """Rows that never teach: crc32 of doc_id as text leaves 1 when divided by 3.
    Rows without doc_id are none; they have no label either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def teach(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents that are not held out."""
    marks = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels grow with the documents: they are shuffled, not broadcast, at every size
    return fit(docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id"))
