"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Document statistics are Spark columns, worked out once and kept as a small table. Standardised, they
go through ``features`` random cosines, which approximate a Gaussian kernel; the ridge weights solve
normal equations that are summed over partitions (one matrix of fixed size from each). Raw scores are
counted in fixed bins, and pooling adjacent violators over the bins gives the calibration.

Defined results: a null or empty text has all statistics 0 and gets a score like any other; a null
``doc_id`` is scored, never learnt from and not held out; labels that are null are ignored, and a
document with several labels takes their mean, rounded up at a half; repeated rows give repeated rows;
without any label every score is 0.5; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodelake.llm import text_stats as S
from nodelake.llm.sums import summed
from nodelake.session import stored

BINS = 2000
CLIP = 5.0
STATS = ["log_words", "word_length", "symbols", "bangs", "repeated_lines", "repeated_words", "distinct_words", "same_as_before", "capitals", "digits", "stops", "words_per_line"]
OUT = "doc_id long, held_out boolean, score double, predicted int"


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the STATS of the whole text, as doubles."""
    text = F.col("text")
    by_word = S.let(
        S.words(text),
        lambda w: F.struct(
            F.size(w).alias("n"),
            S.repeated_words(w).alias("windows"),
            F.size(F.array_distinct(w)).alias("distinct"),
            F.aggregate(F.sequence(F.lit(1), F.size(w)), F.lit(0), lambda a, i: a + F.coalesce((F.get(w, i) == F.get(w, i - 1)).cast("int"), F.lit(0))).alias("same"),
        ),
    )
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(
        "doc_id",
        by_word.alias("w"),
        S.word_chars(text).alias("chars"),
        S.let(S.lines(text), lambda x: F.struct(F.size(x).alias("n"), S.repeats(x).alias("dup"))).alias("l"),
        S.count_of(text, S.SYMBOLS).alias("symbols"),
        S.count_of(text, "!").alias("bangs"),
        S.count_of(text, "0123456789").alias("digits"),
        S.count_of(text, ".,;:").alias("stops"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"),
    )
    over = lambda x, n: x.cast("double") / F.greatest(n.cast("double"), F.lit(1.0))
    n, chars, lines = F.col("w.n"), F.col("chars"), F.col("l.n")
    values: list[Column] = [
        F.log1p(n.cast("double")), over(chars, n), over(F.col("symbols"), chars), over(F.col("bangs"), chars), over(F.col("l.dup"), lines),
        over(F.col("w.windows"), n), over(F.col("w.distinct"), n), over(F.col("w.same"), n), over(F.col("capitals"), chars),
        over(F.col("digits"), chars), over(F.col("stops"), n), F.log1p(over(n, lines)),
    ]
    return counted.select("doc_id", *[v.alias(name) for v, name in zip(values, STATS, strict=True)])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the pooled blocks of a non-decreasing fit."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    total = np.array(blocks).reshape(-1, 3)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


class Model:
    """Standardisation, cosines, weights, calibration: a few hundred kilobytes."""

    def __init__(self, mean, spread, features: int, seed: int):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.spread = mean, spread
        self.directions, self.phases = rng.normal(size=(d, features)) / np.sqrt(d / 2), rng.uniform(0, 2 * np.pi, features)
        self.weights: np.ndarray | None = None
        self.at, self.to = np.array([0.0]), np.array([0.5])

    def features(self, batch: pa.RecordBatch) -> np.ndarray:
        x = np.column_stack([np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False)) for c in STATS]).reshape(-1, len(STATS))
        x = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([np.ones((len(x), 1)), x / CLIP, z])

    def raw(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.clip(self.features(batch) @ self.weights, -0.5, 1.5) if self.weights is not None else np.zeros(batch.num_rows)

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.clip(np.interp(self.raw(batch), self.at, self.to), 0.0, 1.0)


def fit(stats: DataFrame, labels: DataFrame, *, features: int, ridge: float, seed: int, label_id_col: str, label_col: str) -> Model:
    """Learn from the labelled rows that are not held out (all of them; sums of fixed size)."""
    row = stats.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(STATS)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(STATS)]).collect()[0]
    d = len(STATS)
    model = Model(np.array([x or 0.0 for x in row[:d]]), np.array([x or 1.0 for x in row[d:]]), features, seed)
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id_col).cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    learnt = stats.where(F.coalesce(~held_out(), F.lit(False))).join(marks, "doc_id")
    size = 1 + d + features

    def equations(batches):
        total = np.zeros((2, size, size + 1))
        for batch in batches:
            z, y = model.features(batch), batch.column("y").to_numpy()
            for label in (0, 1):
                own = z[y == label]
                total[label, :, :size] += own.T @ own
                total[label, :, size] += own.sum(axis=0)
        return total.ravel()

    total = summed(learnt, equations, 2 * size * (size + 1)).reshape(2, size, size + 1)
    n = total[:, 0, size]
    if n.sum() == 0:
        return model
    share = np.where(n > 0, n.sum() / np.maximum(n, 1) / 2, 0)  # both labels weigh the same
    a = share[0] * total[0, :, :size] + share[1] * total[1, :, :size]
    model.weights = np.linalg.solve(a + ridge * np.eye(size), share[1] * total[1, :, size])

    def binned(batches):
        counts = np.zeros((2, BINS))
        for batch in batches:
            at = np.minimum(((model.raw(batch) + 0.5) / 2 * BINS).astype(int), BINS - 1)
            for label in (0, 1):
                counts[label] += np.bincount(at[batch.column("y").to_numpy() == label], minlength=BINS)
        return counts.ravel()

    counts = summed(learnt, binned, 2 * BINS).reshape(2, BINS)
    there = counts.sum(axis=0) > 0
    centres = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[there]
    model.at, model.to = isotonic(centres, (counts[1] / np.maximum(counts.sum(axis=0), 1))[there], counts.sum(axis=0)[there])
    return model


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    features: int = 192,
    ridge: float = 1.0,
    seed: int = 7,
) -> DataFrame:
    """doc_id, held_out, score (of label 1) and predicted of every row of ``docs``."""
    stats = stored(statistics(docs, id_col, text_col), "quality-statistics")
    model = stats.sparkSession.sparkContext.broadcast(fit(stats, labels, features=features, ridge=ridge, seed=seed, label_id_col=label_id_col, label_col=label_col))

    def scored(batches):
        for batch in batches:
            score = model.value.score(batch)
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype("i4"), pa.int32())]
            yield pa.record_batch(out, ["doc_id", "held_out", "score", "predicted"])

    return stats.withColumn("held_out", F.coalesce(held_out(), F.lit(False))).mapInArrow(scored, OUT)
