"""Toxicity as an ordinal severity: a cumulative-link model over sparse text features.

Features are lower-cased words and their first 4 to 6 letters (``word`` and ``pref*``). Labels say only
toxic or not, so the grades are built from the learning rows: 0 for a row that is not toxic, 1 for a
toxic one, 2 with two or more marked words and 3 with four or more, where a marked word has a feature
that the labels tie to toxic texts. One weight per feature (0 or more)
serves every threshold: P(grade > j) = logistic(w . x - t_j) with t_0 < t_1 < t_2. The severity is the
expected grade, the sum of these three; a text is predicted toxic where P(grade > 0) >= 0.5.

The model is learnt from a bounded sample: ``sample_docs`` labelled documents at most in expectation,
picked by a hash of the id, and ``features`` features at most. Feature counts are summed on the
executors; the driver gets the candidates (``candidates`` at most) and, for each sampled document, the
few chosen features it has.

Defined results: a null or empty text has no features; a null ``doc_id`` is scored, never learnt from
and not held out; null labels are ignored and several labels of a document count as their maximum;
without toxic labels every severity is 0; repeated rows give repeated rows; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodelake.session import small_batches, stored

WORDS = re.compile(r"[^\W\d_]+")
GRADES = 3
OUT = "doc_id long, held_out boolean, severity double, score double, predicted int"


def features_of(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in (4, 5, 6) if len(word) >= n]


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights by feature and the ordered thresholds."""

    def __init__(self, names: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.where, self.weights, self.thresholds = {x: i for i, x in enumerate(names)}, weights, thresholds
        self.by_word: dict[str, tuple[int, ...]] = {}

    def found(self, text: str) -> tuple[set[int], int]:
        """Chosen features of a text, and how many of its words have one."""
        ids, hits, words = set(), 0, WORDS.findall(text.lower())
        for w in words:
            own = self.by_word.get(w)
            if own is None:
                own = tuple(self.where[f] for f in features_of(w) if f in self.where)
                if len(self.by_word) > 300_000:
                    self.by_word.clear()
                self.by_word[w] = own
            if own:
                ids.update(own)
                hits += 1
        return ids, hits

    def over(self, text: str) -> np.ndarray:
        ids, _ = self.found(text)
        return logistic(sum((self.weights[i] for i in ids), 0.0) - self.thresholds)


def fit(rows: list[list[int]], grade: np.ndarray, n: int, *, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood of the grades (Adam, full batch)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([i for r in rows for i in r], np.int64)
    y = np.clip(grade, 0, GRADES)
    p = np.zeros(n + GRADES)  # weights, first threshold, logs of the steps to the next ones
    p[n] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([[p[n]], np.exp(p[n + 1 :])]))
        eta = np.bincount(at, p[feature], len(rows))
        over = logistic(eta[:, None] - t)  # P(grade > j)
        edge = np.hstack([np.ones((len(rows), 1)), over, np.zeros((len(rows), 1))])
        slope = np.hstack([np.zeros((len(rows), 1)), over * (1 - over), np.zeros((len(rows), 1))])
        i = np.arange(len(rows))
        prob = np.maximum(edge[i, y] - edge[i, y + 1], 1e-12)
        d_eta = share * (slope[i, y] - slope[i, y + 1]) / prob
        d_t = np.zeros(GRADES)
        for j in range(GRADES):
            d_t[j] = (share * (np.where(y == j, slope[:, j + 1], 0) - np.where(y == j + 1, slope[:, j + 1], 0)) / prob).sum()
        g = np.concatenate([np.bincount(feature, d_eta[at], n) - ridge * p[:n], [d_t.sum()], [d_t[j:].sum() * np.exp(p[n + j]) for j in range(1, GRADES)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.1 * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        p[:n] = np.maximum(p[:n], 0)  # what ties a text to the toxic ones never speaks against it
    return p[:n], np.cumsum(np.concatenate([[p[n]], np.exp(p[n + 1 :])]))


def surprise(k: int, n: int, p: float) -> float:
    """Minus the log of a bound on the chance of ``k`` or more out of ``n`` at rate ``p``; 0 if k/n <= 3p or half."""
    q = k / n
    if q <= max(0.5, min(3 * p, 0.9)):
        return 0.0
    return n * (q * np.log(q / p) + (0 if q == 1 else (1 - q) * np.log((1 - q) / (1 - p))))


def counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """feature, toxic, clean: documents of each kind that have it, in partial counts by partition."""

    def count(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                own = {f for w in set(WORDS.findall((text or "").lower())) for f in features_of(w)}
                seen[y].update(own if wanted is None else own & wanted)
        names = list(seen[0].keys() | seen[1].keys())
        for lo in range(0, len(names), 50_000):
            some = names[lo : lo + 50_000]
            yield pa.record_batch([pa.array(some, pa.string()), pa.array([seen[1][f] for f in some], pa.int64()), pa.array([seen[0][f] for f in some], pa.int64())], ["feature", "toxic", "clean"])

    return rows.select("text", "y").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, *, sample_docs: int, candidates: int, features: int, label_id_col: str, label_col: str) -> Model:
    empty = Model([], np.zeros(0), np.full(GRADES, 50.0))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    usable = marks.where(F.coalesce(~held_out(), F.lit(False)))
    n = usable.count()
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0) < min(1.0, sample_docs / max(n, 1)))
    rows = stored(docs.select("doc_id", "text").join(picked, "doc_id").select("text", "y"), "toxicity-sample")
    sizes = dict(rows.groupBy("y").count().collect())
    if not sizes.get(1):
        return empty
    least = max(2, sizes[1] // 500)
    first = counted(rows.where("y = 1"), None).where(F.col("toxic") >= least).orderBy(F.desc("toxic"), "feature").limit(candidates)
    wanted = {r["feature"] for r in first.collect()}
    table = counted(rows, wanted).collect()
    share = sizes[1] / sum(sizes.values())
    # Ties to toxic rows that chance would give to fewer than one of all the candidates (Chernoff).
    odds = {r["feature"]: surprise(r["toxic"], r["toxic"] + r["clean"], share) for r in table if r["toxic"] >= least}
    chosen = sorted((f for f, o in odds.items() if o >= np.log(max(2, len(odds)))), key=lambda f: (-odds[f], f))
    counts = {r["feature"]: (r["toxic"], r["clean"]) for r in table}
    # Of features that say the same (a word and its beginnings), the longest stays.
    best: dict[tuple, str] = {}
    for f in chosen:
        twin = (f[:4], *counts[f])
        if twin not in best or len(f.rstrip("*")) > len(best[twin].rstrip("*")) or (f.rstrip("*") == best[twin].rstrip("*") and not f.endswith("*")):
            best[twin] = f
    names = [f for f in chosen if best[(f[:4], *counts[f])] == f][:features]
    if not names:
        return empty
    sketch = Model(names, np.zeros(len(names)), np.zeros(GRADES))

    def look(batches):
        for batch in batches:
            found = [sketch.found(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("y"), pa.array([sorted(f[0]) for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int64())], ["y", "ids", "hits"])

    seen = rows.mapInArrow(look, "y int, ids array<int>, hits long").collect()
    y, hits = np.array([r["y"] for r in seen]), np.array([r["hits"] for r in seen])
    grade = np.where(y == 1, 1 + (hits >= 2).astype(int) + (hits >= 4).astype(int), 0)
    weights, thresholds = fit([r["ids"] for r in seen], grade, len(names), ridge=1e-4, steps=800)
    return Model(names, weights, thresholds)


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    sample_docs: int = 20_000,
    candidates: int = 20_000,
    features: int = 4_000,
) -> DataFrame:
    """doc_id, held_out, severity (0 to 3), score (probability of any toxicity) and predicted of every row."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(plain, labels, sample_docs=sample_docs, candidates=candidates, features=features, label_id_col=label_id_col, label_col=label_col))

    def scored(batches):
        for batch in batches:
            over = np.array([model.value.over(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, GRADES)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(over.sum(axis=1), pa.float64()), pa.array(over[:, 0], pa.float64()), pa.array((over[:, 0] >= 0.5).astype("i4"), pa.int32())],
                ["doc_id", "held_out", "severity", "score", "predicted"],
            )

    return plain.withColumn("held_out", F.coalesce(held_out(), F.lit(False))).mapInArrow(scored, OUT)
