"""Recall of the neighbours on vectors of unequal lengths."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nodelake.llm import neighbours


def directions(n, dimension=64):
    """Unit vectors around a hundred centres."""
    r = np.random.default_rng(4)
    v = r.normal(size=(100, dimension))[r.integers(0, 100, n)] + r.normal(size=(n, dimension))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def recall(spark, v, every, k=20):
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": list(v)})).repartition(4)
    got = neighbours.nearest(table, F.col("id") % every == 0, k=k, parts=8).toPandas()
    hit = 0
    for q in range(0, len(v), every):
        s = v @ v[q]
        s[q] = -np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, k + 1))
        hit += len(set(np.argsort(-s)[:k]) & set(own.vec_id))
    return hit / (k * len(range(0, len(v), every)))


@pytest.mark.parametrize("case", ["equal", "one long", "lognormal", "wide"])
def test_recall_at_unequal_lengths(spark, case):
    v, r = directions(20_000), np.random.default_rng(7)
    if case == "one long":
        v[7] *= 3
    elif case != "equal":
        v *= r.lognormal(0, 0.5 if case == "lognormal" else 1.0, len(v))[:, None]
    found = recall(spark, v, 200)
    print(case, found)
    assert found >= 0.9
