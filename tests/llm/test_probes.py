"""The order of probes, and the setting that is fitted to a table."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from nodelake.llm import neighbours


def test_probes_are_the_likeliest_cells():
    t = neighbours.Tables(6, 2, 3, 1.0, 13, 1)
    v = np.random.default_rng(3).normal(size=(5, 6))
    place, got = t.places(v), t.visited(v)
    for table, row in itertools.product(range(2), range(5)):
        home = np.floor(place[table, row])
        inside = place[table, row] - home
        cells = sorted(itertools.product((-1, 0, 1), repeat=3), key=lambda c: sum((d if s < 0 else 1 - d) ** 2 for s, d in zip(c, inside, strict=True) if s))
        sums = np.array([((home + c).astype(np.int64).view(np.uint64) * t.salt[table]).sum(dtype=np.uint64) for c in np.array(cells)])
        assert got[table, row].tolist() == neighbours.mixed(sums)[:13].tolist()
    assert (got[:, :, 0] == t.own(v)).all()


def test_first_visits():
    visited, own = np.array([[7, 5, 9], [1, 2, 3]], np.uint64), np.array([[5, 8, 9, 9], [8, 8, 3, 1]], np.uint64)
    assert neighbours.first_visits(visited, own).tolist() == [1, 3, 2, 0]


def share(spark, n: int) -> float:
    v = np.random.default_rng(8).normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist(), i % 20 == 0) for i, x in enumerate(v)], "id long, v array<double>, query boolean")
    t = neighbours.fitted(rows, neighbours.least(rows.where("query"), 64, n // 20), neighbours.least(rows, 4000, n), None, 16, 10, n, 10, [(8, 1.0), (8, 1.5), (8, 2.0), (12, 1.5), (12, 2.0), (12, 2.5)], None, 0.94, 5)
    asked = v[::20][:60]
    s = asked @ v.T
    s[np.arange(len(asked)), np.arange(0, n, 20)[: len(asked)]] = -9
    near = [v[r] for r in np.argsort(-s, axis=1)[:, :10]]
    hit, reached = neighbours.curves(t, v, asked, near)
    assert hit[-1] >= 0.9
    return reached[-1]


def test_more_rows_are_searched_in_smaller_shares(spark):
    assert share(spark, 8000) < 0.8 * share(spark, 1000)


def test_given_settings_are_kept(spark):
    rows = spark.range(30).select("id", F.array(F.col("id") * 1.0 + 1, F.lit(1.0)).alias("v"), (F.col("id") < 3).alias("query"))
    t = neighbours.fitted(rows, rows.where("query"), rows, None, 2, 2, 30, 3, [(4, 2.0)], 7, 0.94, 5)
    assert (t.cuts, t.cell, t.probes, t.tables) == (4, 2.0, 7, 3)


def test_least_and_longest_are_whole(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LONGEST", 40)
    rows = spark.range(3000).select("id", F.array(F.col("id") % 500 + 1.0).alias("v"), F.lit(True).alias("query"))
    kept = [r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(70).collect()]
    assert [r["id"] for r in neighbours.least(rows, 70, 3000).collect()] == kept
    assert len(neighbours.least(rows, 5000, 3000).collect()) == 3000
    got = [r["id"] for r in neighbours.longest_of(rows, F.col("v")[0], 1.0, 500.0, 97).collect()]
    assert got == sorted(range(3000), key=lambda i: (-(i % 500), i))[:40]
