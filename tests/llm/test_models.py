"""Classifiers, neighbours, mixing, the pipeline."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from nodelake.llm import language_id, mixing, neighbours, quality_classifier, toxicity

from ..conftest import SF, rows

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


def test_quality_on_held_out_rows(more, odd, none, spark):
    docs, labels = more
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    strange = quality_classifier.classify(odd, labels.withColumn("doc_id", F.lit(None).cast("long"))).toPandas()
    assert len(strange) == 14 and set(strange.score) == {0.5}
    few = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (10, 0), (None, 1), (3, None), (7, 1), (8, 1)], "doc_id long, quality int")
    assert quality_classifier.classify(odd, few).where("score >= 0 and score <= 1").count() == 14
    assert quality_classifier.classify(none, few).count() == 0


def test_isotonic():
    x, y = quality_classifier.isotonic(np.arange(5.0), np.array([0, 0.5, 0.2, 0.2, 1]), np.ones(5))
    assert y.tolist() == pytest.approx([0, 0.3, 1]) and x.tolist() == pytest.approx([0, 2, 4])


def test_language_on_held_out_rows(more, odd, none):
    vocabulary = P.path("piece_bpe_32k.model")
    docs, _ = more
    got = language_id.identify(docs, vocabulary).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()
    strange = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, vocabulary, keep=("score", "key")).select("doc_id", "lang_pred").collect()}
    assert {(4, "und"), (5, "und"), (6, "und")} <= strange and not {i for i, p in strange if p == "und"} - {4, 5, 6}
    assert language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")), vocabulary).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.identify(none, vocabulary).count() == 0


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(["▁", "▁a", "a", "ab", "b"])
    p = dict(zip(pieces.pieces, [0.1, 0.2, 0.3, 0.15, 0.25], strict=True))
    table = np.append([p[x] for x in pieces.pieces], 0.0)[:, None]

    def total(rest):
        if not rest:
            return 1.0
        return sum(p[x] * total(rest[len(x) :]) for x in p if rest.startswith(x)) + language_id.UNKNOWN * total(rest[1:])

    for word in ("ab", "aabb", "z", "b"):
        assert np.exp(pieces.log_probabilities([word, "a"], table)[0, 0]) == pytest.approx(total("▁" + word))
    counts = pieces.expected(["ab"], np.array([2.0]), table[:-1, 0])
    ways = [(["▁", "a", "b"], 0.1 * 0.3 * 0.25), (["▁", "ab"], 0.1 * 0.15), (["▁a", "b"], 0.2 * 0.25)]
    whole = sum(w for _, w in ways)
    assert counts == pytest.approx([2 * sum(w for s, w in ways if x in s) / whole for x in pieces.pieces], rel=1e-3)


def test_language_prediction_against_plain_sums(spark, docs):
    """Scores of whole texts by a plain recursion over every segmentation, also of words of any length."""
    import math

    vocabulary = P.path("piece_bpe_32k.model")
    odd_words = [(90_001, "donaudampfschifffahrtsgesellschaftskapitänswitwenrentenversicherung " * 3), (90_002, "thequickbrownfoxjumpsoverthelazydog" * 40), (90_003, "中文没有空格的句子" * 9)]
    some = docs.where("length(text) < 1500").limit(40).select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, None) for i, t in odd_words], "doc_id long, text string, lang string")).cache()
    pieces = language_id.Pieces(language_id.read_pieces(vocabulary))
    languages, table = language_id.train(some, pieces, sample_docs=1500, rounds=3, most_languages=9)
    where, most = {p: i for i, p in enumerate(pieces.pieces)}, max(map(len, pieces.pieces))

    def plain(word, k):
        word, total = "▁" + word, [0.0]
        for end in range(1, len(word) + 1):
            ways = [total[end - 1] + math.log(language_id.UNKNOWN)] + [total[s] + math.log(table[where[word[s:end]], k]) for s in range(max(0, end - most), end) if word[s:end] in where]
            total.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
        return total[-1]

    for r in language_id.identify(some, vocabulary, most_languages=9).join(some.select("doc_id", "text"), "doc_id").collect():
        total = np.array([sum(plain(w, k) for w in language_id.words_of(r["text"])) for k in range(len(languages))])
        assert r["lang_pred"] == languages[int(total.argmax())] and r["score"] == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-6)
    with pytest.raises(Exception, match="more than 1 languages"):
        language_id.identify(some, vocabulary, most_languages=1)


def test_ridge_equals_a_direct_solution(more):
    docs, labels = more
    stats = quality_classifier.statistics(docs, "doc_id", "text").repartition(70).cache()
    model = quality_classifier.fit(stats, labels, features=24, ridge=1.0, seed=7, label_id_col="doc_id", label_col="quality")
    rows_ = stats.where(~quality_classifier.held_out()).join(labels.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id").toArrow().combine_chunks()
    z, y = model.features(rows_.to_batches()[0]), rows_.column("y").to_numpy()
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    direct = np.linalg.solve(z.T @ (z * weight[:, None]) + np.eye(z.shape[1]), z.T @ (weight * y))
    assert model.weights == pytest.approx(direct, rel=1e-6, abs=1e-8)


def test_ordinal_fit_is_at_its_maximum():
    r = np.random.default_rng(2)
    rows_ = [sorted(r.choice(6, r.integers(0, 4), replace=False).tolist()) for _ in range(400)]
    grade = np.clip(np.array([sum(1 for i in x if i < 3) for x in rows_]) + (r.random(400) < 0.15), 0, 3)
    weights, thresholds = toxicity.fit(rows_, grade, 6, ridge=1e-2, steps=3000)
    share = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / (grade == 0).sum())

    def likelihood(w, t):
        over = toxicity.logistic(np.array([sum(w[i] for i in x) for x in rows_])[:, None] - t)
        edge = np.hstack([np.ones((400, 1)), over, np.zeros((400, 1))])
        i = np.arange(400)
        return (share * np.log(edge[i, grade] - edge[i, grade + 1])).sum() - 1e-2 / 2 * (w**2).sum()

    assert (np.diff(thresholds) > 0).all() and (weights >= 0).all()
    for k in range(6):
        step = np.eye(6)[k] * 1e-4
        slope = (likelihood(weights + step, thresholds) - likelihood(weights - step, thresholds)) / 2e-4
        assert abs(slope) < 2e-3 if weights[k] > 1e-3 else slope < 2e-3
    for k in range(3):
        step = np.eye(3)[k] * 1e-4
        assert abs(likelihood(weights, thresholds + step) - likelihood(weights, thresholds - step)) / 2e-4 < 2e-3


def test_toxicity_on_planted_rows(spark, odd, none):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows_, labels = [], []
    for i in range(900):
        text = list(r.choice(words, 40))
        toxic = i % 6 == 0
        for _ in range(1 + i % 4 if toxic else 0):
            text[r.integers(40)] = str(r.choice(["vilest", "badlyx", "badlyzz"]))
        rows_.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, marks).join(marks, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98 and got[got.toxic == 1].severity.mean() > 1 > got[got.toxic == 0].severity.mean()
    assert toxicity.score(odd, marks).count() == 14 and toxicity.score(odd, marks.limit(0)).where("severity > 0.001").count() == 0
    assert toxicity.score(none, marks).count() == 0


def test_neighbours_recall_and_order(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = neighbours.nearest(table, F.col("id") % 5 == 0, k=20, parts=4).toPandas()
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    hit = total = 0
    for q, own in got.groupby("query_id"):
        scores = sorted(((-(e[q] * v).sum(), i) for i, v in e.items() if i != q))[:20]
        assert own.sort_values("rank")["rank"].tolist() == list(range(1, 21))
        hit, total = hit + len({i for _, i in scores} & set(own.vec_id)), total + 20
        for _, r in own.iterrows():
            assert r.score == pytest.approx((e[q] * e[r.vec_id]).sum(), abs=1e-12)
    assert hit / total >= 0.9


def test_neighbours_of_odd_rows(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.5]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (11, [float("inf"), 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<double>, id string, v int")
    got = rows(neighbours.nearest(table, F.col("id").isin(0, 3, 7), k=2, parts=3))
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (7, 1, 0, -1.0), (7, 2, 1, -2.0)]
    assert neighbours.nearest(table.limit(0), F.lit(True), parts=3).count() == 0


def test_large_buckets_are_cut(spark, monkeypatch):
    same = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    got = rows(neighbours.nearest(same, F.col("id") == 70, k=3, parts=3, tables=1, probes=1))
    assert [(r[1], r[2]) for r in got] == [(1, 0), (2, 1), (3, 2)]


def test_mixing_meets_its_targets(docs, odd, none):
    wanted = {"source": 0.5, "lang": {"en": 4, "fr": 2, "de": 2, "es": 2}, "topic": 1.0}
    got = mixing.sample(docs, temper=wanted, rounds=30).cache()
    share = dict(rows(mixing.shares(got, "lang")))
    assert share == pytest.approx({"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}, abs=1e-3)
    assert got.agg(F.max("probability")).collect()[0][0] == 1.0 and 0 < got.where("kept").count() < got.count()
    strange = mixing.sample(odd, keep=("key", "kept"))
    assert strange.count() == 14 and strange.where("source = 'unknown'").count() == 2 and strange.where("probability is null").count() == 0
    assert mixing.sample(none).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    from .test_copies import cut, groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, kept = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == corpus_pipeline.COLUMNS
        out.append({r["doc_id"]: r["text"] for r in kept.collect()})
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(out[0]) == {i for i, t in start.items() if any(c.isalpha() for c in t)}
    assert set(out[1]) == {i for i, _, g in groups(out[0].items()) if i == g}
    left = {i: (n, gone, sha) for i, n, gone, _, sha in cut(out[1].items(), 50)}
    assert set(out[2]) == {i for i, (n, gone, _) in left.items() if not gone or gone < n}
    import hashlib

    whole = [i for i in out[2] if hashlib.sha256(out[2][i].encode()).hexdigest() == left[i][2]]
    assert len(whole) >= 0.95 * len(out[2])  # the rest were cut inside a character
    assert set(out[3]) <= set(out[2]) and len(out[3]) > 0.5 * len(out[2])
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == set(out[3])


def test_pipeline_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for data in (odd, none):
        kept = data
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF).cache()
        assert kept.count() <= data.count()
