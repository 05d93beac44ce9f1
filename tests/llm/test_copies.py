"""Near copies and repeated passages against brute force."""

import hashlib
import random
import re
import string
from collections import defaultdict

import numpy as np
import pytest

from nodelake.llm import components, ngram_join, shared_keys, suffix_dedup

from ..conftest import rows
from .conftest import COPY, LONG

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def groups(data, percent=80, width=5):
    """doc_id -> (shingles, least doc_id reachable), by comparing all pairs that share one."""
    sets = {}
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets.items())


def variants(seed, n):
    """Chains of edits, shared passages and exact copies, so that leaders, rounds and the last meeting all have work."""
    r, out = random.Random(seed), []
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(n):
        kind = r.random()
        if kind < 0.5 and out:
            words = r.choice(out)[:]
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        elif kind < 0.75:
            words = passage + [r.choice(vocabulary) for _ in range(r.choice([3, 6, 9, 15]))]
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([2, 4, 5, 30, 90]))]
        out.append(words)
    return [(i * 3 + 1, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("frequent, rounds", [(1, 1), (64, 3)])
def test_groups_against_brute_force(spark, frequent, rounds):
    data = variants(frequent, 160)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert rows(ngram_join.join_groups(frame, frequent=frequent, rounds=rounds, buckets=5)) == groups(data)


def cousins(seed, members, base=220):
    """Texts made from one that is not among them, each with so many edits that few of them link."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    root, out = [r.choice(vocabulary) for _ in range(base)], []
    for i in range(members):
        words = root[:]
        for at in r.sample(range(base), r.choice([1, 2, 3, 3, 4, 4, 5, 6])):
            words[at] = r.choice(vocabulary)
        out.append((i + 1, " ".join(words)))
    return out


def test_pairs_of_a_family_do_not_grow_with_its_square(spark, monkeypatch):
    met = []

    def watched(f):
        def run(*args):
            met.append(f(*args).cache())
            return met[-1]

        return run

    for name in ("meeting_pairs", "relative_pairs"):
        monkeypatch.setattr(ngram_join, name, watched(getattr(ngram_join, name)))
    data = cousins(5, 180) + [(1000 + i, t) for i, t in cousins(6, 60, 120)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert rows(ngram_join.join_groups(frame, rounds=1, buckets=5)) == groups(data)
    found = [m.count() for m in met]
    print("pairs checked", found)
    assert len(found) == 2 and sum(found) < 5 * len(data)  # of 16,110 and 1,770 pairs


def test_groups_of_odd_rows(odd, none):
    got = rows(ngram_join.join_groups(odd, rounds=1, buckets=3).na.fill(-1))
    tokens = len({tuple(LONG.split()[k : k + 5]) for k in range(30_000 - 4)})
    assert [r for r in got if r[0] in (1, 2, 3)] == [(1, 20, 1), (2, 20, 1), (2, 20, 1), (3, 21, 1)]
    assert (-1, 20, -1) in got and (4, 0, 4) in got and (5, 0, 5) in got and (6, 0, 6) in got and (8, 1, 8) in got and (10, 1, 10) in got and (7, tokens, 7) in got
    assert ngram_join.join_groups(none, rounds=1, buckets=3).count() == 0
    assert len(COPY.split()) == 24


def test_shingles_of_long_words_and_case():
    doc, token = ngram_join.shingles([b"A b C d E", b"a B c D e", b"a b c d", b"", b"a b c d x" + b"y" * 90_000], 5)
    assert list(np.bincount(doc, minlength=5)) == [1, 1, 1, 0, 1] and token[0] == token[1] and len(set(token.tolist())) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (7, 7)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 103: 100, 105: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(data, width):
    """What is left of each document, window by window."""
    first, out = {}, []
    for i, t in data:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - width + 1):
                w = b[k : k + width]
                first[w] = min(first.get(w, i), i)
    for i, t in data:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if i is not None and first[b[k : k + width]] < i:
                gone[k : k + width] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((-1 if i is None else i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 1024])
def test_dedup_against_brute_force(spark, docs, hot):
    data = variants(7, 60) + [(1000 + i, "Released to all who may want it, in whole or part, by us.\n" + t) for i, t in variants(8, 12)]
    data += [(2001, "é" * 80), (2000, "é" * 90 + "x"), (2002, "ab" * 60), (2003, "ba" * 60)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert rows(suffix_dedup.dedup(frame, width=50, buckets=5, hot_docs=hot)) == cut(data, 50)


def test_dedup_of_real_and_odd_rows(docs, odd, none):
    some = docs.where("length(text) < 4000")
    assert rows(suffix_dedup.dedup(some, buckets=4)) == cut([(r["doc_id"], r["text"]) for r in some.collect()], 50)
    short = odd.where("doc_id is null or doc_id <> 7")
    assert rows(suffix_dedup.dedup(short, buckets=4).na.fill(-1, ["doc_id"])) == cut([(r["doc_id"], r["text"]) for r in short.collect()], 50)
    kept = suffix_dedup.dedup(odd, buckets=4, with_text=True, keep=("key", "score"))
    assert kept.columns[-3:] == ["kept_text", "key", "score"] and kept.where("doc_id = 7").collect()[0]["kept_text"] == LONG
    assert suffix_dedup.dedup(none, buckets=4).count() == 0


def test_zones_that_share_no_window_are_not_compared_by_bytes(spark):
    """Texts with 28 bytes in common share anchors but no window of 50: step 3 gets none of them; with 60 it does."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice(string.ascii_lowercase) for _ in range(n))
    for size, opened in ((28, False), (60, True)):
        common = word(size)
        texts = [(word(80) + common + word(80)).encode() for _ in range(6)]
        _, _, _, h, _, _ = suffix_dedup.zones(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), 50, whole=True)
        codes = suffix_dedup.code(h, 4).astype("<u4").tobytes()
        chosen = spark.createDataFrame([(i + 1, i + 1, bytearray(t), bytearray(codes)) for i, t in enumerate(texts)], "key long, doc_id long, text binary, open binary")
        hot = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
        assert (suffix_dedup.by_zone(chosen, 50, 4, hot).where(f"kind = {suffix_dedup.OPEN}").count() > 0) == opened


def test_answers_come_in_one_row_for_each_text(spark):
    keys = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def keys_of(batch):
        for owner in batch.column("owner").to_pylist():
            yield np.full(len(keys), owner), keys

    got = shared_keys.shared_keys(spark.createDataFrame([(i * 7919,) for i in range(6)], "owner long").repartition(3), keys_of, 5, hot=4, by_owner=True).collect()
    told = {o: np.frombuffer(v, "<u4") for o, _, v in got if o is not None}
    assert sorted(o for o, _, _ in got if o is not None) == sorted(told) and len(told) == 6
    assert all(sorted(v.tolist()) == sorted((keys & np.uint64(0xFFFFFFFF)).tolist()) for v in told.values())
    assert sum(len(v) // 8 for o, _, v in got if o is None) == len(keys)


@pytest.mark.parametrize("hot", [2, 1024])
def test_dedup_of_texts_of_few_words(spark, hot):
    """Windows are shared in every part, around and beside their anchors."""
    r = random.Random(11)
    vocabulary = ["a", "of", "the", "river", "mountains", "understanding", "x"]
    data = [(i * 2 + 1, " ".join(r.choice(vocabulary) for _ in range(r.choice([9, 20, 60])))) for i in range(90)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(suffix_dedup.dedup(frame, width=50, buckets=5, hot_docs=hot)) == cut(data, 50)


def test_least_equal_window():
    r = np.random.default_rng(1)
    data = r.integers(0, 2, 400).astype(np.uint8)
    start, value = np.arange(380), r.integers(0, 99, 380)
    want = [min(value[j] for j in range(380) if (data[j : j + 11] == data[i : i + 11]).all()) for i in range(380)]
    assert suffix_dedup.smallest(data, start, value, 11).tolist() == want
