"""Operators on single texts: tokens, BPE, rules."""

import hashlib
import re

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from nodelake.llm import byte_bpe, quality_rules, queries, token_counts

from ..conftest import SF, rows
from .conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts_equal_the_library(spark, odd, docs, none):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = lambda data: sorted((-1 if i is None else i, len((t or "").encode()), count(t), count(t) > 5) for i, t in data)
    got = token_counts.token_counts(odd, P.path("word_bpe_49k.json"), limit=5, sample_docs=3).na.fill(-1, ["doc_id"])
    assert rows(got) == want([(i, t) for i, t, _, _ in TEXTS])
    got = token_counts.token_counts(docs, P.path("word_bpe_49k.json"), limit=5)
    assert rows(got) == want([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert token_counts.token_counts(none, P.path("word_bpe_49k.json")).count() == 0


def test_frequent_pre_tokens_are_counted_in_all_documents(spark, monkeypatch):
    """4,000 rows, and a text of over 65,536 characters that alone makes one pre-token the most frequent."""
    monkeypatch.setattr(token_counts, "FLUSH", 3)
    data = [(i, f"common once{'abcdefgh'[i % 8]}") for i in range(4000)] + [(4000, "rare " * 20_000), (4001, None)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = token_counts.frequent_lengths(frame, P.path("word_bpe_49k.json"), 3)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert got == {x: len(library.encode(x, add_special_tokens=False).ids) for x in ("rare", "common")}


def test_what_an_encoder_remembers_goes_with_its_task(spark, docs):
    byte_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count()
    byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).write.format("noop").mode("overwrite").save()

    def left(batches):
        import gc

        for _ in batches:
            n = sum(type(x).__name__ == "Encoder" and type(x).__module__ == "nodelake.llm.byte_bpe" for x in gc.get_objects())
            yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    assert sum(r["n"] for r in docs.select("doc_id").mapInArrow(left, "n long").collect()) == 0


def test_bpe_equals_the_library(spark, odd, docs, none):
    vocabulary = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={e: i for i, e in enumerate(byte_bpe.read_ranks(vocabulary))}, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def want(data):
        out = []
        for i, t in data:
            ids = library.encode_ordinary(t or "")
            out.append((-1 if i is None else i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
        return sorted(out)

    assert rows(byte_bpe.round_trip(odd, vocabulary, P.PATTERN).na.fill(-1, ["doc_id"])) == want([(i, t) for i, t, _, _ in TEXTS])
    assert rows(byte_bpe.round_trip(docs, vocabulary, P.PATTERN)) == want([(r["doc_id"], r["text"]) for r in docs.collect()])
    encoded = byte_bpe.encode(odd.where("doc_id = 9"), vocabulary, P.PATTERN)
    text = next(t for i, t, _, _ in TEXTS if i == 9)
    assert encoded.collect()[0]["ids"] == library.encode_ordinary(text)
    assert bytes(byte_bpe.decode(encoded, vocabulary).collect()[0]["bytes"]).decode() == text
    assert byte_bpe.round_trip(none, vocabulary, P.PATTERN).count() == 0


def test_merges_reproduce_plain_merging():
    entries = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    encoder = byte_bpe.Encoder(entries, byte_bpe.Merges(entries), P.PATTERN)
    for piece in (b"a" * 700, b"ab" * 99, b"\xff\xfe\x00", b" the" * 20, "éèê".encode() * 9):
        assert [entries[i] for i in encoder.encode_piece(piece)] == byte_bpe.merge_by_rank(piece, encoder.rank, len(entries))


def measured(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(odd, docs, none):
    for data in (odd, docs):
        got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.ledger(data).collect()}
        assert got == {(r["doc_id"], *measured(r["text"])) for r in data.collect()}
    assert quality_rules.ledger(none).count() == 0 and quality_rules.ablation(quality_rules.ledger(none), "base").count() == len(quality_rules.RULES)


def test_policies_and_ablation(docs):
    ledger = quality_rules.ledger(docs).cache()
    for version, policy in quality_rules.POLICIES.items():
        kept = quality_rules.apply_policy(ledger, version)
        table = {r["rule"]: r for r in quality_rules.ablation(ledger, version).collect()}
        n = ledger.where(quality_rules.passes(policy, ledger["failed"])).count()
        assert {r["n_kept"] for r in table.values()} == {n} and all(r["n_kept_without"] >= n for r in table.values())
        assert kept.where("kept and base_failed").count() == 0
    lenient = quality_rules.POLICIES["2024-lenient"]
    one, two = quality_rules.bits(("symbols",)), quality_rules.bits(("symbols", "shouting"))
    from pyspark.sql import functions as F

    row = ledger.limit(1).select(quality_rules.passes(lenient, F.lit(one)), quality_rules.passes(lenient, F.lit(two)), quality_rules.passes(lenient, F.lit(two), one)).collect()[0]
    assert tuple(row) == (True, False, True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql("SELECT " + ", ".join(columns) + f" FROM ({queries.ORACLES[name]})").fetchall()
    assert rows(df.select(*columns)) == sorted(want)
