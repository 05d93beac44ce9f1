"""Language identification by unigram piece models summed over all segmentations.

The pieces come from a fixed public vocabulary (its lower-case letter pieces). Each language has
probabilities for them, learnt by expectation maximisation over words: a forward and a backward pass
give each piece's expected count over every segmentation of a word, and the counts are summed over
partitions. A word's probability under a language is the forward sum over all its segmentations; a
text's is the product over its words. Words are lower-cased runs of letters of any length (sums are
rescaled on the way, so a text without blanks is one word); workers remember the short words they have scored.

The probabilities are learnt from a bounded sample, about ``sample_docs`` documents of each language,
picked by a hash of the id; everything else covers all rows. All languages of ``lang`` are learnt; more than
``most_languages`` of them are an error, since the model (pieces by languages) must fit into a worker.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing could
be learnt; a null ``doc_id`` is predicted but never learnt from; equal languages go to the one that
sorts first; repeated rows give repeated rows; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodelake.errors import Validation
from nodelake.llm.sums import summed
from nodelake.session import small_batches, stored

WORDS = re.compile(r"[^\W\d_]+")
#: Probability of a character that no piece covers, in any language.
UNKNOWN = 1e-7
#: Numbers in a worker's cache of words (words times languages), and the longest word that goes into it.
CACHE, SHORT = 1_600_000, 64
#: Numbers of a table of sums at a time, and characters between two rescalings of it.
CELLS, STEP = 1_000_000, 16
OUT = "doc_id long, held_out boolean, lang_pred string, score double"
BASE = np.uint64(0x9E3779B97F4A7C15)

def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model that lower-cased words can hold; a leading bar starts a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = lambda p: p and p == p.lower() and p.replace("▁", "", 1).isalpha() or p == "▁"
    return sorted({p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and own(p := model.id_to_piece(i))})


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def portions(sizes: list[int], width: int) -> Iterator[slice]:
    """Parts of a list sorted by size, of CELLS numbers each (or one word) at ``width`` numbers a character."""
    lo = 0
    while lo < len(sizes):
        hi = lo + 1
        while hi < len(sizes) and hi - lo < 4096 and (hi - lo + 1) * sizes[hi] * width <= CELLS:
            hi += 1
        yield slice(lo, hi)
        lo = hi


class Pieces:
    """The vocabulary, and the passes over many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.lengths = sorted({len(p) for p in pieces})
        keys = np.array([self.key_of(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order

    @staticmethod
    def key_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c)) % 2**64
        return h

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids[word, end, k]: the piece of the k-th length that ends before ``end``, or -1; sizes with the bar."""
        size = np.array([len(w) + 1 for w in words])
        width = int(size.max())
        codes = np.zeros((len(words), width), np.uint64)
        codes[:, 0] = ord("▁")
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        codes[:, 1:][np.arange(width - 1) < (size - 1)[:, None]] = flat
        ids = np.full((len(words), width + 1, len(self.lengths)), -1, np.int32)
        for k, n in enumerate(self.lengths):
            if n > width:
                continue
            h = np.zeros((len(words), width - n + 1), np.uint64)
            for j in range(n):
                h = h * BASE + codes[:, j : width - n + 1 + j]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            ids[:, n:, k] = np.where(self.keys[at] == h, self.ids[at], -1)
        return ids, size

    def forward(self, ids: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha, scale: the probability of the characters before ``end`` is alpha[word, end, language] * exp(scale[..]).

        The last row of ``table`` is 0. Every STEP characters the sums still in use are made 1 at most.
        """
        n, width, _ = ids.shape
        reach = self.lengths[-1] if self.lengths else 1
        alpha = np.zeros((n, width, table.shape[1]))
        scale = np.zeros_like(alpha)
        alpha[:, 0] = 1
        so_far = np.zeros((n, table.shape[1]))
        there = (ids >= 0).any(axis=0).tolist()
        for end in range(1, width):
            for k, length in enumerate(self.lengths):
                if there[end][k]:
                    alpha[:, end] += alpha[:, end - length] * table[ids[:, end, k]]
            alpha[:, end] += alpha[:, end - 1] * UNKNOWN
            if end % STEP == 0:
                used = slice(max(0, end + 1 - reach), end + 1)
                top = alpha[:, used].max(axis=1)
                alpha[:, used] /= top[:, None]
                so_far = so_far + np.log(top)
                scale[:, used] = so_far[:, None]
            else:
                scale[:, end] = so_far
        return alpha, scale

    def backward(self, ids: np.ndarray, size: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """beta, scale: of one language, the probability of the characters from ``start`` on, scaled likewise."""
        n, width, _ = ids.shape
        reach = self.lengths[-1] if self.lengths else 1
        beta, scale, so_far = np.zeros((n, width)), np.zeros((n, width)), np.zeros(n)
        beta[np.arange(n), size] = 1
        there = (ids >= 0).any(axis=0).tolist()
        for start in range(width - 2, -1, -1):
            live = start < size
            for k, length in enumerate(self.lengths):
                if start + length < width and there[start + length][k]:
                    beta[:, start] += np.where(live, p[ids[:, start + length, k]] * beta[:, start + length], 0)
            beta[:, start] += np.where(live, UNKNOWN * beta[:, start + 1], 0)
            if start % STEP == 0:
                used = slice(start, min(width, start + reach))
                top = beta[:, used].max(axis=1)
                top = np.where(top > 0, top, 1.0)  # words that end before this place
                beta[:, used] /= top[:, None]
                so_far = so_far + np.log(top)
                scale[:, used] = so_far[:, None]
            else:
                scale[:, start] = so_far
        return beta, scale

    def expected(self, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations of weighted words, in one language."""
        ids, size = self.matches(words)
        table, at = np.append(p, 0.0), np.arange(len(words))
        alpha, above = (x[:, :, 0] for x in self.forward(ids, table[:, None]))
        beta, below = self.backward(ids, size, table)
        whole = np.log(alpha[at, size]) + above[at, size]
        counts = np.zeros(len(p) + 1)
        for start in range(ids.shape[1]):
            for k, length in enumerate(self.lengths):
                if start + length < ids.shape[1]:
                    own = ids[:, start + length, k]
                    there = np.flatnonzero(own >= 0)
                    if len(there):
                        share = np.exp(above[there, start] + below[there, start + length] - whole[there])
                        here = alpha[there, start] * table[own[there]] * beta[there, start + length] * share * weight[there]
                        counts += np.bincount(own[there], here, len(p) + 1)
        return counts[:-1]

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), table.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for part in portions([len(words[i]) + 2 for i in order], max(len(self.lengths), 2 * table.shape[1])):
            some = order[part]
            ids, size = self.matches([words[i] for i in some])
            alpha, scale = self.forward(ids, table)
            at = np.arange(len(some))
            out[some] = np.log(alpha[at, size]) + scale[at, size]
        return out


class Known:
    """The words that a task has scored: rows of log probabilities by word. They go with the task."""

    def __init__(self, pieces: Pieces, table: np.ndarray):
        self.pieces, self.table, self.where = pieces, table, {}
        self.rows = np.zeros((max(1, CACHE // max(4, table.shape[1])), table.shape[1]))

    def totals(self, docs: list[list[str]]) -> Iterator[np.ndarray | None]:
        """The log probability of each document's words by language; None without words."""
        new = list({w for words in docs for w in words if len(w) <= SHORT and w not in self.where})
        if len(self.where) + len(new) > len(self.rows):
            self.where.clear()
            new = list({w for words in docs for w in words if len(w) <= SHORT})
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), self.table.shape[1]))
        long = list({w for words in docs for w in words if len(w) > SHORT})
        scored = dict(zip(long, self.pieces.log_probabilities(long, self.table), strict=True))
        if new:
            self.rows[len(self.where) : len(self.where) + len(new)] = self.pieces.log_probabilities(new, self.table)
            self.where.update(zip(new, range(len(self.where), len(self.where) + len(new)), strict=True))
        for words in docs:
            total = self.rows[[self.where[w] for w in words if len(w) <= SHORT]].sum(axis=0)
            yield sum((scored[w] for w in words if len(w) > SHORT), total) if words else None


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def train(docs: DataFrame, pieces: Pieces, *, sample_docs: int, rounds: int, most_languages: int) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their piece probabilities (one column each; a last row of zeros)."""
    learnt = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(), F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in learnt.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise Validation(f"more than {most_languages} languages to learn; raise most_languages")
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((len(pieces.pieces) + 1, 0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_docs / sizes[lang]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def count(batches):
        for batch in batches:
            seen = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, own in seen.items() for w, n in own.items()]
            yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())], ["lang", "word", "n"])

    sample = learnt.where(F.col("lang").isin(languages) & (draw < share[F.col("lang")])).select("lang", "text")
    counts = stored(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    size, where = len(pieces.pieces), {x: i for i, x in enumerate(languages)}
    p = np.tile((np.array([len(x) for x in pieces.pieces]) ** -2.0)[:, None], (1, len(languages)))
    p /= p.sum(axis=0)
    for _ in range(rounds):
        current = counts.sparkSession.sparkContext.broadcast(p)

        def expect(batches, current=current):
            total = np.zeros((len(languages), size))
            for batch in batches:
                langs, words, n = (batch.column(i).to_pylist() for i in range(3))
                for lang, i in where.items():
                    own = sorted([(w, k) for x, w, k in zip(langs, words, n, strict=True) if x == lang], key=lambda x: len(x[0]))
                    for part in portions([len(w) + 2 for w, _ in own], 2 * len(pieces.lengths)):
                        some = own[part]
                        total[i] += pieces.expected([w for w, _ in some], np.array([k for _, k in some], float), current.value[:, i])
            return total.ravel()

        total = summed(counts, expect, size * len(languages)).reshape(len(languages), size).T
        p = (total + 0.05) / (total + 0.05).sum(axis=0)
    return languages, np.vstack([p, np.zeros(len(languages))])


def identify(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 1500,
    rounds: int = 3,
    most_languages: int = 1000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior, equal priors), then the columns ``keep``.

    The text, if it is kept, travels once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = Pieces(read_pieces(vocabulary))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = spark.sparkContext.broadcast((pieces, *train(plain, pieces, sample_docs=sample_docs, rounds=rounds, most_languages=most_languages)))
    extra = [c for c in keep if c != text_col]
    inputs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(extra)]
    ).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    passed = ["text"] * (text_col in keep) + [f"kept_{i}" for i in range(len(extra))]

    def predicted(batches):
        pieces, languages, table = model.value
        known = Known(pieces, table)
        for batch in batches:
            lang_pred, score = [], []
            texts = batch.column("text")
            for lo in range(0, len(texts), 500):
                for total in known.totals([words_of(t or "") for t in texts[lo : lo + 500].to_pylist()]):
                    if total is None or not languages:
                        lang_pred.append("und")
                        score.append(0.0)
                        continue
                    best = int(total.argmax())
                    lang_pred.append(languages[best])
                    score.append(float(1 / np.exp(total - total[best]).sum()))
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang_pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(out + [batch.column(c) for c in passed], ["doc_id", "held_out", "lang_pred", "score", *passed])

    types = dict(inputs.dtypes)
    schema = OUT + "".join(f", {c} {types[c]}" for c in passed)
    names = {text_col: "text"} | {c: f"kept_{i}" for i, c in enumerate(extra)}
    return inputs.mapInArrow(predicted, schema).select("doc_id", "held_out", "lang_pred", "score", *[F.col(names[c]).alias(c) for c in keep])
