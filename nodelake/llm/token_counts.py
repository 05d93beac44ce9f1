"""Token counts by a two-tier lookup on the map side.

The library's answer for a text is the sum of the lengths of its pre-tokens, so a count needs only
``pre-token -> number of tokens``. Tier one is a broadcast table of the pre-tokens that are most frequent in
all documents (``frequent`` entries at most); tier two is a cache in each Python worker, filled by encoding
a missed pre-token with the library, and emptied at ``CACHE`` entries. The table and the caches decide speed
only: the counts are the same with an empty table.

Texts outside the characters where Python's ``re`` and ``str.lower`` agree with the library's
normaliser, and texts that hold one of the special strings, are encoded by the library whole.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null ``doc_id`` is kept; repeated
rows give repeated rows; an empty table gives an empty table; columns other than the id and the text
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodelake.session import scratch, small_batches, stored

#: The pre-tokeniser's pattern, for texts that match SAFE.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: ASCII without odd controls, and the precomposed Latin letters that lower-case one to one.
SAFE = re.compile("[\\t\\n\\x0b\\x0c\\r\\x20-\\x7eÀ-įı-ſ]*\\Z")
CACHE = 200_000
#: Pre-tokens that a task counts before it hands its counts on.
FLUSH = 200_000
OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_open: dict[str, "Lengths"] = {}


class Lengths(dict):
    """pre-token -> number of tokens; a missed one is encoded and remembered."""

    def __init__(self, path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.frequent, self.tokenizer = frequent, Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not SAFE.match(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, PRETOKEN.findall(text.lower())))


def frequent_lengths(docs: DataFrame, path: str, frequent: int) -> dict[str, int]:
    """The most frequent pre-tokens of all documents (with all that are as frequent, or none of them), and their lengths.

    Each task counts its rows and hands on all its counts, FLUSH pre-tokens at a time.
    """

    def told(seen):
        return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if SAFE.match(text):
                    seen.update(PRETOKEN.findall(text.lower()))
                if len(seen) > FLUSH:
                    yield told(seen)
                    seen.clear()
        yield told(seen)

    counts = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "piece string, n long")
    lengths, least, so_far = Lengths(path, {}), None, 0
    with scratch(docs.sparkSession):
        total = stored(counts.where(F.length("piece") <= 32).groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1"), "token-pieces")
        for r in total.groupBy("n").agg(F.count(F.lit(1)).alias("pieces")).orderBy(F.desc("n")).limit(frequent).collect():
            so_far += r["pieces"]
            if so_far > frequent:
                break
            least = r["n"]
        return {} if least is None else {r["piece"]: lengths[r["piece"]] for r in total.where(F.col("n") >= least).select("piece").collect()}


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    *,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int | None = None,
    frequent: int = 50_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row of ``docs``.

    ``vocabulary`` is the path of a ``tokenizers`` JSON file that every worker can open. With ``sample_docs``, the
    table of frequent pre-tokens sees about so many rows; without, all of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = rows
    if sample_docs is not None:
        seen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0) < min(1.0, sample_docs / max(1, rows.count())))
    table = spark.sparkContext.broadcast(frequent_lengths(seen, vocabulary, frequent))

    def counted(batches):
        if vocabulary not in _open or _open[vocabulary].frequent != table.value:
            _open[vocabulary] = Lengths(vocabulary, table.value)
        lengths = _open[vocabulary]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(lengths.count(text))
            yield pa.record_batch(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(counted, OUT)
