"""A corpus pipeline: language, near copies, repeated passages, mix, tokens.

``STAGES`` are (name, function) in order; each function takes (spark, docs, sf_dir), where docs is what
the stage before kept, and returns a DataFrame with the columns of ``documents`` (the last one: the
digests of the encoded texts). ``run`` writes each stage's rows as Parquet in the shared folder and reads
them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodelake.llm import byte_bpe, language_id, mixing, ngram_join, suffix_dedup
from nodelake.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has less than this share of the posterior is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; a null text, or one without a letter, goes."""
    found = language_id.identify(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=tuple(COLUMNS))
    given = found.columns[4:]
    kept = found.toDF("id", "held_out", "lang_pred", "score", *given).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of linked documents (and rows without an id).

    Of several rows of that id the least (by text, then the other columns) stays.
    """
    groups = ngram_join.join_groups(docs.select("doc_id", "text"), width=5, percent=80)
    first = groups.where("component_id = doc_id").select("doc_id").distinct()
    one = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return one.union(docs.where("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that an earlier document has; what is left empty by that goes."""
    cut = suffix_dedup.dedup(docs, width=50, keep=("lang", "source"), with_text=True)
    left = cut.where("n_removed = 0 or n_removed < n_bytes")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and forms get slightly evened shares of the tokens."""
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*COLUMNS).alias("row"))
    return mixing.sample(rows, temper=0.95, keep=("row",)).where("kept").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; one row of digests for each."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language models and exact joins over five stages are not expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
