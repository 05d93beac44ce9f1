"""Quality rules as a ledger of failure bits (DataFrame functions only).

Every rule is evaluated once for a document. The ledger keeps the measurements and one ``failed``
bit mask; policies are versioned sets of bits applied to that mask later, and ablations (what a
policy would keep without one of its rules) come from the counts of each distinct mask, which are at
most 2 to the number of rules, however many documents there are.

Defined results: a null or empty text has no words and fails ``few_words``; a null ``doc_id`` is kept;
repeated rows give repeated rows; an empty table gives an empty ledger (and zero counts in the
ablation); other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodelake.llm import text_stats as S

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs"]

#: name -> condition under which a document fails, over the measurements; the bit is the position.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "shouting": "100 * n_bangs > 8 * word_chars",
    "odd_word_length": "word_chars > 20 * n_words or word_chars < 2 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """Fails a document that breaks any rule of ``fatal`` or more than ``tolerance`` of ``counted``."""

    version: str
    fatal: tuple[str, ...]
    counted: tuple[str, ...] = ()
    tolerance: int = 0


POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeated_windows")),
        Policy("2024-strict", tuple(RULES)),
        Policy("2024-lenient", ("few_words", "repeated_windows"), ("symbols", "repeated_lines", "shouting", "odd_word_length"), 1),
    )
}


def bits(names: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``: bit i is set if rule i of RULES fails."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        S.let(S.words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), S.repeated_words(w).alias("n_repeat_words"))).alias("w"),
        S.word_chars(F.col("text")).alias("word_chars"),
        S.count_of(F.col("text"), S.SYMBOLS).alias("n_symbols"),
        S.let(S.lines(F.col("text")), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), S.repeats(x).alias("n_dup_lines"))).alias("l"),
        S.count_of(F.col("text"), "!").alias("n_bangs"),
    )
    flat = measured.select("doc_id", "w.*", "word_chars", "n_symbols", "l.*", "n_bangs")
    failed = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return flat.select("doc_id", *MEASURES, failed.alias("failed"))


def passes(policy: Policy, failed: Column, without: int = 0) -> Column:
    """Whether a mask passes ``policy``, with the rules of the bits ``without`` left out."""
    fatal, counted = bits(policy.fatal) & ~without, bits(policy.counted) & ~without
    ok = failed.bitwiseAND(F.lit(fatal)) == 0
    return ok & (F.bit_count(failed.bitwiseAND(F.lit(counted))) <= policy.tolerance) if counted else ok


def apply_policy(ledgered: DataFrame, version: str) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under one policy (which includes the base rules)."""
    base, policy = POLICIES["base"], POLICIES[version]
    failed = F.col("failed")
    return ledgered.withColumn("base_failed", ~passes(base, failed)).withColumn("kept", passes(base, failed) & passes(policy, failed))


def ablation(ledgered: DataFrame, version: str) -> DataFrame:
    """rule, n_failed, n_kept (under the policy) and n_kept_without (the same without that rule)."""
    policy, failed = POLICIES[version], F.col("failed")
    masks = ledgered.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            total(failed.bitwiseAND(F.lit(1 << i)) != 0).alias("n_failed"),
            total(passes(policy, failed)).alias("n_kept"),
            total(passes(policy, failed, 1 << i)).alias("n_kept_without"),
        )
        for i, name in enumerate(RULES)
    ]
    return masks.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 8) t(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (
  SELECT *,
         (CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END)
         + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
         + (CASE WHEN 100 * n_bangs > 8 * word_chars THEN 16 ELSE 0 END)
         + (CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 32 ELSE 0 END) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bangs,
       failed::BIGINT AS failed, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept
FROM f
"""
