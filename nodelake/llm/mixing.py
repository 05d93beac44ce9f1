"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents are counted by cell (source, language, topic); a cell's weight is its tokens. Each round
rakes the weights to the source, language and topic marginals in turn: the weights of a value are
scaled so that they sum to its target. A document is then kept with the probability of its cell, the
ratio of fitted to counted tokens over the largest such ratio, so that the expected tokens of the
sample have the fitted proportions. The draw is a hash of the id, so a rerun keeps the same rows.

Targets are the natural shares to the power ``temper`` (1 keeps them, 0 makes all values equal),
or a given mapping from value to share. Topics are forms of text, told apart by fixed rules.

Only cells and marginals are shuffled, after partial sums, so a source of any size is one row of each
task. Spark picks how the cells meet the documents by their size.

Defined results: null source, language or topic values are the value ``unknown``; a null or empty text
has 0 tokens and the probability of its cell (1 where the cell has no tokens); a null ``doc_id`` is
drawn by its text; rows of one id are kept or dropped together within a cell; values without a target
in a given mapping get probability 0; an empty table gives an empty table; the names of other columns
may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodelake.llm import text_stats as S
from nodelake.session import stored

DIMS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """The form of a text: table, symbols, shouting, or its length."""
    size, marks, bars, bangs = F.octet_length(text), S.count_of(text, "#*$%&<>"), S.count_of(text, "|"), S.count_of(text, "!")
    return (
        F.when(bars * 50 > size, "table").when(marks * 20 > size, "symbols").when(bangs * 20 > size, "shouting")
        .when(size < 800, "short").when(size < 4000, "middle").otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """About one token for four bytes."""
    return F.ceil(F.octet_length(text) / 4.0).cast("long")


def targets(cells: DataFrame, dim: str, wanted: float | dict[str, float]) -> DataFrame:
    """``dim`` and its target share."""
    if isinstance(wanted, dict):
        total = sum(wanted.values())
        return cells.sparkSession.createDataFrame([(k, v / total) for k, v in wanted.items()], f"{dim} string, target double")
    shares = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(wanted))).alias("power"))
    total = shares.agg(F.sum("power")).collect()[0][0] or 1.0
    return shares.select(dim, (F.col("power") / F.lit(total)).alias("target"))


def fitted(cells: DataFrame, wanted: dict[str, float | dict[str, float]], rounds: int) -> DataFrame:
    """The cells with ``weight``: their share of the mix after ``rounds`` rounds of raking."""
    goal = {dim: stored(targets(cells, dim, wanted[dim]), f"mix-{dim}") for dim in DIMS}
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for dim in DIMS:
            scale = out.groupBy(dim).agg(F.sum("weight").alias("now")).join(goal[dim], dim).select(dim, F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0).alias("scale"))
            out = out.join(scale, dim, "left").withColumn("weight", F.col("weight") * F.coalesce("scale", F.lit(0.0))).drop("scale")
        out = stored(out, "mix-cells")
    return out


def draw(id_: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 that the id (or, without one, the text) decides."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), text)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def sample(
    docs: DataFrame,
    *,
    temper: float | dict[str, float | dict[str, float]] = 0.9,
    rounds: int = 8,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every row, then the columns ``keep``."""
    wanted = temper if isinstance(temper, dict) else dict.fromkeys(DIMS, temper)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), named(source_col).alias("source"), named(lang_col).alias("lang"),
        topic_of(text).alias("topic"), tokens_of(text).alias("n_tokens"), draw(F.col(id_col).cast("long"), text, seed).alias("draw"),
        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)],
    )
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "mix-counts")
    fit = fitted(cells, wanted, rounds).withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    most = fit.agg(F.max("ratio")).collect()[0][0]
    rate = fit.select(*DIMS, F.round(F.coalesce(F.col("ratio") / F.lit(most or 1.0), F.lit(1.0)), 9).alias("probability"))
    out = rows.join(rate, list(DIMS))
    return out.select("doc_id", *DIMS, "n_tokens", "probability", (F.col("draw") < F.col("probability")).alias("kept"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def oracle(documents: str = "documents", temper: float = 0.9, rounds: int = 8, seed: int = 11) -> str:
    """The same over DuckDB, raking written out round by round."""
    count = lambda chars: "(" + " + ".join(f"len(text) - len(replace(text, '{c}', ''))" for c in chars) + ")"
    parts = [
        f"""m AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, strlen(text) AS size, text,
         {count('|')} AS bars, {count('#*$%&<>')} AS marks, {count('!')} AS bangs
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM {documents}))""",
        f"""d AS (
  SELECT doc_id, source, lang,
         CASE WHEN bars * 50 > size THEN 'table' WHEN marks * 20 > size THEN 'symbols' WHEN bangs * 20 > size THEN 'shouting'
              WHEN size < 800 THEN 'short' WHEN size < 4000 THEN 'middle' ELSE 'long' END AS topic,
         ceil(size / 4.0)::BIGINT AS n_tokens,
         ('0x' || substr(md5('{seed}:' || doc_id), 1, 13))::UBIGINT::DOUBLE / {2**52}.0 AS draw
  FROM m)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS weight FROM d GROUP BY ALL)",
        *[f"g_{dim} AS MATERIALIZED (SELECT {dim}, p / (SUM(p) OVER ()) AS target FROM (SELECT {dim}, pow(sum(tokens)::DOUBLE, {temper}) AS p FROM c0 GROUP BY {dim}))" for dim in DIMS],
    ]
    step = 0
    for _ in range(rounds):
        for dim in DIMS:
            parts.append(
                f"c{step + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * (target / s) AS weight FROM c{step} "
                f"JOIN (SELECT {dim}, sum(weight) AS s FROM c{step} GROUP BY {dim}) USING ({dim}) JOIN g_{dim} USING ({dim}))"
            )
            step += 1
    return (
        "WITH "
        + ",\n".join(parts)
        + f",\nr AS (SELECT source, lang, topic, round((weight / tokens) / (SELECT max(weight / tokens) FROM c{step}), 9) AS probability FROM c{step})\n"
        + "SELECT doc_id, source, lang, topic, n_tokens, probability, draw < probability AS kept FROM d JOIN r USING (source, lang, topic)"
    )


def shares(sampled: DataFrame, dim: str) -> DataFrame:
    """``dim`` and the expected tokens of its documents in the sample, as a share."""
    by = sampled.groupBy(dim).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"))
    total = by.agg(F.sum("expected")).collect()[0][0] or 1.0
    return by.select(dim, (F.col("expected") / F.lit(total)).alias("share"))
