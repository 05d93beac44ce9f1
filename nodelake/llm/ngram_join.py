"""Exact Jaccard join of documents on word shingles, by prefixes of token combinations.

A document is the set of its distinct shingles (hashed to 64 bits; the tokens). Two link when
intersection / union >= ``similarity``. In one order of all tokens, the k least common tokens of two
linked sets lie in both k-extended prefixes (the first n - ceil(similarity * n) + k tokens). So:

1. Equal sets are one class from here on, whose node is its least doc_id.
2. Extended prefixes (k a tenth of the set), tokens in order of their hash: ``shared_keys`` closes the
   tokens of one class only. A class with fewer open tokens than any partner of its size would share
   with it is alone. What is left are near copies and texts made mostly of shared passages.
3. Rounds over the open tokens: each class is checked against one leader, the class that most of its
   tokens name (first the most common texts, then drawn ones), and links become components. A token whose classes are all
   in one component is closed; a class with too few open tokens is done. So a group of thousands costs a
   check for each member, not for each pair.
4. What a check found of the first leader stays: a class that has half of its tokens or more in common with
   its leader belongs to the leader's family, and is known there by the tokens in which the two differ. Of
   two of one family, |a ^ b| is what is left of both differences once shared ones are taken out, so a
   linked pair that the rounds left apart shares many of these, rare as they are (``relative_pairs``).
5. Classes of different families meet by their own tokens: these are put in order of frequency, those of one
   component or one family first, and a class with too many of these is done. In the 2-extended prefix, rare
   tokens (at most ``frequent`` classes) are indexed alone and frequent ones as combinations of two: a linked
   pair shares a rare one or two frequent ones. Prefixes are as short as the two sizes allow: the smaller set
   of a pair is indexed under its size class, the larger one looks in each class that it can link to. Pairs
   of different components that meet, early enough in both for the overlap that their sizes ask, are checked.

Every check compares whole sets. Equal sets and members of one component are never expanded to pairs.

Defined results: null or blank texts have 0 shingles and are linked with nothing; with fewer words than
``width``, the whole sequence is the one shingle; a row with a null doc_id is linked with nothing and
has a null component; rows of one doc_id are one node with several sets; an empty table gives an empty
table; other columns are carried only if asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodelake.llm.components import components
from nodelake.llm.shared_keys import shared_keys
from nodelake.llm.suffix_dedup import mixed
from nodelake.llm.text_stats import let
from nodelake.session import scratch, small_batches, stored

CHUNK = 2_000_000
#: Sizes of a class of sets differ by this factor at most.
RATIO = 1.06
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
SETS = "owner long, node long, n long, tokens binary"
RELATED = "a long, b long, na long, nb long, linked boolean, differs binary"
#: Shingles of the corpus for each bucket of ``shared_keys``.
BUCKET = 20_000_000


def required(n, percent: int):
    """Least overlap of a set of ``n`` tokens with any set it links to."""
    return (percent * n + 99) // 100


def extension(n):
    return np.maximum(1, (n + 9) // 10)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and token, sorted, once each."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not texts:
        return none
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    start, stop = np.flatnonzero(before & ~blank), np.flatnonzero(~before & blank)
    if not len(start):
        return none
    size = stop - start
    power = np.ones(int(size.max()), np.uint64)
    power[1:] = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(power, dtype=np.uint64)
    keep = ~blank
    flat = data[keep].astype(np.uint64) + np.uint64(1)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    offset = np.arange(len(flat)) - np.repeat(first, size)
    word = mixed(np.add.reduceat(flat * power[offset], first), 3)
    doc = np.searchsorted(ends, start, side="right")
    h = np.full(len(word), width, np.uint64)
    counts = np.bincount(doc, minlength=len(texts))
    last = np.cumsum(counts)[doc]  # one past the last word of the document
    for j in range(width):
        there = np.arange(len(word)) + j < last
        h[there] = mixed(h[there] * np.uint64(0x2545F4914F6CDD1D) + word[np.flatnonzero(there) + j], 5 + j)
    # Whole shingles, and the first word's (shorter) one where there are fewer words.
    own_first = np.concatenate([[True], doc[1:] != doc[:-1]])
    whole = (np.arange(len(word)) + width <= last) | (own_first & (counts[doc] < width))
    doc, h = doc[whole], h[whole]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    return doc[once], h[once]


def chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, and the shingles, of parts of a batch of about CHUNK bytes."""
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        yield lo, hi, *shingles(texts[lo:hi], width)
        lo = hi


def signatures(doc: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set, and two sums that tell sets apart."""
    n = np.bincount(doc, minlength=rows)
    out = []
    for seed in (11, 13):
        total = np.zeros(rows, np.uint64)
        np.add.at(total, doc, mixed(token, seed))
        out.append(mixed(total, seed).view(np.int64))
    return n, *out


def _pairs_with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("of_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity."""

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _pairs_with_sets(pairs, sets).mapInArrow(check, "a long, b long")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """RELATED: for each pair, the sizes, whether the sets reach the similarity, and the tokens of one of the
    two only (null where these are more than a third of both)."""

    def check(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                odd = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(odd)) // 2
                out.append((len(x), len(y), 100 * both >= percent * (len(x) + len(y) - both), odd.tobytes() if 3 * len(odd) <= len(x) + len(y) else None))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.bool_(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], ["a", "b", "na", "nb", "linked", "differs"])

    return _pairs_with_sets(pairs, sets).mapInArrow(check, RELATED)


def families(met: DataFrame) -> DataFrame:
    """node, leader, n, leader_n, linked, differs: the classes that are known by how they differ from a leader.

    Leaders are their own family; so is a class of several sets (rows of one doc_id with unequal texts).
    """
    sole = met.groupBy("a").agg(F.count(F.lit(1)).alias("sets")).where("sets = 1").select("a")
    near = met.where("differs is not null").join(sole, "a", "left_semi")
    near = near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    return near.select(F.col("a").alias("node"), F.col("b").alias("leader"), F.col("na").alias("n"), F.col("nb").alias("leader_n"), "linked", "differs")


def close_sizes(x: str, y: str, percent: int):
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


def spread(names: list[str], columns: list[np.ndarray], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each token of each set, with the set's other columns; some 300,000 at a time."""
    size = np.array([len(t) for t in tokens], np.int64)
    group = np.cumsum(size) // 300_000
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        yield pa.record_batch([*[pa.array(np.repeat(c[own], size[own])) for c in columns], pa.array(np.concatenate([tokens[i] for i in own]))], [*names, "token"])


def with_labels(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def star_round(postings: DataFrame, labels: DataFrame | None, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Postings still open, and a pair for each class with its leader.

    On the first ``turn`` a token's leader is the class with the largest share of open tokens (the text
    that the others were made from has no tokens of its own); later it is drawn.
    """
    now = with_labels(postings, labels)
    rank = F.col("share") if turn == 0 else F.xxhash64("node", F.lit(turn))
    tokens = now.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct(rank.alias("rank"), (-F.col("node")).alias("minus"), "node", "n", "label")).alias("leader")).where("lo <> hi").drop("lo", "hi")
    alive = stored(now.join(tokens, "token"), "open-tokens")
    enough = alive.groupBy("node").agg(F.count(F.lit(1)).alias("open"), F.min("n").alias("n")).where(F.col("open") + 1 >= open_needed(percent)).select("node")  # two tokens may have one code
    alive = alive.join(enough, "node", "left_semi")
    votes = alive.where((F.col("label") != F.col("leader.label")) & close_sizes("n", "leader.n", percent)).groupBy("node", F.col("leader.node").alias("leader")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("leader")).alias("minus"))).alias("best"))
    return alive.select("token", "node", "n", "share"), best.select(F.col("node").alias("a"), (-F.col("best.minus")).alias("b"))


def open_needed(percent: int) -> Column:
    """Tokens of its extended prefix that a set shares with any set it links to, at least."""
    return F.greatest(F.lit(1), F.floor((F.floor((F.lit(percent) * F.col("n") + 99) / 100) + 9) / 10))


def overlap(total: Column, percent: int) -> Column:
    """Least overlap of two linked sets whose sizes add up to ``total``."""
    return F.ceil(F.lit(percent) * total / F.lit(100 + percent))


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(RATIO))).cast("int")


def keyed_prefixes(sets: DataFrame, percent: int, frequent: int) -> DataFrame:
    """token, node, n, label, at, small, large: what each set is indexed by.

    A set is met as the smaller one of a pair (``small``) or as the larger (``large``); ``at`` bounds
    the tokens before this one that the partner lacks. A combination also names the size class of the
    smaller set, so that the larger one's prefix is as short as that class allows.
    """
    n, least = F.col("n"), F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    closed = n - F.size("tokens")
    lacks_as_small, lacks_as_large = n - overlap(n + n, percent), n - least
    placed = F.transform(F.slice("tokens", 1, F.greatest(F.lit(0), lacks_as_large + 2 - closed).cast("int")), lambda t, i: F.struct(t["df"].alias("df"), t["token"].alias("token"), (closed + i - 1).alias("at")))
    entry = lambda token, at, small, large: F.struct(token.alias("token"), at.cast("long").alias("at"), small.alias("small"), large.alias("large"))
    rare = lambda all_: F.transform(F.filter(all_, lambda t: t["df"] <= frequent), lambda t: entry(t["token"], t["at"], t["at"] <= lacks_as_small, F.lit(True)))

    def pairs(often: Column) -> Column:
        return F.flatten(F.transform(often, lambda t, i: F.transform(F.slice(often, i + 2, F.size(often)), lambda u: F.struct(F.xxhash64(t["token"], u["token"]).alias("token"), u["at"].alias("at")))))

    def by_class(combined: Column) -> Column:
        as_small = F.transform(F.filter(combined, lambda c: c["at"] <= lacks_as_small), lambda c: entry(F.xxhash64(c["token"], size_class(n)), c["at"], F.lit(True), F.lit(False)))
        smallest = lambda k: F.greatest(F.pow(F.lit(RATIO), k) * 0.999999, least.cast("double"))
        as_large = F.transform(
            F.sequence(size_class(least), size_class(n)),
            lambda k: F.transform(F.filter(combined, lambda c: c["at"] <= n - overlap(n + smallest(k), percent)), lambda c: entry(F.xxhash64(c["token"], k), c["at"], F.lit(False), F.lit(True))),
        )
        return F.concat(as_small, F.flatten(as_large))

    both = let(placed, lambda all_: F.concat(rare(all_), let(let(F.filter(all_, lambda t: t["df"] > frequent), pairs), by_class)))
    return sets.where(closed <= lacks_as_large).select("node", "n", "label", "family", F.inline(both))


def exploded(rows: DataFrame, tokens: str, names: list[str]) -> DataFrame:
    """A row for each token of a packed column, with the columns ``names`` (longs)."""

    def run(batches):
        for batch in batches:
            packed = [np.frombuffer(t.as_buffer(), "<i8") for t in batch.column(tokens)]
            yield from spread(names, [batch.column(c).to_numpy() for c in names], packed)

    return rows.select(*[F.col(c).cast("long").alias(c) for c in names], tokens).mapInArrow(run, "".join(f"{c} long, " for c in names) + "token long")


def meeting_pairs(nodes: DataFrame, sets: DataFrame, labels: DataFrame | None, kin: DataFrame, percent: int, frequent: int) -> DataFrame:
    """All pairs of different components and families that share a rare token or a combination of two frequent ones."""
    some = sets.join(nodes.select("node").distinct(), "node", "left_semi")
    some = with_labels(some, labels).join(kin.select("node", F.col("leader").alias("family")), "node", "left").withColumn("family", F.coalesce("family", "node"))
    rows = stored(exploded(some, "tokens", ["owner", "node", "n", "label", "family"]), "met-tokens")
    apart = F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("family").alias("first"), F.max("family").alias("last")
    open_ = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), *apart).where("lo <> hi and first <> last").select("token", "df")
    ordered = rows.join(open_, "token").groupBy("owner", "node", "n", "label", "family").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    keyed = stored(keyed_prefixes(ordered, percent, frequent), "combinations")
    side = lambda name, as_: keyed.where(name).select("token", F.col("node").alias(as_), *[F.col(c).alias(c[0] + as_) for c in ("n", "label", "family")], F.col("at").alias(f"i{as_}"))
    na, nb, both = F.col("na"), F.col("nb"), overlap(F.col("na") + F.col("nb"), percent)
    met = (F.col("la") != F.col("lb")) & (F.col("fa") != F.col("fb")) & ((na < nb) | ((na == nb) & (F.col("a") < F.col("b"))))
    met = met & (F.lit(100) * na >= F.lit(percent) * nb) & (F.col("ia") <= na - both) & (F.col("ib") <= nb - both)
    return side("small", "a").join(side("large", "b"), "token").where(met).select("a", "b").distinct()


def relative_pairs(kin: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of one family and different components that differ from their leader in much the same tokens.

    With x and y the numbers of tokens in which a and b differ from their leader and o those they share,
    |a ^ b| = x + y - 2 o. If a and b link, but are not both linked to the leader, o is 1 at least, and more
    the larger x and y are. So one of their first x - o + 1 differences is shared, in an order that has those
    of a single component first and then the rarest. One of the two is never linked to the leader.
    """
    names = ["node", "leader", "n", "leader_n", "x", "linked", "label"]
    rows = with_labels(kin.withColumn("x", F.octet_length("differs") / 8), labels)
    tokens = stored(exploded(rows, "differs", names), "relative-tokens")
    open_ = tokens.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("leader", "token", "df")
    ordered = tokens.join(open_, ["leader", "token"]).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    x, whole, rest = F.col("x"), F.lit(100 + percent), F.lit(100 - percent)
    # Partners of a linked one are not linked themselves, so they differ by more than the sizes allow.
    least = F.when(F.col("linked") == 1, whole * x + rest * (F.col("leader_n") - F.col("n"))).otherwise(whole * x - rest * (F.col("n") + F.col("leader_n")))
    least = F.greatest(F.lit(1), F.ceil(least / (2 * whole)))
    closed = x - F.size("tokens")
    placed = F.transform(F.slice("tokens", 1, F.greatest(F.lit(0), x - least + 1 - closed).cast("int")), lambda t, i: F.struct(t["token"].alias("token"), (closed + i).alias("at")))
    keyed = stored(ordered.select("leader", "node", "n", "x", "linked", "label", F.inline(placed)), "relative-prefixes")
    side = lambda as_: keyed.select("leader", "token", F.col("node").alias(as_), *[F.col(c).alias(f"{c}_{as_}") for c in ("n", "x", "linked", "label", "at")])
    a, b, total = side("a").where("linked_a = 0"), side("b"), F.col("n_a") + F.col("n_b")
    shared = F.ceil((F.col("x_a") + F.col("x_b") - total + F.lit(2) * overlap(total, percent)) / F.lit(2))
    met = (F.col("label_a") != F.col("label_b")) & ((F.col("linked_b") == 1) | (F.col("a") < F.col("b"))) & close_sizes("n_a", "n_b", percent)
    met = met & (F.col("x_a") - F.col("at_a") >= shared) & (F.col("x_b") - F.col("at_b") >= shared)
    return a.join(b, ["leader", "token"]).where(met).select("a", "b").distinct()


def join_groups(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 80,
    frequent: int = 64,
    rounds: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row of ``docs``.

    ``percent`` is over 50; ``rounds`` (1 or more) of leader checks come before the exact meeting of what
    is left.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))

    def sign(batches):
        for batch in batches:
            parts = [signatures(doc, token, hi - lo) for lo, hi, doc, token in chunks(batch, width)]
            n, one, two = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc_id", "key", "n", "owner", "check"])

    signed = stored(rows.mapInArrow(sign, "doc_id long, key long, n long, owner long, check long"), "shingle-signatures")
    real = signed.where("n > 0 and doc_id is not null")
    buckets = buckets or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (real.agg(F.sum("n")).collect()[0][0] or 0) // BUCKET)
    classes = stored(real.groupBy("owner", "check", "n").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("owner", "check", "n", F.col("first.doc_id").alias("node"), F.col("first.key").alias("key")), "shingle-classes")

    def prefixes(batch):
        for lo, hi, doc, token in chunks(batch, width):
            n, owner, _ = signatures(doc, token, hi - lo)
            rank = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(n)[:-1]])[doc]
            own = rank < (n - required(n, percent) + extension(n))[doc]
            yield owner[doc[own]], token[own]

    with scratch(docs.sparkSession):
        found = shared_keys(rows.where("doc_id is not null").select("text"), prefixes, buckets).groupBy("owner").agg(F.collect_list("keys").alias("keys"), F.sum(F.octet_length("keys") / 8).alias("open"))
        left = stored(classes.join(found, "owner").where(F.col("open") >= open_needed(percent)).select("owner", "node", "key", "n", "keys"), "shingle-candidates")

        def post(batches):
            for batch in batches:
                tokens = [np.unique(np.frombuffer(b"".join(keys), "<i8")) for keys in batch.column("keys").to_pylist()]
                node, n = (batch.column(c).to_numpy() for c in ("node", "n"))
                yield from spread(["node", "n", "share"], [node, n, np.array([len(t) for t in tokens]) / n], tokens)

        def gather(batches):
            for batch in batches:
                out = []
                owners, nodes = batch.column("owner").to_pylist(), batch.column("node").to_pylist()
                for lo, hi, doc, token in chunks(batch, width):
                    cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                    out += [(owners[lo + i], nodes[lo + i], int(cut[i + 1] - cut[i]), token[cut[i] : cut[i + 1]].tobytes()) for i in range(hi - lo)]
                yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.binary()])], ["owner", "node", "n", "tokens"])

        chosen = rows.select("key", "text").join(left.select("key", "owner", "node"), "key").dropDuplicates(["key"])
        sets = stored(chosen.select("owner", "node", "text").mapInArrow(gather, SETS), "shingle-sets")
        postings = stored(left.select("node", "n", "keys").mapInArrow(post, "node long, n long, share double, token long"), "shingle-postings")
        links, labels, kin = None, None, None
        for turn in range(rounds):
            postings, pairs = star_round(postings, labels, percent, turn)
            if turn == 0:
                met = stored(compared(pairs, sets, percent), "shingle-leaders")
                kin, new = stored(families(met), "shingle-families"), met.where("linked").select("a", "b").distinct()
            else:
                new = verified(pairs, sets, percent)
            links = stored(new if links is None else links.union(new), "shingle-links")
            labels = stored(components(links).select(F.col("node"), F.col("label")), "shingle-labels")
        last = meeting_pairs(postings, sets, labels, kin, percent, frequent).union(relative_pairs(kin, labels, percent))
        links = stored(links.union(verified(last, sets, percent)), "shingle-links")
        labels = components(links)
        groups = stored(classes.select("owner", "check", "n", "node").join(labels, "node", "left"), "shingle-groups", keep=True)
    whole = signed.where("doc_id is not null").join(groups, ["owner", "check", "n"], "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node", "doc_id").alias("component_id")).union(
        signed.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long"))
    )
