"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed by direction, each divided by its own length, so that one long vector does not press
the others into few buckets. Length decides beside direction which inner products are largest: where
lengths differ, every query is also compared with the LONGEST longest vectors. Each of ``tables`` tables
hashes a point by ``cuts`` random projections, floor((a . x + b) / ``cell``). A query visits its own bucket
and then the buckets next to it, in order of the estimated chance of success: sets of one-step changes by
the sum of the squared distances to the borders they cross (``probes`` buckets a table). The candidates of
all tables are merged and ranked by their exact inner products. A query that finds fewer than ``k`` although
more vectors exist is compared with all vectors, in blocks of about BLOCK queries.

Cuts, cell and probes are fitted, so that they follow the number of rows and how they lie: FIT_QUERIES of
the queries (those of least id hash) are compared with all rows, and of the settings of a grid that find
``recall`` of their true neighbours, the one with the least work is taken, by the share of FIT_ROWS rows
(least id hash) that those queries reach. More rows make nearer neighbours, which fewer or smaller buckets
hold, so the share falls as the table grows. Where no setting reaches ``recall``, the best one is taken.

Rows are dealt by the hash of their bucket. A bucket of more than max(4096, a ten-thousandth of all
entries) is cut into parts, which its queries visit all; there are ten thousand such buckets at most,
which bounds what is broadcast. No pair of vectors is ever a row; only each query's best of a part are.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do those whose length is not the most frequent one, nor rows with a null id; equal scores go
to the smaller id; rows of one id count once (the largest vector in array order); no queries or
candidates give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodelake.llm.shared_keys import per_owner
from nodelake.session import scratch, stored

BLOCK = 2048
PART_BYTES = 32 << 20
LONGEST = 1024
FIT_QUERIES, FIT_ROWS = 64, 4000
CUTS, CELLS, PROBES = (6, 8, 10, 12, 14, 16, 20, 24, 28), (1.0, 1.5, 2.0, 2.5, 3.0, 3.5), 600
SENT = "part int, query boolean, id long, vector binary, buckets binary"
BEST = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    usual = [r[0] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()]
    return rows.where(F.size("v") == (usual[0] if usual else 0)).groupBy("id").agg(F.max("v").alias("v"))


def step_sets(cuts: int, most: int) -> np.ndarray:
    """The ``most`` likeliest sets of steps, likeliest first: [set, place], filled up with 2 * cuts.

    A step is named by its rank among the 2 * cuts squared distances of a point to the borders of its cell;
    sets are put in order by the expected sum of those. The steps of rank j and 2 * cuts - 1 - j cross the two
    borders of one cut, so no set holds both.
    """
    j = np.arange(1, cuts + 1)
    near = j * (j + 1) / (4 * (cuts + 1) * (cuts + 2))
    costs = np.concatenate([near, (1 - j / (cuts + 1) + near)[::-1]])
    out: list[tuple[int, ...]] = [()]
    heap = [(costs[0], (0,))]
    while heap and len(out) < most:
        cost, chosen = heapq.heappop(heap)
        if len({min(c, 2 * cuts - 1 - c) for c in chosen}) == len(chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < len(costs):
            heapq.heappush(heap, (cost - costs[last] + costs[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + costs[last + 1], (*chosen, last + 1)))
    widest = max(1, max(map(len, out)))
    return np.array([(*c, *(2 * cuts,) * (widest - len(c))) for c in out])


class Tables:
    """The random projections of one setting."""

    def __init__(self, dimension: int, tables: int, cuts: int, cell: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.cuts, self.cell, self.probes = tables, cuts, cell, probes
        self.a, self.b = rng.normal(size=(tables, dimension, cuts)), rng.uniform(0, cell, (tables, 1, cuts))
        self.salt = rng.integers(1, 2**63, (tables, cuts), dtype=np.uint64) | np.uint64(1)
        self.sets = step_sets(cuts, 2 * probes)

    def places(self, v: np.ndarray) -> np.ndarray:
        """Projections in cells: [table, row, cut]."""
        x = v / np.abs(v).max(axis=1, keepdims=True)
        return (x / np.linalg.norm(x, axis=1, keepdims=True) @ self.a + self.b) / self.cell

    def sums(self, home: np.ndarray) -> np.ndarray:
        return (home.astype(np.int64).view(np.uint64) * self.salt[:, None]).sum(axis=-1, dtype=np.uint64)

    def own(self, v: np.ndarray) -> np.ndarray:
        """The bucket of each row: [table, row]."""
        return mixed(self.sums(np.floor(self.places(v))))

    def visited(self, v: np.ndarray) -> np.ndarray:
        """The buckets each row visits, likeliest first by its own distances: [table, row, probe]."""
        place = self.places(v)
        home = np.floor(place)
        inside = place - home
        cost = np.concatenate([inside, 1 - inside], axis=-1) ** 2
        order = np.argsort(cost, axis=-1)
        none = np.zeros((*cost.shape[:2], 1))
        cost = np.concatenate([np.take_along_axis(cost, order, -1), none], axis=-1)
        salt = np.broadcast_to(np.concatenate([np.uint64(0) - self.salt, self.salt], axis=-1)[:, None], order.shape)
        salt = np.concatenate([np.take_along_axis(salt, order, -1), none.astype(np.uint64)], axis=-1)
        total, away = np.zeros((*cost.shape[:2], len(self.sets))), np.zeros((*cost.shape[:2], len(self.sets)), np.uint64)
        for step in self.sets.T:
            total += cost[..., step]
            away += salt[..., step]
        likely = np.argsort(total, axis=-1, kind="stable")[..., : self.probes]
        return mixed(self.sums(home)[..., None] + np.take_along_axis(away, likely, -1))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def first_visits(visited: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The probe with which a query (its ``visited`` [table, probe]) first reaches each row (``own`` [table, row])."""
    probes = visited.shape[-1]
    first = np.full(own.shape[-1], probes)
    for some, bucket in zip(visited, own, strict=True):
        order = np.argsort(some, kind="stable")
        at = np.minimum(np.searchsorted(some[order], bucket), probes - 1)
        first = np.minimum(first, np.where(some[order][at] == bucket, order[at], probes))
    return first


def curves(t: Tables, sample: np.ndarray, queries: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(recall, share of the sample's rows reached) of each number of probes from 1."""
    rows, hits, reached = t.own(sample), np.zeros(t.probes + 1), np.zeros(t.probes + 1)
    for i in range(len(queries)):
        visited = t.visited(queries[i : i + 1])[:, 0]
        hits += np.bincount(first_visits(visited, t.own(found[i])), minlength=t.probes + 1)
        reached += np.bincount(first_visits(visited, rows), minlength=t.probes + 1)
    return np.cumsum(hits)[:-1] / hits.sum(), np.cumsum(reached)[:-1] / reached.sum()


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best_of(ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest inner products; equal ones by id. Row sums, so that equal vectors score the same."""
    s = (v * q).sum(axis=1)
    if len(s) > 4 * k:
        some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        ids, s = ids[some], s[some]
    order = np.lexsort((ids, -s))[:k]
    return ids[order], s[order]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 10,
    cuts: int | None = None,
    cell: float | None = None,
    probes: int | None = None,
    recall: float = 0.94,
    seed: int = 5,
    parts: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best found of all other rows.

    ``is_query`` is a condition on the column ``id``. Those of ``cuts``, ``cell`` and ``probes`` that are given
    are kept as they are.
    """
    with scratch(vectors.sparkSession):
        grid = [(c, w) for c in ([cuts] if cuts else CUTS) for w in ([cell] if cell else CELLS)]
        return searched(vectors, is_query, k, id_col, vector_col, tables, grid, probes, recall, seed, parts)


def searched(vectors, is_query, k, id_col, vector_col, tables, grid, probes, recall, seed, parts) -> DataFrame:
    spark = vectors.sparkSession
    kind = np.dtype("f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8")
    rows = stored(usable(vectors, id_col, vector_col).withColumn("query", F.coalesce(is_query, F.lit(False))), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, queries, dimension, shortest, longest = rows.agg(F.count(F.lit(1)), F.count_if("query"), F.max(F.size("v")), F.min(length), F.max(length)).collect()[0]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest_rows = stored(longest_of(rows, length, shortest, longest), "longest") if longest > shortest * 1.001 else None
    asked, sample = least(rows.where("query"), FIT_QUERIES, queries), least(rows, FIT_ROWS, n)
    hashing = spark.sparkContext.broadcast(fitted(rows, asked, sample, longest_rows, dimension, k, n, tables, grid, probes, recall, seed))
    parts = parts or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), n * tables * (dimension * kind.itemsize + 32) // PART_BYTES)
    limit = max(4096, n * tables // 10_000)

    def count(batches):
        for batch in batches:
            t = hashing.value
            for own in t.own(matrix(batch.column("v"))):
                bucket, counts = np.unique(own, return_counts=True)
                yield pa.record_batch([pa.array(bucket.view(np.int64)), pa.array(counts)], ["bucket", "n"])

    large = rows.select("v").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    cut_in = spark.sparkContext.broadcast({r["bucket"] & (2**64 - 1): -(-r["n"] // limit) for r in large.collect()})

    def deal(batches):
        t, salts = hashing.value, cut_in.value
        for batch in batches:
            ids, v = np.array(batch.column("id").to_pylist()), matrix(batch.column("v"))
            out = []

            def send(query, own, x, buckets, out=out):
                part = ((buckets >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)
                out += [(p, query, own, x, b) for p, b in per_owner(part, buckets)]

            own = t.own(v).T
            for i in range(len(ids)):
                mine = own[i]
                if salts:
                    mine = np.array([b + np.uint64(int(ids[i]) % salts[int(b)]) if int(b) in salts else b for b in mine], np.uint64)
                send(False, int(ids[i]), v[i].astype(kind).tobytes(), mine)
            asked = np.flatnonzero(batch.column("query").to_numpy(zero_copy_only=False))
            for lo in range(0, len(asked), 64):
                some = asked[lo : lo + 64]
                for i, visited in zip(some, t.visited(v[some]).swapaxes(0, 1), strict=True):
                    visited = np.unique(visited)
                    if salts:
                        visited = np.array([b + np.uint64(j) for b in visited for j in range(salts.get(int(b), 1))], np.uint64)
                    send(True, int(ids[i]), v[i].astype(kind).tobytes(), visited)
            for lo in range(0, len(out), 5000):
                some = out[lo : lo + 5000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], x) for i, x in enumerate([pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()])], ["part", "query", "id", "vector", "buckets"])

    def search(batches):
        held, asked = [], []
        for batch in batches:
            for query, own, x, b in zip(*(batch.column(c).to_pylist() for c in ("query", "id", "vector", "buckets")), strict=True):
                (asked if query else held).append((own, x, b))
        if not held or not asked:
            return
        ids = np.array([r[0] for r in held])
        v = np.frombuffer(b"".join(r[1] for r in held), kind).reshape(len(held), -1)
        row = np.repeat(np.arange(len(held)), [len(r[2]) // 8 for r in held])
        bucket = np.frombuffer(b"".join(r[2] for r in held), "<u8")
        order = np.argsort(bucket, kind="stable")
        bucket, row = bucket[order], row[order]
        del held
        out = []
        for own, x, b in asked:
            b = np.frombuffer(b, "<u8")
            lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, side="right")
            some = [row[i:j] for i, j in zip(lo, hi, strict=True) if i < j]
            if not some:
                continue
            some = np.unique(np.concatenate(some))
            some = some[ids[some] != own]
            out.append((own, *best_of(ids[some], v[some].astype(float), np.frombuffer(x, kind).astype(float), k)))
            if len(out) >= 500:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    def packed(out):
        return pa.record_batch([pa.array(np.repeat([r[0] for r in out], [len(r[1]) for r in out])), pa.array(np.concatenate([r[1] for r in out])), pa.array(np.concatenate([r[2] for r in out]))], ["query_id", "vec_id", "score"])

    found = stored(rows.mapInArrow(deal, SENT).repartitionById(parts, "part").mapInArrow(search, BEST).distinct(), "neighbours")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    short = rows.where("query").join(enough, "id", "left_anti")
    best = found
    if longest_rows is not None:
        best = best.union(against(rows.where("query"), longest_rows, k))
    for block in blocks(short):
        best = best.union(stored(top(compared(rows, spark.sparkContext.broadcast(block), k), k).drop("rank"), "neighbours"))
    ranked = top(best.distinct(), k)
    return stored(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "neighbours", keep=True)


def top(found: DataFrame, k: int) -> DataFrame:
    return found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(_by_query())).where(F.col("rank") <= k)


def least(rows: DataFrame, many: int, n: int) -> DataFrame:
    """The ``many`` rows of least id hash, of ``n``. Only twice as many pass the bound on the hash, so that what the
    partitions send to be put in order does not grow with their number."""
    bound = -(2**63) + int(2**64 * min(1.0, 2 * many / max(n, 1)))
    few = rows.where(F.xxhash64("id") <= min(bound, 2**63 - 1))
    return few.orderBy(F.xxhash64("id"), "id").limit(many).select("id", "v")


def longest_of(rows: DataFrame, length: Column, shortest: float, longest: float, bins: int = 65_536) -> DataFrame:
    """The LONGEST longest rows, equal ones by id; a histogram of lengths first leaves out what cannot be among them."""
    at = F.floor((length - shortest) / (longest - shortest) * (bins - 1))
    above, bound = 0, 0
    for r in sorted(rows.groupBy(at.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        above, bound = above + r["count"], r["bin"]
        if above >= LONGEST:
            break
    return rows.where(at >= bound).orderBy(F.desc(length), "id").limit(LONGEST)


def fitted(rows: DataFrame, asked: DataFrame, sample: DataFrame, longest: DataFrame | None, dimension, k, n, tables, grid, probes, recall, seed) -> Tables:
    """The setting of ``grid`` with the least work at ``recall``, on the bounded samples ``asked`` of the queries and
    ``sample`` of the rows.

    Neighbours among the ``longest`` rows are found anyway and not counted. Work is counted in rows ranked, a
    visited bucket as half a row.
    """
    spark = rows.sparkSession
    asked = asked.collect()
    if not asked or len(grid) == 1 and probes:
        return Tables(dimension, tables, *grid[0], probes or 1, seed)
    block = spark.sparkContext.broadcast((np.array([r["id"] for r in asked]), np.array([r["v"] for r in asked])))
    true = top(compared(rows, block, k), k)
    if longest is not None:
        true = true.join(longest.select(F.col("id").alias("vec_id")), "vec_id", "left_anti")
    near = true.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("query_id", "v").collect()
    by_query: dict[int, list] = {}
    for r in near:
        by_query.setdefault(r["query_id"], []).append(r["v"])
    if not by_query:
        return Tables(dimension, tables, *grid[0], probes or 1, seed)
    sample = np.array([r["v"] for r in sample.collect()])
    queries = np.array([r["v"] for r in asked if r["id"] in by_query])
    given = spark.sparkContext.broadcast((sample, queries, [np.array(by_query[r["id"]]) for r in asked if r["id"] in by_query]))

    def tried(batches):
        for batch in batches:
            for at in batch.column("id").to_pylist():
                cuts, cell = grid[at]
                hit, share = curves(Tables(dimension, tables, cuts, cell, probes or PROBES, seed), *given.value)
                i = len(hit) - 1 if probes else min(int(np.searchsorted(hit, recall)), len(hit) - 1)
                yield pa.record_batch([pa.array([at]), pa.array([i + 1]), pa.array([hit[i]]), pa.array([share[i] * n + tables * (i + 1) / 2])], ["at", "probes", "hit", "work"])

    settings = spark.range(len(grid), numPartitions=len(grid)).mapInArrow(tried, "at long, probes long, hit double, work double").collect()
    good = [r for r in settings if r["hit"] >= recall]
    best = min(good, key=lambda r: (r["work"], r["at"])) if good else max(settings, key=lambda r: (r["hit"], -r["work"], -r["at"]))
    return Tables(dimension, tables, *grid[best["at"]], best["probes"], seed)


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def blocks(short: DataFrame):
    """(ids, vectors) of about BLOCK queries at a time, by the hash of their ids."""
    short = stored(short.select("id", "v"), "short")
    many = -(-short.count() // BLOCK)
    for i in range(many):
        block = short.where(F.pmod(F.xxhash64("id"), F.lit(many)) == i).collect()
        if block:
            yield np.array([r["id"] for r in block]), np.array([r["v"] for r in block])


def against(queries: DataFrame, few: DataFrame, k: int) -> DataFrame:
    """Each query's best of a few vectors, which are broadcast."""
    held = few.select("id", "v").collect()
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in held]), np.array([r["v"] for r in held])))

    def run(batches):
        ids, v = shared.value
        for batch in batches:
            for own, x in zip(batch.column("id").to_pylist(), matrix(batch.column("v")), strict=True):
                other = ids != own
                found, score = best_of(ids[other], v[other], x, k)
                yield pa.record_batch([pa.array(np.full(len(found), own)), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return queries.select("id", "v").mapInArrow(run, BEST)


def compared(rows: DataFrame, block, k: int) -> DataFrame:
    """Each of a block of queries against all rows; the best of each batch."""

    def run(batches):
        asked, q = block.value
        for batch in batches:
            ids, v = np.array(batch.column("id").to_pylist()), matrix(batch.column("v"))
            for own, x in zip(asked, q, strict=True):
                other = ids != own
                found, score = best_of(ids[other], v[other], x, k)
                yield pa.record_batch([pa.array(np.full(len(found), own)), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return rows.select("id", "v").mapInArrow(run, BEST)
