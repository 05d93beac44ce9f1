"""N-dimensional arrays as rows: dense blocks, single cells, sparse cells and nested lists.

Dense arrays are *blocks*: (path, b0, b1, .., off0, off1, .., shape, data), one row for each block of
the chunk grid, data in C order. *Cells* are (i0, i1, .., value). What a block id or a slice means is
worked out on the driver; the data is then reached by plain comparisons that Spark pushes to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodelake.errors import Validation
from nodelake.functions import ndslice
from nodelake.functions.structures import ArrayStructure


def offsets(sizes: Sequence[int]) -> list[int]:
    """Where each chunk of a dimension starts."""
    return [0, *accumulate(sizes)][:-1]


def grid(shape: Sequence[int], chunk: Sequence[int]) -> tuple[tuple[int, ...], ...]:
    """Chunk sizes along each dimension for chunks of one size; the last may be smaller."""
    if len(shape) != len(chunk) or any(c < 1 for c in chunk):
        raise Validation(f"chunks {chunk!r} for a shape {shape!r}")
    return tuple(tuple([c] * (n // c) + ([n % c] if n % c else [])) if n else (0,) for n, c in zip(shape, chunk, strict=True))


def strides(shape: Sequence[int]) -> list[int]:
    """Elements from one position to the next along each dimension, in C order."""
    out, step = [], 1
    for n in reversed(shape):
        out.append(step)
        step *= n
    return out[::-1]


def block_ranges(chunks: Sequence[Sequence[int]], block: Sequence[int]) -> list[tuple[int, int]]:
    """First position and size of a block along each dimension, checked against the grid."""
    if len(block) != len(chunks):
        raise Validation(f"a block of {len(block)} indices in an array of {len(chunks)} dimensions")
    for b, own in zip(block, chunks, strict=True):
        if not 0 <= b < len(own):
            raise Validation(f"block {tuple(block)} is outside the grid")
    return [(offsets(own)[b], own[b]) for b, own in zip(block, chunks, strict=True)]


def parse_block(text: str, ndim: int) -> tuple[int, ...]:
    """``1,2``; the empty text is the first block."""
    try:
        block = tuple(int(x) for x in text.split(",")) if text.strip() else (0,) * ndim
    except ValueError:
        raise Validation(f"not a block: {text!r}") from None
    if len(block) != ndim:
        raise Validation(f"a block of {len(block)} indices in an array of {ndim} dimensions")
    return block


def from_values(spark: SparkSession, path: str, values: Sequence[float], shape: Sequence[int], chunk: Sequence[int] | None = None) -> DataFrame:
    """Blocks of a small array given as its values in C order."""
    if len(values) != ArrayStructure(None, (), tuple(shape)).size():
        raise Validation(f"{len(values)} values for a shape {tuple(shape)}")
    flat = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "flat long, value double")
    return to_blocks(unravel(flat, shape), path, shape, chunk or shape)


def ramp(spark: SparkSession, path: str, shape: Sequence[int], scale: float = 1.0, chunk: Sequence[int] | None = None) -> DataFrame:
    """Blocks of the array whose values are ``scale`` times their place in C order."""
    size = ArrayStructure(None, (), tuple(shape)).size()
    flat = spark.range(size).select(F.col("id").alias("flat"), (F.col("id") * F.lit(scale)).alias("value"))
    return to_blocks(unravel(flat, shape), path, shape, chunk or shape)


def unravel(flat: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Cells from (flat, value): the coordinates of each place in C order."""
    at = [F.floor(F.col("flat") / s).cast("long") % n for s, n in zip(strides(shape), shape, strict=True)]
    return flat.select(*[a.alias(f"i{d}") for d, a in enumerate(at)], "value")


def ravel(ndim: int, shape: Sequence[int]) -> Column:
    """The place of a cell in C order."""
    place = F.lit(0).cast("long")
    for d, s in zip(range(ndim), strides(shape), strict=True):
        place = place + F.col(f"i{d}") * F.lit(s)
    return place


def to_blocks(cells: DataFrame, path: str, shape: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """Blocks of regular chunks; every cell of the array must be there once."""
    ndim, sizes = len(shape), grid(shape, chunk)
    ids = [F.floor(F.col(f"i{d}") / c).cast("int").alias(f"b{d}") for d, c in enumerate(chunk)]
    own = [F.least(F.lit(c), F.lit(n) - F.floor(F.col(f"i{d}") / c) * c) for d, (c, n) in enumerate(zip(chunk, shape, strict=True))]
    inner, place = F.lit(1).cast("long"), F.lit(0).cast("long")
    for d in reversed(range(ndim)):
        place = place + (F.col(f"i{d}") % chunk[d]) * inner
        inner = inner * own[d]
    tagged = cells.select(*ids, F.array(*[o.cast("long") for o in own]).alias("shape"), F.struct(place.alias("at"), F.col("value").cast("double").alias("v")).alias("cell"))
    keys = [f"b{d}" for d in range(ndim)]
    blocks = tagged.groupBy(*keys, "shape").agg(F.transform(F.sort_array(F.collect_list("cell")), lambda c: c["v"]).alias("data"))
    starts = [(F.col(f"b{d}") * F.lit(c)).cast("long").alias(f"off{d}") for d, c in enumerate(chunk)]
    assert len(sizes) == ndim
    return blocks.select(F.lit(path).alias("path"), *keys, *starts, "shape", "data")


def cells(blocks: DataFrame, ndim: int) -> DataFrame:
    """Cells of blocks of one array."""
    exploded = blocks.select(*[f"off{d}" for d in range(ndim)], "shape", F.posexplode("data").alias("at", "value"))
    inner, out = F.lit(1).cast("long"), []
    for d in reversed(range(ndim)):
        size = F.get("shape", F.lit(d))
        out.insert(0, (F.col(f"off{d}") + F.floor(F.col("at") / inner) % size).cast("long").alias(f"i{d}"))
        inner = inner * size
    return exploded.select(*out, "value")


def read(blocks: DataFrame, path: str) -> DataFrame:
    return blocks.where(F.col("path") == path)


def read_block(blocks: DataFrame, path: str, structure: ArrayStructure, block: Sequence[int]) -> DataFrame:
    """The one row of a block."""
    block_ranges(structure.chunks, block)
    found = read(blocks, path)
    for d, b in enumerate(block):
        found = found.where(F.col(f"b{d}") == b)
    return found


def cell_block(all_cells: DataFrame, chunks: Sequence[Sequence[int]], block: Sequence[int]) -> DataFrame:
    """The cells of a block of an array kept as cells (dense or sparse), with their own coordinates."""
    found = all_cells
    for d, (start, size) in enumerate(block_ranges(chunks, block)):
        found = found.where((F.col(f"i{d}") >= start) & (F.col(f"i{d}") < start + size))
    return found


def apply_slice(all_cells: DataFrame, dims: tuple, shape: Sequence[int]) -> tuple[DataFrame, tuple[int, ...]]:
    """Cells of a slice, with coordinates that count from 0, and the shape that is left."""
    out, left, found = [], [], all_cells
    for d, p in enumerate(ndslice.pick(dims, tuple(shape))):
        at = F.col(f"i{d}")
        low, high = p.bounds()
        if low > 0 or high < shape[d] - 1:
            found = found.where(at.between(low, high))
        if abs(p.step) > 1:
            found = found.where((at - low) % abs(p.step) == 0)
        if not p.dropped:
            moved = at - low if p.step > 0 else high - at
            out.append((moved if abs(p.step) == 1 else F.floor(moved / abs(p.step))).cast("long").alias(f"i{len(left)}"))
            left.append(p.count)
    return found.select(*out, "value"), tuple(left)


def slice_blocks(blocks: DataFrame, dims: tuple, structure: ArrayStructure) -> tuple[DataFrame, tuple[int, ...]]:
    """The same over blocks: only those that the slice touches are read."""
    found = blocks
    for d, p in enumerate(ndslice.pick(dims, structure.shape)):
        low, high = p.bounds()
        starts, sizes = offsets(structure.chunks[d]), structure.chunks[d]
        touched = [b for b in range(len(sizes)) if starts[b] <= high and starts[b] + sizes[b] > low]
        if len(touched) < len(sizes):
            found = found.where(F.col(f"b{d}").between(touched[0], touched[-1]) if touched else F.lit(False))
    return apply_slice(cells(found, len(structure.shape)), dims, structure.shape)


def write_blocks(blocks: DataFrame, where: str) -> None:
    """Write blocks as Parquet by path and block id; only blocks of the same ids are replaced."""
    ids = [c for c in blocks.columns if re.fullmatch(r"b\d+", c)]
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("path", *ids).parquet(where)


def dense(coo: DataFrame, shape: Sequence[int], fill: float = 0.0) -> DataFrame:
    """All cells of a sparse array; the ones that are not there hold ``fill``."""
    ndim, size = len(shape), ArrayStructure(None, (), tuple(shape)).size()
    all_places = unravel(coo.sparkSession.range(size).select(F.col("id").alias("flat"), F.lit(None).alias("value")), shape).drop("value")
    keys = [f"i{d}" for d in range(ndim)]
    found = coo.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("value").alias("given"))
    return all_places.join(found, keys, "left").select(*keys, F.coalesce("given", F.lit(fill)).alias("value"))


def sparse(all_cells: DataFrame, fill: float = 0.0) -> DataFrame:
    """The cells that differ from ``fill``."""
    return all_cells.where(F.col("value") != fill)


def element_count(shape: Column) -> Column:
    """Product of an array of sizes; 1 for none."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, n: a * n.cast("long"))


def awkward_elements(lists: DataFrame, value: str) -> DataFrame:
    """(i0, i1, value): the elements of one list a row, with the row's place and their own."""
    return lists.select("i0", F.posexplode(value).alias("i1", "value"))


def write_awkward(lists: DataFrame, where: str) -> None:
    """Write nested lists (one a row, with its place ``i0``) as Parquet, in place of what is there."""
    lists.write.mode("overwrite").parquet(where)


def awkward_counts(lists: DataFrame, value: str) -> DataFrame:
    return lists.select("i0", F.coalesce(F.size(value), F.lit(0)).alias("n"))


def awkward_buffers(buffers: DataFrame, keys: Sequence[str] | None = None, column: str = "buffers") -> DataFrame:
    """Named buffers (a map of binaries), all or those of the given form keys."""
    if keys is None:
        return buffers
    wanted = F.array(*map(F.lit, keys)).cast("array<string>")
    return buffers.withColumn(column, F.map_filter(column, lambda k, _: F.array_contains(wanted, k)))
