"""Writing arrays, tables and documents in wire formats.

``*_bytes`` give one block, partition or run back to the caller, whose size the chunk grid bounds; the
``write_*`` functions write any amount as files, one for each task.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodelake.errors import NotFound, Validation
from nodelake.functions import media


def array_bytes(block: DataFrame, kind: str = "<f8") -> bytes:
    """The values of one block, packed in C order."""
    rows = block.select("data").limit(2).collect()
    if len(rows) != 1:
        raise NotFound("no such block") if not rows else Validation("more than one block")
    return np.asarray(rows[0]["data"], dtype=np.dtype(kind)).tobytes()


def sparse_bytes(cells: DataFrame, ndim: int) -> bytes:
    """One block of a sparse array: the coordinates of each dimension (``<u8``), then the values (``<f8``)."""
    keys = [f"i{d}" for d in range(ndim)]
    found = cells.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("value").cast("double").alias("value")).orderBy(*keys).toArrow()
    return b"".join(found.column(c).to_numpy().astype("<f8" if c == "value" else "<u8").tobytes() for c in [*keys, "value"])


def sparse_file(cells: DataFrame, ndim: int) -> bytes:
    """The same as an Arrow file."""
    return table_bytes(cells.select(*[f"i{d}" for d in range(ndim)], "value").orderBy(*[f"i{d}" for d in range(ndim)]))


def number_text(value: Column) -> Column:
    """Shortest plain text of a double: no exponent, no trailing zeros (1 for 1.0); null for null."""
    text = value.cast("double").cast("string")
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d+)\.(\d+)(?:E(-?\d+))?$", k)
    digits = F.concat(part(2), part(3))
    point = (F.length(part(2)) + F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))).cast("int")
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, "0"))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    trimmed = F.regexp_replace(trimmed, r"^0+(?=\d)", "")
    return F.when(F.isnan(value), "NaN").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(F.concat(part(1), trimmed))


def csv_rows(cells: DataFrame, ndim: int, text: Column | None = None) -> DataFrame:
    """(i0, line): one line for each leading index, its values in C order."""
    cell = F.struct(*[f"i{d}" for d in range(1, ndim)], (text if text is not None else number_text(F.col("value"))).alias("t"))
    return cells.groupBy("i0").agg(F.array_join(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["t"]), ",").alias("line"))


def write_csv(cells: DataFrame, ndim: int, where: str) -> None:
    csv_rows(cells, ndim).orderBy("i0").select("line").write.text(where)


def table_bytes(table: DataFrame) -> bytes:
    """One partition of a table as an Arrow file."""
    found, out = table.toArrow(), io.BytesIO()
    with pa.ipc.new_file(out, found.schema) as writer:
        writer.write_table(found)
    return out.getvalue()


def json_lines(rows: DataFrame) -> DataFrame:
    """Every row as one JSON object in a column ``line``."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def write_json_lines(lines: DataFrame, where: str, compression: str | None = None) -> None:
    lines.select("line").write.option("compression", compression or "none").text(where)


def default_registry() -> media.Registry:
    registry = media.Registry()
    registry.register("array", media.OCTET_STREAM, array_bytes)
    registry.register("array", media.CSV, csv_rows)
    registry.register("sparse", media.OCTET_STREAM, sparse_bytes)
    registry.register("sparse", media.ARROW_FILE, sparse_file)
    registry.register("table", media.ARROW_FILE, table_bytes)
    return registry
