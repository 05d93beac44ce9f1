"""The node table: one row for each container, array, table, sparse or awkward array of a tree."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodelake.errors import Validation
from nodelake.functions.structures import FAMILIES

SPECS = "array<struct<name:string,version:string>>"
COLUMNS = {
    "path": "string", "parent": "string", "key": "string", "pos": "bigint", "depth": "int", "family": "string",
    "specs": SPECS, "metadata": "variant", "structure": "variant", "user_id": "string", "tags": "array<string>",
}


def nodes(rows: DataFrame) -> DataFrame:
    """A node table from rows that have at least path, pos, family and metadata.

    ``parent``, ``key`` and ``depth`` follow from the path; other columns default to null.
    """
    parts = F.split("path", "/")
    derived = {
        "key": F.element_at(parts, -1),
        "parent": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"),
        "depth": F.when(F.col("path") == "", F.lit(0)).otherwise(F.size(parts)),
    }
    out = []
    for name, kind in COLUMNS.items():
        have = F.col(name) if name in rows.columns else derived.get(name, F.lit(None))
        out.append((have if kind == "variant" and name in rows.columns else have.cast(kind)).alias(name))
    return rows.select(*out)


def metadata(**fields: Column) -> Column:
    """Columns as one VARIANT object."""
    return F.to_variant_object(F.struct(*[c.alias(k) for k, c in fields.items()]))


def literal(spark: SparkSession, entries: Iterable[dict]) -> DataFrame:
    """A small tree written out: dicts with path, family, and perhaps metadata, structure, specs, user_id, tags."""
    rows = []
    for pos, e in enumerate(entries):
        if e["family"] not in FAMILIES:
            raise Validation(f"no such family: {e['family']!r}")
        specs = [(s, None) if isinstance(s, str) else (s["name"], s.get("version")) for s in e.get("specs", [])]
        rows.append((e["path"].strip("/"), e.get("pos", pos), e["family"], json.dumps(e.get("metadata", {})), json.dumps(e["structure"]) if "structure" in e else None, specs, e.get("user_id"), e.get("tags", [])))
    frame = spark.createDataFrame(rows, f"path string, pos long, family string, m string, s string, specs {SPECS}, user_id string, tags array<string>")
    return nodes(frame.withColumn("metadata", F.parse_json("m")).withColumn("structure", F.parse_json("s")).drop("m", "s"))


def demo_tree(spark: SparkSession) -> DataFrame:
    """Arrays of one and two dimensions and a nested container, for trying things out."""

    def array(path: str, shape: list[int], meta: dict) -> dict:
        kind = {"endianness": "little", "kind": "f", "itemsize": 8, "dt_units": None}
        return {"path": path, "family": "array", "metadata": meta, "structure": {"data_type": kind, "chunks": [[n] for n in shape], "shape": shape, "dims": None, "resizable": False}}

    return literal(
        spark,
        [
            {"path": "", "family": "container", "metadata": {"description": "demo"}, "pos": 0},
            array("small_1d", [100], {}),
            array("medium_2d", [10, 20], {}),
            {"path": "sample_data", "family": "container", "metadata": {}},
            array("sample_data/spectrum", [50], {"element": "Cu", "edge": "K"}),
            array("large_1d", [100_000], {}),
            array("large_2d", [1000, 1000], {}),
        ],
    )


def inserted(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new nodes after the existing children of each parent; a taken path is an error."""
    if not table.join(new, "path", "left_semi").isEmpty():
        raise Validation("a path is taken")
    last = table.groupBy("parent").agg(F.max("pos").alias("last"))
    placed = new.join(last, "parent", "left").withColumn("pos", F.col("pos") + F.coalesce(F.col("last") + 1, F.lit(0)))
    return table.select(*COLUMNS).union(placed.select(*COLUMNS))


def with_metadata(table: DataFrame, path: str, doc: dict | None = None, specs: list[str] | None = None) -> DataFrame:
    """The table with one node's metadata and/or specs replaced."""
    here = F.col("path") == path
    if doc is not None:
        table = table.withColumn("metadata", F.when(here, F.parse_json(F.lit(json.dumps(doc)))).otherwise(F.col("metadata")))
    if specs is not None:
        named = F.array(*[F.struct(F.lit(s).alias("name"), F.lit(None).cast("string").alias("version")) for s in specs]).cast(SPECS)
        table = table.withColumn("specs", F.when(here, named).otherwise(F.col("specs")))
    return table
