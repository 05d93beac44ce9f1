"""Structure documents of the node families, read and checked."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nodelake.errors import Validation
from nodelake.functions import dtypes

FAMILIES = ("array", "awkward", "container", "sparse", "table")
#: Fixed value: what an encoded Arrow schema starts with.
SCHEMA_PREFIX = "data:application/vnd.apache.arrow.file;base64,"
#: Coordinates of a sparse array, where the document names no type.
COORDINATES = dtypes.DType("<", "u", 8)


@dataclass(frozen=True)
class ArrayStructure:
    data_type: dtypes.DType | dtypes.StructDType
    chunks: tuple[tuple[int, ...], ...]
    shape: tuple[int, ...]
    dims: tuple[str, ...] | None = None
    resizable: tuple[bool, ...] = (False,)

    def size(self) -> int:
        total = 1
        for n in self.shape:
            total *= n
        return total

    def nbytes(self) -> int:
        return self.size() * self.data_type.itemsize

    def strides(self) -> tuple[int, ...]:
        """Bytes from one element to the next along each dimension, last dimension fastest."""
        out, step = [], self.data_type.itemsize
        for n in reversed(self.shape):
            out.append(step)
            step *= n
        return tuple(reversed(out))


@dataclass(frozen=True)
class TableStructure:
    schema: pa.Schema
    npartitions: int
    columns: tuple[str, ...]


@dataclass(frozen=True)
class SparseStructure:
    shape: tuple[int, ...]
    chunks: tuple[tuple[int, ...], ...]
    dims: tuple[str, ...] | None = None
    data_type: dtypes.DType | None = None
    coord_data_type: dtypes.DType = COORDINATES
    layout: str = "COO"


@dataclass(frozen=True)
class AwkwardStructure:
    length: int
    form: dict


def encode_schema(schema: pa.Schema) -> str:
    return SCHEMA_PREFIX + base64.b64encode(schema.serialize().to_pybytes()).decode()


def decode_schema(text: str) -> pa.Schema:
    if not text.startswith(SCHEMA_PREFIX):
        raise Validation("an Arrow schema starts with its data prefix")
    return pa.ipc.read_schema(pa.py_buffer(base64.b64decode(text[len(SCHEMA_PREFIX) :])))


def to_json(structure, count: int | None = None) -> dict:
    """The document of a structure; ``from_json`` reads it back. A container's gives its number of children."""
    if isinstance(structure, ArrayStructure):
        resizable = structure.resizable[0] if len(structure.resizable) == 1 else list(structure.resizable)
        return {"data_type": structure.data_type.to_json(), "chunks": [list(c) for c in structure.chunks], "shape": list(structure.shape), "dims": list(structure.dims) if structure.dims else None, "resizable": resizable}
    if isinstance(structure, TableStructure):
        return {"arrow_schema": encode_schema(structure.schema), "npartitions": structure.npartitions, "columns": list(structure.columns), "resizable": False}
    if isinstance(structure, SparseStructure):
        kind = structure.data_type.to_json() if structure.data_type else None
        dims = list(structure.dims) if structure.dims else None
        return {"shape": list(structure.shape), "chunks": [list(c) for c in structure.chunks], "dims": dims, "resizable": False, "data_type": kind, "coord_data_type": structure.coord_data_type.to_json(), "layout": structure.layout}
    if isinstance(structure, AwkwardStructure):
        return {"length": structure.length, "form": structure.form}
    return {"contents": None, "count": count if count is not None else len(structure or ())}


def array_json(kind: Column, shape: Column, dims: Column) -> Column:
    """The same text for arrays of one chunk a dimension, as a column: ``kind`` is a ``dtype_column``."""
    one = F.struct(kind.alias("data_type"), F.transform(shape, lambda n: F.array(n)).alias("chunks"), shape.alias("shape"), dims.alias("dims"), F.lit(False).alias("resizable"))
    return F.to_json(one, {"ignoreNullFields": "false"})


def dtype_column(kind: dtypes.DType) -> Column:
    return F.struct(*[F.lit(v).cast("int" if k == "itemsize" else "string").alias(k) for k, v in kind.to_json().items()])


def _grid(chunks, shape) -> tuple[tuple[int, ...], ...]:
    grid = tuple(tuple(int(n) for n in own) for own in chunks)
    if len(grid) != len(shape) or any(sum(own) != n for own, n in zip(grid, shape, strict=True)):
        raise Validation(f"chunks {chunks!r} do not fill the shape {shape!r}")
    return grid


def from_json(family: str, doc: dict):
    """The structure of a node of ``family``; a container's is its child keys or None."""
    try:
        if family == "container":
            return tuple(doc["keys"]) if doc and doc.get("keys") is not None else None
        if family == "table":
            return TableStructure(decode_schema(doc["arrow_schema"]), int(doc["npartitions"]), tuple(doc["columns"]))
        if family == "awkward":
            return AwkwardStructure(int(doc["length"]), doc["form"])
        shape = tuple(int(n) for n in doc["shape"])
        dims = tuple(doc["dims"]) if doc.get("dims") else None
        if family == "array":
            resizable = doc.get("resizable", False)
            return ArrayStructure(dtypes.from_json(doc["data_type"]), _grid(doc["chunks"], shape), shape, dims, tuple(resizable) if isinstance(resizable, list) else (bool(resizable),))
        if family == "sparse":
            kind, coordinates = doc.get("data_type"), doc.get("coord_data_type")
            return SparseStructure(shape, _grid(doc["chunks"], shape), dims, dtypes.DType.from_json(kind) if kind else None, dtypes.DType.from_json(coordinates) if coordinates else COORDINATES)
    except (KeyError, TypeError, ValueError) as e:
        raise Validation(f"not a structure of {family}: {doc!r}") from e
    raise Validation(f"no such family: {family!r}")
