"""Array data types: strings such as ``<f8``, their JSON form, and the Spark types that hold them."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

from nodelake.errors import InvalidDType, Unsupported

KINDS = {"b": "boolean", "t": "bit_field", "i": "integer", "u": "unsigned", "f": "floating", "c": "complex", "m": "timedelta", "M": "datetime", "S": "bytes", "U": "unicode", "V": "void"}
ORDERS = {"<": "little", ">": "big", "|": "not_applicable"}
_TEXT = re.compile(r"([<>|=])([btiufcmMSUV])(\d+)(?:\[([^\]]*)\])?")


@dataclass(frozen=True)
class DType:
    """One scalar kind. ``itemsize`` is in bytes (unicode: four a character)."""

    order: str
    kind: str
    itemsize: int
    unit: str | None = None

    @staticmethod
    def parse(text: str) -> DType:
        m = _TEXT.fullmatch(text)
        if m is None:
            raise InvalidDType(f"not a data type: {text!r}")
        order, kind, size, unit = m.groups()
        if unit is not None and kind not in "mM":
            raise InvalidDType(f"only times have a unit: {text!r}")
        if order == "=":
            order = "<" if sys.byteorder == "little" else ">"
        return DType(order, kind, int(size) * (4 if kind == "U" else 1), unit)

    def __str__(self) -> str:
        size = self.itemsize // 4 if self.kind == "U" else self.itemsize
        return f"{self.order}{self.kind}{size}" + (f"[{self.unit}]" if self.unit else "")

    def to_json(self) -> dict:
        return {"endianness": ORDERS[self.order], "kind": self.kind, "itemsize": self.itemsize, "dt_units": f"[{self.unit}]" if self.unit else None}

    @staticmethod
    def from_json(doc: dict) -> DType:
        order = {v: k for k, v in ORDERS.items()}.get(doc.get("endianness"))
        if order is None or doc.get("kind") not in KINDS or not isinstance(doc.get("itemsize"), int):
            raise InvalidDType(f"not a data type: {doc!r}")
        units = doc.get("dt_units")
        return DType(order, doc["kind"], doc["itemsize"], units.strip("[]") if units else None)

    def numpy(self) -> np.dtype:
        if self.kind == "t":
            raise Unsupported("bit fields have no numpy type")
        return np.dtype(str(self))

    def spark(self) -> T.DataType:
        """Unsigned integers widen by one step; nanosecond times stay integers, which lose nothing."""
        n = self.itemsize
        table = {
            ("b", 1): T.BooleanType(),
            **{("i", k): t for k, t in ((1, T.ByteType()), (2, T.ShortType()), (4, T.IntegerType()), (8, T.LongType()))},
            **{("u", k): t for k, t in ((1, T.ShortType()), (2, T.IntegerType()), (4, T.LongType()), (8, T.DecimalType(20, 0)))},
            **{("f", k): t for k, t in ((2, T.FloatType()), (4, T.FloatType()), (8, T.DoubleType()))},
        }
        if self.kind == "c":
            part = {8: T.FloatType(), 16: T.DoubleType()}.get(n)
            if part is not None:
                return T.StructType([T.StructField("re", part), T.StructField("im", part)])
        if self.kind in "mM":
            if self.unit in ("s", "ms", "us"):
                return T.TimestampNTZType() if self.kind == "M" else T.DayTimeIntervalType()
            return T.LongType()
        if self.kind in "StV":
            return T.BinaryType()
        if self.kind == "U":
            return T.StringType()
        if (self.kind, n) not in table:
            raise Unsupported(f"no Spark type holds {self}")
        return table[self.kind, n]


@dataclass(frozen=True)
class Field:
    """A named part of a struct type, perhaps an array of fixed shape."""

    name: str
    dtype: DType | StructDType
    shape: tuple[int, ...] = ()


@dataclass(frozen=True)
class StructDType:
    itemsize: int
    fields: tuple[Field, ...]

    def depth(self) -> int:
        """Levels of struct types, this one included."""
        return 1 + max((f.dtype.depth() for f in self.fields if isinstance(f.dtype, StructDType)), default=0)

    def spark(self) -> T.StructType:
        def held(f: Field) -> T.DataType:
            kind = f.dtype.spark()
            for _ in f.shape:
                kind = T.ArrayType(kind)
            return kind

        return T.StructType([T.StructField(f.name, held(f)) for f in self.fields])

    def to_json(self) -> dict:
        return {"itemsize": self.itemsize, "fields": [{"name": f.name, "dtype": f.dtype.to_json(), "shape": list(f.shape) or None} for f in self.fields]}


def from_json(doc: dict) -> DType | StructDType:
    """A struct type if the document has ``fields``, else a scalar kind."""
    if "fields" not in doc:
        return DType.from_json(doc)
    try:
        fields = tuple(Field(f["name"], from_json(f["dtype"]), tuple(f.get("shape") or ())) for f in doc["fields"])
        return StructDType(int(doc["itemsize"]), fields)
    except (KeyError, TypeError) as e:
        raise InvalidDType(f"not a struct type: {doc!r}") from e


#: The declared kind of a run's data key -> its array type, where nothing more is known.
DECLARED = {"string": DType("<", "U", 40), "boolean": DType("|", "b", 1)}


def of_data_key(declared: str) -> DType:
    return DECLARED.get(declared, DType("<", "f", 8))
