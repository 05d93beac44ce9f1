"""Predicates over node metadata: fifteen kinds, each a Spark condition.

Metadata is a VARIANT; keys are literal top-level keys (``a.b`` is one key). What is missing, or of
another type, does not meet a predicate, and meets the negative kinds (``NotEq``, ``NotIn``). A JSON
null is a value: it makes a key present and can equal null.

The positive kinds are plain comparisons of one typed value (a null condition filters like a false
one), so that Spark can hand them to the scan of a stored table; the negative ones are two valued.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodelake.errors import Validation
from nodelake.functions.structures import FAMILIES

INTEGERS = ("BIGINT", "INT", "SMALLINT", "TINYINT")
OPERATORS = {"lt": "<", "gt": ">", "le": "<=", "ge": ">="}


@dataclass(frozen=True)
class Context:
    """Where a node table keeps things.

    ``scope`` is a key that metadata keys are looked up under (runs keep theirs under ``start``);
    ``promoted`` maps a metadata key to a plain column with the same values, which is used instead (a null in
    it is a missing key). Its type counts as the value's: a literal of another one meets nothing.
    """

    metadata: str = "metadata"
    text: str | None = None
    scope: str | None = None
    promoted: dict[str, str] = field(default_factory=dict)

    def path(self, key: str) -> str:
        return "$" + "".join(_step(k) for k in ([self.scope] if self.scope else []) + [key])

    def value(self, key: str) -> Column:
        """The value as a VARIANT; NULL where the key is missing."""
        return F.variant_get(F.col(self.metadata), self.path(key), "variant")

    def typed(self, key: str, kind: str) -> Column:
        return F.try_variant_get(F.col(self.metadata), self.path(key), kind)

    def full_text(self) -> Column:
        return F.col(self.text) if self.text else F.to_json(F.col(self.metadata))


def _step(key: str) -> str:
    if '"' not in key:
        return f'["{key}"]'
    if "'" not in key:
        return f"['{key}']"
    raise Validation(f"a key with both kinds of quotes: {key!r}")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_integer(v: Column) -> Column:
    return _kind(v).isin(*INTEGERS)


def _is_fraction(v: Column) -> Column:
    return _kind(v).isin("DOUBLE", "FLOAT") | _kind(v).startswith("DECIMAL")


def _cast(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def equals(v: Column, value: Any) -> Column:
    """Whether a VARIANT equals a JSON value: same type and value; 1 and 1.0 differ."""
    if value is None:
        same = F.is_variant_null(v)
    elif isinstance(value, bool):
        same = (_kind(v) == "BOOLEAN") & (_cast(v, "boolean") == value)
    elif isinstance(value, int) and -(2**63) <= value < 2**63:
        same = _is_integer(v) & (_cast(v, "bigint") == F.lit(value).cast("bigint"))
    elif isinstance(value, (int, float)):
        same = _is_fraction(v) & (_cast(v, "double") == float(value))
    elif isinstance(value, str):
        same = (_kind(v) == "STRING") & (_cast(v, "string") == value)
    else:
        same = F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False))))
    return v.isNotNull() & F.coalesce(same, F.lit(False))


def compares(v: Column, operator: str, value: Any) -> Column:
    """Whether a VARIANT is less, greater, ... than a number or string of the same sort."""

    def put(x: Column, y: Column) -> Column:
        return {"lt": x < y, "gt": x > y, "le": x <= y, "ge": x >= y}[operator]

    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return F.lit(False)
    if isinstance(value, str):
        found = (_kind(v) == "STRING") & put(_cast(v, "string"), F.lit(value))
    else:
        exact = isinstance(value, int) and -(2**63) <= value < 2**63
        by_integer = put(_cast(v, "bigint"), F.lit(value).cast("bigint")) if exact else put(_cast(v, "double"), F.lit(float(value)))
        found = F.when(_is_integer(v), by_integer).when(_is_fraction(v), put(_cast(v, "double"), F.lit(float(value))))
    return v.isNotNull() & F.coalesce(found, F.lit(False))


def _of_types(c: Column, names: tuple[str, ...]) -> Column:
    """Whether a plain column has one of the types; Spark folds this before it reads a row."""
    return F.regexp_extract(F.typeof(c), r"^[a-z]+", 0).isin(*names)


INTEGER_TYPES, FRACTION_TYPES = ("tinyint", "smallint", "int", "bigint"), ("float", "double", "decimal")


def promoted_equals(c: Column, value: Any) -> Column:
    """Whether a plain column equals a JSON value of the same type."""
    if isinstance(value, bool):
        return _of_types(c, ("boolean",)) & (c.try_cast("boolean") == value)
    if isinstance(value, str):
        return _of_types(c, ("string",)) & (c.cast("string") == value)
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        return _of_types(c, INTEGER_TYPES) & (c.try_cast("bigint") == F.lit(value).cast("bigint"))
    if isinstance(value, (int, float)):
        return _of_types(c, FRACTION_TYPES) & (c.try_cast("double") == float(value))
    return F.lit(False)


def promoted_compares(c: Column, operator: str, value: Any) -> Column:
    """Whether a plain column is less, greater, ... than a string or number of the same sort."""
    put = lambda x, y: {"lt": x < y, "gt": x > y, "le": x <= y, "ge": x >= y}[operator]
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return F.lit(False)
    if isinstance(value, str):
        return _of_types(c, ("string",)) & put(c.cast("string"), F.lit(value))
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        whole = _of_types(c, INTEGER_TYPES) & put(c.try_cast("bigint"), F.lit(value).cast("bigint"))
        return whole | (_of_types(c, FRACTION_TYPES) & put(c.try_cast("double"), F.lit(float(value))))
    return _of_types(c, INTEGER_TYPES + FRACTION_TYPES) & put(c.try_cast("double"), F.lit(float(value)))


class Predicate:
    """A condition on the rows of a node table."""

    name: str

    def column(self, ctx: Context) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class FullText(Predicate):
    """The metadata's text holds ``text`` (case counts)."""

    text: str
    name = "fulltext"

    def column(self, ctx):
        return F.coalesce(F.contains(ctx.full_text(), F.lit(self.text)), F.lit(False))


@dataclass(frozen=True)
class Lookup(Predicate):
    key: str
    name = "lookup"

    def column(self, ctx):
        return F.col("key") == self.key


@dataclass(frozen=True)
class KeysFilter(Predicate):
    keys: tuple[str, ...]
    name = "keys_filter"

    def column(self, ctx):
        return F.col("key").isin(list(self.keys))


@dataclass(frozen=True)
class Regex(Predicate):
    """A string value has a match of the pattern."""

    key: str
    pattern: str
    case_sensitive: bool = True
    name = "regex"

    def column(self, ctx):
        return _on_string(ctx, self.key, lambda s: s.rlike(self.pattern if self.case_sensitive else f"(?i){self.pattern}"))


@dataclass(frozen=True)
class Like(Predicate):
    """A string value matches an SQL LIKE pattern."""

    key: str
    pattern: str
    name = "like"

    def column(self, ctx):
        return _on_string(ctx, self.key, lambda s: s.like(self.pattern))


def _on_string(ctx: Context, key: str, test) -> Column:
    if key in ctx.promoted:
        c = F.col(ctx.promoted[key])
        return _of_types(c, ("string",)) & test(c.cast("string"))
    v = ctx.value(key)
    return F.coalesce((_kind(v) == "STRING") & test(ctx.typed(key, "string")), F.lit(False))


@dataclass(frozen=True)
class Eq(Predicate):
    key: str
    value: Any
    name = "eq"

    def column(self, ctx):
        if self.key in ctx.promoted:
            return promoted_equals(F.col(ctx.promoted[self.key]), self.value)
        v = ctx.value(self.key)
        if isinstance(self.value, bool):
            return (ctx.typed(self.key, "boolean") == self.value) & (_kind(v) == "BOOLEAN")
        if isinstance(self.value, str):
            return (ctx.typed(self.key, "string") == self.value) & (_kind(v) == "STRING")
        if isinstance(self.value, int) and -(2**63) <= self.value < 2**63:
            return (ctx.typed(self.key, "bigint") == F.lit(self.value).cast("bigint")) & _is_integer(v)
        return equals(v, self.value)


@dataclass(frozen=True)
class NotEq(Predicate):
    """Also true where the key is missing."""

    key: str
    value: Any
    name = "noteq"

    def column(self, ctx):
        return ~F.coalesce(Eq(self.key, self.value).column(ctx), F.lit(False))


@dataclass(frozen=True)
class Comparison(Predicate):
    operator: str
    key: str
    value: Any
    name = "comparison"

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise Validation(f"no such comparison: {self.operator!r}")

    def column(self, ctx):
        if self.key in ctx.promoted:
            return promoted_compares(F.col(ctx.promoted[self.key]), self.operator, self.value)
        if isinstance(self.value, (int, float)) and not isinstance(self.value, bool) and abs(self.value) < 2**53:
            c, v, kind = ctx.typed(self.key, "double"), F.lit(float(self.value)), ctx.value(self.key)
            return {"lt": c < v, "gt": c > v, "le": c <= v, "ge": c >= v}[self.operator] & (_is_integer(kind) | _is_fraction(kind))
        return compares(ctx.value(self.key), self.operator, self.value)


@dataclass(frozen=True)
class Contains(Predicate):
    """An array value has ``value`` as an element."""

    key: str
    value: Any
    name = "contains"

    def column(self, ctx):
        v = ctx.value(self.key)
        held = F.exists(ctx.typed(self.key, "array<variant>"), lambda x: equals(x, self.value))
        return F.coalesce(_kind(v).startswith("ARRAY") & held, F.lit(False))


@dataclass(frozen=True)
class In(Predicate):
    key: str
    values: tuple[Any, ...]
    name = "in"

    def column(self, ctx):
        if self.key in ctx.promoted and self.values and all(isinstance(v, str) for v in self.values):
            c = F.col(ctx.promoted[self.key])
            return _of_types(c, ("string",)) & c.cast("string").isin(list(self.values))
        return reduce(lambda a, b: a | b, [F.coalesce(Eq(self.key, v).column(ctx), F.lit(False)) for v in self.values], F.lit(False))


@dataclass(frozen=True)
class NotIn(Predicate):
    """Also true where the key is missing."""

    key: str
    values: tuple[Any, ...]
    name = "notin"

    def column(self, ctx):
        return ~F.coalesce(In(self.key, self.values).column(ctx), F.lit(False))


@dataclass(frozen=True)
class KeyPresent(Predicate):
    key: str
    exists: bool = True
    name = "keypresent"

    def column(self, ctx):
        there = F.col(ctx.promoted[self.key]).isNotNull() if self.key in ctx.promoted else ctx.value(self.key).isNotNull()
        return there if self.exists else ~there


@dataclass(frozen=True)
class Specs(Predicate):
    """The node has all specs of ``include`` and none of ``exclude`` (by name)."""

    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    name = "specs"

    def column(self, ctx):
        names = F.coalesce(F.transform("specs", lambda s: s["name"]), F.array().cast("array<string>"))
        listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        has_all = F.size(F.array_except(listed(self.include), names)) == 0
        return has_all & ~F.arrays_overlap(names, listed(self.exclude)) if self.exclude else has_all


@dataclass(frozen=True)
class AccessBlobFilter(Predicate):
    """The node belongs to the user or carries one of the tags."""

    user_id: str | None = None
    tags: tuple[str, ...] = ()
    name = "access_blob_filter"

    def column(self, ctx):
        mine = F.col("user_id") == self.user_id if self.user_id is not None else F.lit(False)
        tagged = F.arrays_overlap("tags", F.array(*map(F.lit, self.tags))) if self.tags else F.lit(False)
        return F.coalesce(mine, F.lit(False)) | F.coalesce(tagged, F.lit(False))


@dataclass(frozen=True)
class StructureFamily(Predicate):
    value: str
    name = "structure_family"

    def __post_init__(self):
        if self.value not in FAMILIES:
            raise Validation(f"no such family: {self.value!r}")

    def column(self, ctx):
        return F.col("family") == self.value


KINDS = {
    c.name: c
    for c in (FullText, Lookup, KeysFilter, Regex, Eq, NotEq, Comparison, Contains, In, NotIn, KeyPresent, Like, Specs, AccessBlobFilter, StructureFamily)
}


class Key:
    """``Key("color") == "red"``, ``Key("t") > 300`` and so on, as predicates."""

    def __init__(self, key: str):
        self.key = key

    def __eq__(self, value):
        return Eq(self.key, value)

    def __ne__(self, value):
        return NotEq(self.key, value)

    def __lt__(self, value):
        return Comparison("lt", self.key, value)

    def __gt__(self, value):
        return Comparison("gt", self.key, value)

    def __le__(self, value):
        return Comparison("le", self.key, value)

    def __ge__(self, value):
        return Comparison("ge", self.key, value)

    __hash__ = None


def all_of(predicates: Iterable[Predicate], ctx: Context | None = None) -> Column | None:
    """The conjunction, or None where there is nothing to ask."""
    columns = [p.column(ctx or Context()) for p in predicates]
    return reduce(lambda a, b: a & b, columns) if columns else None
