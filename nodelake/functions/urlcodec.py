"""Predicates as URL parameters ``filter[<kind>][condition][<field>]`` and back.

Parameters are an ordered list of pairs, so that a kind may come more than once: a field seen again
starts the next predicate of its kind. What cannot be read is an error, never left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from nodelake.errors import Validation
from nodelake.operators import predicates as P

_PARAM = re.compile(r"filter\[([^\]]+)\]\[condition\]\[([^\]]+)\]")

#: kind -> (field of the parameter, attribute, whether it is JSON, default or ... if required)
FIELDS: dict[str, list[tuple[str, str, bool, object]]] = {
    "fulltext": [("text", "text", False, ...)],
    "lookup": [("key", "key", False, ...)],
    "keys_filter": [("keys", "keys", True, ...)],
    "regex": [("key", "key", False, ...), ("pattern", "pattern", False, ...), ("case_sensitive", "case_sensitive", True, True)],
    "eq": [("key", "key", False, ...), ("value", "value", True, ...)],
    "noteq": [("key", "key", False, ...), ("value", "value", True, ...)],
    "comparison": [("operator", "operator", False, ...), ("key", "key", False, ...), ("value", "value", True, ...)],
    "contains": [("key", "key", False, ...), ("value", "value", True, ...)],
    "in": [("key", "key", False, ...), ("value", "values", True, ...)],
    "notin": [("key", "key", False, ...), ("value", "values", True, ...)],
    "keypresent": [("key", "key", False, ...), ("exists", "exists", True, True)],
    "like": [("key", "key", False, ...), ("pattern", "pattern", False, ...)],
    "specs": [("include", "include", True, ...), ("exclude", "exclude", True, ())],
    "access_blob_filter": [("user_id", "user_id", False, None), ("tags", "tags", True, ())],
    "structure_family": [("value", "value", False, ...)],
}
_LISTS = {"keys", "values", "include", "exclude", "tags"}


def encode(predicate: P.Predicate) -> list[tuple[str, str]]:
    out = []
    for name, attribute, is_json, default in FIELDS[predicate.name]:
        value = getattr(predicate, attribute)
        if default is ... or value != default:
            text = json.dumps(list(value) if attribute in _LISTS else value, separators=(",", ":"), ensure_ascii=False) if is_json else value
            out.append((f"filter[{predicate.name}][condition][{name}]", text))
    return out


def decode(params: Iterable[tuple[str, str]]) -> list[P.Predicate]:
    """Predicates of the parameters, in order; parameters that are no filters are passed over."""
    groups: list[tuple[str, dict[str, str]]] = []
    for key, value in params:
        if not key.startswith("filter["):
            continue
        m = _PARAM.fullmatch(key)
        if m is None or m[1] not in FIELDS:
            raise Validation(f"not a filter: {key!r}")
        kind, name = m.groups()
        if name not in [f[0] for f in FIELDS[kind]]:
            raise Validation(f"{kind} has no field {name!r}")
        own = next((g for k, g in reversed(groups) if k == kind and name not in g), None)
        if own is None:
            groups.append((kind, own := {}))
        own[name] = value
    return [_one(kind, fields) for kind, fields in groups]


def _one(kind: str, fields: dict[str, str]) -> P.Predicate:
    values = {}
    for name, attribute, is_json, default in FIELDS[kind]:
        if name not in fields:
            if default is ...:
                raise Validation(f"{kind} needs {name}")
            continue
        try:
            value = json.loads(fields[name]) if is_json else fields[name]
        except ValueError:
            raise Validation(f"{kind}: {name} is not JSON: {fields[name]!r}") from None
        if attribute in _LISTS:
            if not isinstance(value, list):
                raise Validation(f"{kind}: {name} is not a list")
            value = tuple(value)
        values[attribute] = value
    return P.KINDS[kind](**values)
