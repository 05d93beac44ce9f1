"""Slices of N-dimensional arrays: text and JSON forms, and the index ranges they mean for a shape."""

from __future__ import annotations

import re
from dataclasses import dataclass

from nodelake.errors import InvalidSlice

#: A slice without blanks or an ellipsis, as a parameter may have to be.
PATTERN = re.compile(r"^\[?(-?\d+|-?\d*:-?\d*(:-?\d*)?)(,(-?\d+|-?\d*:-?\d*(:-?\d*)?))*\]?$")


@dataclass(frozen=True)
class Index:
    at: int


@dataclass(frozen=True)
class Range:
    start: int | None = None
    stop: int | None = None
    step: int | None = None


ELLIPSIS = Ellipsis
Dim = Index | Range | type(Ellipsis)


@dataclass(frozen=True)
class Picked:
    """One dimension of a slice on a known length: positions start, start + step, ... (``count`` of them)."""

    start: int
    step: int
    count: int
    dropped: bool

    def bounds(self) -> tuple[int, int]:
        """Least and largest position picked; (0, -1) if there is none."""
        if not self.count:
            return 0, -1
        last = self.start + self.step * (self.count - 1)
        return min(self.start, last), max(self.start, last)


def parse(text: str) -> tuple[Dim, ...]:
    """``1:3, 4, ..., ::2`` with or without brackets; the empty text picks everything."""
    body = text.replace(" ", "")
    if body.startswith("[") != body.endswith("]"):
        raise InvalidSlice(f"brackets do not match: {text!r}")
    body = body[1:-1] if body.startswith("[") else body
    dims = tuple(_dim(part, text) for part in body.split(",")) if body else ()
    if sum(d is ELLIPSIS for d in dims) > 1:
        raise InvalidSlice(f"more than one ellipsis: {text!r}")
    return dims


def _dim(part: str, text: str) -> Dim:
    if part == "...":
        return ELLIPSIS
    try:
        if ":" not in part:
            return Index(int(part))
        numbers = [int(x) if x else None for x in part.split(":")]
    except ValueError:
        raise InvalidSlice(f"not a slice: {text!r}") from None
    if len(numbers) > 3:
        raise InvalidSlice(f"not a slice: {text!r}")
    return _checked(Range(*numbers))


def _checked(r: Range) -> Range:
    if r.step == 0:
        raise InvalidSlice("a step of zero")
    return r


def to_text(dims: tuple[Dim, ...]) -> str:
    def one(d: Dim) -> str:
        if d is ELLIPSIS:
            return "..."
        if isinstance(d, Index):
            return str(d.at)
        ends = ":".join("" if x is None else str(x) for x in (d.start, d.stop))
        return ends if d.step is None else f"{ends}:{d.step}"

    return ",".join(map(one, dims))


def to_json(dims: tuple[Dim, ...]) -> list:
    def one(d: Dim):
        if d is ELLIPSIS:
            return {"step": 0}
        if isinstance(d, Index):
            return d.at
        return {k: v for k, v in (("start", d.start), ("stop", d.stop), ("step", d.step)) if v is not None}

    return [one(d) for d in dims]


def from_json(items: list) -> tuple[Dim, ...]:
    def one(x) -> Dim:
        if isinstance(x, int) and not isinstance(x, bool):
            return Index(x)
        if isinstance(x, dict):
            return ELLIPSIS if x == {"step": 0} else _checked(Range(x.get("start"), x.get("stop"), x.get("step")))
        raise InvalidSlice(f"neither a number nor an object: {x!r}")

    return tuple(map(one, items))


def parse_parameter(text: str) -> tuple[Dim, ...]:
    """``parse`` of a request's parameter, which may hold neither blanks nor an ellipsis."""
    if text and not PATTERN.match(text):
        raise InvalidSlice(f"not a slice: {text!r}")
    return parse(text)


def is_empty(dims: tuple[Dim, ...]) -> bool:
    """Whether no dimension is named (which picks everything)."""
    return len(dims) == 0


def is_full(dims: tuple[Dim, ...]) -> bool:
    """Whether every dimension is picked whole."""
    return all(d is ELLIPSIS or isinstance(d, Range) and d.start in (None, 0) and d.stop is None and d.step in (None, 1) for d in dims)


def expand(dims: tuple[Dim, ...], ndim: int) -> tuple[Dim, ...]:
    """One entry for each dimension: the ellipsis (or the end) is filled with whole dimensions."""
    given = sum(d is not ELLIPSIS for d in dims)
    if given > ndim:
        raise InvalidSlice(f"{given} dimensions in a slice of an array of {ndim}")
    at = dims.index(ELLIPSIS) if ELLIPSIS in dims else len(dims)
    return dims[:at] + (Range(),) * (ndim - given) + dims[at + 1 :]


def pick(dims: tuple[Dim, ...], shape: tuple[int, ...]) -> tuple[Picked, ...]:
    """The positions picked in each dimension; negative numbers count from the end."""

    def one(d: Dim, n: int) -> Picked:
        if isinstance(d, Index):
            if not -n <= d.at < n:
                raise InvalidSlice(f"index {d.at} in a dimension of {n}")
            return Picked(d.at % n, 1, 1, True)
        positions = range(n)[slice(d.start, d.stop, d.step)]
        return Picked(positions.start, positions.step, len(positions), False)

    return tuple(one(d, n) for d, n in zip(expand(dims, len(shape)), shape, strict=True))
