"""Counts over whole texts as Spark columns (no Python on the executors).

A word is a maximal run of characters other than space and U+0009 to U+000D. All counts are 0 for
a null text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, also where ``f`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among the one-byte ``chars``."""
    return (F.octet_length(text) - F.octet_length(without(text, chars))).cast("long")


def words(text: Column) -> Column:
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.char_length(without(text, BLANKS)).cast("long")


def lines(text: Column) -> Column:
    """Lines, cut at line feeds, that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def repeats(items: Column) -> Column:
    """How many items of an array equal an earlier one."""
    return let(items, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def repeated_words(all_words: Column, width: int = 8) -> Column:
    """Words inside a window of ``width`` words that occurs twice or more, every occurrence counted.

    Windows are told apart by a 64-bit hash within their own text only.
    """

    def starts(hashes: Column) -> Column:
        def repeated(s: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
            picked = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(picked, lambda k: F.get(s, k)["i"]))

        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)

    def covered(s: Column) -> Column:
        steps = F.transform(s, lambda at, k: F.coalesce(F.least(F.lit(width), F.get(s, k + 1) - at), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(starts(h), covered)))
        )

    return let(all_words, count)
