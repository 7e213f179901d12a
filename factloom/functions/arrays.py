"""Higher-order column helpers: a value computed once, running totals, places of matches, replaced matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element what those before it combine to, by blocks: in n elements about n x BLOCK steps and (n / BLOCK) squared."""

    def blocks(v):
        count = F.ceil(F.size(v) / BLOCK).cast("int")
        return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), 1, count), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, combine))

    def within(v, base):
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, (i - i % BLOCK) + 1, i % BLOCK), F.get(base, F.floor(i / BLOCK).cast("int")), combine))

    def bases(v):
        return let(blocks(v), lambda own: F.transform(own, lambda _, b: F.aggregate(F.slice(own, F.lit(1), b), zero, combine)))

    return let(values, lambda v: let(bases(v), lambda base: within(v, base)))


def places(text: Column, pattern: Column) -> Column:
    """array<struct<start, value>> of the matches of a pattern: code points from 0."""
    pieces = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def placed(p):
        steps = F.zip_with(p["found"], F.slice(p["between"], F.lit(1), F.size(p["found"])), lambda m, b: F.length(m) + F.length(b))
        starts = F.zip_with(running(steps, F.lit(0), lambda x, y: x + y), p["between"], lambda x, b: x + F.length(b))
        return F.zip_with(p["found"], F.slice(starts, F.lit(1), F.size(p["found"])), lambda m, at: F.struct(at.alias("start"), m.alias("value")))

    return let(pieces, placed)


def spliced(text: Column, pattern: Column, change: Callable[[Column, Column], Column]) -> Column:
    """The text with ``change(match, number of the match)`` in place of each match."""
    pieces = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return let(pieces, lambda p: F.concat(F.array_join(F.zip_with(F.slice(p["between"], F.lit(1), F.size(p["found"])), F.transform(p["found"], change), lambda b, m: F.concat(b, m)), ""), F.element_at(p["between"], -1)))


def quoted(value: Column) -> Column:
    """The value as a pattern that matches it alone."""
    return F.regexp_replace(value, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
