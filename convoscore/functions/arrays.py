"""Folds over long arrays in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded before what they emitted is put aside: an array is copied whenever something is appended.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, whatever it is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stretch(items: Column, begin: Column, stop: Column) -> Column:
    """The elements from ``begin`` to before ``stop`` of a column or bound array; ``slice`` copies the whole array first."""
    return F.when(begin < stop, F.transform(F.sequence(begin, stop - 1), lambda i: F.get(items, i))).otherwise(F.filter(F.array(F.get(items, F.lit(0))), lambda x: F.lit(False)))


def scan(items: Column, carry: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """ARRAY<kind> of all that ``step`` emits.

    ``step(carry, item)`` gives (ARRAY<kind> to emit, next carry); ``last(carry)`` what to emit in the end.  Items are
    folded in blocks, so that the cost of appending stays in proportion to their number."""
    none, blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    parts = bound(items, lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: stretch(x, k * BLOCK, F.least(F.size(x), (k + 1) * BLOCK)))))

    def inner(acc: Column, x: Column) -> Column:
        emitted, after = step(acc["carry"], x)
        return F.struct(F.concat(acc["out"], emitted).alias("out"), after.alias("carry"))

    def outer(acc: Column, part: Column) -> Column:
        begin = F.struct(none.alias("out"), acc["carry"].alias("carry"))
        return F.aggregate(part, begin, inner, lambda done: F.struct(F.concat(acc["out"], F.array(done["out"])).alias("out"), done["carry"].alias("carry")))

    def finish(acc: Column) -> Column:
        whole = F.flatten(acc["out"])
        return whole if last is None else F.concat(whole, last(acc["carry"]))

    return F.coalesce(F.aggregate(parts, F.struct(blocks.alias("out"), carry.alias("carry")), outer, finish), none if last is None else F.concat(none, last(carry)))
