"""Places of regular expression matches as column expressions. Patterns must be linear: possessive, and begun only where a run begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(lengths: Column) -> Column:
    """Sums of the elements before each element. In chunks, so that a long array costs little more than its length."""
    sums = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def listed(a: Column, begin: Column) -> Column:
        state = F.struct(begin.alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(a, state, lambda t, x: F.struct((t["s"] + x).alias("s"), F.concat(t["a"], F.array(t["s"])).alias("a")), lambda t: t["a"])

    def chunked(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda k: F.slice(a, k * CHUNK + 1, F.lit(CHUNK)))
        return let(parts, lambda p: let(listed(F.transform(p, sums), F.lit(0).cast("long")), lambda at: F.flatten(F.zip_with(p, at, listed))))

    return let(lengths, lambda a: F.when(F.size(a) > CHUNK, chunked(a)).otherwise(listed(a, F.lit(0).cast("long"))))


def matches(text: Column, pattern: Column, near: int = 0) -> Column:
    """array<struct<start, end, found>> of all leftmost matches that do not overlap, in code points, end exclusive.

    With `near`, also `before` and `after`: that many characters at most between a match and its neighbours.
    """

    def placed(between: Column, found: Column) -> Column:
        lengths = F.zip_with(between, found, lambda b, m: (F.length(b) + F.coalesce(F.length(m), F.lit(0))).cast("long"))

        def one(at: Column):
            def span(m: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(F.get(between, i))
                sides = [F.substring(F.get(between, i), -near, near).alias("before"), F.substring(F.get(between, i + 1), 1, near).alias("after")] if near else []
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"), *sides)

            return span

        return let(running_sums(lengths), lambda at: F.transform(found, one(at)))

    return let(F.split(text, pattern, -1), lambda between: let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: placed(between, found)))
