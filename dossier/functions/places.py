"""Values bound once, running joins over arrays, and places of regular-expression matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``values`` with each replaced by the join (an associative operation) of all up to it, in log2 n passes."""
    steps = F.filter(F.lit([1 << k for k in range(31)]), lambda p: p < F.size(values))
    return F.aggregate(steps, values, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, join(x, F.get(acc, i - p))).otherwise(x)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as array of (start, end, value); end is exclusive."""

    def place(hits: Column, gaps: Column) -> Column:
        lengths = F.transform(hits, lambda h, i: F.char_length(h) + F.char_length(F.get(gaps, i)))
        span = lambda end, h: F.struct((end - F.char_length(h)).alias("start"), end.alias("end"), h.alias("value"))
        return F.zip_with(running(lengths, lambda a, b: a + b), hits, span)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPAN)
    return bind(found, lambda hits: F.when(F.coalesce(F.size(hits), F.lit(0)) <= 0, none).otherwise(bind(F.split(text, pattern, -1), lambda gaps: place(hits, gaps))))
