"""Spans of code points: naming, cutting, covering and redaction, from DataFrame functions only.

Everything is about linear in the text and its matches: running sums and running maxima are taken
by doubling (log2 n passes of one ``transform``), never by appending to an array, and stretches of a
long text are cut out of blocks of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.places import bind, matches, running

__all__ = ["apart", "covered", "digest", "matches", "named", "none", "outside", "redact", "stretch"]

SPAN = "struct<start:int,end:int,value:string>"
#: Characters of the blocks that stretches of a text are cut from.
BLOCK = 4096


def none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def named(spans: Column, kind: str, rank: int) -> Column:
    """Spans as (start, rank, end, kind, value), which sort by start and then by the kinds' order."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def digest(spans: Column) -> Column:
    """Named spans in order as kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def covered(spans: Column) -> Column:
    """What ``spans`` cover, as disjoint (start, end) in order; spans that touch stay apart."""

    def merged(own: Column, reach: Column) -> Column:
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(-1))
        heads = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.get(own, i)["start"] >= before(i))
        last = lambda heads, k: F.coalesce(F.get(heads, k + 1), F.size(own)) - 1
        return bind(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(own, i)["start"].alias("start"), F.get(reach, last(h, k)).alias("end"))))

    empty = none("struct<start:int,end:int>")
    ends = lambda own: running(F.transform(own, lambda s: s["end"]), F.greatest)
    sorted_spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when(F.size(spans) == 0, empty).otherwise(bind(sorted_spans, lambda own: bind(ends(own), lambda reach: merged(own, reach))))


def _leading(cover: Column, holds: Callable[[Column], Column]) -> Column:
    """How many of the first elements ``holds`` is true of, by halving; after the first false one it is false."""
    steps = F.lit([1 << k for k in reversed(range(31))])
    return F.aggregate(steps, F.lit(0), lambda at, p: F.when((p <= F.size(cover) - at) & holds(F.get(cover, at + p - 1)), at + p).otherwise(at))


def _first_beyond(cover: Column, place: Column) -> Column:
    """How many of the disjoint ``cover`` end at or before ``place``."""
    return _leading(cover, lambda c: c["end"] <= place)


def apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``."""
    free = lambda cover, s: F.coalesce(F.get(cover, _first_beyond(cover, s["start"]))["start"] >= s["end"], F.lit(True))
    chosen = bind(covered(base), lambda cover: F.filter(spans, lambda s: free(cover, s)))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(chosen)


def outside(spans: Column, base: Column) -> Column:
    """The parts of the named ``spans`` that lie outside ``base``."""

    def parts(s: Column, cover: Column) -> Column:
        def cut(low: Column, high: Column) -> Column:
            # the gaps between the covered stretches from number low to high (exclusive), within the span
            start = lambda i: F.when(i == low, s["start"]).otherwise(F.greatest(F.get(cover, i - 1)["end"], s["start"]))
            end = lambda i: F.when(i == high, s["end"]).otherwise(F.least(F.get(cover, i)["start"], s["end"]))
            part = lambda a, b: F.struct(a.alias("start"), s["rank"].alias("rank"), b.alias("end"), s["kind"].alias("kind"), stretch(s["value"], a - s["start"], b - s["start"]).alias("value"))
            return F.filter(F.transform(F.sequence(low, high), lambda i: part(start(i), end(i))), lambda p: p["start"] < p["end"])

        high = _leading(cover, lambda c: c["start"] < s["end"])
        return bind(F.struct(_first_beyond(cover, s["start"]).alias("low"), high.alias("high")), lambda x: cut(x["low"], F.greatest(x["low"], x["high"])))

    every = bind(covered(base), lambda cover: F.flatten(F.transform(spans, lambda s: parts(s, cover))))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(every)


def stretch(text: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of ``text``."""
    return F.substring(text, start + 1, end - start)


def _cutter(text: Column, blocks: Column) -> Callable[[Column, Column], Column]:
    """A function that cuts stretches out of ``text`` by way of its ``blocks`` where it has more than one."""

    def cut(start: Column, end: Column) -> Column:
        low, high = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        one = stretch(F.get(blocks, low), start - low * BLOCK, end - low * BLOCK)
        more = F.concat(
            stretch(F.get(blocks, low), start - low * BLOCK, F.lit(BLOCK)), F.array_join(F.slice(blocks, low + 2, F.greatest(high - low - 1, F.lit(0))), ""),
            F.coalesce(stretch(F.get(blocks, high), F.lit(0), end - high * BLOCK), F.lit("")),
        )
        return F.when(start >= end, "").when(F.size(blocks) < 2, stretch(text, start, end)).when(low == high, one).otherwise(more)

    return cut


def redact(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every stretch that spans cover replaced by ``mark``."""

    def done(cover: Column, blocks: Column) -> Column:
        cut = _cutter(text, blocks)
        kept = lambda s, i: F.concat(cut(F.coalesce(F.get(cover, i - 1)["end"], F.lit(0)), s["start"]), F.lit(mark))
        return F.concat(F.array_join(F.transform(cover, kept), ""), cut(F.element_at(cover, -1)["end"], F.char_length(text)))

    blocks = F.when(F.char_length(text) > BLOCK, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))).otherwise(F.array(text))
    return F.when(F.size(spans) == 0, text).otherwise(bind(covered(spans), lambda cover: bind(blocks, lambda b: done(cover, b))))
