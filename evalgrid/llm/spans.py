"""Spans of regular expressions in texts, with DataFrame functions only.

Everything here takes time in proportion to the text and its matches, but for a small power: sums
run over stretches of STRETCH matches, whose offsets run over the stretches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: int, end: int, hit: string>"
AROUND = "struct<start: int, end: int, hit: string, before: string, after: string>"
EMPTY = f"array<{SPAN}>"
#: Matches in one stretch.
STRETCH = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, guard: Column | None = None, context: int = 0) -> Column:
    """array<struct<start, end, hit>>: leftmost non-overlapping matches, in code points, end exclusive.

    The gaps between the matches come from splitting at them, so a running sum of lengths gives
    the places. ``guard``: a cheap condition without which nothing can match. ``context``: adds
    ``before`` and ``after``, up to so many characters of the text beside a match; beyond the next
    match on a side they hold that match and no more.
    """
    kind = f"array<{AROUND if context else SPAN}>"
    none = F.array().cast(kind)

    def located(both: Column) -> Column:
        hits, gaps = both["hits"], both["gaps"]
        parts = F.transform(hits, lambda hit, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), (F.length(F.get(gaps, i)) + F.length(hit)).alias("size"), hit.alias("hit"), *_sides(hits, gaps, i, context)))
        return F.when(F.size(hits) == 0, none).otherwise(let(parts, lambda p: _places(p, kind, context)))

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), located)
    return found if guard is None else F.when(guard, found).otherwise(none)


def _sides(hits: Column, gaps: Column, i: Column, context: int) -> list[Column]:
    if not context:
        return []
    tail = lambda s: F.substring(s, F.greatest(F.length(s) - context, F.lit(0)) + 1, F.lit(context))
    head = lambda s: F.substring(s, F.lit(1), F.lit(context))
    before = F.concat(F.when(i > 0, tail(F.get(hits, i - 1))).otherwise(""), tail(F.get(gaps, i)))
    after = F.concat(head(F.get(gaps, i + 1)), F.coalesce(head(F.get(hits, i + 1)), F.lit("")))
    return [tail(before).alias("before"), head(after).alias("after")]


def _places(parts: Column, kind: str, context: int) -> Column:
    last = F.floor((F.size(parts) - 1) / F.lit(STRETCH)).cast("int")
    stretch = lambda j: F.slice(parts, j * STRETCH + 1, F.lit(STRETCH))
    sizes = F.transform(F.sequence(F.lit(0), last), lambda j: F.aggregate(stretch(j), F.lit(0), lambda n, p: n + p["size"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate(sizes, start, lambda d, n: F.struct((d["at"] + n).alias("at"), F.concat(d["out"], F.array(d["at"])).alias("out")), lambda d: d["out"])

    def step(done: Column, p: Column) -> Column:
        sides = [p["before"].alias("before"), p["after"].alias("after")] if context else []
        span = F.struct((done["at"] + p["gap"]).alias("start"), (done["at"] + p["size"]).alias("end"), p["hit"].alias("hit"), *sides)
        return F.struct((done["at"] + p["size"]).alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    def placed(begins: Column) -> Column:
        each = lambda at, j: F.aggregate(stretch(j), F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda d: d["out"])
        return F.flatten(F.transform(begins, each))

    return let(offsets, placed)


def in_stretches(found: Column) -> Column:
    """An array of spans as an array of stretches, each about as long as there are stretches."""
    def cut(both: Column) -> Column:
        spans_, size = both["spans"], both["size"]
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(spans_) - 1) / size).cast("int")), lambda j: F.slice(spans_, j * size + 1, size))

    whole = let(F.struct(found.alias("spans"), F.ceil(F.sqrt(F.size(found))).cast("int").alias("size")), cut)
    return F.when(F.size(found) > 0, whole).otherwise(F.array(found))


def overlaps(span: Column, stretches: Column) -> Column:
    """Whether a span overlaps one of ``in_stretches`` of ascending, disjoint spans."""
    meets = lambda d: (d["start"] < span["end"]) & (span["start"] < d["end"])
    near = lambda s: (F.size(s) > 0) & (F.get(s, F.lit(0))["start"] < span["end"]) & (span["start"] < F.get(s, F.size(s) - 1)["end"])
    return F.exists(stretches, lambda s: F.when(near(s), F.exists(s, meets)).otherwise(False))


def listed(found: Column) -> Column:
    """``kind:start:end`` of an ordered array of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0
