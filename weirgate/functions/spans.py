"""Native span extraction: matches of a pattern with code point offsets, by Catalyst expressions only.

Patterns must never match the empty string. Trailing groups are written possessively, which Java runs in a loop
(a greedy group recurses once for each repetition and would overflow the stack on a very long run).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def find(text: Column, pattern: str, kind: str, group: int = 0, gate: Column | None = None) -> Column:
    """All leftmost, non-overlapping matches as ``SPAN``; value is ``group``. ``gate``: a cheap necessary condition.

    The start of match i is the length of the first i + 1 pieces between matches plus that of the matches before it.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    rows = F.zip_with(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"))), values, lambda g, v: F.struct(g["gap"].alias("gap"), g["size"].alias("size"), v.alias("value")))
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(state: Column, r: Column) -> Column:
        begin = state["at"] + r["gap"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + r["size"]).alias("end"), r["value"].alias("value"))
        return F.struct((begin + r["size"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    found = F.aggregate(rows, start, step, lambda s: s["out"])
    condition = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(condition, found).otherwise(none())


def show(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Sorted by start, then by the kinds as listed."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(rank, s["kind"]).alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def by_kind(spans: Column, kinds: list[str]) -> Column:
    """Sorted by the kinds as listed, then by start."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("a"), s["start"].alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def replace(text: Column, spans: Column, by) -> Column:
    """``text`` with each span (sorted, the earlier one wins an overlap) replaced by ``by(span)``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        grown = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), by(s))
        return F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), grown.alias("out"))).otherwise(state)

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def within(start: Column, end: Column, spans: Column) -> Column:
    """Whether a span lies fully inside one of ``spans``."""
    return F.exists(spans, lambda s: (start >= s["start"]) & (end <= s["end"]))
