"""Finding stretches of text with their places, by built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of context on either side of a match.
BEFORE, AFTER = 32, 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda over a one-element array binds it."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All leftmost non-overlapping matches: array<struct<s, e, m, before, after>>, places in code points.

    The stretches between matches and the matches themselves alternate, so places are running sums of lengths.
    Texts without a match are only searched once. Patterns must not repeat groups: Java's matcher recurses on them.
    """
    empty = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")

    def placed(gaps: Column, hits: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), empty.alias("out"))

        def step(acc: Column, m: Column) -> Column:
            gap = F.get(gaps, acc["i"])
            s = acc["at"] + F.length(gap)
            e = s + F.length(m)
            after = F.left(F.get(gaps, acc["i"] + 1), F.lit(AFTER))
            hit = F.struct(s.alias("s"), e.alias("e"), m.alias("m"), F.right(gap, F.lit(BEFORE)).alias("before"), after.alias("after"))
            return F.struct(e.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(hit)).alias("out"))

        return F.aggregate(hits, start, step, lambda acc: acc["out"])

    found = let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: placed(gaps, hits)))
    has = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(has, found).otherwise(empty)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of all spans (structs with kind, s and e), by start, then kind as listed, then end."""
    order = F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate(kinds)) for x in pair))
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), order[x["kind"]].alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def apart(extra: Column, spans: Column, same_kind: bool) -> Column:
    """Those of extra that overlap no span (of the same kind)."""
    clash = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"]) & ((x["kind"] == y["kind"]) if same_kind else F.lit(True))
    return F.filter(extra, lambda x: ~F.exists(spans, lambda y: clash(x, y)))
