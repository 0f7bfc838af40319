"""Regex matches with their positions as Column expressions: no Python runs on executors.

A text is split at a pattern's matches; the lengths of what lies between and of the matches give each match's place in code
points. Patterns here are Java's, written so that no group repeats by recursion and no run of characters is scanned again
from each of its places.

Columns of lambda bodies are worked out for each element, so what all elements share is bound by ``let`` first; and appending
to an array copies it, so ``scan`` appends within small blocks, and their results to those of larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Elements of an innermost block.
_BLOCK = 32


def _blocks(x: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(x) / size) - 1).cast("int")), lambda j: F.slice(x, j * size + 1, size))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """The running results over an array. step(state, item) -> struct(state, out); out: the type of a result."""

    def run(state: Column, own: Column, level: int) -> Column:
        """struct(state, outs) of an array, at level 0, or of arrays of arrays; outs nested alike."""
        kind = "array<" * (level + 1) + out + ">" * (level + 1)
        start = F.struct(state.alias("state"), F.expr(f"cast(array() as {kind})").alias("outs"))
        one = (lambda s, x: step(s, x)) if level == 0 else lambda s, x: run(s, x, level - 1)
        last = "out" if level == 0 else "outs"
        return F.aggregate(own, start, lambda a, x: let(one(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(a["outs"], F.array(r[last])).alias("outs"))))

    def whole(x: Column) -> Column:
        size = (_BLOCK * F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x) / _BLOCK)))).cast("int")
        nested = F.transform(let(size, lambda n: _blocks(x, n)), lambda y: _blocks(y, F.lit(_BLOCK)))
        return F.flatten(F.flatten(run(zero, nested, 2)["outs"]))

    return F.when(F.size(items) > 0, let(items, whole)).otherwise(F.expr(f"cast(array() as array<{out}>)"))


SPAN = "struct<start:int,end:int,match:string,value:string>"


def matches(text: Column, pattern: str, group: int = 0, has: str | None = None) -> Column:
    """array<struct<start, end, match, value>> of all leftmost, non-overlapping matches, ends exclusive; value: the group, as
    the match alone has it.

    has: a string that every match holds, checked first. Null texts have no matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), found.alias("match"))
    # the last gap has no match behind it
    rows = F.filter(rows, lambda r: r["match"].isNotNull())

    def step(at: Column, r: Column) -> Column:
        start, end = (at + r["gap"]).cast("int"), (at + r["gap"] + F.length(r["match"])).cast("int")
        value = F.regexp_extract(r["match"], pattern, group) if group else r["match"]
        return F.struct(end.alias("state"), F.struct(start.alias("start"), end.alias("end"), r["match"].alias("match"), value.alias("value")).alias("out"))

    made = scan(rows, F.lit(0), step, SPAN)
    test = text.rlike(pattern)
    if has:
        test = text.contains(has) & test
    return F.when(F.coalesce(test, F.lit(False)), made).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def tagged(spans: Column, kind: str, order: int) -> Column:
    """array<struct<start, order, end, kind>>"""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


_FAR = 2**31 - 1


def overlapping(spans: Column, others: Column) -> Column:
    """array<boolean>: which of the spans, given by start and apart from one another, overlap any of the others: one sorted
    pass forth, with how far others reach, and one back, with where the next one starts."""
    event = lambda s, own: F.struct(s["start"].cast("int").alias("start"), F.lit(own).alias("own"), s["end"].cast("int").alias("end"))
    every = F.array_sort(F.concat(F.transform(others, lambda o: event(o, 0)), F.transform(spans, lambda s: event(s, 1))))
    mark = "struct<start:int,own:int,end:int,hit:boolean>"

    def forth(reach: Column, e: Column) -> Column:
        return F.struct(F.when(e["own"] == 0, F.greatest(reach, e["end"])).otherwise(reach).alias("state"), F.struct(e["start"].alias("start"), e["own"].alias("own"), e["end"].alias("end"), (reach > e["start"]).alias("hit")).alias("out"))

    def back(next_: Column, e: Column) -> Column:
        return F.struct(F.when(e["own"] == 0, e["start"]).otherwise(next_).alias("state"), F.struct(e["start"].alias("start"), e["own"].alias("own"), e["end"].alias("end"), (e["hit"] | (next_ < e["end"])).alias("hit")).alias("out"))

    swept = F.reverse(scan(F.reverse(scan(every, F.lit(0), forth, mark)), F.lit(_FAR), back, mark))
    flags = F.transform(F.filter(swept, lambda e: e["own"] == 1), lambda e: e["hit"])
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), flags).otherwise(F.transform(spans, lambda s: F.lit(False)))


def apart(spans: Column, others: Column) -> Column:
    """Those spans, given by start and apart from one another, that overlap none of the others."""
    pairs = F.arrays_zip(spans.alias("span"), overlapping(spans, others).alias("hit"))
    return F.transform(F.filter(pairs, lambda p: ~p["hit"]), lambda p: p["span"])


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """text with its spans (by start, perhaps overlapping) replaced by ``mark``: what overlaps is replaced together, by one.

    Code points are cut from UTF-32, where a place is found at once.
    """

    def cut(wide: Column) -> Column:
        piece = lambda a, b: F.decode(F.substr(wide, 4 * a + 1, F.greatest(F.lit(0), 4 * (b - a))), "UTF-32")

        def step(at: Column, s: Column) -> Column:
            kept = F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(at, s["end"]).alias("state"), kept.alias("out"))

        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(scan(spans, F.lit(0), step, "string"), ""), piece(end, (F.octet_length(wide) / 4).cast("int")))

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), cut)).otherwise(text)
