"""Matches with offsets, contexts and spans as Column expressions. Offsets count code points, from 0, end-exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<text:string,start_offset:int,end_offset:int>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside lambdas Spark would else compute each mention anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Noncharacters around the matches in a marked text: before a match, before its first group, after it.
OPEN, CUT, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"
MATCH = "struct<start:int,neg_length:int,ord:int,text:string,value:string,stop:int>"


def clear(text: Column) -> Column:
    """The text with other characters in the marks' places, as long as before."""
    return F.translate(text, OPEN + CUT + CLOSE, "\ufffd" * 3)


def found(text: Column, pattern: str, core: str = "") -> Column:
    """The text with the matches of a pattern marked, in one pass; null if it lacks core, lower-case letters that every match has.

    text must be clear of marks."""
    group = "$1" if "(" in pattern.replace("(?", "") else "$0"
    hit = F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CUT}{group}{CLOSE}"))
    return F.when(F.lower(text).contains(core), hit) if core else hit


def located(marked: Column, order: Column) -> Column:
    """Structs (MATCH) of the matches in a marked text; they sort in reading order."""
    pieces = F.split(marked, OPEN, -1)

    def one(so_far: Column, piece: Column) -> Column:
        whole, start = F.substring_index(piece, CUT, 1), so_far["at"]
        value = F.trim(F.substring_index(F.substring_index(piece, CLOSE, 1), CUT, -1))
        hit = F.struct(
            start.alias("start"), (-F.length(whole)).alias("neg_length"), order.cast("int").alias("ord"), whole.alias("text"),
            F.when(value == "", F.trim(whole)).otherwise(value).alias("value"), (start + F.length(whole)).alias("stop"),
        )
        return F.struct(
            (start + F.length(whole) + F.length(F.substring_index(piece, CLOSE, -1))).alias("at"), F.array_append(so_far["hits"], hit.cast(MATCH)).alias("hits")
        )

    first = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast(f"array<{MATCH}>").alias("hits"))
    none = F.array().cast(f"array<{MATCH}>")
    return F.when(F.locate(OPEN, marked) > 0, F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), first, one, lambda x: x["hits"])).otherwise(none)


def in_order(hits: Column) -> Column:
    """Matches in reading order, longer ones first; equal spans and values once."""
    flat = F.array_sort(hits)
    bare = F.transform(flat, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["text"].alias("text"), m["value"].alias("value")))
    return F.array_distinct(F.filter(bare, lambda m: m["value"] != ""))


def first_span(text: Column, pattern) -> Column:
    """The first match as a span, or null. pattern may be a Column."""
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    hit = F.call_function("regexp_extract", text, p, F.lit(0))
    start = F.length(F.element_at(F.split(text, p, 2), 1))
    span = let(F.struct(hit.alias("hit"), start.alias("at")), lambda x: F.struct(x["hit"].alias("text"), x["at"].alias("start_offset"), (x["at"] + F.length(x["hit"])).alias("end_offset")))
    return F.when(F.call_function("rlike", text, p), span)


def first_of(text: Column, patterns, value: Column) -> Column:
    """The first match of the first pattern that has one, with VALUE replaced by a column; as a span, or null."""
    each = F.transform(F.array(*map(F.lit, patterns)), lambda p: first_span(text, F.replace(p, F.lit("VALUE"), value)))
    return F.get(F.filter(each, lambda s: s.isNotNull()), F.lit(0))


def shifted(span: Column, by: Column) -> Column:
    moved = lambda s: F.struct(s["text"].alias("text"), (s["start_offset"] + by).cast("int").alias("start_offset"), (s["end_offset"] + by).cast("int").alias("end_offset"))
    return let(span, lambda s: F.when(s.isNotNull(), moved(s)))


def slice_of(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, stop - start)


def nearby(text: Column, start: Column, stop: Column, window: int = 100) -> Column:
    """Back to the last line end or full stop (included) or `window` characters, whichever is nearest, and on to the next
    line end or full stop wherever it is, else `window` characters."""
    back = F.reverse(F.substring(text, F.lit(1), start))

    def left(before: Column) -> Column:
        return F.greatest(*[F.when(p > 0, start - p).otherwise(F.lit(-1)) for p in (F.locate("\n", before), F.locate(".", before))], start - window, F.lit(0))

    def right(after: Column) -> Column:
        return F.when(after.rlike("[\\n.]"), stop + F.length(F.element_at(F.split(after, "[\\n.]", 2), 1)) + 1).otherwise(F.least(F.length(text), stop + window))

    return let(let(back, left), lambda a: slice_of(text, a, let(F.substring(text, stop + 1, F.length(text)), right)))


def statement_start(text: Column, start: Column) -> Column:
    """Where the line or sentence around a place begins."""
    tail = F.regexp_extract(F.substring(text, F.lit(1), start), r"(?s)^(?:.*(?:\n|[.?!] ))?(.*)$", 1)
    return start - F.length(tail)


def statement(text: Column, start: Column, stop: Column) -> Column:
    """The line or sentence around a span; empty if the span lies outside the text."""
    end = r"(?Ud)[.!?](?=\s|$)|\n"

    def rest(after: Column) -> Column:
        return F.when(after.rlike(end), F.concat(F.element_at(F.split(after, end, 2), 1), F.regexp_extract(after, end, 0))).otherwise(after)

    inside = (start >= 0) & (start < stop) & (stop <= F.length(text))
    tail = let(F.substring(text, stop + 1, F.length(text)), rest)
    return F.when(inside, F.concat(slice_of(text, statement_start(text, start), stop), tail)).otherwise(F.lit(""))
