"""Positions of matches, and other building blocks over text columns.

Offsets count code points from 0, as Spark's own string functions do (from 1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Stands for a match; texts that hold it are split the slow way.
MARK = "\u0001"


def literal(pattern: str) -> Column:
    """A pattern whose classes and borders know all of Unicode."""
    return F.lit("(?U)" + pattern)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of the pattern's matches, from left to right.

    What is between the matches gives their places, so no code runs in Python.
    """
    p = literal(pattern)

    def placed(found: Column) -> Column:
        # splitting at a single character needs no expression; splitting at the pattern
        # would compile it anew for every row
        marked = F.split(F.regexp_replace(text, p, F.lit(MARK)), MARK, -1)
        between = F.when(F.contains(text, F.lit(MARK)), F.split(text, "(?U)" + pattern, -1)).otherwise(marked)
        pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,`end`:int,text:string>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"])
            one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        walked = F.aggregate(pairs, empty, step, lambda acc: acc["out"])
        return F.when(F.size(found) > 0, walked).otherwise(F.array().cast("array<struct<start:int,`end`:int,text:string>>"))

    return let(F.regexp_extract_all(text, p, F.lit(0)), placed)


def before(text: Column, start: Column, size: int) -> Column:
    """Up to `size` characters before the place."""
    return F.substring(text, F.greatest(F.lit(1), start - (size - 1)), F.least(F.lit(size), start))


def after(text: Column, end: Column, size: int) -> Column:
    return F.substring(text, end + 1, F.lit(size))


def last_words(text: Column, n: int) -> Column:
    words = F.regexp_extract_all(text, literal(r"\S+"), F.lit(0))
    return F.array_join(F.reverse(F.slice(F.reverse(words), 1, n)), " ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether text holds one of the words in any case: one expression, so what gives
    the text is evaluated once and not for each word."""
    return text.rlike("(?iu)" + "|".join(rf"\Q{w}\E" for w in words))


def spliced(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """text with each span replaced; spans are sorted and disjoint."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], kept, replacement(s)).alias("out"), s["end"].alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, rest)).otherwise(text)
