"""Excerpts of texts around what matches a query, as columns; and the full table of character references."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Mapping
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Fixed value: marks that end a sentence.
ENDS = "[.!?。！？]"
_TAG = re.compile(r"<[^>]+>")

#: A term's points in a sentence: by itself, and if one of the partners is among the query's tokens.
Bonus = Mapping[str, tuple[float, float, tuple[str, ...]]]


def _points(sentence: Column, tokens: Column, bonus: Bonus) -> Column:
    own = F.size(F.filter(tokens, lambda t: F.contains(sentence, t))).cast("double")
    more = [F.when(F.contains(sentence, F.lit(term)), F.when(F.exists(tokens, lambda t, p=partners: t.isin(*p)), paired).otherwise(plain)).otherwise(0.0) for term, (plain, paired, partners) in bonus.items()]
    return reduce(add, more, own)


def _outwards(parts: Column, best: Column, chars: int) -> Column:
    """Sentences from the best one (a place from 1) outwards, left before right, taken while they fit."""
    visits = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array(best - k, best + k))), lambda i: (i >= 1) & (i <= F.size(parts)))

    def visit(a: Column, v: Column) -> Column:
        size = a["size"] + 1 + v["n"]
        fits = size <= chars
        taken = F.struct(F.when(fits, size).otherwise(a["size"]).alias("size"), F.when(fits, F.concat(a["chosen"], F.array(v["i"]))).otherwise(a["chosen"]).alias("chosen"), (a["seen"] + 1).alias("seen"))
        return F.when(a["size"] >= chars, a).otherwise(taken)

    def of(order: Column) -> Column:
        begin = F.struct(F.length(F.element_at(parts, best)).alias("size"), F.array(best).alias("chosen"), F.lit(0).alias("seen"))
        sized = F.transform(order, lambda i: F.struct(i.alias("i"), F.length(F.element_at(parts, i)).alias("n")))
        return T.let(F.aggregate(sized, begin, visit), shown(order))

    def shown(order: Column) -> Callable[[Column], Column]:
        def text(a: Column) -> Column:
            left = F.exists(F.slice(order, a["seen"] + 1, F.size(order) + 1), lambda i: i < best)
            right = F.exists(F.slice(order, a["seen"] + 1, F.size(order) + 1), lambda i: i > best)
            body = F.array_join(F.transform(F.array_sort(a["chosen"]), lambda i: F.element_at(parts, i)), " ")
            return F.concat(F.when(left, "...").otherwise(""), body, F.when(right, "...").otherwise(""))

        return text

    return T.let(visits, of)


def _around(flat: Column, tokens: Column, chars: int) -> Column:
    """A stretch of `chars` characters that begins a third of it before the first token."""
    low = F.lower(flat)
    places = F.filter(F.transform(tokens, lambda t: F.position(t, low)), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(1)) - 1
    end = F.least(F.length(flat), F.greatest(F.lit(0), first - chars // 3) + chars)
    start = F.greatest(F.lit(0), end - chars)
    return F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(flat, start + 1, end - start)), F.when(end < F.length(flat), "...").otherwise(""))


def excerpt(text: Column, tokens: Column, chars: int, bonus: Bonus | None = None) -> Column:
    """At most about `chars` characters of a text around what matches the tokens.

    A short text stays whole. Else sentences are visited from the one with most points outwards, left before right, and
    taken where they still fit, until the excerpt is full; without a sentence that has points, it is a stretch of text.
    What is left out at an end is marked by dots.
    """
    asked = F.transform(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != ""), F.lower)

    def around(flat: Column) -> Column:
        return T.let(F.split(F.regexp_replace(flat, f"({ENDS}) ", "$1\n"), "\n"), lambda parts: T.let(F.transform(parts, lambda s: _points(F.lower(s), asked, bonus or {})), lambda points: T.let(F.array_max(points), lambda most: F.when((F.size(parts) > 1) & (most > 0), T.let(F.array_position(points, most).cast("int"), lambda best: _outwards(parts, best, chars))).otherwise(_around(flat, asked, chars)))))

    return T.let(T.collapse(text), lambda flat: F.when(F.length(flat) <= chars, flat).otherwise(around(flat)))


def parent_excerpt(parent: Column, chunk: Column, tokens: Column, chars: int = 1800) -> Column:
    """The excerpt of a section around the tokens, empty if there is none or the chunk is all of it."""
    return F.when((F.coalesce(parent, F.lit("")) == "") | (parent == chunk), "").otherwise(excerpt(parent, tokens, chars))


def unescape_cell(cell: Column) -> Column:
    """clean_cell() with every named and numbered character reference."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: " ".join(html.unescape(_TAG.sub(" ", v or "")).split()).strip(" •"))

    return run(cell)
