"""Text functions: columns in, column out. Null input counts as an empty text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The class of white space, written so that Java's and RE2's regular expressions read it alike.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed value: ends of lines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Fixed value: words of Latin letters, numbers, and runs of one to four CJK characters.
TOKEN = r"[A-Za-z][A-Za-z0-9+-]*|[0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]{1,4}"
#: Fixed value: tokens that count although they are one character long.
ONE = r"^[0-9\x{4e00}-\x{9fff}]"
#: Character references that clean_cell() decodes without Python.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
#: Fixed value: what is cut off the ends of a name.
NAME_STRIP = r"[ ，。,.！!？?]"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once for each row, wherever of() uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column | str) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), f"{WS}+", " "))


def tokenize(c: Column | str) -> Column:
    """Lower-case tokens in order; single characters only if they are a digit or CJK."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) | t.rlike(ONE))


def indexed_tokens(label: Column, title: Column, section: Column, chunk_type: Column, metadata: Column, body: Column) -> Column:
    """Tokens of a chunk with those of what names it; metadata is an array."""
    return tokenize(F.concat(F.concat_ws(" ", label, title, section, chunk_type, metadata), F.lit("\n"), text(body)))


def clean_cell(c: Column | str) -> Column:
    """Tags out, common character references decoded, white space collapsed, bullets cut off; see excerpt.unescape_cell() for all references."""
    out = F.regexp_replace(text(c), "<[^>]+>", " ")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.regexp_replace(F.regexp_replace(out, f"{WS}+", " "), "^[ •\t\r\n]+|[ •\t\r\n]+$", "")


def tidy_label(c: Column | str) -> Column:
    out = F.regexp_replace(text(c), f"{WS}+", " ")
    out = F.replace(F.replace(out, F.lit(" - "), F.lit(" ")), F.lit("--"), F.lit("-"))
    return F.regexp_replace(out, "^[ _-]+|[ _-]+$", "")


def heading(c: Column | str) -> Column:
    """A heading's text without emphasis marks."""
    return strip(F.translate(F.regexp_replace(text(c), f"{WS}+", " "), "*_", ""))


def context_text(c: Column | str, chars: int = 700) -> Column:
    return F.substring(collapse(c), 1, chars)


def clean_name(c: Column | str, ends: Sequence[str], marks: Sequence[str], chars: int = 20) -> Column:
    """What may be a name: up to the first of the words `ends` or the marks `marks`, which may stand in a word."""
    out = text(c)
    if ends:
        out = F.regexp_replace(out, name_end(ends), "$1")
    if marks:
        out = F.regexp_replace(out, f"(?s)(?:{'|'.join(map(re.escape, marks))}).*$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(out, f"{WS}+", " "), f"^{NAME_STRIP}+|{NAME_STRIP}+$", ""), 1, chars)


def name_end(ends: Sequence[str]) -> str:
    """The pattern of a whole word of `ends` and all after it."""
    return rf"(?is)(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(map(re.escape, ends))})(?:[^\p{{L}}\p{{N}}_].*|$)"


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two token arrays as sets, 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), both / F.size(F.array_union(left, right))).otherwise(0.0)


def json_object(c: Column | str) -> Column:
    """The JSON object from the first brace to the last as a map of strings, an empty map if there is none."""
    found = F.regexp_extract(text(c), r"(?s)\{.*\}", 0)
    return F.coalesce(F.from_json(F.when(found != "", found), "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_list(c: Column | str) -> Column:
    """Trimmed non-empty strings of a JSON array, or of a plain value."""
    value = F.trim(text(c))
    many = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    return F.filter(F.transform(F.coalesce(many, F.array(value)), lambda x: strip(text(x))), lambda x: x != "")


def dedupe(c: Column) -> Column:
    """Trimmed terms of an array, the first spelling of each, in order; case doesn't count, empty terms go."""
    first = lambda terms, lowered: F.filter(terms, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return let(F.filter(F.transform(c, lambda x: F.trim(text(x))), lambda x: x != ""), lambda terms: let(F.transform(terms, F.lower), lambda lowered: first(terms, lowered)))


def without_trailing_question(c: Column | str, starters: Sequence[str] = ("Could you", "May I", "What", "How"), short: int = 120) -> Column:
    """An answer without the question that its last paragraph ends in.

    The last sentence goes if it begins with a starter or is at most `short` long, and with it the paragraph if that
    has no other sentence.
    """
    parts = F.filter(F.transform(F.split(strip(text(c)), r"\n{2,}"), strip), lambda x: x != "")
    last = F.element_at(parts, -1)
    sentences = F.split(last, rf"(?<=[。.!！]){WS}*")
    tail = strip(F.element_at(sentences, -1))
    goes = F.greatest(*[tail.startswith(s) for s in starters], F.length(tail) <= short)
    head = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    cut = F.when(F.size(sentences) > 1, strip(F.array_join(F.slice(sentences, 1, F.greatest(F.size(sentences) - 1, F.lit(0))), "")))
    shorter = F.array_join(F.filter(F.concat(head, F.array(F.coalesce(cut, F.lit("")))), lambda x: x != ""), "\n\n")
    asks = (F.size(parts) > 0) & last.rlike(f"[？?]{WS}*$")
    return F.when(asks & goes, strip(shorter)).otherwise(strip(text(c)))
