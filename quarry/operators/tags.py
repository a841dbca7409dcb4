"""Tags and facets of chunks, by rules. One projection over the chunk rows; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.rules import Rules

#: The year, chapter and number of a recommendation as they stand in a text.
YEAR, CHAPTER = r"(?:^|[^0-9])(20[0-9]{2})(?:[^0-9]|$)", r"chapter[ ]*([0-9]{1,2})"
NUMBER = r"(?:^|[^0-9.])([0-9]{1,2}\.[0-9]+)([abce]?)(?:[^0-9a-z]|$)"


def haystack(label: Column, title: Column, section: Column, chunk_type: Column, text: Column, parent: Column, parent_chars: int = 1400) -> Column:
    return F.lower(F.concat_ws(" ", label, title, section, chunk_type, text, F.substring(T.text(parent), 1, parent_chars)))


def captured(hay: Column, families: Rules, chunk_type: Column) -> Column:
    """Source family (the first that fits), year, chapter, number and grade of a recommendation, kind of chunk."""
    family, year, chapter = families.first(hay), F.regexp_extract(hay, YEAR, 1), F.regexp_extract(hay, CHAPTER, 1)
    number, grade = F.regexp_extract(hay, NUMBER, 1), F.regexp_extract(hay, NUMBER, 2)
    tag = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}:"), value))
    plain = F.when(chapter != "", chapter.cast("int").cast("string")).otherwise("")
    return F.array_compact(F.array(tag("source", family), tag("year", year), tag("chapter", plain), tag("recommendation", number), tag("grade", grade), F.concat(F.lit("chunk_type:"), chunk_type)))


def presence(hay: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(hay.rlike(p), F.lit(tag)) for tag, p in patterns.items()]))


def ontology(hay: Column, rules: Rules) -> Column:
    """ontology:<category>:<name> for each rule; a rule's target is its category."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(r.fires(hay), F.concat(F.lit(f"ontology:{r.target}:"), r.result(hay))) for r in rules.rules])))


def near_number(term: str, chars: int = 40) -> str:
    """A pattern for a number within so many characters of a term."""
    return rf"(?s){term}.{{0,{chars}}}[0-9]|[0-9].{{0,{chars}}}{term}"


def facets(hay: Column, rules: Rules, chunk_type: Column, family: Column) -> Column:
    """Facets by rule, `table` for table rows, and the source's family; sorted."""
    more = F.array_compact(F.array(F.when(chunk_type == "table_row", F.lit("table")), F.when(family != "", F.concat(F.lit("source_"), family))))
    return F.array_sort(F.array_distinct(F.concat(rules.values(hay), more)))


def tag_table(chunks: DataFrame, id_col: str = "chunk_id", tags_col: str = "metadata") -> DataFrame:
    """(id, category, tag) per tag; the category is what stands before the first colon, else empty."""
    rows = chunks.select(id_col, F.explode(tags_col).alias("tag"))
    return rows.select(id_col, F.when(F.col("tag").contains(":"), F.split("tag", ":", 2)[0]).otherwise("").alias("category"), "tag")
