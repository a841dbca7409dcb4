"""Files to sections to typed chunks.

A file is one row; its lines are cut and joined again in array expressions, so sections come out of the row that holds
the file without a shuffle. Only table rows, which carry a caption and open rows forward, use a window, over the blocks
that have a table at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

#: White space inside a line.
SPACE = r"[\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
HEADING = rf"^#{{1,4}}{SPACE}+(.+)$"
#: Lines that aren't content.
NOISE_TERM, NOISE = "Downloaded", rf"^>{SPACE}+\*(?:[^*]|$)"
#: Sections that aren't cut into chunks.
SKIPPED = ("references", "reference")
#: How a recommendation begins, where its number stands, and what goes on with it.
RECOMMENDATION = rf"(?i)^{SPACE}*>?{SPACE}*(?:[-*]{SPACE}*)?(?:\*\*)?(?:([0-9]{{1,2}}\.[0-9]+[a-z]?)|(?:recommendation|practice point){SPACE}+([0-9][0-9A-Za-z.-]*))"
FOLLOWING = r"(?i)(?:^|[^\p{L}\p{N}_])(?:consider|recommend|should|may|screen|monitor|treat|assess|refer|prescribe|avoid)(?:[^\p{L}\p{N}_]|$)"
CAPTION = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(Table{SPACE}+[0-9]+(?:\.[0-9]+)?[^<]*)"
RULE_LINE = rf"^\|?{SPACE}*[-:| ]+{SPACE}*\|?$"
KINDS = ("section_summary", "recommendation", "text", "table_row")


def _kept(text: Column) -> Column:
    """The file's lines that are headings or content."""
    lines = F.transform(F.split(T.text(text), T.LINE_END), T.strip)
    return F.filter(lines, lambda x: (x != "") & (x.rlike(HEADING) | ~(x.contains(NOISE_TERM) | x.rlike(NOISE))))


def content_lines(files: DataFrame) -> DataFrame:
    """(path, pos, line) of the lines that are headings or content; pos counts all lines of the file from 0."""
    rows = files.select("path", F.posexplode(F.transform(F.split(T.text("text"), T.LINE_END), T.strip)).alias("pos", "line"))
    return rows.where((F.col("line") != "") & (F.col("line").rlike(HEADING) | ~(F.col("line").contains(NOISE_TERM) | F.col("line").rlike(NOISE))))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sections(files: DataFrame) -> DataFrame:
    """(path, source, title, block_no, section, lines) of every section that has lines; files: path, text.

    block_no counts the headings up to the section. The title is the first heading that isn't empty, else the file's
    name; an empty section name falls back to the title.
    """
    cut = files.select("path", _kept(F.col("text")).alias("kept"))
    names = F.filter(F.transform(F.filter("kept", lambda x: x.rlike(HEADING)), lambda x: T.heading(F.regexp_extract(x, HEADING, 1))), lambda x: x != "")
    stem = F.regexp_replace(base_name(F.col("path")), r"(.)\.[^.]*$", "$1")
    parts = F.split(F.array_join("kept", "\n"), rf"\n(?=#{{1,4}}{SPACE}+[^\n])")
    rows = cut.where(F.size("kept") > 0).select(
        "path", base_name(F.col("path")).alias("source"), F.coalesce(F.get(names, F.lit(0)), stem).alias("title"),
        F.get("kept", F.lit(0)).rlike(HEADING).cast("int").alias("first"), F.posexplode(parts).alias("at", "part"),
    )
    headed = (F.col("at") > 0) | (F.col("first") == 1)
    rows = rows.withColumn("all", F.split("part", "\n")).withColumn("raw", F.when(headed, T.heading(F.regexp_extract(F.get("all", F.lit(0)), HEADING, 1))).otherwise(""))
    lines = F.when(headed, F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))).otherwise(F.col("all"))
    rows = rows.select("path", "source", "title", (F.col("at") + F.col("first")).alias("block_no"), "raw", lines.alias("lines"))
    rows = rows.where((F.size("lines") > 0) & ~F.lower("raw").isin(*SKIPPED))
    return rows.select("path", "source", "title", "block_no", F.when(F.col("raw") == "", F.col("title")).otherwise(F.col("raw")).alias("section"), "lines")


def parents(blocks: DataFrame) -> DataFrame:
    """(path, block_no, section, parent_text): the section texts, once each, for chunks to join when they need them."""
    return blocks.select("path", "block_no", "section", F.array_join("lines", "\n").alias("parent_text"))


def packed(lines: Column, cap: int) -> Column:
    """Lines joined greedily into texts of at most cap characters; a longer line is a text of its own."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("buf"), F.lit(0).alias("size"))

    def step(acc: Column, line: Column) -> Column:
        full = acc["buf"].isNotNull() & (acc["size"] + F.length(line) > cap)
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"]).alias("out"),
            F.when(full | acc["buf"].isNull(), line).otherwise(F.concat(acc["buf"], F.lit("\n"), line)).alias("buf"),
            (F.when(full, 0).otherwise(acc["size"]) + F.length(line) + 1).alias("size"),
        )

    return F.aggregate(lines, start, step, lambda acc: F.concat(acc["out"], F.array(acc["buf"])))


_KEY = ("path", "source", "title", "block_no", "section")


def _chunks(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(*_KEY, F.lit(kind).alias("chunk_type"), F.col("pos").cast("int").alias("pos"), "text")


def text_chunks(blocks: DataFrame, chunk_chars: int = 1800) -> DataFrame:
    return _chunks(blocks.select(*_KEY, F.posexplode(packed(F.col("lines"), chunk_chars)).alias("pos", "text")), "text")


def summary_chunks(blocks: DataFrame, lines: int = 8) -> DataFrame:
    opening = F.slice(F.filter("lines", lambda x: ~x.startswith("|")), 1, lines)
    body = F.concat_ws("\n", F.concat(F.lit("Section map: "), "title"), F.concat(F.lit("Section: "), "section"), F.lit("Key opening context:"), opening)
    return _chunks(blocks.where(F.size(opening) > 0).select(*_KEY, F.lit(0).alias("pos"), body.alias("text")), "section_summary")


def recommendation_chunks(blocks: DataFrame, start: str = RECOMMENDATION, following: str = FOLLOWING) -> DataFrame:
    """A chunk per line that begins a recommendation, with those of the next two lines that go on with it.

    start: a pattern whose groups 1 and 2 are the two forms of the number. A further beginning stops the search; a line
    that doesn't go on is only passed over.
    """

    def goes_on(x: Column) -> Column:
        usual = (F.length(x) < 360) & x.rlike(following) & ~x.rlike(rf"^#{{1,6}}{SPACE}+")
        return x.isNotNull() & ~x.startswith("|") & ~F.lower(x).contains("<tr") & (x.rlike(rf"^{SPACE}*>") | usual)

    def whole(x: Column, i: Column) -> Column:
        one, two = F.get("lines", i + 1), F.get("lines", i + 2)
        free = ~F.coalesce(one.rlike(start), F.lit(False))
        number = F.coalesce(F.nullif(F.regexp_extract(x, start, 1), F.lit("")), F.regexp_extract(x, start, 2))
        text = F.concat_ws("\n", x, F.when(free & goes_on(one), one), F.when(free & ~F.coalesce(two.rlike(start), F.lit(False)) & goes_on(two), two))
        return F.when(x.rlike(start), F.struct(i.alias("pos"), F.concat(F.when(number != "", F.concat(F.lit("Recommendation "), number, F.lit(": "))).otherwise(""), text).alias("text")))

    rows = blocks.select(*_KEY, F.explode(F.filter(F.transform("lines", whole), lambda x: x.isNotNull())).alias("r"))
    return _chunks(rows.select(*_KEY, F.col("r.pos").alias("pos"), F.col("r.text").alias("text")), "recommendation")


def parent_context(lines: Column, chars: int = 900) -> Column:
    """The block's lines that aren't part of a table, cleaned, joined and cut."""
    prose = F.filter(lines, lambda x: ~F.lower(x).contains("<tr") & ~F.lower(x).contains("</tr>") & ~x.rlike(RULE_LINE) & (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) < 2))
    return F.substring(F.array_join(F.filter(F.transform(prose, T.clean_cell), lambda x: x != ""), " "), 1, chars)


def table_rows(blocks: DataFrame) -> DataFrame:
    """(key columns, pos, nth, label, cells) of the rows of Markdown and HTML tables that have two cells or more.

    An HTML row may span lines: it opens at <tr, a further <tr starts it anew, and the first </tr> closes it; in between
    no line counts as Markdown. label: the last caption in the block up to there.
    """
    has = F.exists("lines", lambda x: x.contains("|") | F.lower(x).contains("<tr"))
    rows = blocks.where(has).select(*_KEY, F.posexplode("lines").alias("pos", "line"))
    block = Window.partitionBy("path", "block_no").orderBy("pos")
    low = F.lower("line")
    rows = rows.withColumn("opened", F.sum(low.contains("<tr").cast("int")).over(block.rowsBetween(Window.unboundedPreceding, 0)))
    caption = F.regexp_extract("line", CAPTION, 1)
    label = F.when(caption != "", F.substring(T.clean_cell(caption), 1, 160))
    rows = rows.withColumn("label", F.last(label, ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("path", "block_no", "opened").orderBy("pos")
    closed = F.coalesce(F.sum(low.contains("</tr>").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", (F.col("opened") > 0) & (closed == 0))
    buffer = F.array_join(F.collect_list(F.when(F.col("inside"), F.col("line"))).over(run.rowsBetween(Window.unboundedPreceding, 0)), " ")
    rows = rows.withColumn("buffer", F.when(F.col("inside") & low.contains("</tr>"), buffer))

    found = F.regexp_extract_all("buffer", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    html = F.transform(F.when(F.size(found) > 0, found).otherwise(F.array("buffer")), lambda r: F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))
    marked = F.array(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"))
    plain = ~F.col("inside") & F.col("line").contains("|") & ~F.col("line").rlike(RULE_LINE)
    every = F.when(F.col("buffer").isNotNull(), html).when(plain, marked)
    rows = rows.where(F.col("buffer").isNotNull() | plain).select(*_KEY, "pos", "label", F.posexplode(every).alias("nth", "raw"))
    rows = rows.withColumn("cells", F.filter(F.transform("raw", T.clean_cell), lambda x: x != "")).where(F.size("cells") >= 2)
    return rows.where(~F.array_join("cells", " | ").rlike("^[-:| ]+$")).select(*_KEY, "pos", "nth", "label", "cells")


def table_chunks(blocks: DataFrame, context_chars: int = 900) -> DataFrame:
    context = blocks.select("path", "block_no", parent_context(F.col("lines"), context_chars).alias("context"))
    rows = table_rows(blocks).join(context, ["path", "block_no"])
    text = F.concat(F.when(F.coalesce("label", F.lit("")) != "", F.concat("label", F.lit(": "))).otherwise("Table row: "), F.array_join("cells", " | "))
    text = F.when(F.col("context") != "", F.concat(text, F.lit("\nParent section context: "), "context")).otherwise(text)
    return _chunks(rows.select(*_KEY, (F.col("pos") * 1000 + F.col("nth")).alias("pos"), text.alias("text")), "table_row")


def chunks(files: DataFrame, chunk_chars: int = 1800, context_chars: int = 900, start: str = RECOMMENDATION, following: str = FOLLOWING) -> DataFrame:
    """All chunks of files (path, text): chunk_id, path, source, title, block_no, section, chunk_type, kind_no, pos, text.

    kind_no orders the kinds within a section; chunk_id is a hash of what names the chunk, the same on every run.
    """
    blocks = sections(files)
    every = summary_chunks(blocks).unionByName(recommendation_chunks(blocks, start, following)).unionByName(text_chunks(blocks, chunk_chars)).unionByName(table_chunks(blocks, context_chars))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("chunk_type")).cast("int")
    return every.withColumn("kind_no", kind).withColumn("chunk_id", F.xxhash64("path", "block_no", "kind_no", "pos"))
