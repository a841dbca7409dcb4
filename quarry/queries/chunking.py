"""P1 to P14, P10 with an HTML fixture made from pages: lines, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunks as C
from quarry.operators.rules import Rules, all_of, any_of
from quarry.queries.shared import SQL_CONVS, SQL_DOCS, lit, md_convs, md_docs, read, sql_strip
from quarry.queries.texts import sql_clean_cell

#: Our own rules for the invented corpus: labels of sources by path and text.
LABELS = [
    *all_of(1, "label", "Handbook of the first source", "contains", ("src1/", "src2/"), ("the", "und")),
    *any_of(2, "label", "Letters in French", "regex", "(^|[^a-z])(des|les)([^a-z]|$)"),
    *any_of(3, "label", "Numbers of 20dd", "regex", "20[0-9][0-9]"),
    *all_of(4, "label", "Spanish papers", "contains_ci", ("CIÓN",), ("que", "los")),
]
#: Our own patterns for recommendations in it: two short openings and words that go on.
START, FOLLOW = r"(?i)^(?:(th[a-z]{1,3}) |(er[a-z]{1,4}) )", r"(?i)(?:^|[^\p{L}\p{N}_])(?:the|and|in|of)(?:[^\p{L}\p{N}_]|$)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(md_convs(spark, d))


_LINK = r'<li><a href="([^"]*)">([^<]*)</a>'


def md_pages(spark: SparkSession, d: str) -> DataFrame:
    """The links of pages as HTML tables whose rows span two lines: (path, text)."""
    rows = F.zip_with(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), F.regexp_extract_all("html", F.lit(_LINK), F.lit(2)), lambda x, y: F.concat(F.lit("<TR class=r><td>"), x, F.lit("</td>\n<th> "), y, F.lit("</th></tr>")))
    return read(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Links\n"), F.array_join(rows, "\n")).alias("text"))


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.content_lines(md_docs(spark, d)).select("path", F.col("pos").cast("long").alias("pos"), "line")


def p2_headings(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("path", F.col("block_no").cast("long").alias("block_no"), "section", F.size("lines").cast("long").alias("n_lines"))


def p3_titles(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).unionByName(C.sections(md_docs(spark, d))).select("path", "source", "title").distinct()


def p4_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the conversations in which the heading of each system turn is called References."""
    files = md_convs(spark, d).select("path", F.regexp_replace("text", "(?m)^## system [0-9]+$", "### *References*").alias("text"))
    return C.sections(files).groupBy("path").agg(F.count("*").alias("n_sections"))


def p5_source_label(spark: SparkSession, d: str) -> DataFrame:
    files = md_docs(spark, d)
    hay = F.lower(F.concat_ws("\n", "path", F.substring(T.text("text"), 1, 5000)))
    return files.select("path", Rules(LABELS).first(hay, "Other papers").alias("label"))


def p6_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.text_chunks(C.sections(md_docs(spark, d)), 1800).select("path", F.col("pos").cast("long").alias("pos"), "text")


def p7_summaries(spark: SparkSession, d: str) -> DataFrame:
    return C.summary_chunks(_blocks(spark, d)).select("path", F.col("block_no").cast("long").alias("block_no"), "text")


def p8_recommendations(spark: SparkSession, d: str) -> DataFrame:
    rows = C.recommendation_chunks(C.sections(md_docs(spark, d)), START, FOLLOW)
    return rows.select("path", F.col("pos").cast("long").alias("pos"), "text")


def p9_markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table_rows(C.sections(md_docs(spark, d)))
    return rows.select("path", F.col("pos").cast("long").alias("pos"), F.size("cells").cast("long").alias("n_cells"), F.array_join("cells", " | ").alias("row"))


def p10_html_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table_rows(C.sections(md_pages(spark, d)))
    return rows.select("path", F.col("block_no").cast("long").alias("block_no"), F.col("pos").cast("long").alias("pos"), F.array_join("cells", " | ").alias("row"))


def _captioned(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which some lines are captions and each fifth becomes a row."""
    caption = lambda x, i: F.when(i % 7 == 2, F.concat(F.lit("See Table "), i.cast("string"), F.lit(".1 "), F.substring(x, 1, 30))).when(i % 5 == 4, F.concat(F.substring(x, 1, 20), F.lit(" | cell"))).otherwise(x)
    return md_docs(spark, d).select("path", F.array_join(F.transform(F.split("text", "\n"), caption), "\n").alias("text"))


def p11_captions(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table_rows(C.sections(_captioned(spark, d)))
    return rows.select("path", F.col("pos").cast("long").alias("pos"), F.coalesce("label", F.lit("Table row")).alias("label"))


def p12_parent_context(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(md_docs(spark, d)).select("path", C.parent_context(F.col("lines")).alias("context"))


def p13_parents(spark: SparkSession, d: str) -> DataFrame:
    own = C.parents(_blocks(spark, d)).withColumn("own_chars", F.length("parent_text").cast("long"))
    rows = C.text_chunks(_blocks(spark, d), 400).join(own.select("path", "block_no", "own_chars"), ["path", "block_no"])
    return rows.groupBy("path", F.col("block_no").cast("long").alias("block_no")).agg(F.count("*").alias("n_chunks"), F.max("own_chars").alias("parent_chars"))


def p14_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = C.chunks(md_convs(spark, d), chunk_chars=600, start=START, following=FOLLOW)
    return rows.groupBy("path", "chunk_type", F.col("kind_no").cast("long").alias("kind_no")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("chunk_id").alias("n_ids"))


QUERIES = (p1_lines, p2_headings, p3_titles, p4_sections, p5_source_label, p6_text_chunks, p7_summaries, p8_recommendations, p9_markdown_rows, p10_html_rows, p11_captions, p12_parent_context, p13_parents, p14_chunks)


def sql_lines(files: str) -> str:
    """Common table expressions up to kept(path, pos, line, h)."""
    noise = f"(contains(line, '{C.NOISE_TERM}') or regexp_matches(line, {lit(C.NOISE)}))"
    return f"""{files},
        cut as (select path, regexp_split_to_array(coalesce(text, ''), {lit(T.LINE_END)}) as a from files),
        raw as (select path, generate_subscripts(a, 1) - 1 as pos, {sql_strip('unnest(a)')} as line from cut),
        kept as (select *, cast(regexp_matches(line, {lit(C.HEADING)}) as int) as h from raw where line <> '' and (regexp_matches(line, {lit(C.HEADING)}) or not {noise}))"""


def sql_heading(x: str) -> str:
    return sql_strip(f"translate(regexp_replace({x}, {lit(T.WS + '+')}, ' ', 'g'), '*_', '')")


def sql_blocks(files: str) -> str:
    """Up to blk(path, source, title, block_no, section, lines)."""
    return f"""{sql_lines(files)},
        numbered as (select *, sum(h) over (partition by path order by pos) as block_no from kept),
        heads as (select path, block_no, {sql_heading(f"regexp_extract(line, {lit(C.HEADING)}, 1)")} as raw from numbered where h = 1),
        titles as (select path, arg_min(raw, block_no) as title from heads where raw <> '' group by path),
        bodies as (select path, cast(block_no as bigint) as block_no, list(line order by pos) as lines from numbered where h = 0 group by path, block_no),
        blk as (select b.path, string_split(b.path, '/')[-1] as source, coalesce(t.title, regexp_replace(string_split(b.path, '/')[-1], '(.)\\.[^.]*$', '\\1')) as title, b.block_no,
                  case when coalesce(h.raw, '') = '' then coalesce(t.title, regexp_replace(string_split(b.path, '/')[-1], '(.)\\.[^.]*$', '\\1')) else h.raw end as section, b.lines
                from bodies b left join heads h using (path, block_no) left join titles t on t.path = b.path where lower(coalesce(h.raw, '')) not in ('references', 'reference'))"""


def sql_packed(cap: int, source: str = "blk") -> str:
    """Recursive: pk(path, block_no, i, line, size, chunk) over the blocks' lines."""
    return f"""ln as (select path, block_no, generate_subscripts(lines, 1) as i, unnest(lines) as line from {source}),
        pk as (select path, block_no, i, line, length(line) + 1 as size, 0 as chunk from ln where i = 1
               union all select l.path, l.block_no, l.i, l.line, case when p.size + length(l.line) > {cap} then 0 else p.size end + length(l.line) + 1, p.chunk + cast(p.size + length(l.line) > {cap} as int)
               from pk p join ln l on l.path = p.path and l.block_no = p.block_no and l.i = p.i + 1)"""


def _context(x: str = "lines", chars: int = 900) -> str:
    keep = f"not contains(lower(x), '<tr') and not contains(lower(x), '</tr>') and not regexp_matches(x, {lit(C.RULE_LINE)}) and length(x) - length(replace(x, '|', '')) < 2"
    return f"substr(array_to_string(list_filter(list_transform(list_filter({x}, lambda x: {keep}), lambda x: {sql_clean_cell('x')}), lambda x: x <> ''), ' '), 1, {chars})"


def sql_fires(rule) -> str:
    def hit(kind: str, term: str) -> str:
        return {"contains": f"contains(x, {lit(term)})", "contains_ci": f"contains(lower(x), {lit(term.lower())})", "regex": f"regexp_matches(x, {lit(term)})"}[kind]

    return "(" + " and ".join(("not " if negate else "") + "(" + " or ".join(hit(*t) for t in terms) + ")" for negate, terms in rule.clauses) + ")"


def sql_first(rules: Rules, default: str) -> str:
    return "case " + " ".join(f"when {sql_fires(r)} then {lit(r.value)}" for r in rules.rules) + f" else {lit(default)} end"


_CAPTIONED = "files as (select source || '/' || doc_id || '.md' as path, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when (i - 1) % 7 = 2 then 'See Table ' || (i - 1) || '.1 ' || substr(x, 1, 30) when (i - 1) % 5 = 4 then substr(x, 1, 20) || ' | cell' else x end), chr(10)) as text from documents)"
_MD_ROWS = f"""ln as (select path, block_no, generate_subscripts(lines, 1) - 1 as pos, unnest(lines) as line from blk),
        rows as (select *, list_filter(list_transform(string_split(regexp_replace(line, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: {sql_clean_cell('x')}), lambda x: x <> '') as cells from ln
                 where contains(line, '|') and not regexp_matches(line, {lit(C.RULE_LINE)})),
        cell_rows as (select * from rows where len(cells) >= 2 and not regexp_matches(array_to_string(cells, ' | '), '^[-:| ]+$'))"""
def _goes(x: str) -> str:
    usual = f"length({x}) < 360 and regexp_matches({x}, {lit(FOLLOW)}) and not regexp_matches({x}, '^#{{1,6}} +')"
    return f"coalesce({x} is not null and not starts_with({x}, '|') and not contains(lower({x}), '<tr') and (regexp_matches({x}, '^ *>') or ({usual})), false)"


_RECS = f"""ln as (select path, block_no, generate_subscripts(lines, 1) - 1 as pos, unnest(lines) as line from blk),
        nx as (select *, lead(line, 1) over w as one, lead(line, 2) over w as two from ln window w as (partition by path, block_no order by pos)),
        recs as (select path, block_no, pos, 'Recommendation ' || coalesce(nullif(regexp_extract(line, {lit(START)}, 1), ''), regexp_extract(line, {lit(START)}, 2)) || ': ' || line
            || case when not coalesce(regexp_matches(one, {lit(START)}), false) and {_goes('one')} then chr(10) || one else '' end
            || case when not coalesce(regexp_matches(one, {lit(START)}), false) and not coalesce(regexp_matches(two, {lit(START)}), false) and {_goes('two')} then chr(10) || two else '' end as text
            from nx where regexp_matches(line, {lit(START)}))"""
_SUMMARY = "'Section map: ' || title || chr(10) || 'Section: ' || section || chr(10) || 'Key opening context:' || chr(10) || array_to_string(list_filter(lines, lambda x: not starts_with(x, '|'))[1:8], chr(10))"

SQL = {
    "p1_lines": f"with {sql_lines(SQL_DOCS)} select path, pos, line from kept",
    "p2_headings": f"with {sql_blocks(SQL_CONVS)} select path, block_no, section, cast(len(lines) as bigint) as n_lines from blk",
    "p3_titles": f"with a as (with {sql_blocks(SQL_CONVS)} select path, source, title from blk), b as (with {sql_blocks(SQL_DOCS)} select path, source, title from blk) select * from a union select * from b",
    "p4_sections": "with " + sql_blocks("files0 as (select 'convs/' || conv_id || '.md' as path, string_agg(case role when 'system' then '### *References*' else '## ' || role || ' ' || turn end || chr(10) || text, chr(10) order by turn) as text from conversations group by conv_id), files as (select * from files0)") + " select path, count(*) as n_sections from blk group by path",
    "p5_source_label": f"with {SQL_DOCS} select path, {sql_first(Rules(LABELS), 'Other papers')} as label from (select path, lower(path || chr(10) || substr(text, 1, 5000)) as x from files)",
    "p6_text_chunks": f"with recursive {sql_blocks(SQL_DOCS)}, {sql_packed(1800)} select path, cast(chunk as bigint) as pos, string_agg(line, chr(10) order by i) as text from pk group by path, block_no, chunk",
    "p7_summaries": f"with {sql_blocks(SQL_CONVS)} select path, block_no, {_SUMMARY} as text from blk where len(list_filter(lines, lambda x: not starts_with(x, '|'))) > 0",
    "p8_recommendations": f"with {sql_blocks(SQL_DOCS)}, {_RECS} select path, pos, text from recs",
    "p10_html_rows": f"""with l as (select page_id, regexp_extract_all(html, {lit(_LINK)}, 1) as h, regexp_extract_all(html, {lit(_LINK)}, 2) as t from pages),
        u as (select page_id, unnest(range(1, len(h) + 1)) as k, h, t from l), c as (select page_id, k, {sql_clean_cell("h[k]")} as a, {sql_clean_cell("t[k]")} as b from u)
        select 'pages/' || page_id || '.md' as path, cast(1 as bigint) as block_no, 2 * k - 1 as pos, a || ' | ' || b as row from c where a <> '' and b <> '' and not regexp_matches(a || ' | ' || b, '^[-:| ]+$')""",
    "p9_markdown_rows": f"with {sql_blocks(SQL_DOCS)}, {_MD_ROWS} select path, pos, cast(len(cells) as bigint) as n_cells, array_to_string(cells, ' | ') as row from cell_rows",
    "p11_captions": f"""with {sql_blocks(_CAPTIONED)}, {_MD_ROWS},
        lb as (select path, block_no, pos, last_value(nullif(substr({sql_clean_cell(f"regexp_extract(line, {lit(C.CAPTION)}, 1)")}, 1, 160), '') ignore nulls) over (partition by path, block_no order by pos) as label from ln)
        select path, pos, coalesce(label, 'Table row') as label from cell_rows join lb using (path, block_no, pos)""",
    "p12_parent_context": f"with {sql_blocks(SQL_DOCS)} select path, {_context()} as context from blk",
    "p13_parents": f"with recursive {sql_blocks(SQL_CONVS)}, {sql_packed(400)} select path, block_no, count(distinct chunk) as n_chunks, cast(sum(length(line) + 1) - 1 as bigint) as parent_chars from pk group by path, block_no",
    "p14_chunks": f"""with recursive {sql_blocks(SQL_CONVS)}, {sql_packed(600).replace('ln as', 'l0 as').replace('from ln', 'from l0').replace('join ln', 'join l0')}, {_RECS.replace('ln as', 'l1 as').replace('from ln', 'from l1')}, {_MD_ROWS.replace('ln as', 'l2 as').replace('from ln', 'from l2')},
        lb as (select path, block_no, pos, last_value(nullif(substr({sql_clean_cell(f"regexp_extract(line, {lit(C.CAPTION)}, 1)")}, 1, 160), '') ignore nulls) over (partition by path, block_no order by pos) as label from l2),
        every as (select path, 'section_summary' as chunk_type, 1 as kind_no, {_SUMMARY} as text from blk where len(list_filter(lines, lambda x: not starts_with(x, '|'))) > 0
          union all select path, 'recommendation', 2, text from recs
          union all select path, 'text', 3, string_agg(line, chr(10) order by i) from pk group by path, block_no, chunk
          union all select c.path, 'table_row', 4, coalesce(label, 'Table row') || ': ' || array_to_string(cells, ' | ') || case when {_context()} <> '' then chr(10) || 'Parent section context: ' || {_context()} else '' end
             from cell_rows c join lb using (path, block_no, pos) join blk b on b.path = c.path and b.block_no = c.block_no)
        select path, chunk_type, cast(kind_no as bigint) as kind_no, count(*) as n, cast(sum(length(text)) as bigint) as chars, count(*) as n_ids from every group by all""",
}
