"""Files to chunks: a file with everything, against what it must give."""

from __future__ import annotations

from quarry.operators import chunks as C
from quarry.sources.files import text_files
from quarry.sources.keywords import keyword_entries

FILE = """intro line
# **Title** _one_
##### five hashes are text
Downloaded from somewhere
> *citation footer
> **7.15** Quoted recommendation
You should consider it.
not going on
Recommendation 2.1 next
## Empty
## Tables
See Table 3.2 Doses
| a | b |
|---|---|
| only |
prose | with pipe
<table><tr><td>x</td>
<td>y &amp; z</td></tr>
<tr><td>half
<tr><td>p</td><td>q</td></tr>
## References
Nothing from here
"""


def kinds(spark, text: str, **how) -> dict[str, list[str]]:
    rows = C.chunks(spark.createDataFrame([("d/file.md", text)], "path string, text string"), **how).orderBy("block_no", "kind_no", "pos").collect()
    return {k: [r.text for r in rows if r.chunk_type == k] for k in C.KINDS}


def test_sections(spark):
    rows = C.sections(spark.createDataFrame([("d/file.md", FILE)], "path string, text string")).orderBy("block_no").collect()
    assert [(r.block_no, r.section, r.title) for r in rows] == [(0, "Title one", "Title one"), (1, "Title one", "Title one"), (3, "Tables", "Title one")]
    assert rows[1].lines[0] == "##### five hashes are text" and len(rows[1].lines) == 5


def test_chunk_kinds(spark):
    found = kinds(spark, FILE)
    assert found["recommendation"] == ["Recommendation 7.15: > **7.15** Quoted recommendation\nYou should consider it.", "Recommendation 2.1: Recommendation 2.1 next"]
    rows = [t.split("\n")[0] for t in found["table_row"]]
    assert rows == ["Table 3.2 Doses: a | b", "Table 3.2 Doses: prose | with pipe", "Table 3.2 Doses: x | y & z", "Table 3.2 Doses: p | q"]
    assert found["section_summary"][0] == "Section map: Title one\nSection: Title one\nKey opening context:\nintro line"
    assert "Nothing from here" not in str(found)


def test_packing(spark):
    text = "\n".join(["a" * 5, "b" * 3, "c" * 20, "d", "e"])
    assert kinds(spark, text, chunk_chars=10)["text"] == ["a" * 5 + "\n" + "b" * 3, "c" * 20, "d\ne"]


def test_odd_files(spark):
    rows = spark.createDataFrame([("a.md", None), ("b.md", ""), ("c.md", "# only heading"), ("e", "x\r\ny\x0bz")], "path string, text string")
    assert [(r.path, r.title, r.lines) for r in C.sections(rows).collect()] == [("e", "e", ["x", "y", "z"])]


def test_text_files(spark, tmp_path):
    for name, body in {"a/one.md": b"one", "a/b/two.md": b"tw\xffo", "a/icon.md": b"no", "a/.hid/x.md": b"no", "a/x.txt": b"no", "c/three.md": b"three"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = text_files(spark, [f"{tmp_path}/a", f"{tmp_path}/a/b"], [f"{tmp_path}/c/three.md"]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.text) for r in rows) == [("one.md", "one"), ("three.md", "three"), ("two.md", "two")]


def test_keyword_entries(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"entries": [{"id": "e1", "triggers": [" a ", ""], "expansions": ["b"]}, "odd", {"id": "e2", "triggers": []}, {"id": "e3", "triggers": ["t"], "variant_queries": ["v"]}, {"id": "e4", "triggers": ["t"]}]}')
    (tmp_path / "n.json").write_text('{"name": "named", "entries": [{"id": "e5", "triggers": ["x"], "expansions": ["y"]}]}')
    (tmp_path / "broken.json").write_text("{")
    rows = keyword_entries(spark, str(tmp_path)).orderBy("module", "entry_no").collect()
    assert [(r.module, r.entry_id, r.triggers, r.expansions, r.variant_queries) for r in rows] == [("m", "e1", ["a"], ["b"], []), ("m", "e3", ["t"], [], ["v"]), ("named", "e5", ["x"], ["y"], [])]
