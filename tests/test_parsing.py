"""Parsers: Markdown, plain text, Office files, PDF runs."""

from __future__ import annotations

import io
import zipfile

import pytest

from sectionlake.queries.parsing import MARKDOWN, _office
from sectionlake.sources import blocks as b
from sectionlake.sources import office, pdf
from sectionlake.sources.markdown import parse_markdown, parse_plain


def kinds(document):
    return [x.kind for x in document.blocks]


def test_markdown_blocks():
    doc = parse_markdown(MARKDOWN, "stem")
    assert doc.title == "Pump manual" and doc.front_matter == {"title": "Pump manual"}
    assert kinds(doc) == [b.PARAGRAPH, b.HEADING, b.HEADING, b.PARAGRAPH, b.LIST, b.HEADING, b.TABLE, b.HEADING, b.CODE]
    table = doc.blocks[6]
    assert table.header == "| code | meaning |" and len(table.rows) == 2
    assert (doc.blocks[7].level, doc.blocks[7].text) == (2, "Restart") and doc.blocks[8].lang == "sh"


def test_front_matter_that_never_closes_is_text_but_its_keys_count():
    doc = parse_markdown("---\nTitle: 'A: b'\nx\n\n# H", "stem")
    assert doc.front_matter == {"title": "A: b"} and doc.title == "A: b"
    assert doc.blocks[0].raw == "---\nTitle: 'A: b'\nx" and doc.blocks[-1].text == "H"


def test_titles():
    assert parse_markdown("## two\n# one\n# more", "stem").title == "one"
    assert parse_markdown("text", "stem").title == "stem"
    assert parse_plain("Some text that ends here.\n\nHeading here\n\nmore text.", "stem").title == "Heading here"


def test_headings_of_both_forms():
    doc = parse_markdown("# A #\n####### seven\nB\n===\n\none\ntwo\n---\n\n#no", "s")
    assert [(x.kind, x.level, x.text) for x in doc.blocks if x.kind == b.HEADING] == [(b.HEADING, 1, "A")]
    assert parse_markdown("B\n===\n\nC\n-----\n", "s").blocks == [b.heading(1, "B"), b.heading(2, "C")]


def test_fences():
    doc = parse_markdown("text\n~~~~ py x\n# no heading\n~~~\n| a | b |\n~~~~~\nafter\n```\nopen to the end\n", "s")
    assert kinds(doc) == [b.PARAGRAPH, b.CODE, b.PARAGRAPH, b.CODE]
    assert doc.blocks[1].raw.endswith("~~~~~") and doc.blocks[1].lang == "py" and doc.blocks[3].raw == "```\nopen to the end\n"


def test_tables_need_a_rule_with_a_bar():
    assert kinds(parse_markdown("a | b\n--|--\n1 | 2\nnot a row\n", "s")) == [b.TABLE, b.PARAGRAPH]
    assert kinds(parse_markdown("a | b\n-----\n", "s")) == [b.HEADING]
    assert kinds(parse_markdown("a | b\nc | d\n", "s")) == [b.PARAGRAPH]


def test_line_ends_and_lists():
    doc = parse_markdown("1) one\r\n2) two\r\rtext\r\n", "s")
    assert doc.blocks == [b.Block(b.LIST, "1) one\n2) two"), b.Block(b.PARAGRAPH, "text")]


def test_plain_text():
    doc = parse_plain("Known Issues\n\nThe gauge sticks.\n \n- tap\n- wait\n\nNote:\n\n2 ways\n", "s")
    assert [(x.kind, x.raw) for x in doc.blocks] == [(b.HEADING, "## Known Issues"), (b.PARAGRAPH, "The gauge sticks."), (b.LIST, "- tap\n- wait"), (b.PARAGRAPH, "Note:"), (b.HEADING, "## 2 ways")]


def test_office_files():
    docx = office.parse_office(_office("docx"), "docx", "stem")
    assert docx.title == "Valves" and kinds(docx) == [b.HEADING, b.PARAGRAPH]
    xlsx = office.parse_office(_office("xlsx"), "xlsx", "stem")
    assert [x.raw for x in xlsx.blocks] == ["# stem", "## Parts", "| part |  | 1 |\n|---|---|---|\n| seal |  |  |"]
    pptx = office.parse_office(_office("pptx"), "pptx", "stem")
    assert [x.raw for x in pptx.blocks] == ["# Service", "## Slide 1: Service", "Every spring"]


def test_docx_lists_and_tables():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    item = lambda t: f"<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading7"/></w:pPr><w:r><w:t>Deep</w:t></w:r></w:p>{item("a")}<w:p/>{item("b")}<w:tbl><w:tr>{cell("x|y")}{cell(" ")}</w:tr><w:tr>{cell("1")}</w:tr></w:tbl>{item("c")}'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    doc = office.parse_office(out.getvalue(), "docx", "stem")
    assert [x.raw for x in doc.blocks] == ["###### Deep", "- a\n- b", "| x\\|y |  |\n|---|---|\n| 1 |  |", "- c"]


def test_bad_office_files():
    with pytest.raises(office.OfficeError):
        office.parse_office(b"no zip", "docx")
    out = io.BytesIO()
    zipfile.ZipFile(out, "w").close()
    with pytest.raises(office.OfficeError):
        office.parse_office(out.getvalue(), "docx")


def test_column_numbers():
    assert [office.column_number(x) for x in ("A1", "Z9", "AA1", "BC22")] == [0, 25, 26, 54]


def test_pdf_runs():
    pages = [[(20.0, "Big"), (20.0, "title"), (10.0, "Body text that is\n"), (10.0, "long enough."), (14.0, "\nPart"), (10.0, "more")], [(10.0, "next page")]]
    assert [x.raw for x in pdf.blocks_of_runs(pages)] == ["# Big title", "Body text that is long enough.", "## Part", "more", "next page"]
    assert pdf.blocks_of_runs([]) == []


def test_table_functions_of_sql(spark):
    from sectionlake.functions.tables import register
    from sectionlake.sources.sections import Limits, sectionize

    register(spark)
    body = "# A\nwords of a that are long enough to be a section\n\n## B\n" + "word " * 60
    spark.createDataFrame([(1, body), (2, None)], "id int, body string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, s.* FROM texts, LATERAL sectionize(body, 'markdown', 200) s ORDER BY id, ordinal").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(s) for s in sectionize(parse_markdown(body, ""), Limits(max_chars=200))] and {r["id"] for r in got} == {1}
    blocks = spark.sql("SELECT b.kind, b.level FROM texts, LATERAL parse_blocks(body, 'markdown') b ORDER BY b.pos").collect()
    assert [tuple(r) for r in blocks] == [("heading", 1), ("paragraph", 0), ("heading", 2), ("paragraph", 0)]
