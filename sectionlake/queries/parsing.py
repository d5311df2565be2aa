"""Sectioning of documents and of small fixtures in code; rows only, for SQL has no form of these folds."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.plans import ingest
from sectionlake.queries import common as c
from sectionlake.session import ship_package, spread, table
from sectionlake.sources import files
from sectionlake.sources.sections import Limits

MARKDOWN = """---
title: "Pump manual"
---
Read this first.

# Pump manual
## Safety
Never open the housing while it runs. Wait until the pressure is zero, then lock the valve.

- gloves
- goggles

### Codes
| code | meaning |
|------|---------|
| E-1  | dry run |
| E-2  | too hot |

Restart
-------
```sh
pump --restart
```
"""


def word_split_sections(spark, sf_dir: str) -> DataFrame:
    """documents cut at word borders into sections of at most 400 characters."""
    docs = spread(table(spark, sf_dir, "documents")).select(c.paths().alias("path"), "text")
    parsed = files.parse_table(docs, Limits(max_chars=400))
    return ingest.exploded_sections(parsed).select("id", "heading_path", "level", "kind", "char_len", "hash", "prev_id", "next_id")


def sectionize_pages(spark, sf_dir: str) -> DataFrame:
    """pages as Markdown documents: their sections' kinds and sizes."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.col("html").alias("text"))
    return ingest.exploded_sections(files.parse_table(pages, Limits(), kind="markdown")).select("id", "level", "kind", "char_len", "hash")


def _office(kind: str) -> bytes:
    """A small file of each Office kind."""
    main = "http://schemas.openxmlformats.org"
    parts = {
        "docx": {"word/document.xml": f'<w:document xmlns:w="{main}/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>Valves</w:t></w:r></w:p><w:p><w:r><w:t>Turn clockwise to close, and never force it.</w:t></w:r></w:p></w:body></w:document>'},
        "xlsx": {
            "xl/workbook.xml": f'<workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships"><sheets><sheet name="Parts" sheetId="1" r:id="a"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>part</t></is></c><c r="C1"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>seal</t></is></c></row></sheetData></worksheet>',
        },
        "pptx": {"ppt/slides/slide1.xml": f'<p:sld xmlns:p="{main}/presentationml/2006/main" xmlns:a="{main}/drawingml/2006/main"><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><a:p><a:r><a:t>Service</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>Every spring</a:t></a:r></a:p></p:sp></p:sld>'},
    }[kind]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _fixtures(spark) -> DataFrame:
    rows = [("manual.md", "markdown", MARKDOWN.encode()), ("notes.txt", "text", b"Known issues\n\nThe gauge sticks below five degrees.\n\n- tap it\n- wait\n")]
    rows += [(f"file.{kind}", kind, _office(kind)) for kind in ("docx", "xlsx", "pptx")]
    return spark.createDataFrame(rows, "path string, kind string, data binary")


def parse_blocks(spark, sf_dir: str) -> DataFrame:
    """The block stream of every fixture."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                blocks = files.parse_bytes(bytes(row["data"]), row["kind"], row["path"].split(".")[0]).blocks
                rows = [{"path": row["path"], "pos": i, "kind": b.kind, "level": b.level, "lang": b.lang, "raw": b.raw} for i, b in enumerate(blocks)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("lang", pa.string()), ("raw", pa.string())]))

    ship_package(spark)
    return _fixtures(spark).mapInArrow(run, "path string, pos int, kind string, level int, lang string, raw string")


def sectionize_fixtures(spark, sf_dir: str) -> DataFrame:
    """The sections of every fixture, with titles."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([files._parsed(row["path"], row["kind"], bytes(row["data"]), Limits(max_chars=200))], files._PARSED)

    ship_package(spark)
    parsed = _fixtures(spark).mapInArrow(run, files.PARSED)
    return parsed.select("path", "title", F.explode("sections").alias("s")).select("path", "title", "s.*")


QUERIES = {f.__name__: f for f in (word_split_sections, sectionize_pages, parse_blocks, sectionize_fixtures)}
ORACLE_SQL: dict[str, str] = {}
