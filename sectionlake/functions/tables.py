"""Parsing and sectioning as table functions of SQL: FROM sectionize(text, 'markdown', 2000)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sectionlake.session import ship_package

SECTION = "ordinal int, heading_path string, level int, kind string, text string"
BLOCK = "pos int, kind string, level int, raw string"


def _document(text: str | None, kind: str | None):
    from sectionlake.sources.files import parse_bytes

    return parse_bytes((text or "").encode("utf-8", "surrogatepass"), kind or "markdown", "")


class Sectionize:
    """The sections of a text of a kind ('markdown' or 'text'), of at most so many characters (null: the default)."""

    def eval(self, text: str, kind: str, max_chars: int):
        from sectionlake.sources.sections import Limits, sectionize

        yield from map(tuple, sectionize(_document(text, kind), Limits(max_chars=max_chars) if max_chars else None))


class ParseBlocks:
    """The blocks of a text of a kind, in order."""

    def eval(self, text: str, kind: str):
        for pos, block in enumerate(_document(text, kind).blocks):
            yield pos, block.kind, block.level, block.raw


def register(spark: SparkSession) -> None:
    """Make `sectionize` and `parse_blocks` known to the session's SQL; a document's text is one row of one task."""
    ship_package(spark)
    spark.udtf.register("sectionize", udtf(Sectionize, returnType=SECTION))
    spark.udtf.register("parse_blocks", udtf(ParseBlocks, returnType=BLOCK))
