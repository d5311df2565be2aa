"""Views of the driver's tables as sections, and SQL pieces that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.functions import text
from sectionlake.session import spread, table


def paths() -> F.Column:
    return F.concat_ws("/", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))


def document_sections(spark, sf_dir: str) -> DataFrame:
    """documents as sections: one for each document, with path lang/source/doc_id and heading lang/source."""
    docs = spread(table(spark, sf_dir, "documents"))
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.concat(paths(), F.lit("#0")).alias("id"), F.col("doc_id"), paths().alias("path"), F.lit(0).alias("ordinal"),
        F.concat_ws("/", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("heading_path"), F.lit("prose").alias("kind"), body.alias("text"),
    )


def turn_sections(spark, sf_dir: str) -> DataFrame:
    """conversations as documents of sections: the turn is the ordinal, the role the heading; system turns count as tables."""
    rows = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"))
    kind = F.when(F.col("role") == "user", "prose").otherwise("table")
    return rows.select(F.concat(name, F.lit("#"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("doc_id"), name.alias("path"), F.col("turn").cast("int").alias("ordinal"), F.lit("turns").alias("heading_path"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


SECTIONS = """
sections AS (SELECT concat_ws('/', coalesce(lang, ''), coalesce(source, ''), CAST(doc_id AS VARCHAR)) || '#0' AS id, doc_id,
  concat_ws('/', coalesce(lang, ''), coalesce(source, ''), CAST(doc_id AS VARCHAR)) AS path, 0 AS ordinal,
  concat_ws('/', coalesce(lang, ''), coalesce(source, '')) AS heading_path, 'prose' AS kind, coalesce(text, '') AS text FROM documents)"""

TURNS = """
turns AS (SELECT 'chat/' || conv_id || '#' || turn AS id, conv_id AS doc_id, 'chat/' || conv_id AS path, CAST(turn AS INTEGER) AS ordinal,
  'turns' AS heading_path, CASE WHEN role = 'user' THEN 'prose' ELSE 'table' END AS kind, coalesce(text, '') AS text FROM conversations)"""

_UPPER = "".join(map(chr, range(65, 91)))


def sql_normalise(expression: str) -> str:
    """DuckDB's form of `text.normalise`: its patterns can't look around, so neighbours are taken in and put back."""
    word = r"\p{L}\p{N}_"
    lead = rf"regexp_replace({expression}, '(^|[^{word}.\-])[-_.]+([{word}])', '\1\2', 'g')"
    return rf"regexp_replace({lead}, '([{word}])[-_.]+([^{word}.\-]|$)', '\1\2', 'g')"


def sql_fold(expression: str) -> str:
    marked, base = text._accents()
    return f"translate({expression}, '{marked}', '{base}')"


def sql_query_tokens(expression: str) -> str:
    found = rf"regexp_extract_all({sql_normalise(f'lower({expression})')}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_.\-]*')"
    return f"list_filter(list_transform({found}, lambda t: trim(t, '._-')), lambda t: t <> '')"


def sql_index_tokens(expression: str) -> str:
    return rf"regexp_extract_all({sql_fold(f'lower({sql_normalise(expression)})')}, '[\p{{L}}\p{{N}}\p{{Co}}._\-]+')"


def sql_ascii_lower(expression: str) -> str:
    return f"translate({expression}, '{_UPPER}', '{_UPPER.lower()}')"


def sql_lines(expression: str) -> str:
    """The lines of a text; the ends are those of `text.lines`."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    parts = f"regexp_split_to_array({expression}, '{ends}')"
    return f"(CASE WHEN {expression} = '' THEN [] WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def sql_strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_collapse(expression: str) -> str:
    return f"regexp_replace(regexp_replace({expression}, '{SQL_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"
