"""Adjacency, context, table runs, exports and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.functions import text
from sectionlake.operators import reading
from sectionlake.queries import common as c
from sectionlake.session import spread, table


def adjacency(spark, sf_dir: str) -> DataFrame:
    return reading.adjacent(c.turn_sections(spark, sf_dir)).select("id", "prev_id", "next_id")


def read_context(spark, sf_dir: str) -> DataFrame:
    rows = c.turn_sections(spark, sf_dir)
    return reading.around(rows, rows.select("id"), 2, 2, itself=False).select("asked", "id", F.sha2("text", 256).alias("text_sha256"))


def neighbours(spark, sf_dir: str) -> DataFrame:
    rows = c.turn_sections(spark, sf_dir)
    return reading.around(rows, rows.select("id"), 1, 1).select("asked", "id", "ordinal")


def table_runs(spark, sf_dir: str) -> DataFrame:
    rows = reading.table_runs(c.turn_sections(spark, sf_dir))
    return rows.select("id", "header_id", F.sha2("header_text", 256).alias("header_sha256"))


def point_read(spark, sf_dir: str) -> DataFrame:
    rows = c.document_sections(spark, sf_dir)
    return rows.where(F.col("doc_id") == 17).select("id", "path", "heading_path", "kind", F.sha2("text", 256).alias("text_sha256"))


def split_lines(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "pages")
    return docs.select("page_id", F.posexplode(text.lines(F.coalesce("html", F.lit(""))))).select("page_id", "pos", text.collapse(F.col("col")).alias("line"))


def export_chunks(spark, sf_dir: str) -> DataFrame:
    rows = c.document_sections(spark, sf_dir)
    return rows.select("id", F.to_json(F.struct("id", "text", F.col("path").alias("source"))).alias("value")).select("id", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n"))


def offline_summary(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    body = text.summary_body(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", text.summary_line(F.concat_ws(" ", "lang", "source"), F.array(body)).alias("summary"))


def word_counts_by_kind(spark, sf_dir: str) -> DataFrame:
    """Sections and characters of each kind and heading."""
    rows = c.turn_sections(spark, sf_dir)
    return rows.groupBy("kind", "heading_path").agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"))


def _json_sql(column: str) -> str:
    return f"CAST(to_json({column}) AS VARCHAR)"


QUERIES = {f.__name__: f for f in (adjacency, read_context, neighbours, table_runs, point_read, split_lines, export_chunks, offline_summary, word_counts_by_kind)}
ORACLE_SQL = {
    "adjacency": f"WITH {c.TURNS} SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)",
    "read_context": f"WITH {c.TURNS} SELECT a.id AS asked, b.id AS id, sha256(b.text) AS text_sha256 FROM turns a JOIN turns b ON a.doc_id = b.doc_id AND b.ordinal BETWEEN a.ordinal - 2 AND a.ordinal + 2 AND a.id <> b.id",
    "neighbours": f"WITH {c.TURNS} SELECT a.id AS asked, b.id AS id, b.ordinal FROM turns a JOIN turns b ON a.doc_id = b.doc_id AND b.ordinal BETWEEN a.ordinal - 1 AND a.ordinal + 1",
    "table_runs": f"""WITH {c.TURNS},
marked AS (SELECT *, CASE WHEN kind = 'table' AND coalesce(lag(kind) OVER w = 'table' AND lag(heading_path) OVER w = heading_path, false) THEN 0 ELSE 1 END AS start FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
runs AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY ordinal) AS run FROM marked),
heads AS (SELECT *, first_value(id) OVER r AS first_id, first_value(text) OVER r AS first_text FROM runs WINDOW r AS (PARTITION BY doc_id, run ORDER BY ordinal))
SELECT id, CASE WHEN kind = 'table' AND start = 0 THEN first_id END AS header_id, CASE WHEN kind = 'table' AND start = 0 THEN sha256(first_text) END AS header_sha256 FROM heads""",
    "point_read": f"WITH {c.SECTIONS} SELECT id, path, heading_path, kind, sha256(text) AS text_sha256 FROM sections WHERE doc_id = 17",
    "split_lines": f"WITH l AS (SELECT page_id, {c.sql_lines("coalesce(html, '')")} AS x FROM pages) SELECT page_id, CAST(unnest(range(len(x))) AS INTEGER) AS pos, {c.sql_collapse('unnest(x)')} AS line FROM l",
    "export_chunks": f"WITH {c.SECTIONS}, j AS (SELECT id, '{{\"id\":' || {_json_sql('id')} || ',\"text\":' || {_json_sql('text')} || ',\"source\":' || {_json_sql('path')} || '}}' AS value FROM sections) SELECT id, sha256(value) AS value_sha256, CAST(length(value) AS INTEGER) AS n FROM j",
    "offline_summary": rf"""WITH b AS (SELECT doc_id, concat_ws(' ', lang, source) AS title, {c.sql_collapse("coalesce(array_to_string(list_filter(" + c.sql_lines("coalesce(text, '')") + ", lambda x: NOT starts_with(x, '#') AND " + c.sql_strip("x") + " <> ''), chr(10)), '')")} AS body FROM documents),
s AS (SELECT doc_id, title, CASE WHEN length(body) < 20 OR starts_with(body, '|') OR starts_with(body, '```') THEN '' WHEN regexp_matches(body, '[.!?]\s') THEN regexp_extract(body, '^(?s:(.*?[.!?]))\s', 1) ELSE body END AS sentence FROM b),
w AS (SELECT doc_id, CASE WHEN sentence <> '' AND lower(sentence) <> lower(title) THEN title || ' · ' || sentence ELSE title END AS whole FROM s)
SELECT doc_id, CASE WHEN length(whole) > 160 THEN substr(whole, 1, 157) || '…' ELSE whole END AS summary FROM w""",
    "word_counts_by_kind": f"WITH {c.TURNS} SELECT kind, heading_path, count(*) AS sections, CAST(sum(length(text)) AS BIGINT) AS chars FROM turns GROUP BY ALL",
}
