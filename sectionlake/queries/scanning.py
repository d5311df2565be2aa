"""Grep, path filters and listings over documents and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sectionlake.functions import text
from sectionlake.operators import contents, reading
from sectionlake.queries import common as c
from sectionlake.session import table


def _pages(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").cast("string").alias("id"), F.coalesce("url", F.lit("")).alias("path"), F.lit("page").alias("heading_path"), F.coalesce("html", F.lit("")).alias("text"))


def grep_literal(spark, sf_dir: str) -> DataFrame:
    return reading.grep(c.document_sections(spark, sf_dir), "Clown").select("id", "line")


def grep_accented(spark, sf_dir: str) -> DataFrame:
    """Upper-case accented text isn't found by the plain form, which lowers A to Z alone; unicode=True finds it."""
    rows = c.document_sections(spark, sf_dir)
    plain = reading.grep(rows, "éeux").select("id", F.lit(1).alias("plain"))
    every = reading.grep(rows, "éeux", unicode=True).select("id", F.lit(1).alias("every"))
    return every.join(plain, "id", "left").select("id", F.coalesce("plain", F.lit(0)).alias("plain"))


def grep_pages(spark, sf_dir: str) -> DataFrame:
    return reading.grep(_pages(spark, sf_dir), "<title>").select("id", "line")


def grep_scoped(spark, sf_dir: str) -> DataFrame:
    scope = text.path_filter(F.col("path"), ["en/src1", "de/*[13579]"])
    return reading.grep(c.document_sections(spark, sf_dir), "er", within=scope).select("id", "path", "line")


def grep_regex(spark, sf_dir: str) -> DataFrame:
    return reading.grep(c.document_sections(spark, sf_dir), r"\bclown\W+\w+ing\b|[0-9]{4,}", regex=True).select("id", "line")


def grep_truncated(spark, sf_dir: str) -> DataFrame:
    """The first 20 matches by id, and whether there are more."""
    rows = reading.grep(c.document_sections(spark, sf_dir), "the").select("id", "line").orderBy("id").limit(21)
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy("id")))  # over 21 rows
    more = numbered.agg((F.max("n") > 20).alias("truncated"))  # one row
    return numbered.where("n <= 20").join(F.broadcast(more), F.lit(True)).select("id", "line", "truncated")


def grep_budget(spark, sf_dir: str) -> DataFrame:
    """Where a regular-expression scan by id would stop: the ids within the budget of 200,000 characters."""
    return reading.scan_cost(c.document_sections(spark, sf_dir)).where("within_budget").select("id")


def glob_filter(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", c.paths().alias("path"))
    globs = {"stars": ["en/*7"], "classes": ["[ef]?/src[0-4]/*"], "not_class": ["d[^f]/src1[^0-9]*"], "folder": ["fr/src3/"], "exact": ["es", "en/src2/2"]}
    return docs.select("doc_id", *[text.path_filter(F.col("path"), g).alias(name) for name, g in globs.items()])


def prefix_listing(spark, sf_dir: str) -> DataFrame:
    """Documents and sections below a prefix, in either case of A to Z."""
    docs = _documents(spark, sf_dir).where(text.prefix_filter(F.col("path"), "EN/src1"))
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_sections"), F.lit(0)).alias("sections"))


def _documents(spark, sf_dir: str) -> DataFrame:
    """documents as a store has them: title lang source, one section for each line."""
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    return docs.select(c.paths().alias("path"), F.concat_ws(" ", "lang", "source").alias("title"), F.substring(body, 1, 70).alias("summary"), F.size(F.split(body, "\n")).alias("n_sections"))


def store_counts(spark, sf_dir: str) -> DataFrame:
    """Documents, sections, and documents of each kind of path."""
    docs = _documents(spark, sf_dir)
    return docs.groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.count("*").alias("documents"), F.sum("n_sections").alias("sections"), F.max("n_sections").alias("most"))


def directory_listing(spark, sf_dir: str) -> DataFrame:
    return contents.directory_lines(_documents(spark, sf_dir)).select("top", "line")


def toc_lines(spark, sf_dir: str) -> DataFrame:
    return contents.document_lines(_documents(spark, sf_dir))


def toc_compact_lines(spark, sf_dir: str) -> DataFrame:
    return contents.document_lines(_documents(spark, sf_dir), compact=True)


def toc_budget_mode(spark, sf_dir: str) -> DataFrame:
    """The index mode and tokens that each of four budgets gives."""
    docs = _documents(spark, sf_dir).cache()
    meta = {"corpus_fingerprint": "0" * 16}
    try:
        rows = [(budget, *contents.build_index(docs, meta, budget)[1:]) for budget in (120, 200, 12_000, 4_000_000)]
    finally:
        docs.unpersist()
    return spark.createDataFrame(rows, "budget int, mode string, tokens int")


_DOCS = f"""
docs AS (SELECT concat_ws('/', coalesce(lang, ''), coalesce(source, ''), CAST(doc_id AS VARCHAR)) AS path, concat_ws(' ', lang, source) AS title,
  substr(coalesce(text, ''), 1, 70) AS summary, len(string_split(coalesce(text, ''), chr(10))) AS n_sections FROM documents)"""


def _grep_sql(needle: str, source: str = "sections", whole: str | None = None, where: str = "true", columns: str = "id, line") -> str:
    low = needle.lower()
    whole = whole or c.sql_ascii_lower("text")
    return f"""
WITH {c.SECTIONS}, pages_ AS (SELECT CAST(page_id AS VARCHAR) AS id, coalesce(html, '') AS text FROM pages),
found AS (SELECT *, list_filter({c.sql_lines("text")}, lambda x: contains(lower(x), '{low}')) AS hits FROM {source} WHERE contains({whole}, '{low}') AND {where}),
matched AS (SELECT *, {c.sql_strip("hits[1]")} AS line FROM found WHERE len(hits) > 0)
SELECT {columns} FROM matched"""


_LABEL = c.sql_strip("CASE WHEN coalesce(summary, '') = '' THEN title ELSE summary END")
_PAD = lambda x: f"(CASE WHEN length({x}) < 30 THEN rpad({x}, 30, ' ') ELSE {x} END)"

QUERIES = {f.__name__: f for f in (grep_literal, grep_accented, grep_pages, grep_scoped, grep_regex, grep_truncated, grep_budget, glob_filter, prefix_listing, store_counts, directory_listing, toc_lines, toc_compact_lines, toc_budget_mode)}
ORACLE_SQL = {
    "grep_literal": _grep_sql("Clown"),
    "grep_accented": _grep_sql("éeux", whole="lower(text)", columns=f"id, CASE WHEN contains({c.sql_ascii_lower('text')}, 'éeux') THEN 1 ELSE 0 END AS plain"),
    "grep_pages": _grep_sql("<title>", "pages_"),
    "grep_scoped": _grep_sql("er", where="(starts_with(path, 'en/src1/') OR path = 'en/src1' OR path GLOB 'de/*[13579]')", columns="id, path, line"),
    "grep_regex": rf"""WITH {c.SECTIONS}, found AS (SELECT id, list_filter({c.sql_lines("text")}, lambda x: regexp_matches(x, '(?i)\bclown[^\p{{L}}\p{{N}}_]+[\p{{L}}\p{{N}}_]+ing\b|[0-9]{{4,}}')) AS hits FROM sections)
SELECT id, {c.sql_strip("hits[1]")} AS line FROM found WHERE len(hits) > 0""",
    "grep_truncated": f"SELECT id, line, n > 20 AS truncated FROM (SELECT *, count(*) OVER () AS n FROM ({_grep_sql('the')} ORDER BY id LIMIT 21)) ORDER BY id LIMIT 20",
    "grep_budget": f"WITH {c.SECTIONS} SELECT id FROM (SELECT id, sum(length(text)) OVER (ORDER BY id) AS total FROM sections) WHERE total <= {reading.SCAN_BUDGET}",
    "glob_filter": """WITH p AS (SELECT doc_id, concat_ws('/', coalesce(lang, ''), coalesce(source, ''), CAST(doc_id AS VARCHAR)) AS path FROM documents)
SELECT doc_id, regexp_full_match(path, 'en/.*7') AS stars, regexp_full_match(path, '[ef]./src[0-4]/.*') AS classes, regexp_full_match(path, 'd[^f]/src1[^0-9].*') AS not_class,
  path = 'fr/src3/' OR starts_with(path, 'fr/src3/') AS folder, path = 'es' OR starts_with(path, 'es/') OR path = 'en/src2/2' OR starts_with(path, 'en/src2/2/') AS exact FROM p""",
    "prefix_listing": f"WITH {_DOCS} SELECT count(*) AS documents, CAST(coalesce(sum(n_sections), 0) AS BIGINT) AS sections FROM docs WHERE starts_with({c.sql_ascii_lower('path')}, 'en/src1')",
    "store_counts": f"WITH {_DOCS} SELECT split_part(path, '/', 1) AS top, count(*) AS documents, CAST(sum(n_sections) AS BIGINT) AS sections, max(n_sections) AS most FROM docs GROUP BY top",
    "directory_listing": f"""WITH {_DOCS}, tops AS (SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) || '/' ELSE '(root)' END AS top, substr(CASE WHEN summary = '' THEN title ELSE summary END, 1, 40) AS label FROM docs)
SELECT top, {_PAD("top")} || count(*) || ' docs · ' || sum(n_sections) || ' sections · ' || array_to_string(list(label ORDER BY path)[1:3], ', ') || CASE WHEN count(*) > 3 THEN ', +' || (count(*) - 3) || ' more' ELSE '' END AS line FROM tops GROUP BY top""",
    "toc_lines": f"WITH {_DOCS}, l AS (SELECT path, n_sections, {_LABEL} AS label FROM docs) SELECT path, {_PAD('path')} || '  ' || CASE WHEN length(label) > 60 THEN rtrim(substr(label, 1, 59), chr(32) || chr(10) || chr(9)) || '…' ELSE label END || '  (' || n_sections || ')' AS line FROM l",
    "toc_compact_lines": f"WITH {_DOCS} SELECT path, {_PAD('path')} || '  (' || n_sections || ')' AS line FROM docs",
}
