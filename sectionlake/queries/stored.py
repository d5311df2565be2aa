"""The engine over stored snapshots of the driver's tables, with the SQL of the same results over the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.plans.engine import Engine, UnknownSection
from sectionlake.plans.ingest import import_sections
from sectionlake.queries import common as c
from sectionlake.queries import lexical as words
from sectionlake.queries import scanning
from sectionlake.session import scratch_dir

#: The section whose text and surroundings are read.
ASKED = "chat/3#2"
_stores: dict[tuple[str, str, str], Engine] = {}


def stored(spark, sf_dir: str, name: str) -> Engine:
    """An engine over a store of a table's sections, made once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stores:
        sections = {"documents": c.document_sections, "turns": c.turn_sections}[name](spark, sf_dir)
        _stores[key] = Engine(import_sections(spark, sections, f"{scratch_dir(spark)}/store-{len(_stores)}"))
    return _stores[key]


def store_search(spark, sf_dir: str) -> DataFrame:
    """Every section with a word of the query, ranked from the stored postings and terms."""
    return stored(spark, sf_dir, "documents").ranked(words.WORDS).select("id", "path", "tier", F.round("score", 6).alias("score"))


def store_search_scoped(spark, sf_dir: str) -> DataFrame:
    """The hits of a scoped search, as the operator returns them."""
    found = stored(spark, sf_dir, "documents").search("der die und", ["de", "fr/src1?/*"], 20)
    return spark.createDataFrame([(h.id, h.doc, h.score) for h in found.hits], "id string, path string, score double")


def store_read(spark, sf_dir: str) -> DataFrame:
    """The asked section and its surroundings; no rows where the conversation has no such turn."""
    try:
        found = stored(spark, sf_dir, "turns").read(ASKED, 2)
        views = [found.section, *found.context]
    except UnknownSection:
        views = []
    return spark.createDataFrame([(s.id, s.kind, s.text, s.prev_id, s.next_id, s.context) for s in views], "id string, kind string, text string, prev_id string, next_id string, context boolean")


def store_neighbours(spark, sf_dir: str) -> DataFrame:
    """The sections around the asked one; no rows where the conversation has no such turn."""
    try:
        views = stored(spark, sf_dir, "turns").neighbours(ASKED, 1, 3).sections
    except UnknownSection:
        views = []
    return spark.createDataFrame([(s.id, s.heading_path, s.text) for s in views], "id string, heading_path string, text string")


def store_grep(spark, sf_dir: str) -> DataFrame:
    found = stored(spark, sf_dir, "documents").grep("the", limit=100)
    return spark.createDataFrame([(m.id, m.line, found.truncated) for m in found.matches], "id string, line string, truncated boolean")


def store_export(spark, sf_dir: str) -> DataFrame:
    lines = stored(spark, sf_dir, "documents").export_chunks().select(F.get_json_object("value", "$.id").alias("id"), "value")
    return lines.select("id", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n"))


QUERIES = {f.__name__: f for f in (store_search, store_search_scoped, store_read, store_neighbours, store_grep, store_export)}


def _sql() -> dict[str, str]:
    from sectionlake.queries import reading

    near = f"WITH {c.TURNS}, near AS (SELECT *, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)), "
    own = f"own AS (SELECT doc_id AS d, ordinal AS o, kind AS k FROM turns WHERE id = '{ASKED}') "
    # The asked turn is a user's, so it continues no table.
    return {
        "store_search": words._top_sql(words.WORDS, None),
        "store_search_scoped": words._top_sql("der die und", 20, "path = 'de' OR starts_with(path, 'de/') OR path GLOB 'fr/src1?/*'", "id, path, round(score, 2) AS score"),
        "store_read": near + own + f"SELECT id, kind, text, prev_id, next_id, id <> '{ASKED}' AS context FROM near JOIN own ON doc_id = d AND ordinal BETWEEN o - 2 AND o + 2",
        "store_neighbours": near + own + "SELECT id, heading_path, text FROM near JOIN own ON doc_id = d AND ordinal BETWEEN o - 1 AND o + 3",
        "store_grep": f"SELECT id, line, n > 100 AS truncated FROM (SELECT *, count(*) OVER () AS n FROM ({scanning._grep_sql('the')} ORDER BY id LIMIT 101)) ORDER BY id LIMIT 100",
        "store_export": reading.ORACLE_SQL["export_chunks"],
    }


ORACLE_SQL = _sql()
