"""Change scans, upserts, deletions and fingerprints over documents split into an old and a new state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.operators import contents
from sectionlake.plans import ingest
from sectionlake.queries import common as c
from sectionlake.session import table

# The old state lacks the sources 0 to 2 and has other texts for source 5; the new state lacks source 9.


def _states(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(c.paths().alias("path"), "source", F.coalesce("text", F.lit("")).alias("text"))
    earlier = F.when(F.col("source") == "src5", F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    old = docs.where(~F.col("source").isin("src0", "src1", "src2")).select("path", F.sha2(earlier, 256).alias("sha256"))
    return old, docs.where(F.col("source") != "src9").select("path", F.sha2("text", 256).alias("sha256"))


def change_scan(spark, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    return ingest.changed_paths(new, old, "").select("path", "sha256")


def deleted_docs(spark, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    return ingest.vanished_paths(new, old)


def upsert_snapshot(spark, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    changed = ingest.changed_paths(new, old, "").select("path", "sha256")
    return ingest.upsert(old, changed, ingest.vanished_paths(new, old))


def embed_missing(spark, sf_dir: str) -> DataFrame:
    """Documents without a vector of their number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", c.paths().alias("path"))
    return docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def fingerprint(spark, sf_dir: str) -> DataFrame:
    _, new = _states(spark, sf_dir)
    return spark.createDataFrame([(ingest.fingerprint(new),)], "fingerprint string")


def ingest_report(spark, sf_dir: str) -> DataFrame:
    """What an ingest of the new state over the old one would report."""
    old, new = _states(spark, sf_dir)
    changed, gone = ingest.changed_paths(new, old, ""), ingest.vanished_paths(new, old)
    counts = new.agg(F.count("*").alias("seen")), changed.agg(F.count("*").alias("changed")), gone.agg(F.count("*").alias("deleted"))
    told = counts[0].join(counts[1], F.lit(True)).join(counts[2], F.lit(True))  # three rows in all
    return told.select("seen", "changed", "deleted", (F.col("seen") - F.col("changed")).alias("unchanged"))


def index_header(spark, sf_dir: str) -> DataFrame:
    docs, sections = table(spark, sf_dir, "documents").agg(F.count("*"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n")))).first()
    return spark.createDataFrame([(contents.header({"corpus_fingerprint": "0123456789abcdef"}, docs, sections, "compact"),)], "header string")


_STATES = """
docs AS (SELECT concat_ws('/', coalesce(lang, ''), coalesce(source, ''), CAST(doc_id AS VARCHAR)) AS path, source, coalesce(text, '') AS text FROM documents),
old AS (SELECT path, sha256(CASE WHEN source = 'src5' THEN text || ' old' ELSE text END) AS sha256 FROM docs WHERE source NOT IN ('src0', 'src1', 'src2')),
new AS (SELECT path, sha256(text) AS sha256 FROM docs WHERE source <> 'src9'),
changed AS (SELECT new.* FROM new LEFT JOIN old ON old.path = new.path AND old.sha256 = new.sha256 WHERE old.path IS NULL),
gone AS (SELECT path FROM old WHERE path NOT IN (SELECT path FROM new))"""

QUERIES = {f.__name__: f for f in (change_scan, deleted_docs, upsert_snapshot, embed_missing, fingerprint, ingest_report, index_header)}
ORACLE_SQL = {
    "change_scan": f"WITH {_STATES} SELECT path, sha256 FROM changed",
    "deleted_docs": f"WITH {_STATES} SELECT path FROM gone",
    "upsert_snapshot": f"WITH {_STATES} SELECT path, sha256 FROM old WHERE path NOT IN (SELECT path FROM changed UNION ALL SELECT path FROM gone) UNION ALL SELECT path, sha256 FROM changed",
    "embed_missing": "SELECT doc_id, concat_ws('/', coalesce(lang, ''), coalesce(source, ''), CAST(doc_id AS VARCHAR)) AS path FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "fingerprint": f"WITH {_STATES} SELECT substr(sha256(string_agg(path || chr(0) || sha256 || chr(0), '' ORDER BY path)), 1, 16) AS fingerprint FROM new",
    "ingest_report": f"WITH {_STATES} SELECT (SELECT count(*) FROM new) AS seen, (SELECT count(*) FROM changed) AS changed, (SELECT count(*) FROM gone) AS deleted, (SELECT count(*) FROM new) - (SELECT count(*) FROM changed) AS unchanged",
    "index_header": "SELECT 'sectionlake index · ' || count(*) || ' documents · ' || CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) || ' sections · corpus 01234567 · summaries: offline · compact; call index(prefix) for summaries' AS header FROM documents",
}
