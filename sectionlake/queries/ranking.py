"""Dense ranking, fusion and retrieval quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.functions import scoring
from sectionlake.operators import dense, evaluation
from sectionlake.queries import common as c
from sectionlake.queries import lexical as words
from sectionlake.session import table


def _query_vector(vectors: DataFrame) -> list[float]:
    """The vector of the smallest id, as the query."""
    return [float(x) for x in vectors.orderBy("vec_id").select("embedding").first()[0]]


def dense_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    best = dense.dense_top(vectors, _query_vector(vectors), 40, "vec_id", "embedding")
    return best.select("vec_id", "rank", F.round("similarity", 6).alias("similarity"))


def dense_normalise(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    one = scoring.unit(scaled)
    return vectors.select("vec_id", F.round(scoring.dot(one, one), 6).alias("size"), F.round(F.get(one, F.lit(0)), 6).alias("first"))


def hybrid_rrf(spark, sf_dir: str) -> DataFrame:
    """A lexical ranking of documents fused with the dense ranking of the vectors of the same number."""
    hits = words.lexical.top(_lexical(spark, sf_dir), 10)
    ranked = hits.select("id", F.expr("row_number() OVER (ORDER BY tier, score DESC, id)").alias("rank"))  # over ten rows
    vectors = table(spark, sf_dir, "embeddings")
    near = dense.dense_top(vectors, _query_vector(vectors), 40, "vec_id", "embedding")
    ids = table(spark, sf_dir, "documents").select("doc_id", F.concat(c.paths(), F.lit("#0")).alias("id"))
    near = ids.join(F.broadcast(near), F.col("doc_id") == F.col("vec_id")).select("id", "rank")  # 40 rows
    return dense.fuse([ranked, near], "id", 10).select("id", F.round(100 * F.col("score"), 6).alias("score"))


def _lexical(spark, sf_dir: str) -> DataFrame:
    return words.lexical.search_sections(c.document_sections(spark, sf_dir), words.lexical.words_of(words.RARE))


def _runs(spark, sf_dir: str) -> DataFrame:
    """Each vector's label as a query, answered by documents in an order that is given by remainders."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    shape = F.element_at(F.array(F.lit("conceptual"), F.lit("table"), F.lit("comparison")), (F.col("doc_id") % 3 + 1).cast("int"))
    return labels.select(F.col("doc_id").alias("qid"), shape.alias("shape"), (F.col("doc_id") % 7).alias("shift"))


def eval_quality(spark, sf_dir: str) -> DataFrame:
    """Quality at 5 where a query's gold ids are its number and the next, and its answer starts some numbers before."""
    runs = _runs(spark, sf_dir)
    gold = runs.select("qid", F.explode(F.array(F.col("qid"), F.col("qid") + 1)).alias("id"), "shape")
    answers = runs.select("qid", F.posexplode(F.sequence(F.col("qid") - F.col("shift"), F.col("qid") - F.col("shift") + 5)).alias("position", "id"))
    return evaluation.by_shape(evaluation.quality(evaluation.first_seen(answers, 5), gold, 5))


def first_seen_ids(spark, sf_dir: str) -> DataFrame:
    """Of each user's events by time: the first three different kinds."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("id"), F.col("event_id").alias("position"))
    return evaluation.first_seen(events, 3)


def latency_percentiles(spark, sf_dir: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value")


def run_totals(spark, sf_dir: str) -> DataFrame:
    """Calls, tokens, turns, reads and cost of runs: a run is a user, each kind of event a tool and a turn."""
    events = table(spark, sf_dir, "events")
    per = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    runs = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("calls"), F.sum("n").alias("tokens"), F.count("*").alias("turns"), F.coalesce(F.sum(F.when(F.col("event_type") == "click", F.col("n"))), F.lit(0)).alias("reads"))
    return evaluation.run_totals(runs.withColumnRenamed("user_id", "qid"), 2.5)


_DOT = lambda a, b: f"list_sum(list_transform(range(len({a})), lambda i: {a}[i + 1]::DOUBLE * {b}[i + 1]::DOUBLE))"
_NEAR = f"""near AS (SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM (
  SELECT e.vec_id, round({_DOT('e.embedding', 'q.embedding')}, 9) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q)
  ORDER BY similarity DESC, vec_id LIMIT 40)"""

QUERIES = {f.__name__: f for f in (dense_topk, dense_normalise, hybrid_rrf, eval_quality, first_seen_ids, latency_percentiles, run_totals)}
ORACLE_SQL = {
    "dense_topk": f"WITH {_NEAR} SELECT vec_id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM near",
    "dense_normalise": f"WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt({_DOT('v', 'v')})) AS v FROM s) SELECT vec_id, round({_DOT('v', 'v')}, 6) AS size, round(v[1], 6) AS first FROM u",
    "hybrid_rrf": words._scores_sql(words.RARE) + f""",
words AS (SELECT id, row_number() OVER (ORDER BY tier, score DESC, id) AS rank FROM scored ORDER BY tier, score DESC, id LIMIT 10), {_NEAR},
shares AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS share FROM words UNION ALL
  SELECT concat_ws('/', coalesce(lang, ''), coalesce(source, ''), CAST(doc_id AS VARCHAR)) || '#0', 1.0::DOUBLE / (60 + rank) FROM near JOIN documents ON doc_id = vec_id)
SELECT id, round(100 * score, 6) AS score FROM (SELECT id, round(sum(share), 12) AS score FROM shares GROUP BY id) ORDER BY score DESC, id LIMIT 10""",
    "eval_quality": """WITH runs AS (SELECT doc_id AS qid, ['conceptual', 'table', 'comparison'][doc_id % 3 + 1] AS shape, doc_id % 7 AS shift FROM labels),
hits AS (SELECT qid, shape, list_filter(range(1, 6), lambda r: qid - shift + r - 1 IN (qid, qid + 1)) AS ranks FROM runs),
q AS (SELECT qid, shape, CASE WHEN len(ranks) > 0 THEN 1.0 ELSE 0.0 END AS recall, coalesce(1.0 / ranks[1], 0.0) AS mrr,
  list_sum(list_transform(ranks, lambda r: 1.0::DOUBLE / log2(r + 1))) / (1 + 1.0::DOUBLE / log2(3)) AS ndcg FROM hits)
SELECT shape, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM q GROUP BY shape
UNION ALL SELECT 'overall', count(*), round(avg(recall), 6), round(avg(mrr), 6), round(avg(ndcg), 6) FROM q""",
    "first_seen_ids": "SELECT qid, CAST(rank AS INTEGER) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY position, id) AS rank FROM (SELECT user_id AS qid, event_type AS id, min(event_id) AS position FROM events GROUP BY ALL)) WHERE rank <= 3",
    "latency_percentiles": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, v[CAST(floor(len(v) * 0.5) AS INTEGER) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS INTEGER) + 1] AS p95, v[-1] AS max FROM l",
    "run_totals": """WITH per AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
runs AS (SELECT user_id, sum(n) AS tokens, count(*) AS turns, coalesce(sum(n) FILTER (event_type = 'click'), 0) AS reads FROM per GROUP BY user_id),
base AS (SELECT count(*) AS queries, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(turns) AS BIGINT) AS turns, round(CAST(sum(tokens) AS DOUBLE) * 2.5 / 1e6, 6) AS usd, round(avg(reads), 6) AS reads_per_query, count(*) FILTER (reads = 0) AS without_reading FROM runs)
SELECT event_type AS tool, CAST(sum(n) AS BIGINT) AS calls, queries, tokens, turns, usd, reads_per_query, without_reading FROM per, base GROUP BY ALL""",
}
