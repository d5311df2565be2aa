"""Retrieval quality and cost over tables of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen(ranked: DataFrame, k: int) -> DataFrame:
    """qid, rank, id: the first k different ids of each query in the order of `position`."""
    once = ranked.groupBy("qid", "id").agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("position", "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "id")


def quality(retrieved: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """qid, shape, recall, mrr and ndcg (null without a hit) at k of each query in `gold` (qid, id, shape).

    recall is 1 if any gold id is among the first k; ndcg is that of binary relevance.
    """
    hits = retrieved.where(F.col("rank") <= k).join(gold, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = gold.groupBy("qid", "shape").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    scored = wanted.join(hits, "qid", "left")
    return scored.select("qid", "shape", F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"))


def by_shape(scores: DataFrame) -> DataFrame:
    """Means by query shape, and over all (shape 'overall')."""
    agg = [F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")]]
    return scores.groupBy("shape").agg(*agg).unionByName(scores.agg(*agg).withColumn("shape", F.lit("overall")))


def nearest_rank(values: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """p50, p95 and max of each group by the nearest rank: the floor(p * n)-th value, from 0.

    Ranks come from counts of equal values, so that a group's values are never held as a list.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(group))
    ranked = counted.select(group, value, upto.alias("_upto"), total.alias("_total"))
    picks = [F.min(F.when(F.col("_upto") > F.floor(F.col("_total") * p), F.col(value))).alias(f"p{round(100 * p)}") for p in shares]
    return ranked.groupBy(group).agg(*picks, F.max(value).alias("max"))


def run_totals(runs: DataFrame, usd_per_million: float = 0.0) -> DataFrame:
    """Of runs (qid, tokens, turns, calls: map of tool to number, reads): sums, means, cost and the tools' calls, a row for each tool."""
    base = runs.agg(
        F.count("*").alias("queries"), F.sum("tokens").alias("tokens"), F.sum("turns").alias("turns"), F.round(F.sum("tokens") * usd_per_million / 1e6, 6).alias("usd"),
        F.round(F.avg("reads"), 6).alias("reads_per_query"), F.count_if(F.col("reads") == 0).alias("without_reading"),
    )
    tools = runs.select(F.explode("calls").alias("tool", "n")).groupBy("tool").agg(F.sum("n").alias("calls"))
    return tools.join(F.broadcast(base), F.lit(True))  # `base` is one row
