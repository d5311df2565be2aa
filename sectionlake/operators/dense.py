"""Dense ranking by dot product, and fusion of rankings by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sectionlake.functions import scoring


def dense_top(vectors: DataFrame, query: list[float], depth: int, key: str = "section_id", vector: str = "vec") -> DataFrame:
    """The nearest rows: key, rank (1 first) and similarity. A scan with a top-k, nothing else moves."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(F.col(key), F.round(scoring.dot(F.col(vector), q), 9).alias("similarity")).orderBy(F.desc("similarity"), key).limit(depth)
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), key))  # over `depth` rows
    return best.withColumn("rank", rank)


def fuse(rankings: list[DataFrame], key: str, limit: int) -> DataFrame:
    """key and fused score of rankings with (key, rank): the first `limit` by score, then key."""
    each = [r.select(key, scoring.reciprocal_rank(F.col("rank")).alias("share")) for r in rankings]
    every = each[0]
    for more in each[1:]:
        every = every.unionByName(more)
    return every.groupBy(key).agg(F.round(F.sum("share"), 12).alias("score")).orderBy(F.desc("score"), key).limit(limit)
