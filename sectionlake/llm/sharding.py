"""Shards by extendible hashing: a directory of hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.llm.common import text_of, written

BITS = 60


def _bits(parts: list) -> F.Column:
    """The first 60 bits of an MD5 as a string of 0 and 1."""
    digest = F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, BITS // 4)
    return F.lpad(F.conv(digest, 16, 2), BITS, "0")


def extendible_shards(df: DataFrame, key: str = "doc_id", size: str | None = None, text: str = "text", limit_bytes: int = 64 << 20) -> DataFrame:
    """Give every row the shard of its hash prefix, all shards within `limit_bytes` where rows allow it.

    The hash of a row is 60 bits of MD5 over its key. A bucket above the limit splits on its next
    bit, alone; the directory's depth is that of its deepest bucket. The sizes of all prefixes come
    from one aggregation at a depth that suits the total, then from further ones over the oversized
    buckets only, so each pass moves sums, never texts. What 60 bits can't part is one key (repeated
    rows): its bucket is split on by 60 bits more, over the row's other columns. Only rows that are
    equal in all columns, or one row above the limit, leave a bucket above it; `over_limit` says so.

    Adds: n_bytes (UTF-8 length of `text`, or the column `size`), shard (prefix bits; '' is the whole
    table), depth, shard_bytes, over_limit. Null keys hash as 'null', null texts have 0 bytes; an
    empty table gives no rows. Columns of these names in the input are replaced.
    """
    added = ["n_bytes", "shard", "depth", "shard_bytes", "over_limit"]
    n_bytes = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else F.octet_length(text_of(text)).cast("long")
    others = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c, kind in df.dtypes if c != key and c not in added and not kind.startswith(("map", "array", "struct", "variant"))]
    own = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    kept = [c for c in df.columns if c not in added]
    row = F.struct(*kept) if kept else F.lit(None).cast("struct<x:int>")
    base = df.select(row.alias("_row"), n_bytes.alias("n_bytes"), _bits([own]).alias("_bits"), F.concat_ws("\x1f", own, *others).alias("_whole"))
    total, rows = base.agg(F.sum("n_bytes"), F.count("*")).first()
    start = max(0, ((total or 0) // max(limit_bytes, 1)).bit_length() + 2) if rows else 0

    def census(rows_df: DataFrame, depth: int) -> DataFrame:
        return rows_df.groupBy(F.substring("_bits", 1, depth).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))

    def leaves(cells: DataFrame, low: int, high: int) -> DataFrame:
        """Of cells at depth `high`: the shallowest prefixes, from depth `low`, within the limit."""
        levels = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        sums = cells.select("prefix", "bytes", "n", levels).groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"), ((F.col("bytes") > limit_bytes) & (F.col("n") > 1)).alias("parted"))
        tree = sums.withColumn("parent", F.expr("substring(shard, 1, depth - 1)")).join(parents, ["depth", "parent"], "left")
        reached = (F.col("depth") == low) | F.col("parted")
        whole = (F.col("bytes") <= limit_bytes) | (F.col("n") == 1) | (F.col("depth") == high)
        return tree.where(reached & whole).select("shard", "depth", "bytes", "n")

    step, low, high = 8, 0, min(BITS, start)
    directory = written(leaves(census(base, high), low, high), "directory")
    bits = base
    while high < 2 * BITS:
        large = directory.where((F.col("bytes") > limit_bytes) & (F.col("depth") == high) & (F.col("n") > 1))
        if large.isEmpty():
            break
        if high == BITS:  # one key fills the bucket: the other columns part its rows
            bits = base.withColumn("_bits", F.concat("_bits", _bits([F.col("_whole")])))
        low, high = high, min(high + step, BITS if high < BITS else 2 * BITS)
        within = bits.withColumn("shard", F.substring("_bits", 1, low)).join(large.select("shard"), "shard", "left_semi")
        deeper = leaves(census(within, high), low, high).where(F.col("depth") > low)
        directory = written(directory.join(large.select("shard"), "shard", "left_anti").unionByName(deeper), "directory")
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # at most 120 numbers
    # A row's shard is the one prefix of its bits that the directory holds; depths are few.
    prefixes = F.array(*[F.substring("_bits", 1, d) for d in depths]) if depths else F.array(F.lit(""))
    rows_df = bits.select("_row", "n_bytes", "_bits")
    sized = directory.select("shard", F.col("depth").cast("int").alias("depth"), F.col("bytes").alias("shard_bytes"))
    entries = F.broadcast(sized) if directory.count() <= 200_000 else sized  # 60 bytes an entry: 12 MB at most
    out = rows_df.withColumn("shard", F.explode(prefixes)).join(entries, "shard")
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "n_bytes", "shard", "depth", "shard_bytes", (F.col("shard_bytes") > limit_bytes).alias("over_limit"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard as a folder of its own, rows of a shard together."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


#: Of the query: small enough that the tables of the tests split too. Files of object stores want some hundred times as much.
LIMIT_BYTES = 256 << 10


def op3_extendible_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return extendible_shards(docs, limit_bytes=LIMIT_BYTES).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "over_limit")


OP3_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         lpad(format('{{:b}}', CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT)), {BITS}, '0') AS bits
  FROM documents),
tree AS (
  SELECT doc_id, n_bytes, bits, 0 AS depth, sum(n_bytes) OVER () AS shard_bytes, count(*) OVER () AS n FROM docs
  UNION ALL
  SELECT doc_id, n_bytes, bits, depth + 1,
         sum(n_bytes) OVER (PARTITION BY substr(bits, 1, depth + 1)), count(*) OVER (PARTITION BY substr(bits, 1, depth + 1))
  FROM tree WHERE shard_bytes > {LIMIT_BYTES} AND n > 1 AND depth < {BITS})
SELECT doc_id, n_bytes, substr(bits, 1, depth) AS shard, CAST(depth AS INTEGER) AS depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {LIMIT_BYTES} AS over_limit
FROM tree WHERE NOT (shard_bytes > {LIMIT_BYTES} AND n > 1 AND depth < {BITS})
"""

QUERIES = {"op3_extendible_shards": op3_extendible_shards}
ORACLE_SQL = {"op3_extendible_shards": OP3_SQL}
