"""What several operators of this subpackage share: written tables, distributed order, connected components."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}
#: The tables that each unfinished `settled` of a thread has written so far.
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder and any other master is refused,
    for a machine-local folder loses what other executors wrote.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _scratch:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="sectionlake-")
        _scratch[app] = f"{base.rstrip('/')}/sectionlake-{uuid.uuid4().hex}"
        atexit.register(drop_table, spark, _scratch[app])
    return _scratch[app]


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written folder through Spark's own file system; at the end of a session this may be too late."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session is gone, or the folder is
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if stack := getattr(_scopes, "stack", None):
        stack[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that `build` makes, written; the tables that making it wrote are deleted then."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        made = build()
        own = stack.pop()
        stack.append([])
        out = written(made, name)
    except BaseException:
        stack.pop()
        raise
    kept = stack.pop()
    if stack:
        stack[-1] += kept
    for path in own:
        drop_table(spark, path)
    return out


_files: set[tuple[str, str]] = set()


def ship_file(spark: SparkSession, path: str) -> None:
    """Give the session's executors a file of the driver, such as a vocabulary, once; workers open it by `local_file`."""
    if (key := (spark.sparkContext.applicationId, path)) not in _files:
        spark.sparkContext.addFile(path)
        _files.add(key)


def local_file(path: str) -> str:
    """Where a worker finds a file: at its own path, where that is installed on all machines, else as it was shipped."""
    import os

    from pyspark import SparkFiles

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def text_of(column: str = "text") -> Column:
    """A text column as a string without nulls (null: empty)."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: A key with more than this share of all rows (1 in so many) is dealt over several tasks, so at most so many keys are.
MOST_HOT = 4000


def spread_join(rows: DataFrame, groups: DataFrame, on: str | list[str], size: str, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with `groups` on a key, where no task gets all rows of a key that many have.

    `groups` has a row for each key, with the number of its rows in the column `size`; `total` is at
    least their sum. Keys with more than total / MOST_HOT rows, which are MOST_HOT at most, are
    broadcast with the number of parts they are dealt to: their rows go to a part by the hash of the
    columns `by`, and their group goes to each part. All others have one part. Nothing is left out.
    """
    on = [on] if isinstance(on, str) else on
    share = max(16, total // MOST_HOT)
    parts = F.when(F.col(size) > share, F.ceil(F.col(size) / share)).otherwise(1).cast("int")
    hot = groups.where(F.col(size) > share).select(*on, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), on, "left")
    dealt = dealt.select(*rows.columns, F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part"))
    many = groups.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return dealt.join(many, [*on, "_part"], how).drop("_part")


def in_ranges(rows: DataFrame, key: str, tie: Column, per_range: int = 500, most_ranges: int = 65_536) -> DataFrame:
    """Rows dealt to ranges of a whole-number key, so that each can be ordered by itself and see its successor.

    Ranges are cut at approximate quantiles of the key, about `per_range` rows each (more beyond
    `most_ranges`, which bounds the cuts and what is broadcast). The rows with the first key of a
    range are also sent to the range before it, marked _copy, and those with the first key of all to
    the last range. Ordered by (_copy, _place, _tie) within a _range, each row that isn't a copy is
    followed by its successor in the whole table. Adds _range, _copy, _place (the key; null comes
    first) and _tie. `tie` orders the rows of one key and starts with hexadecimal digits: a key that
    fills more than a range has its rows parted by the first three of them. Rows that are equal in
    key and tie are in one range.
    """
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    n = rows.count()
    parts = max(1, min(most_ranges, n // per_range))
    found: list[int] = []
    if parts > 1:
        found = [int(x) for x in rows.agg(F.percentile_approx(place, [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0]]
    full = sorted(k for k, times in Counter(found).items() if times > 1)
    cuts = sorted({*found, *(k + 1 for k in full)})  # a full key has its range to itself
    number = F.lit(0)
    if cuts:
        bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
        # Bisection: the number of cuts at or below the key.
        steps = F.array(*[F.lit(1 << h) for h in reversed(range(len(cuts).bit_length()))])
        number = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= F.col("_place")), at + step).otherwise(at))
    part = F.when(F.col("_place").isin(full), F.conv(F.substring(F.col("_tie"), 1, 3), 16, 10).cast("long")).otherwise(F.lit(0)) if full else F.lit(0)
    placed = rows.withColumn("_place", place).withColumn("_tie", tie.cast("string"))
    placed = placed.withColumn("_part", part.cast("long")).withColumn("_range", number * F.lit(4096).cast("long") + F.col("_part"))
    heads = sorted((int(r[0]), int(r[1].p), int(r[1].q)) for r in placed.groupBy("_range").agg(F.min(F.struct(F.col("_place").alias("p"), F.col("_part").alias("q")))).collect())  # a row for each range
    before = [(p, q, heads[i - 1][0]) for i, (_, p, q) in enumerate(heads)]
    spark = rows.sparkSession
    sent = F.broadcast(spark.createDataFrame(before, "_place long, _part long, _before long"))
    both = placed.join(sent, ["_place", "_part"], "left")
    to = F.filter(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("c")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("c"))), lambda x: x["r"].isNotNull())
    return both.withColumn("_to", F.explode(to)).select(*rows.columns, F.col("_to.r").alias("_range"), F.col("_to.c").alias("_copy"), "_place", "_tie")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links: (node, component), component the smallest node of it.

    Alternating star contractions: in each round every node's larger neighbours are hung onto its
    smallest one, then its smaller neighbours are. Each round is two aggregations and two joins over
    the links that are left, where nodes with many neighbours, if there are any, are dealt over
    several tasks; its result is written. The rounds end when every node that hangs on another hangs
    on one alone that hangs on none. Nothing is collected but three numbers of a round. Nodes without
    links don't appear.
    """
    links = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most_rounds):
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
        nodes = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
        open_ = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("n") > F.col("up")))
        state = nodes.agg(F.count_if(open_).alias("open"), F.sum("up").alias("n"), F.max("n").alias("most")).first()
        if not state["open"]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
        total = 2 * state["n"]

        def onto(rows: DataFrame, least: DataFrame, hot: bool = state["most"] > total // MOST_HOT, total: int = total) -> DataFrame:
            return spread_join(rows, least, "u", "n", total, ["v"]) if hot else rows.join(least, "u")

        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = onto(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = onto(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m")))
        links = written(small.where("u <> v").distinct(), "links")
    raise RuntimeError("the links didn't settle")
