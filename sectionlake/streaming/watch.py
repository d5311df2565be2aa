"""A folder or table watched by Structured Streaming: every micro-batch goes through the incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sectionlake.plans import store
from sectionlake.plans.ingest import Report, ingest, ingest_table
from sectionlake.sources.sections import Limits


def watch_folder(spark: SparkSession, corpus: str, root: str, checkpoint: str, limits: Limits | None = None, reports: list[Report] | None = None, **trigger) -> StreamingQuery:
    """Ingest whenever files arrive below `corpus`. Default trigger: what is there now, then stop.

    The stream only tells that something came; the ingest lists the folder, so that changed and
    vanished files count too. A batch that is run again changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        report = ingest(batch.sparkSession, corpus, root, limits=limits)
        if reports is not None:
            reports.append(report)

    arrivals = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(corpus).select("path", "modificationTime")
    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch_table(rows: DataFrame, root: str, checkpoint: str, path: str = "path", body: str = "text", limits: Limits | None = None, **trigger) -> StreamingQuery:
    """Upsert a stream of (path, text) rows: within a batch the last text of a path by `version` counts, if there is one."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = F.struct(F.col("version"), F.col(body)) if "version" in batch.columns else F.struct(F.col(body))
        newest = batch.groupBy(F.col(path).alias("path")).agg(F.max_by(F.col(body), order).alias("text"))
        if store.Files(spark, root).exists(store.MANIFEST):
            known = store.open_store(spark, root).table("documents").select("path", "sha256", "settings")
            ingest_table(spark, newest, root, limits=limits, carry=known)
        else:
            ingest_table(spark, newest, root, limits=limits)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
