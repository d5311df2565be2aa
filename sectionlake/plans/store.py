"""Snapshots of a corpus: immutable Parquet folders and a manifest that names the present one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"
MANIFEST = "MANIFEST.json"

DOCUMENTS = (
    "doc_id bigint, path string, title string, summary string, summary_src string, sha256 string, bytes bigint, kind string, "
    "n_sections int, settings string, ingested_at timestamp"
)
SECTIONS = "id string, doc_id bigint, path string, ordinal int, heading_path string, level int, kind string, text string, char_len int, hash string, prev_id string, next_id string, segment int"
POSTINGS = "term string, id string, path string, length int, heading_at array<int>, text_at array<int>, segment int"
TERMS = "term string, df bigint"
EMBEDDINGS = "section_id string, model string, dim int, vec array<float>"
#: Of documents that were replaced or deleted since the last compaction: their rows in segments before this one are dead.
DEAD = "path string, before int"
SUMMARIES = "sha256 string, model string, summary string"
TABLES = {"documents": DOCUMENTS, "sections": SECTIONS, "postings": POSTINGS, "terms": TERMS, "embeddings": EMBEDDINGS, "summaries": SUMMARIES, "dead": DEAD}
#: Tables that an ingest adds a segment to; the others are written whole, with a row for each document at most.
SEGMENTED = ("sections", "postings", "terms")
#: More dead paths than this are joined by a shuffle, not broadcast.
MOST_BROADCAST = 1_000_000


class StoreError(ValueError):
    """A folder that can't be opened as a store."""


class Files:
    """A few file operations of any store that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.path(*names))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside the file, then rename over it: readers see the old text or the new one."""
        aside = f".{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf) if "://" in self.root else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(self.path(aside)), context.makeQualified(self.path(name)), options)

    def drop(self, *names: str) -> None:
        self.fs.delete(self.path(*names), True)

    def folders(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.path()) if x.isDirectory()]


class Snapshot:
    """One immutable state of a store. Its tables are read when asked for."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), manifest

    @property
    def meta(self) -> dict[str, str]:
        return self.manifest["meta"]

    @property
    def n_sections(self) -> int:
        return self.manifest["sections"]

    @property
    def mean_length(self) -> float:
        """Mean tokens of a section."""
        return self.manifest["tokens"] / max(1, self.manifest["sections"])

    def counts(self) -> tuple[int, int]:
        return self.manifest["documents"], self.manifest["sections"]

    def segments(self, name: str) -> list[str]:
        """The folders of a table, oldest first."""
        at = self.manifest["tables"].get(name, [])
        return [at] if isinstance(at, str) else list(at)

    def table(self, name: str) -> DataFrame:
        """A table's live rows. Filters on its columns reach the files of every segment."""
        folders = self.segments(name)
        if not folders:
            rows = self.spark.createDataFrame([], TABLES[name])
        else:
            rows = self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{at}" for at in folders])
        if name == "terms":  # segments hold what each ingest added and took away
            return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        if name not in SEGMENTED:
            return rows
        if "dead" in self.manifest["tables"]:
            dead = self.table("dead").select(F.col("path").alias("_path"), "before")
            dead = F.broadcast(dead) if self.manifest.get("dead", 0) <= MOST_BROADCAST else dead
            rows = rows.join(dead, (F.col("path") == F.col("_path")) & (F.coalesce("segment", F.lit(0)) < F.col("before")), "left_anti")
        return rows.drop("segment")


def open_store(spark: SparkSession, root: str) -> Snapshot:
    """The present snapshot; refuses what is no store and other major versions of the format."""
    files = Files(spark, root)
    if not files.exists():
        raise StoreError(f"{root} doesn't exist; ingest a corpus into it first")
    if not files.exists(MANIFEST):
        raise StoreError(f"{root} is no store: it has no {MANIFEST}")
    try:
        manifest = json.loads(files.read(MANIFEST))
        version = manifest["meta"]["schema_version"]
    except (ValueError, KeyError, TypeError) as e:
        raise StoreError(f"{root} has no schema_version") from e
    if version.split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        raise StoreError(f"{root} has format {version}; this reads {SCHEMA_VERSION.split('.')[0]}.x")
    return Snapshot(spark, root, manifest)


def commit(spark: SparkSession, root: str, manifest: dict, keep: int = 2) -> Snapshot:
    """Make a manifest the present one, and drop the folders of snapshots older than the last `keep`."""
    files = Files(spark, root)
    files.replace(MANIFEST, json.dumps(manifest, indent=1, ensure_ascii=False))
    now = Snapshot(spark, root, manifest)
    used = {at.split("/")[0] for name in manifest["tables"] for at in now.segments(name)} | {f"snap-{manifest['snapshot'] - i}" for i in range(keep)}
    for folder in files.folders():
        if folder.startswith("snap-") and folder not in used:
            files.drop(folder)
    return now
