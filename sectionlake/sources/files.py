"""Corpus discovery, and files or table rows to documents with sections."""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionlake.session import ship_package
from sectionlake.sources import pdf
from sectionlake.sources.blocks import Document
from sectionlake.sources.markdown import parse_markdown, parse_plain
from sectionlake.sources.office import parse_office
from sectionlake.sources.sections import Limits, sectionize

IGNORE_FILE = ".sectionlakeignore"
#: Fixed suffixes and the kinds of documents that they name.
TEXT_KINDS = {".md": "markdown", ".markdown": "markdown", ".txt": "text"}
OFFICE_KINDS = {".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx"}

FILES = "path string, uri string, kind string"
PARSED = (
    "path string, kind string, sha256 string, bytes long, title string, error string, "
    "sections array<struct<ordinal:int,heading_path:string,level:int,kind:string,text:string>>"
)


def kinds() -> dict[str, str]:
    """Suffixes that can be read here."""
    return TEXT_KINDS | OFFICE_KINDS | ({".pdf": "pdf"} if pdf.available() else {})


def ignored(path: str, patterns: list[str]) -> bool:
    return any(fnmatch.fnmatch(path, p) or path.startswith(p.rstrip("/") + "/") for p in patterns)


def ignore_patterns(text: str) -> list[str]:
    return [line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")]


def wanted(path: str, known: dict[str, str], patterns: list[str]) -> str | None:
    """The kind of a path below the root, or None: hidden, of no known kind, or ignored."""
    if any(part.startswith(".") for part in path.split("/")) or ignored(path, patterns):
        return None
    return known.get(PurePosixPath(path).suffix.lower())


def listed(spark: SparkSession, root: str) -> Iterator[tuple[str, str]]:
    """(path below root, URI) of every file, by the Hadoop file system of the URI: any store, and no name is special."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top) or not fs.getFileStatus(top).isDirectory():
        raise FileNotFoundError(f"{root} is not a folder (supported files: {', '.join(sorted(kinds()))})")
    top = fs.resolvePath(top)
    base = top.toUri().getPath().rstrip("/") + "/"
    found = fs.listFiles(top, True)
    while found.hasNext():
        where = found.next().getPath()
        yield where.toUri().getPath().removeprefix(base), where.toString()


def file_system(uri: str):
    """(Arrow file system, path) of a URI. The Hadoop names of a store stand for Arrow's: s3a and s3n for s3, abfss for abfs."""
    from pyarrow import fs

    scheme, apart, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}.get(scheme, scheme) if apart else ""
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{rest}" if apart else uri)


def read_bytes(uri: str) -> bytes:
    """A file's bytes on a worker, by the Arrow file system of its URI."""
    system, path = file_system(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


#: Schemes that workers can read by Arrow; files of any other store come through Spark's own reader.
ARROW_SCHEMES = ("file", "s3", "s3a", "s3n", "gs", "gcs", "hdfs", "abfs", "abfss")


def with_bytes(files: DataFrame) -> DataFrame:
    """Files (path, uri, kind) with a column `data`: their bytes where only Spark's reader reaches their store, else null.

    One file system's files have one scheme, that of the first row. Bytes are read by tasks, a file in a row.
    """
    first = files.select("uri").first()
    scheme = (first[0] or "").partition(":")[0] if first and first[0] else "file"
    if scheme in ARROW_SCHEMES:
        return files.withColumn("data", F.lit(None).cast("binary"))
    folder = files.select(F.regexp_extract("uri", "^(.*)/[^/]*$", 1).alias("d")).distinct()
    folders = [r[0] for r in folder.limit(MOST_FOLDERS + 1).collect()]
    if len(folders) > MOST_FOLDERS:
        raise OSError(f"more than {MOST_FOLDERS} folders in a store that only Spark reads")
    read = files.sparkSession.read.format("binaryFile").load(folders).select(F.col("path").alias("uri"), F.col("content").alias("data"))
    return files.join(read, "uri", "left").select(*files.columns, "data")


MOST_FOLDERS = 10_000


def driver_text(spark: SparkSession, uri: str) -> str:
    """A small file's text, on the driver, through the Hadoop file system of its URI."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(uri)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def discover(spark: SparkSession, root: str, ignore: Iterable[str] = ()) -> DataFrame:
    """path, uri and kind of the files to read, from a listing made on the driver (names only)."""
    every = list(listed(spark, root))
    patterns = list(ignore)
    for path, uri in every:
        if path == IGNORE_FILE:
            patterns += ignore_patterns(driver_text(spark, uri))
    known = kinds()
    rows = sorted((path, uri, kind) for path, uri in every if (kind := wanted(path, known, patterns)))
    n = max(1, min(len(rows), 8 * spark.sparkContext.defaultParallelism, 1 + len(rows) // 16))
    return spark.createDataFrame(rows, FILES).repartition(n, "path")


def parse_bytes(data: bytes, kind: str, stem: str, limits: Limits | None = None) -> Document:
    if kind == "pdf":
        return pdf.parse_pdf(data, stem)
    if kind in OFFICE_KINDS.values():
        return parse_office(data, kind, stem, limits.sheet_rows if limits else None)
    return (parse_markdown if kind == "markdown" else parse_plain)(data.decode("utf-8", "replace"), stem)


def _parsed(path: str, kind: str, data: bytes, limits: Limits) -> dict:
    row = {"path": path, "kind": kind, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "title": None, "error": None, "sections": []}
    stem = PurePosixPath(path).stem
    try:
        document = parse_bytes(data, kind, stem, limits)
        row["sections"] = [s._asdict() for s in sectionize(document, limits)]
        row["title"] = document.title or stem
        if not row["sections"]:
            row["error"] = "no content"
    except Exception as e:  # noqa: BLE001 - a bad file is reported, and never ends the run
        row["error"] = f"parse error: {e}"
    return row


_SECTION = pa.struct([("ordinal", pa.int32()), ("heading_path", pa.string()), ("level", pa.int32()), ("kind", pa.string()), ("text", pa.string())])
_PARSED = pa.schema([("path", pa.string()), ("kind", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64()), ("title", pa.string()), ("error", pa.string()), ("sections", pa.list_(_SECTION))])


def hash_files(files: DataFrame) -> DataFrame:
    """path, uri, kind, sha256 and error (why a file couldn't be read)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = row.pop("data")
                try:
                    told = (hashlib.sha256(read_bytes(row["uri"]) if data is None else data).hexdigest(), None)
                except Exception as e:  # noqa: BLE001 - whatever one file's store says is that file's error alone
                    told = (None, f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_pylist([row | {"sha256": told[0], "error": told[1]}], pa.schema([("path", pa.string()), ("uri", pa.string()), ("kind", pa.string()), ("sha256", pa.string()), ("error", pa.string())]))

    ship_package(files.sparkSession)
    return with_bytes(files.select("path", "uri", "kind")).mapInArrow(run, FILES + ", sha256 string, error string")


def parse_files(files: DataFrame, limits: Limits) -> DataFrame:
    """A row for each file of (path, uri, kind): its hash, title and sections, or why there are none."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    done = _parsed(row["path"], row["kind"], read_bytes(row["uri"]) if row["data"] is None else row["data"], limits)
                except Exception as e:  # noqa: BLE001 - as above
                    done = {"path": row["path"], "kind": row["kind"], "sections": [], "error": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([done], _PARSED)

    ship_package(files.sparkSession)
    return with_bytes(files.select("path", "uri", "kind")).mapInArrow(run, PARSED)


def parse_table(rows: DataFrame, limits: Limits, path: str = "path", text: str = "text", kind: str = "text") -> DataFrame:
    """The same for rows that hold their text themselves."""

    def run(batches):
        for batch in batches:
            for where, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist([_parsed(where, kind, (body or "").encode("utf-8", "surrogatepass"), limits)], _PARSED)

    ship_package(rows.sparkSession)
    return rows.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text")).mapInArrow(run, PARSED)


def settings(limits: Limits) -> str:
    """The sectioning settings as text: documents sectioned under others are read anew."""
    return json.dumps(vars(limits), sort_keys=True)
