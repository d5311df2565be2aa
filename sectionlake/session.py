"""Session defaults for local runs, and how the engine opens the tables of a folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sectionlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; the path goes to Spark's reader alone, so any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, bytes_each: int = 8 << 20) -> DataFrame:
    """A small table of fewer files than cores dealt out to all cores; a larger one as its files lie, without a shuffle.

    A Parquet file with one row group is one task otherwise, whatever is computed for its rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_each and len(df.inputFiles()) < cores else df


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, below spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder and any other master is refused,
    for a machine-local folder loses what other executors wrote.
    """
    context = spark.sparkContext
    if context.applicationId not in _scratch:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="sectionlake-")
        _scratch[context.applicationId] = f"{base.rstrip('/')}/sectionlake-{uuid.uuid4().hex}"
    return _scratch[context.applicationId]


_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the session's executors this package, once; operators with Python workers call it first."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sectionlake-"), "sectionlake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(top.rglob("*.py")):
            out.write(module, module.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
