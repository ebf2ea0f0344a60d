"""Session settings and tables shared between the steps of one job."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "folioscope", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver loaded it from. Done once per session."""
    context = spark.sparkContext
    if any(Path(str(name)).name.startswith("folioscope-package") for name in context._python_includes or ()):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="folioscope-")) / f"folioscope-package-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables; only a local session gets one of its own.

    The folder of a local session goes with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.TemporaryDirectory(prefix="folioscope-")
    return _LOCAL_FOLDERS[context.applicationId].name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, for plans that need the same rows more than once.

    Task retries and lost executors are covered by the commit protocol of the write; the read has no lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
