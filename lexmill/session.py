"""Sessions and what their Python workers need."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever they run; once for each context."""
    context = spark.sparkContext
    if getattr(context, "_has_lexmill", False):
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="lexmill-package-")) / "lexmill.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(to))
    context._has_lexmill = True


_made: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only where none is set and all is on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a Parquet table in the shared folder: its lineage ends here, and its size is known to the optimizer."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(to)
    _made[-1].append(to)
    return spark.read.schema(df.schema).parquet(to)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that :func:`cut` makes inside are removed at the end."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def clean_up(spark: SparkSession) -> int:
    """Removes all tables that :func:`cut` made in this process and has kept so far; how many those were."""
    paths = [p for level in _made for p in level]
    for level in _made:
        level.clear()
    for path in paths:
        remove(spark, path)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than those; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
