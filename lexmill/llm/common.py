"""What the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: its lineage ends here and lost executors don't matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    """How many words a text has, as a long; null has none."""
    words = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(words, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def batched(df: DataFrame) -> DataFrame:
    """``df`` in a session that hands texts to Python in small batches, unless it names a batch size itself: whole texts
    are large, and a worker holds a batch several times over."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` computed once as a Parquet table in the shared folder, a fraction of a checkpoint's size, and what removes it."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(to)

    def remove() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(to), remove


def bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """``df``, in ``buckets`` partitions by hash of ``key`` and sorted by it, as a table in the shared folder that joins on ``key`` without a shuffle, of columns of too many values for dictionaries; and what removes it."""
    spark = df.sparkSession
    name, to = f"t_{uuid.uuid4().hex}", f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", to).option("parquet.enable.dictionary", "false").saveAsTable(name)

    def remove() -> None:
        spark.sql(f"drop table if exists {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.table(name), remove
