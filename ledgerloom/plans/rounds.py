"""Written intermediates and rounds of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition, about, where their number follows the input (`partitions`).
SPREAD_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    If it is unset, a local session takes a temporary folder; on a cluster that is an error, since executors don't share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str = "round", by: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, and a lost executor costs no recomputation.

    by: a column with few values, each of which gets a folder, so that readers of one value skip the others.
    """
    path = f"{shared_dir(df.sparkSession)}/ledgerloom/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, each: int = 1) -> int:
    """How many partitions df's rows, or `each` times as many, need at SPREAD_ROWS each; at least the session's number.

    What is repartitioned by that number and then grouped by the same keys takes a memory of a task that doesn't follow the
    input. df is counted for it, which for a Parquet table reads footers only.
    """
    return spread(df.sparkSession, df.select(F.lit(1)).count() * each)


def spread(spark: SparkSession, rows: int) -> int:
    """`partitions` of a known number of rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // SPREAD_ROWS + 1)


def hub_rows() -> int:
    """Rows of one key above which it is dealt to several partitions: a tenth of one, so ten times as many keys as partitions at most."""
    return SPREAD_ROWS // 10


def appended(frames: Iterator[DataFrame], label: str) -> DataFrame:
    """Frames of one schema written one after another into one folder, and read back.

    A generator that makes each frame's broadcast before it yields it, and destroys it afterwards, holds one at a time; the
    plan of what is read back doesn't grow with their number.
    """
    path, first = "", None
    for frame in frames:
        path = path or f"{shared_dir(frame.sparkSession)}/ledgerloom/{label}-{uuid.uuid4().hex}"
        frame.write.mode("append").parquet(path)
        first = first or frame
    if first is None:
        raise ValueError("there is no frame to write")
    return first.sparkSession.read.schema(first.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a written intermediate that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        delete(df.sparkSession, file.rsplit("/", 1)[0])
