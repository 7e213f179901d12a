"""Cut lineage by a table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: A table of more rows is never broadcast: the planner knows only its compressed files, of which 10 MB can hold some million keys.
SMALL = 50_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset on a local master."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom-{name}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    return large(rows) if rows.count() > SMALL else rows


def large(df: DataFrame) -> DataFrame:
    """The same rows, whose joins are by sorted shuffles whatever the size of the files suggests (a hint, which holds up to the next join or union)."""
    return df.hint("merge")
