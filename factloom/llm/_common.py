"""Helpers shared by the operators: the shared folder, cut lineage, names, sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom._ship import ship

#: Bytes of an Arrow batch on its way to a Python worker; a count of rows alone would not bound long texts.
BATCH_BYTES = 4 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset on a local master
    (tests) is a folder of our own made, once for each session; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` in the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*cols: Column) -> Column:
    """128 bits of SHA-256 over the columns: equal for equal rows, else different."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols]
    return F.unhex(F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32))


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def _bounded(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _give_back() -> None:
    """Return freed memory to the system, since workers wait for their next task beside stages that run in the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow``, with this package sent to the workers and batches of at most ``BATCH_BYTES``."""
    _bounded(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(each, schema)


def arrow_column(spark: SparkSession, run, kind, *cols: Column) -> Column:
    """A column made by Python from ``cols`` alone; the other columns of the row stay in the JVM.

    ``run``: an iterator of tuples of arrays to an iterator of arrays as long. It runs once, where the column is made.
    """
    _bounded(spark)

    def each(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from run((b,) if isinstance(b, pa.Array) else b for b in batches)
        _give_back()

    one: type = Iterator[pa.Array] if len(cols) == 1 else Iterator[tuple[(pa.Array,) * len(cols)]]
    each.__annotations__ = {"batches": one, "return": Iterator[pa.Array]}
    return F.arrow_udf(each, kind).asNondeterministic()(*cols)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` with the one row of their group; ``n``: rows of the group, of ``total``.

    Groups of a thousandth of all rows or more, of which there are at most a thousand, are broadcast, so that no key gathers its rows in one task.
    """
    hot = materialise(groups.where(F.col(n) * 1000 >= total).drop(n), "hot-groups")
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(n) * 1000 < total).drop(n), keys)
    return near.unionByName(far)
