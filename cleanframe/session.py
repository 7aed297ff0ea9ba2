"""Where intermediate tables go.

Intermediate results that later jobs scan again are written as Parquet below
the cluster's shared checkpoint folder: a lost executor then costs one re-read,
and later scans still prune columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

_ARROW = {
    T.StringType: pa.string(),
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.DoubleType: pa.float64(),
    T.BooleanType: pa.bool_(),
}


#: Spark's setting that a finished write deletes its shuffle files.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`; set here only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cleanframe-"))
    return spark.sparkContext.getCheckpointDir()


# Scratch tables of this driver that still exist, in the order of their making.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/cleanframe/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables made so far (from the `since`-th on). DataFrames that read them end with that."""
    paths, _MADE[since:] = _MADE[since:], []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end; results must be written or collected before."""
    since = len(_MADE)
    try:
        yield
    finally:
        release(spark, since)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver's JVM next collects its garbage. Nothing
    reads them again: a later job over the same DataFrame, or over the written table, has a plan of its own."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str = "table") -> DataFrame:
    """The table that `make` gives, written and read back; the scratch tables of its making are deleted."""
    return all_written_alone(spark, lambda: [make()], label)[0]


def all_written_alone(spark: SparkSession, make: Callable[[], list[DataFrame]], *labels: str) -> list[DataFrame]:
    """The tables that `make` gives, one for each label, as `written_alone` has one."""
    paths = [scratch_path(spark, label) for label in labels]
    with scratch(spark):
        tables = make()
        schemas = [df.schema for df in tables]
        for df, path in zip(tables, paths, strict=True):
            with shuffles_deleted(spark):
                df.write.parquet(path)
    return [spark.read.schema(schema).parquet(path) for schema, path in zip(schemas, paths)]


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, label)
    schema = df.schema
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A local relation of driver-held rows; only for row counts the caller bounds."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    table = pa.table(
        [pa.array(list(c), type=_ARROW.get(type(f.dataType)) or to_arrow_type(f.dataType)) for c, f in zip(columns, schema)],
        names=schema.names,
    )
    return spark.createDataFrame(table, schema)


def table_schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])
