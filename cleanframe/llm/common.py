"""Shared by the operators: reading tables, row keys, scratch tables, joins with hot keys."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from cleanframe.session import all_written_alone, scratch_path, written, written_alone

__all__ = ["all_written_alone", "bound_arrow_batches", "bucketed", "fresh_names", "give_back", "hashed_share", "lower_ascii", "packed_rows", "read", "returning_memory", "row_keys", "salted_join", "scanned", "smallest", "struct_type", "utf8", "written", "written_alone"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """df written in buckets of a key and read back: work that groups by the key needs no shuffle of it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    name = "cleanframe_" + path.rsplit("-", 1)[-1]
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    table = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name goes, the files stay
    return table


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def hashed_share(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; NULL for a NULL key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string")) % n


def row_keys(id_column: str, text: str) -> list[Column]:
    """Two 64-bit keys of a row: equal for rows with equal id and text, also where either is NULL."""
    one, two = F.col(id_column), F.col(text)
    parts = [one.isNull(), two.isNull(), one, two]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts[::-1]).alias("k2")]


def smallest(df: DataFrame, rows: int, *key: Column) -> DataFrame:
    """The `rows` rows with the smallest key, a bounded sample that does not depend on partitioning."""
    return df.orderBy(*key).limit(rows)


def salted_join(many: DataFrame, one: DataFrame, on: str, rows_per_task: int = 50_000) -> DataFrame:
    """Inner join of `many` with `one`, which has few rows per key, however often a key occurs in `many`.

    Keys that occur more than `rows_per_task` times get several salts; their rows in `one` are copied to each.
    The list of such keys has at most count(many) / rows_per_task rows and is itself joined, not collected.
    """
    counts = many.groupBy(on).agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("_salts"))
    one = one.join(counts, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    others = [c for c in many.columns if c != on]
    spread = F.xxhash64(*others) if others else F.lit(0)
    hot = counts.filter("_salts > 1")
    dealt = many.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.coalesce(F.pmod(spread, F.col("_salts")).cast("int"), F.lit(0))
    )
    return dealt.drop("_salts").join(one.drop("_salts"), [on, "_salt"]).drop("_salt")


def struct_type(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])



def bound_arrow_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Batches handed to Python hold at most `size` bytes, unless the session bounds them more tightly: texts can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "", str((1 << 31) - 1)) or _bytes(spark.conf.get(name)) > size:
        spark.conf.set(name, str(size))


def _bytes(said: str) -> int:
    unit = {"k": 10, "m": 20, "g": 30}.get(said.lower().rstrip("b")[-1:], 0)
    return int(said.lower().rstrip("bkmg") or 0) << unit


def give_back() -> None:
    """Memory of this process that nothing uses goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def returning_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a function on batches; when a task ends its memory goes back. Spark keeps the Python processes of a stage, as many as
    it has tasks and Python steps at a time, so what they hold would add to the memory of later stages."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where a column of df has one of them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def packed_rows(df: DataFrame, **named: str) -> tuple[DataFrame, Callable[..., list[Column]]]:
    """df as (named columns, row): whatever its columns are called, none clashes with names used in between. The function
    gives the columns back, with those that changed taken from elsewhere."""
    columns = list(df.columns)
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in columns}
    own = df.select(*[quoted[c].alias(n) for n, c in named.items()], F.struct(*quoted.values()).alias("row"))

    def unpacked(**changed: str) -> list[Column]:
        by_column = {named[n]: c for n, c in changed.items()}
        return [(F.col(by_column[c]) if c in by_column else F.col("row").getField(c)).alias(c) for c in columns]

    return own, unpacked


def scanned(rows: DataFrame, unit: list[int], join: Callable[[list[int], list[int]], list[int]], backwards: bool) -> DataFrame:
    """(at, before): for each row (c, block, at, value array<long>) of a key c, what comes before it in the order of `at`
    (behind it, if backwards), joined in the order of `at`; `unit` where there is nothing.

    `join` is associative. Rows of a block are joined first, then the blocks of a key: a task holds the rows of one block or
    one row for each block of a key, and blocks are partitions of sorted data, so neither grows with a hot key.
    """
    kind = rows.schema["c"].dataType
    arrow = to_arrow_type(kind)
    both = (lambda old, new: join(new, old)) if backwards else join

    def ordered(table: pa.Table, by: str) -> list[dict]:
        return sorted(table.to_pylist(), key=lambda r: r[by], reverse=backwards)

    def totals(table: pa.Table) -> pa.Table:
        whole, own = list(unit), ordered(table, "at")
        for r in own:
            whole = both(whole, r["value"])
        return pa.table([pa.array([own[0]["c"]], arrow), pa.array([own[0]["block"]], pa.int64()), pa.array([whole], pa.list_(pa.int64()))], names=["c", "block", "value"])

    def seeds(table: pa.Table) -> pa.Table:
        whole, own, out = list(unit), ordered(table, "block"), []
        for r in own:
            out.append(whole)
            whole = both(whole, r["value"])
        return pa.table([pa.array([own[0]["c"]] * len(own), arrow), pa.array([r["block"] for r in own], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["kc", "kblock", "seed"])

    def placed(table: pa.Table) -> pa.Table:
        own = ordered(table, "at")
        whole, out = own[0]["seed"], []
        for r in own:
            out.append(whole)
            whole = both(whole, r["value"])
        return pa.table([pa.array([r["at"] for r in own], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["at", "before"])

    rows = written(rows, "scan-rows")
    long, values = T.LongType(), T.ArrayType(T.LongType())
    whole = rows.groupBy("c", "block").applyInArrow(totals, struct_type(c=kind, block=long, value=values))
    first = whole.groupBy("c").applyInArrow(seeds, struct_type(kc=kind, kblock=long, seed=values))
    held = rows.join(first, F.col("c").eqNullSafe(F.col("kc")) & (F.col("block") == F.col("kblock")))
    return held.groupBy("c", "block").applyInArrow(placed, struct_type(at=long, before=values))
