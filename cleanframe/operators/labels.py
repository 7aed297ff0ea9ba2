"""Label codes: dense zero-based numbers for the distinct values of a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cleanframe.functions.cells import col
from cleanframe.operators.ordering import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    lookup,
    with_position,
)
from cleanframe.operators.statistics import filled
from cleanframe.session import small_table

# Up to this many distinct values, and bytes of them, are numbered on the driver.
DRIVER_VALUES = 20_000
DRIVER_BYTES = 16 << 20


@dataclass(frozen=True)
class LabelCodes:
    """Mapping `(__value, n, __code)` with the sizes needed to join it well."""

    mapping: DataFrame
    values: int
    bytes: int
    total: int


_SIMPLE = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.BooleanType)


def label_codes(
    df: DataFrame, column: str, order: Column | None, strict: bool = False
) -> LabelCodes:
    """Codes by first appearance along `order`, or by value where it is None."""
    value = filled(df, column, strict)
    dtype = df.schema[column].dataType
    aggs = [F.count("*").alias("n")]
    sorting = [F.col("__value")]
    source = [value.alias("__value")]
    if order is not None:
        source.append(order.alias("__order"))
        aggs.append(F.min("__order").alias("__first"))
        sorting.insert(0, F.col("__first"))
    counted = (
        df.select(*source)
        .filter(F.col("__value").isNotNull())
        .groupBy("__value")
        .agg(*aggs)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        values, size, total = _sizes(counted)
        if isinstance(dtype, _SIMPLE) and values <= DRIVER_VALUES and size <= DRIVER_BYTES:
            head = counted.orderBy(*sorting).select("__value", "n").collect()
            fields = [("__value", dtype), ("n", T.LongType()), ("__code", T.LongType())]
            schema = T.StructType([T.StructField(n, t) for n, t in fields])
            rows = [(r["__value"], r["n"], i) for i, r in enumerate(head)]
            return LabelCodes(small_table(df.sparkSession, rows, schema), values, size, total)
        ranked = with_position(counted, sorting, "__code").select("__value", "n", "__code")
        return LabelCodes(ranked, values, size, total)
    finally:
        counted.unpersist()


def _sizes(counted: DataFrame) -> tuple[int, int, int]:
    """Distinct values, bytes they take, and rows they stand for."""
    width = F.octet_length(F.col("__value").cast("string")).cast("bigint")
    row = counted.agg(F.count("*").alias("values"), F.sum(width).alias("bytes"), F.sum("n").alias("total"))
    r = row.first()
    return r["values"], r["bytes"] or 0, r["total"] or 0


def group_label_codes(df: DataFrame, column: str, order: Column, group: str) -> LabelCodes:
    """Codes by first appearance inside each group.

    Positions over all (group, value) pairs, minus the first position of the
    group; no task holds a whole group.
    """
    counted = (
        df.select(
            col(group).alias("__g"),
            filled(df, column).alias("__value"),
            order.alias("__order"),
        )
        .filter(F.col("__value").isNotNull())
        .groupBy("__g", "__value")
        .agg(F.count("*").alias("n"), F.min("__order").alias("__first"))
    )
    ranked = with_position(
        counted, [F.col("__g"), F.col("__first"), F.col("__value")], "__at_all"
    )
    starts = ranked.groupBy("__g").agg(F.min("__at_all").alias("__start"))
    # One row per group; callers bound the number of groups.
    mapping = ranked.join(F.broadcast(starts), "__g").select(
        "__g", "__value", "n", (F.col("__at_all") - F.col("__start")).alias("__code")
    )
    return LabelCodes(mapping, *_sizes(ranked))


def encode(
    df: DataFrame,
    column: str,
    codes: LabelCodes,
    strict: bool = False,
    group: str | None = None,
    null_code: bool = False,
) -> DataFrame:
    """Replace `column` by its codes; with `null_code` NULL takes the code after the last."""
    keys = ["__g", "__value"] if group else ["__value"]
    keyed = df.withColumn("__value", filled(df, column, strict))
    if group:
        keyed = keyed.withColumn("__g", col(group))
    small = codes.values <= BROADCAST_ROWS and codes.bytes <= BROADCAST_BYTES
    joined = lookup(keyed, keys, codes.mapping, small, codes.total, "__code")
    code = F.col("__code")
    if null_code:
        code = F.when(F.col("__value").isNull(), F.lit(codes.values).cast("bigint")).otherwise(code)
    kept = [code.alias(c) if c == column else col(c) for c in df.columns]
    return joined.select(*kept)
