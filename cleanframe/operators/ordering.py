"""Total order without a single task: sorting, global positions, skew-safe lookups."""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cleanframe.functions.cells import col
from cleanframe.session import small_table, table_schema, written

# Up to this many rows, and bytes of keys, a mapping is broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def row_digest(columns: list[str]) -> Column:
    return F.xxhash64(*[col(c) for c in columns])


def sort_rows(
    df: DataFrame,
    keys: list[Column],
    tiebreak: list[Column] | None = None,
    distinct_rows: bool = False,
) -> DataFrame:
    """Sort by `keys`; equal keys are ordered by `tiebreak`, then by row content.

    The row digest cuts a hot key over range partitions. Copies of a whole row share a digest; their place in the
    table is the last key and cuts them too. A task that runs again must deal its rows as before, so the place is that
    in the file where the source tells it, and is written down first where not. `distinct_rows` says that there are no
    copies.
    """
    names = df.columns
    order = [*keys, *(tiebreak or []), row_digest(names)]
    if distinct_rows:
        return df.orderBy(*order)
    place = _file_place(df)
    if place:
        return df.orderBy(*order, *place)
    placed = written(df.withColumn("__place", F.monotonically_increasing_id()), "places")
    return placed.orderBy(*order, "__place").select(*[col(c) for c in names])


def _file_place(df: DataFrame) -> list[Column] | None:
    """File and row number inside it, where every row comes from one row of a file that has row numbers."""
    place = [F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")]
    if "_metadata" in (c.lower() for c in df.columns):
        return None
    try:
        df.select(*place).schema  # noqa: B018
    except AnalysisException:
        return None
    return place


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Zero-based position of every row in the order; `order` must be unique."""
    return number_rows(df.orderBy(*order), name)


def number_rows(sorted_df: DataFrame, name: str) -> DataFrame:
    """Zero-based position of every row of a sorted table.

    The range-sorted partitions are written once; their row counts (one number
    per partition) give each partition its offset.
    """
    table = written(sorted_df.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = [0, *accumulate(r["n"] for r in sizes)]
    offsets = small_table(
        sorted_df.sparkSession,
        [(r["part"], s) for r, s in zip(sizes, starts)],
        table_schema(__part=T.LongType(), __start=T.LongType()),
    )
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        table.join(F.broadcast(offsets), part == F.col("__part"))
        .withColumn(name, F.col("__start") + inside)
        .drop("__at", "__part", "__start")
    )


def lookup(
    df: DataFrame, keys: list[str], mapping: DataFrame, small: bool, total: int, result: str
) -> DataFrame:
    """Left join of `df` with `mapping(keys..., n, result)`; NULL keys give NULL.

    `n` is how many rows of the fitted table hold the key, `total` their sum. A
    mapping known to be small is broadcast. Otherwise one join by shuffle reads
    `df` once: a key above one partition's share is dealt to several salts, and
    its row of the mapping is copied to each. Only digests of such keys (never
    more of them than partitions) and their salts are broadcast, however long
    the keys are; keys with equal digests share the salts, on both sides. Rows
    without a key are spread too.
    """
    spark = df.sparkSession
    if small:
        return df.join(F.broadcast(mapping.drop("n")), keys, "left")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digest = F.xxhash64(*[col(k) for k in keys])
    # A salt has an eighth of a partition's share, so that several that meet in one partition still fit.
    salts = F.ceil(F.col("n") / F.lit(total / parts / 8)).cast("int")
    hot = mapping.filter(F.col("n") > total / parts).groupBy(digest.alias("__digest")).agg(F.max(salts).alias("__salts"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | col(k).isNull()
    # Copies of a row lie in many partitions, whose numbers stay when a task runs again.
    spread = F.xxhash64(F.spark_partition_id(), *[col(c) for c in df.columns])
    salt = F.when(missing, F.pmod("__spread", F.lit(8 * parts))).otherwise(F.pmod("__spread", F.coalesce("__salts", F.lit(1)))).cast("int")
    many = df.withColumn("__digest", digest).withColumn("__spread", spread)
    many = many.join(F.broadcast(hot), "__digest", "left")
    many = many.select(*[col(c) for c in df.columns], salt.alias("__salt"))
    one = mapping.drop("n").withColumn("__digest", digest).join(F.broadcast(hot), "__digest", "left")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    one = one.select(*[col(k) for k in keys], result, copies.alias("__salt"))
    return many.join(one, [*keys, "__salt"], "left").select(*[col(c) for c in df.columns], result)
