"""Column profiles: one result row per column of the profiled table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cleanframe.functions.cells import cell_text, col
from cleanframe.operators.quantiles import WEIBULL6
from cleanframe.operators.statistics import (
    COLUMNS_PER_JOB,
    Moments,
    filled,
    frequency_summary,
    moments,
    quartiles,
)
from cleanframe.session import small_table, table_schema

NUMERIC, TEXT, BOOLEAN, UNKNOWN = "NUMERIC", "TEXT", "BOOLEAN", "UNKNOWN"

_FIELDS = table_schema(
    position=T.IntegerType(),
    name=T.StringType(),
    data_type=T.StringType(),
    total_count=T.LongType(),
    null_count=T.LongType(),
    unique_count=T.LongType(),
    most_common=T.StringType(),
    mean=T.DoubleType(),
    median=T.DoubleType(),
    std_dev=T.DoubleType(),
    min=T.DoubleType(),
    max=T.DoubleType(),
    q1=T.DoubleType(),
    q3=T.DoubleType(),
)


def infer_type(m: Moments) -> str:
    """Numbers win over boolean words, so a 0/1 column is numeric."""
    if m.filled == 0:
        return UNKNOWN
    if m.all_numeric:
        return NUMERIC
    return BOOLEAN if m.boolean else TEXT


def profile(
    df: DataFrame,
    columns: list[str] | None = None,
    method: str = WEIBULL6,
    order: Column | None = None,
    exact_distinct: bool = True,
) -> DataFrame:
    """Type, counts, most frequent value and numeric statistics per column.

    `order` decides ties for the most frequent value by first appearance. With
    `exact_distinct=False` distinct counts come from a sketch, which saves the
    shuffle of all distinct values; the most frequent value is then left out.
    """
    columns = columns or df.columns
    stats = moments(df, columns, words=True)
    numeric = [c for c in columns if stats[c,].n]
    quarts = quartiles(df, numeric, stats, method) if numeric else {}
    common: dict[tuple, tuple[int, str | None]] = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        chunk = columns[start : start + COLUMNS_PER_JOB]
        if exact_distinct:
            common.update(frequency_summary(df, chunk, first=order))
        else:
            common.update(_sketched_distinct(df, chunk))
    rows = []
    for i, c in enumerate(columns):
        m = stats[c,]
        distinct, best = common.get((c,), (0, None))
        q1, median, q3 = quarts.get((c,), (None, None, None))
        rows.append(
            (i, c, infer_type(m), m.rows, m.rows - m.filled, distinct, best or "")
            + (m.mean, median, m.sd, m.low, m.high, q1, q3)
        )
    # One row per column of the table.
    table = small_table(df.sparkSession, rows, _FIELDS)
    iqr = F.col("q3") - F.col("q1")
    percent = F.when(F.col("total_count") == 0, 0.0).otherwise(
        F.col("null_count") * 100.0 / F.col("total_count")
    )
    return (
        table.withColumn("null_percent", percent)
        .withColumn("iqr", iqr)
        .withColumn("lower_fence", F.col("q1") - 1.5 * iqr)
        .withColumn("upper_fence", F.col("q3") + 1.5 * iqr)
    )


def _sketched_distinct(df: DataFrame, columns: list[str]) -> dict[tuple, tuple[int, None]]:
    aggs = [
        F.approx_count_distinct(cell_text(filled(df, c), df.schema[c].dataType)).alias(f"d{i}")
        for i, c in enumerate(columns)
    ]
    row = df.agg(*aggs).first()
    return {(c,): (row[f"d{i}"], None) for i, c in enumerate(columns)}


def infer_types(df: DataFrame) -> DataFrame:
    """Promote text columns in which every filled cell is a number to double."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    from cleanframe.operators.statistics import number

    stats = moments(df, texts)
    numeric = {c for c in texts if infer_type(stats[c,]) == NUMERIC}
    return df.select(*[number(df, c).alias(c) if c in numeric else col(c) for c in df.columns])


def numeric_columns(profiles: DataFrame) -> DataFrame:
    """The profiles that charts may use."""
    return profiles.filter(F.col("data_type") == NUMERIC)


def display_number(c: Column) -> Column:
    """Whole numbers bare, others with four decimals, none as a dash."""
    return (
        F.when(c.isNull() | F.isnan(c), "—")
        .when(c == F.floor(c), c.try_cast("bigint").cast("string"))
        .otherwise(F.format_string("%.4f", c))
    )


def display_table(profiles: DataFrame) -> DataFrame:
    """P5: the twelve columns of the profile view."""
    # The titles of the view.
    return profiles.select(
        F.col("name").alias("Column"),
        F.col("data_type").alias("Type"),
        F.col("total_count").alias("Total"),
        F.col("null_count").alias("Nulls"),
        F.format_string("%.1f%%", F.col("null_percent")).alias("Null %"),
        F.col("unique_count").alias("Unique"),
        display_number(F.col("mean")).alias("Mean"),
        display_number(F.col("median")).alias("Median"),
        display_number(F.col("std_dev")).alias("Std Dev"),
        display_number(F.col("min")).alias("Min"),
        display_number(F.col("max")).alias("Max"),
        F.col("most_common").alias("Most Common"),
    )


def stats_strip(profiles: DataFrame) -> DataFrame:
    """One line of four-digit statistics per column."""

    def short(name: str) -> Column:
        c = F.col(name)
        return F.when(c.isNull() | F.isnan(c), "n/a").otherwise(F.format_string("%.4g", c))

    # Fixed value: the layout of the line.
    line = F.format_string(
        "Mean %s   Median %s   Q1 %s   Q3 %s   Min %s   Max %s   Missing %.1f%%",
        *[short(n) for n in ("mean", "median", "q1", "q3", "min", "max")],
        F.col("null_percent"),
    )
    return profiles.select("name", line.alias("stats"))
