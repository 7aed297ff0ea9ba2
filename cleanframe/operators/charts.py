"""The aggregates behind a histogram and a box plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cleanframe.operators.quantiles import LINEAR7
from cleanframe.operators.statistics import moments, number, quartiles

MIN_BINS, MAX_BINS, DEFAULT_BINS = 5, 60, 20


def chart_values(df: DataFrame, column: str) -> DataFrame:
    """The cells of a column that are numbers, as `value`."""
    v = F.nanvl(number(df, column), F.lit(None).cast("double"))
    return df.select(v.alias("value")).filter(F.col("value").isNotNull())


def histogram(df: DataFrame, column: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """H1: `(bin, lower, upper, count)` with equal widths; empty bins are kept.

    Bins lie between the smallest and the largest finite cell; infinite cells count in the first and in the last bin. Without
    a finite cell there are no bins.
    """
    if not MIN_BINS <= bins <= MAX_BINS:
        raise ValueError(f"bins must lie between {MIN_BINS} and {MAX_BINS}")
    values = chart_values(df, column)
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    low, high = values.agg(F.min(finite), F.max(finite)).first()
    if low is None:
        return _bin_frame(df, bins, 0.0, 0.0).limit(0)
    v = F.col("value")
    place = F.least(F.floor((v - low) / F.lit(high - low or 1.0) * bins), F.lit(bins - 1))
    bin_ = F.when(v < low, 0).when(v < high, place).otherwise(bins - 1)
    counted = values.groupBy(bin_.alias("bin")).agg(F.count("*").alias("count"))
    # At most `bins` rows on either side.
    return (
        _bin_frame(df, bins, low, high)
        .drop("count")
        .join(F.broadcast(counted), "bin", "left")
        .withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    )


def _bin_frame(df: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    width = (high - low) / bins
    bin_ = F.col("bin")
    upper = F.when(bin_ == bins - 1, F.lit(high)).otherwise(low + (bin_ + 1) * width)
    return df.sparkSession.range(0, bins, 1, 1).select(
        F.col("id").alias("bin"),
    ).select(
        "bin",
        (low + bin_ * width).alias("lower"),
        upper.alias("upper"),
        F.lit(0).cast("bigint").alias("count"),
    )


def histogram_markers(df: DataFrame, column: str) -> DataFrame:
    """H2: mean and midpoint median."""
    values = chart_values(df, column)
    stats = moments(values, ["value"])
    m = stats["value",]
    median = quartiles(values, ["value"], stats, LINEAR7)["value",][1]
    return df.sparkSession.range(1).select(
        F.lit(m.mean).cast("double").alias("mean"), F.lit(median).cast("double").alias("median")
    )


def box_plot(profiles: DataFrame) -> DataFrame:
    """Mean, median, quartiles and whiskers clamped to the fences."""
    return profiles.filter(F.col("q1").isNotNull()).select(
        "name",
        "mean",
        "median",
        "q1",
        "q3",
        F.greatest("min", "lower_fence").alias("lower_whisker"),
        F.least("max", "upper_fence").alias("upper_whisker"),
    )
