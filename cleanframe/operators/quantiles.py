"""Exact quantiles by distributed selection.

`percentile` keeps one value-to-count map per group in a single task, which
does not hold when a column has billions of distinct values or one group owns
a third of the table. Here the wanted ranks are narrowed instead: every round
scans the values once, counts them in at most BINS bins per open interval with
map-side aggregation, and keeps the bin that holds the rank. An interval with
at most DIRECT rows is finished by counting its distinct values. Nothing but
bin counts is shuffled, and the result is exact.

The first round bins on a signed logarithm and later rounds bin linearly. One
logarithmic bin spans less than a factor e, so each linear round then settles
about twelve more bits of the mantissa: six rounds cover any set of doubles.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import floor, log

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cleanframe.functions.cells import col
from cleanframe.session import small_table, table_schema

BINS = 4096
DIRECT = 20_000

# The signed logarithm of any finite non-zero double lies within these bounds.
_LOG_SHIFT = 746.0
_LOG_CAP = 2000.0

WEIBULL6 = "weibull6"
LINEAR7 = "linear7"


@dataclass(frozen=True)
class Summary:
    """Count, smallest and largest of the non-NaN values of one key."""

    n: int
    low: float | None
    high: float | None


@dataclass(frozen=True)
class _Search:
    """One wanted rank: the `rank`-th smallest of `rows` values in [low, high]."""

    key: tuple
    goal: int
    rank: int
    rows: int
    low: float
    high: float
    first: bool = True


def rank_position(n: int, p: float, method: str) -> float:
    """One-based fractional rank of quantile `p` among `n` sorted values."""
    if method == WEIBULL6:
        return min(max(p * (n + 1), 1.0), float(n))
    if method == LINEAR7:
        return p * (n - 1) + 1.0
    raise ValueError(f"unknown quantile method: {method}")


def quantiles(
    values: DataFrame,
    summaries: dict[tuple, Summary],
    probs: list[float],
    method: str,
    keys: list[str],
    value: str = "v",
) -> dict[tuple, list[float | None]]:
    """Quantiles of `value` per key.

    `values` holds the `keys` columns and a double column without NULL or NaN;
    `summaries` holds count, minimum and maximum of each key.
    """
    wanted = {}
    for key, s in summaries.items():
        ranks = set()
        if s.n:
            for p in probs:
                k = floor(rank_position(s.n, p, method))
                ranks.update((k, min(k + 1, s.n)))
        wanted[key] = sorted(ranks)
    picked = order_statistics(values, summaries, wanted, keys, value)

    result = {}
    for key, s in summaries.items():
        row: list[float | None] = []
        for p in probs:
            if not s.n:
                row.append(None)
                continue
            pos = rank_position(s.n, p, method)
            k = floor(pos)
            below, above = picked[key, k], picked[key, min(k + 1, s.n)]
            row.append(below if below == above else below + (pos - k) * (above - below))
        result[key] = row
    return result


def order_statistics(
    values: DataFrame,
    summaries: dict[tuple, Summary],
    wanted: dict[tuple, list[int]],
    keys: list[str],
    value: str = "v",
) -> dict[tuple, float]:
    """The values at the wanted one-based ranks, as `{(key, rank): value}`."""
    found: dict[tuple, float] = {}
    open_: list[_Search] = []
    for key, ranks in wanted.items():
        s = summaries[key]
        for r in ranks:
            if s.low == s.high or r == 1:
                found[key, r] = s.low
            elif r == s.n:
                found[key, r] = s.high
            else:
                open_.append(_Search(key, r, r, s.n, s.low, s.high))
    while open_:
        open_ = _narrow(values, open_, found, keys, value)
    return found


def _log_key(x: float) -> float:
    if x == 0:
        return 0.0
    size = _LOG_CAP if abs(x) == float("inf") else log(abs(x)) + _LOG_SHIFT
    return size if x > 0 else -size


def _log_key_column(v: Column) -> Column:
    size = F.least(F.ln(F.abs(v)) + _LOG_SHIFT, F.lit(_LOG_CAP))
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * size)


def _narrow(
    values: DataFrame,
    searches: list[_Search],
    found: dict[tuple, float],
    keys: list[str],
    value: str,
) -> list[_Search]:
    """One round: a scan that replaces every search by a smaller one."""
    spark = values.sparkSession
    key_fields = [values.schema[k] for k in keys]

    intervals: dict[tuple, int] = {}
    interval_rows, goal_rows = [], []
    for s in searches:
        span = (s.key, s.low, s.high)
        if span not in intervals:
            intervals[span] = len(intervals)
            direct = s.rows <= DIRECT
            if s.first:
                start, width = _log_key(s.low), _log_key(s.high) - _log_key(s.low)
            else:
                start, width = s.low, s.high - s.low
            interval_rows.append(
                (*s.key, intervals[span], s.low, s.high, start, width, direct, s.first)
            )
        goal_rows.append((intervals[span], s.goal, s.rank))

    key_types = {f"_{k.name}": k.dataType for k in key_fields}
    interval_df = small_table(
        spark,
        interval_rows,
        table_schema(
            **key_types,
            _span=T.IntegerType(),
            _low=T.DoubleType(),
            _high=T.DoubleType(),
            _start=T.DoubleType(),
            _width=T.DoubleType(),
            _direct=T.BooleanType(),
            _log=T.BooleanType(),
        ),
    )
    goal_df = small_table(
        spark,
        goal_rows,
        table_schema(_goal_span=T.IntegerType(), _goal=T.LongType(), _rank=T.LongType()),
    )

    v = col(value)
    place = F.when(F.col("_log"), _log_key_column(v)).otherwise(v)
    bin_ = F.least(
        F.floor((place - F.col("_start")) / F.col("_width") * BINS).cast("double"),
        F.lit(float(BINS - 1)),
    )
    match = (v >= F.col("_low")) & (v <= F.col("_high"))
    for k in keys:
        match = match & col(k).eqNullSafe(F.col(f"_{k}"))

    # Both small sides hold one row per open rank, set by the caller's keys.
    counted = (
        values.join(F.broadcast(interval_df), match)
        .select("_span", F.when(F.col("_direct"), v).otherwise(bin_).alias("_slot"), v.alias("_v"))
        .groupBy("_span", "_slot")
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    # At most BINS slots, or DIRECT distinct values, per interval.
    running = Window.partitionBy("_span").orderBy("_slot")
    hits = (
        counted.withColumn("_upto", F.sum("_n").over(running))
        .join(
            F.broadcast(goal_df),
            (F.col("_span") == F.col("_goal_span"))
            & (F.col("_rank") <= F.col("_upto"))
            & (F.col("_rank") > F.col("_upto") - F.col("_n")),
        )
        .select("_span", "_goal", "_n", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_before"))
        .collect()
    )

    by_goal = {(h["_span"], h["_goal"]): h for h in hits}
    rest = []
    for s in searches:
        h = by_goal[intervals[s.key, s.low, s.high], s.goal]
        if h["_lo"] == h["_hi"]:
            found[s.key, s.goal] = h["_lo"]
        else:
            rest.append(
                replace(
                    s, rank=s.rank - h["_before"], rows=h["_n"], low=h["_lo"], high=h["_hi"], first=False
                )
            )
    return rest
