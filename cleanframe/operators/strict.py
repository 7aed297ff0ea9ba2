"""The seventeen steps, SQL form.

Only NULL is missing, comparisons are typed, bad casts raise, and quantiles are
linearly interpolated. Statistics are fitted values, so no step needs a window
over the whole table or a cross join.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, functions as F, types as T

from cleanframe.functions.cells import col, row_hash
from cleanframe.operators.labels import encode
from cleanframe.operators.lenient import unique_names
from cleanframe.operators.split import mark_split
from cleanframe.operators.state import HIDDEN, SortKey, State, Statistics
from cleanframe.plans.spec import Op, Step, numeric_literal


def drop_missing_rows(state: State, step: Step, stats: Statistics) -> State:
    """Q1"""
    return state.with_df(state.df.na.drop("any", subset=["`" + c + "`" for c in state.columns]))


def _fill_number(field: str):
    def fill(state: State, step: Step, stats: Statistics) -> State:
        value = stats.value(step.column, field)
        return state.with_column(step.column, F.coalesce(col(step.column).cast("double"), value))

    return fill


def fill_mode(state: State, step: Step, stats: Statistics) -> State:
    """Q4"""
    value = stats.value(step.column, "mode").cast(state.dtype(step.column))
    return state.with_column(step.column, F.coalesce(col(step.column), value))


def fill_custom(state: State, step: Step, stats: Statistics) -> State:
    """Q5"""
    value = F.lit(step.param or "").cast(state.dtype(step.column))
    return state.with_column(step.column, F.coalesce(col(step.column), value))


def remove_duplicates(state: State, step: Step, stats: Statistics) -> State:
    """Q6"""
    from cleanframe.operators import lenient

    hidden = [c for c in state.df.columns if c.startswith(HIDDEN)]
    if hidden:
        return lenient.remove_duplicates(state, step, stats)
    return state.with_df(state.df.distinct())


def remove_outliers(state: State, step: Step, stats: Statistics) -> State:
    """Q7: NULL rows go too."""
    q1, q3 = stats.value(step.column, "q1"), stats.value(step.column, "q3")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return state.with_df(state.df.filter(col(step.column).cast("double").between(low, high)))


def _scale(state: State, column: str, centre: Column, width: Column) -> State:
    v = col(column).cast("double")
    return state.with_column(column, (v - centre) / F.nullif(width, F.lit(0.0)))


def normalize_minmax(state: State, step: Step, stats: Statistics) -> State:
    """Q8"""
    low, spread = stats.value(step.column, "low"), stats.value(step.column, "spread")
    return _scale(state, step.column, low, spread)


def normalize_zscore(state: State, step: Step, stats: Statistics) -> State:
    """Q9"""
    mean, sd = stats.value(step.column, "mean"), stats.value(step.column, "sd")
    return _scale(state, step.column, mean, sd)


def normalize_robust(state: State, step: Step, stats: Statistics) -> State:
    """Q10"""
    q1, median, q3 = (stats.value(step.column, f) for f in ("q1", "median", "q3"))
    return _scale(state, step.column, median, q3 - q1)


def cast_column(state: State, step: Step, stats: Statistics) -> State:
    """Q11: bad input raises; doubles round half to even on their way to integers."""
    c, dtype = col(step.column), state.dtype(step.column)
    target = (step.param or "string").lower()
    if target in ("int", "integer"):
        if isinstance(dtype, T.FractionalType):
            c = F.rint(c.cast("double"))
        value = c.cast("int")
    elif target in ("float", "double"):
        value = c.cast("double")
    elif target in ("boolean", "bool"):
        value = c.cast("boolean")
    else:
        value = c.cast("string")
    return state.with_column(step.column, value)


def train_test_split(state: State, step: Step, stats: Statistics) -> State:
    """Q12"""
    columns = tuple(state.columns)
    hashed = row_hash(state.df, list(columns))
    return state.with_df(mark_split(state.df, hashed, stats.cuts[columns]))


def label_encode(state: State, step: Step, stats: Statistics) -> State:
    """Q13: codes by value; NULL takes the last code."""
    codes = stats.codes[step.column]
    return state.with_df(encode(state.df, step.column, codes, strict=True, null_code=True))


def one_hot_encode(state: State, step: Step, stats: Statistics) -> State:
    """Q14: dummies at the end, in the order their values were first seen."""
    values = stats.categories[step.column]
    if not values:
        return state
    kept = [c for c in state.df.columns if c != step.column]
    names = unique_names([dummy_name(step.column, v) for v in values], set(kept))
    text = col(step.column).cast("string")
    dummies = [
        F.when(text == F.lit(v), 1).otherwise(0).alias(n) for v, n in zip(values, names)
    ]
    return state.with_df(state.df.select(*[col(c) for c in kept], *dummies))


def dummy_name(column: str, value: str) -> str:
    """Runs of other characters become one underscore."""
    words = [w for w in re.split(r"[^A-Za-z0-9]+", value) if w]
    return f"{column}_{'_'.join(words) or 'value'}"


def sort_column(state: State, step: Step, stats: Statistics) -> State:
    """Q15: NULL sorts as the largest value."""
    name = f"{HIDDEN}sort{len(state.sorts)}"
    key = SortKey(name, step.ascending(), nulls_last=step.ascending())
    df = state.df.withColumn(name, col(step.column))
    return replace(state, df=df, sorts=(key, *state.sorts))


def filter_rows(state: State, step: Step, stats: Statistics) -> State:
    """Q16: typed comparison; NULL rows go."""
    operator, target = step.filter_parts()
    c = col(step.column)
    if operator == "contains":
        keep = c.cast("string").ilike(f"%{target}%")
    else:
        number = numeric_literal(target)
        value = F.lit(target if number is None else number)
        compare = {
            "!=": c != value,
            ">": c > value,
            "<": c < value,
            ">=": c >= value,
            "<=": c <= value,
        }
        keep = compare.get(operator, c == value)
    return state.with_df(state.df.filter(keep))


def replace_regex(state: State, step: Step, stats: Statistics) -> State:
    """Q17"""
    rule = step.regex_rule()
    text = col(step.column).cast("string")
    replaced = F.regexp_replace(text, F.lit(rule.pattern), F.lit(rule.replacement or ""))
    return state.with_column(step.column, replaced)


STEPS = {
    Op.DROP_MISSING_ROWS: drop_missing_rows,
    Op.FILL_MISSING_MEAN: _fill_number("mean"),
    Op.FILL_MISSING_MEDIAN: _fill_number("median"),
    Op.FILL_MISSING_MODE: fill_mode,
    Op.FILL_MISSING_CUSTOM: fill_custom,
    Op.REMOVE_DUPLICATES: remove_duplicates,
    Op.REMOVE_OUTLIERS_IQR: remove_outliers,
    Op.NORMALIZE_MINMAX: normalize_minmax,
    Op.NORMALIZE_ZSCORE: normalize_zscore,
    Op.NORMALIZE_ROBUST: normalize_robust,
    Op.CAST_COLUMN: cast_column,
    Op.TRAIN_TEST_SPLIT: train_test_split,
    Op.LABEL_ENCODE: label_encode,
    Op.ONE_HOT_ENCODE: one_hot_encode,
    Op.SORT_COLUMN: sort_column,
    Op.FILTER_ROWS: filter_rows,
    Op.REGEX_REPLACE: replace_regex,
}
