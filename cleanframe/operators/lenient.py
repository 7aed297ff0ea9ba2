"""The seventeen steps, lenient form.

Blank cells are missing and cells that are no numbers are left alone. Numbers
put into text columns are written to six decimals, and a text column stays text
whatever it holds. Columns of a numeric type give doubles, unrounded.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cleanframe.functions.cells import (
    as_boolean,
    as_long,
    blank_to_null,
    cell_text,
    col,
    contains_ignore_case,
    format_double,
    is_blank,
    is_filled,
    is_number,
    is_text,
    once,
    parse_double,
    regex_replace,
    row_hash,
    trim_controls,
)
from cleanframe.operators.labels import encode
from cleanframe.operators.split import mark_split
from cleanframe.operators.state import HIDDEN, SortKey, State, Statistics
from cleanframe.plans.spec import Op, SpecError, Step, numeric_literal


def drop_missing_rows(state: State, step: Step, stats: Statistics) -> State:
    """E1"""
    df = state.df
    for c in state.columns:
        # The NULL test alone reaches the file scan.
        df = df.filter(col(c).isNotNull())
        if is_text(state.dtype(c)):
            df = df.filter(is_filled(col(c)))
    return state.with_df(df)


def _fill_number(field: str):
    def fill(state: State, step: Step, stats: Statistics) -> State:
        c, dtype = col(step.column), state.dtype(step.column)
        value = stats.value(step.column, field)
        if is_text(dtype):
            return state.with_column(
                step.column, F.when(is_filled(c), c).otherwise(format_double(value))
            )
        if is_number(dtype):
            value = F.when(~F.isnan(value), value)
            return state.with_column(step.column, F.coalesce(c.cast("double"), value))
        return state

    return fill


def fill_mode(state: State, step: Step, stats: Statistics) -> State:
    """E4"""
    c, dtype = col(step.column), state.dtype(step.column)
    value = stats.value(step.column, "mode").try_cast(dtype)
    return state.with_column(step.column, F.when(is_blank(c, dtype), value).otherwise(c))


def fill_custom(state: State, step: Step, stats: Statistics) -> State:
    """E5: a parameter that is no value of a typed column leaves its cells missing."""
    c, dtype = col(step.column), state.dtype(step.column)
    value = F.lit(step.param).cast("string").try_cast(dtype)
    return state.with_column(step.column, F.when(is_blank(c, dtype), value).otherwise(c))


def remove_duplicates(state: State, step: Step, stats: Statistics) -> State:
    """Whole-row distinct. The kept copy is the first one in row order."""
    columns = state.columns
    group = [state.group] if state.group else []
    cells = [blank_to_null(col(c), state.dtype(c)).alias(c) for c in columns]
    hidden = [c for c in state.df.columns if c.startswith(HIDDEN) and c != state.group]
    df = state.df.select(*group, *cells, *[col(h) for h in hidden])
    if not hidden:
        return state.with_df(df.dropDuplicates())
    order = state.row_order()
    payload = F.struct(*[col(h) for h in hidden]).alias("payload")
    first = F.struct(payload) if order is None else F.struct(order.alias("order"), payload)
    kept = df.groupBy(*[col(c) for c in [*group, *columns]]).agg(F.min(first).alias(f"{HIDDEN}first"))
    return state.with_df(
        kept.select(
            *[col(c) for c in [*group, *columns]],
            *[F.col(f"{HIDDEN}first")["payload"][h].alias(h) for h in hidden],
        )
    )


def remove_outliers(state: State, step: Step, stats: Statistics) -> State:
    """Numeric cells outside the fences go; missing, text and NaN cells stay."""
    c, dtype = col(step.column), state.dtype(step.column)
    q1, q3 = stats.value(step.column, "q1"), stats.value(step.column, "q3")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)

    if not is_text(dtype):
        # Plain comparisons, which reach the file scan; NaN lies above infinity.
        v = col(step.column) if is_number(dtype) else parse_double(c, dtype)
        outside = (v < low) | ((v > high) & (v <= float("inf")))
        if not state.group and stats.raw(step.column, "q1") is None:
            return state
        return state.with_df(state.df.filter(v.isNull() | low.isNull() | ~outside))

    def inside(v: Column) -> Column:
        return F.coalesce(F.isnan(v) | v.between(low, high), F.lit(True))

    return state.with_df(state.df.filter(once(once(c, parse_double), inside)))


def _scale(state: State, step: Step, centre: Column, width: Column) -> State:
    """`(x - centre) / width`; where the width is 0 or unknown the column stays as it is."""
    column = step.column
    c, dtype = col(column), state.dtype(column)
    scaled = (parse_double(c, dtype) - centre) / F.nullif(width, F.lit(0.0))
    if is_number(dtype):
        flat = F.coalesce(width == 0, F.lit(True))
        return state.with_column(column, F.when(flat, c.cast("double")).otherwise(scaled))
    if not is_text(dtype):
        return state
    return state.with_column(column, once(c, lambda x: _scaled_text(x, centre, width)))


def _scaled_text(x: Column, centre: Column, width: Column) -> Column:
    def shown(d: Column) -> Column:
        # A NaN result is missing: the empty text, while NULL would give the cell back.
        return F.when(F.isnan(d), "").otherwise(format_double(d))

    scaled = (parse_double(x) - centre) / F.nullif(width, F.lit(0.0))
    return F.coalesce(once(scaled, shown), x)


def normalize_minmax(state: State, step: Step, stats: Statistics) -> State:
    """E8"""
    low, spread = stats.value(step.column, "low"), stats.value(step.column, "spread")
    return _scale(state, step, low, spread)


def normalize_zscore(state: State, step: Step, stats: Statistics) -> State:
    """E9"""
    mean, sd = stats.value(step.column, "mean"), stats.value(step.column, "sd")
    return _scale(state, step, mean, sd)


def normalize_robust(state: State, step: Step, stats: Statistics) -> State:
    """E10"""
    q1, median, q3 = (stats.value(step.column, f) for f in ("q1", "median", "q3"))
    return _scale(state, step, median, q3 - q1)


def cast_column(state: State, step: Step, stats: Statistics) -> State:
    """Cells that cannot be cast become NULL; blank text stays missing."""
    c, dtype = col(step.column), state.dtype(step.column)
    target = (step.param or "").lower()
    if target in ("int", "integer"):
        value = as_long(c, dtype)
    elif target in ("float", "double"):
        value = parse_double(c, dtype)
    elif target in ("boolean", "bool"):
        value = as_boolean(c, dtype)
    elif target in ("string", "str"):
        text = cell_text(c, dtype)
        value = F.when(is_blank(text), text).otherwise(trim_controls(text))
    else:
        return state
    return state.with_column(step.column, value)


def train_test_split(state: State, step: Step, stats: Statistics) -> State:
    """Adds `split_set` where asked for; else the table passes unchanged."""
    if not state.split:
        return state
    columns = tuple(state.columns)
    hashed = row_hash(state.df, list(columns))
    return state.with_df(mark_split(state.df, hashed, stats.cuts[columns]))


def label_encode(state: State, step: Step, stats: Statistics) -> State:
    """E13"""
    codes = stats.codes[step.column]
    return state.with_df(encode(state.df, step.column, codes, group=state.group))


def one_hot_encode(state: State, step: Step, stats: Statistics) -> State:
    """Dummies in place of the column, ordered by value."""
    values = stats.categories[step.column]
    others = set(state.df.columns) - {step.column}
    names = unique_names([f"{step.column}_{v}" for v in values], others)
    text = cell_text(col(step.column), state.dtype(step.column))
    dummies = [
        F.coalesce((text == F.lit(v)).cast("int"), F.lit(0)).alias(n)
        for v, n in zip(values, names)
    ]
    kept: list[Column] = []
    for c in state.df.columns:
        kept += dummies if c == step.column else [col(c)]
    return state.with_df(state.df.select(*kept))


def unique_names(names: list[str], taken: set[str]) -> list[str]:
    """Names as given, later or colliding ones with `_2`, `_3`, ... appended."""
    used = {t.lower() for t in taken}
    result = []
    for base in names:
        name, n = base, 2
        while name.lower() in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name.lower())
        result.append(name)
    return result


def sort_column(state: State, step: Step, stats: Statistics) -> State:
    """By number where every filled cell is one, else by text; missing cells last."""
    c, dtype = col(step.column), state.dtype(step.column)
    at = len(state.sorts)
    if not is_text(dtype):
        keys = {f"{HIDDEN}sort{at}": c}
    else:
        numeric = stats.value(step.column, "all_numeric")
        keys = {
            f"{HIDDEN}sort{at}n": F.when(numeric, parse_double(c)),
            f"{HIDDEN}sort{at}t": F.when(~numeric, blank_to_null(c)),
        }
        if not state.group:
            wanted = "n" if stats.raw(step.column, "all_numeric") else "t"
            keys = {k: v for k, v in keys.items() if k.endswith(wanted)}
    added = tuple(SortKey(k, step.ascending(), nulls_last=True) for k in keys)
    return replace(state, df=state.df.withColumns(keys), sorts=added + state.sorts)


def filter_rows(state: State, step: Step, stats: Statistics) -> State:
    """Rows whose cell is missing stay."""
    operator, target = step.filter_parts()
    c, dtype = col(step.column), state.dtype(step.column)
    literal = numeric_literal(target)
    if operator not in (">", "<", ">=", "<=", "==", "!=", "contains"):
        return state
    if operator == "contains":
        keep = is_blank(c, dtype) | contains_ignore_case(cell_text(c, dtype), target)
    elif is_number(dtype) and literal is not None:
        # Plain comparisons, which reach the file scan.
        keep = c.isNull() | _typed_comparison(c, dtype, operator, literal)
    elif operator in ("==", "!="):
        value = F.lit(target) if is_text(dtype) else F.lit(target).try_cast(dtype)
        same = F.coalesce(c == value, F.lit(False))
        keep = is_blank(c, dtype) | (same if operator == "==" else ~same)
    else:
        v = once(c, parse_double) if is_text(dtype) else parse_double(c, dtype)
        keep = once(v, lambda x: _compares(x, operator, target))
    return state.with_df(state.df.filter(keep))


def _typed_comparison(
    c: Column, dtype: T.DataType, operator: str, value: int | float
) -> Column:
    compared = {
        ">": c > value,
        "<": c < value,
        ">=": c >= value,
        "<=": c <= value,
        "==": c == value,
        "!=": c != value,
    }[operator]
    if operator in (">", ">=") and isinstance(dtype, (T.FloatType, T.DoubleType)):
        # NaN lies above infinity, and a comparison with NaN is false here.
        return compared & (c <= float("inf"))
    return compared


def _compares(v: Column, operator: str, target: str) -> Column:
    """Numeric comparison; cells (or a target) that are no numbers count as matching."""
    t = parse_double(F.lit(target))
    compared = {">": v > t, "<": v < t, ">=": v >= t, "<=": v <= t}[operator]
    # Spark orders NaN above every number; a comparison with NaN is false here.
    ordered = F.when(F.isnan(v) | F.isnan(t), False).otherwise(compared)
    return F.when(v.isNull() | t.isNull(), True).otherwise(ordered)


def replace_regex(state: State, step: Step, stats: Statistics) -> State:
    """E17"""
    rule = step.regex_rule()
    text = cell_text(col(step.column), state.dtype(step.column))
    return state.with_column(step.column, regex_replace(text, rule.pattern, rule.replacement))


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


def category_values(
    df: DataFrame, column: str, limit: int | None, order: Column | None = None
) -> list[str]:
    """The distinct filled texts of a column, by value or by first appearance.

    They become columns of the result; more than `limit` of them is an error where one is given.
    """
    dtype = df.schema[column].dataType
    text = cell_text(blank_to_null(col(column), dtype), dtype).alias("v")
    if order is None:
        found = df.select(text).filter(F.col("v").isNotNull()).distinct()
    else:
        cells = df.select(text, order.alias("at")).filter(F.col("v").isNotNull())
        found = cells.groupBy("v").agg(F.min("at").alias("at")).orderBy("at", "v")
    rows = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise SpecError(f"{column} has more than {limit} values to encode as columns")
    values = [r["v"] for r in rows]
    return values if order is not None else sorted(values, key=lambda s: s.encode("utf-16-be"))
