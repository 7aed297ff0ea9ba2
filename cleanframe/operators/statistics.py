"""Column statistics, for whole tables or per group, in as few scans as possible.

Results are keyed by `(*group, column)`, where `group` is empty for a whole
table. They are small: one entry per column, times the number of groups, which
callers bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cleanframe.functions.cells import (
    FALSE_WORDS,
    TRUE_WORDS,
    blank_to_null,
    cell_text,
    col,
    is_text,
    parse_double,
)
from cleanframe.operators.quantiles import WEIBULL6, Summary, quantiles
from cleanframe.session import written

# Columns per aggregation job, so that generated code stays compilable.
COLUMNS_PER_JOB = 40

QUARTILES = [0.25, 0.5, 0.75]

# Longer texts are counted by this many leading characters and a digest.
PREFIX = 64
_MARK = "\u0000"


@dataclass(frozen=True)
class Moments:
    """Statistics over the cells that parse as numbers."""

    rows: int
    filled: int  # cells that are not blank
    numeric: int  # cells that parse, NaN included
    n: int  # numeric cells without NaN
    mean: float | None
    sd: float | None  # sample deviation, 0 for a single cell
    low: float | None
    high: float | None
    boolean: bool  # every filled cell is a boolean word

    @property
    def all_numeric(self) -> bool:
        return self.numeric == self.filled

    @property
    def spread(self) -> float | None:
        return None if self.low is None else self.high - self.low

    @property
    def summary(self) -> Summary:
        return Summary(self.n, self.low, self.high)


def number(df: DataFrame, name: str, strict: bool = False) -> Column:
    """A column's cells as doubles; `strict` raises on text that is no number."""
    dtype = df.schema[name].dataType
    return col(name).cast("double") if strict else parse_double(col(name), dtype)


def filled(df: DataFrame, name: str, strict: bool = False) -> Column:
    """A column with its missing cells as NULL; `strict` takes only NULL as missing."""
    return col(name) if strict else blank_to_null(col(name), df.schema[name].dataType)


def moments(
    df: DataFrame,
    columns: list[str],
    group: str | None = None,
    strict: bool = False,
    words: bool = False,
) -> dict[tuple, Moments]:
    """A1 and the counts of P1/P2, all columns of a chunk in one aggregation.

    Boolean words are looked for in text columns, and only if `words` asks for it.
    """
    result: dict[tuple, Moments] = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        chunk = columns[start : start + COLUMNS_PER_JOB]
        cells = []
        for i, name in enumerate(chunk):
            dtype = df.schema[name].dataType
            cells.append(number(df, name, strict).alias(f"v{i}"))
            cells.append(filled(df, name, strict).isNotNull().alias(f"f{i}"))
            cells.append(_is_other_word(col(name), dtype, words).alias(f"w{i}"))
        keys = [col(group).alias("g")] if group else []
        aggs = [F.count("*").alias("rows")]
        for i in range(len(chunk)):
            v = F.col(f"v{i}")
            real = F.when(~F.isnan(v), v)
            aggs += [
                F.count_if(F.col(f"f{i}")).alias(f"filled{i}"),
                F.count(v).alias(f"numeric{i}"),
                F.count(real).alias(f"n{i}"),
                F.avg(v).alias(f"mean{i}"),
                F.when(F.count(v) == 1, F.when(~F.isnan(F.max(v)), 0.0))
                .otherwise(F.stddev_samp(v))
                .alias(f"sd{i}"),
                F.min(real).alias(f"low{i}"),
                F.max(real).alias(f"high{i}"),
                F.count_if(F.col(f"f{i}") & F.col(f"w{i}")).alias(f"other{i}"),
            ]
        cells = df.select(*keys, *cells)
        rows = (cells.groupBy("g").agg(*aggs) if group else cells.agg(*aggs)).collect()
        for r in rows:
            for i, name in enumerate(chunk):
                key = (r["g"], name) if group else (name,)
                result[key] = Moments(
                    rows=r["rows"],
                    filled=r[f"filled{i}"],
                    numeric=r[f"numeric{i}"],
                    n=r[f"n{i}"],
                    mean=r[f"mean{i}"],
                    sd=r[f"sd{i}"],
                    low=r[f"low{i}"],
                    high=r[f"high{i}"],
                    boolean=r[f"other{i}"] == 0,
                )
    return result


def _is_other_word(c: Column, dtype: T.DataType, words: bool) -> Column:
    """Does the cell hold anything but a boolean word?"""
    if not words or not is_text(dtype):
        return F.lit(not isinstance(dtype, T.BooleanType))
    return ~F.coalesce(F.lower(c).isin(TRUE_WORDS + FALSE_WORDS), F.lit(False))


def long_numbers(
    df: DataFrame, columns: list[str], group: str | None = None, strict: bool = False
) -> DataFrame:
    """The numeric cells of `columns` as rows `([g,] c, v)`, without NULL and NaN."""
    keys = [col(group).alias("g")] if group else []
    names = [f"c{i}" for i in range(len(columns))]
    cells = df.select(*keys, *[number(df, n, strict).alias(a) for n, a in zip(columns, names)])
    long = cells.unpivot(["g"] if group else [], names, "c", "v")
    return long.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def quartiles(
    df: DataFrame,
    columns: list[str],
    stats: dict[tuple, Moments],
    method: str = WEIBULL6,
    group: str | None = None,
    strict: bool = False,
) -> dict[tuple, list[float | None]]:
    """A2: first quartile, median and third quartile of each column."""
    keys = ["g", "c"] if group else ["c"]
    result = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        chunk = columns[start : start + COLUMNS_PER_JOB]
        alias = {name: f"c{i}" for i, name in enumerate(chunk)}
        summaries = {
            (*key[:-1], alias[key[-1]]): m.summary for key, m in stats.items() if key[-1] in alias
        }
        values = long_numbers(df, chunk, group, strict)
        if any(is_text(df.schema[name].dataType) for name in chunk):
            # The rounds below read parsed numbers instead of parsing the texts again each time.
            values = written(values, "numbers")
        for key, q in quantiles(values, summaries, QUARTILES, method, keys).items():
            result[(*key[:-1], chunk[int(key[-1][1:])])] = q
    return result


def compact(text: Column) -> Column:
    """Short texts as they are, long ones as prefix and digest of the whole text."""
    digest = F.concat(F.substring(text, 1, PREFIX), F.lit(_MARK), F.md5(text))
    return F.when(F.length(text) > PREFIX, digest).otherwise(text)


def _kind(dtype: T.DataType) -> str:
    """The type in which cells of a column are counted."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    return "double" if isinstance(dtype, (T.FloatType, T.DoubleType)) else "string"


def value_counts(
    df: DataFrame,
    columns: list[str],
    group: str | None = None,
    strict: bool = False,
    first: Column | None = None,
) -> DataFrame:
    """Rows `([g,] c, value, n[, first])`: how often each filled cell of `columns` occurs.

    The columns must be of one kind; they share one scan. Counting combines on
    the map side, so a value that fills a third of a column costs one row per
    task in the shuffle, and texts are counted in compact form, so that whole
    documents are not shuffled.
    """
    keys = [col(group).alias("g")] if group else []
    extra = [first.alias("first")] if first is not None else []
    names = [f"c{i}" for i in range(len(columns))]
    cells = []
    for name, a in zip(columns, names):
        dtype, value = df.schema[name].dataType, filled(df, name, strict)
        kind = _kind(dtype)
        if kind != "string":
            value = value.cast(kind)
        else:
            value = compact(value) if is_text(dtype) else cell_text(value, dtype)
        cells.append(value.alias(a))
    ids = ["g"] * len(keys) + ["first"] * len(extra)
    long = df.select(*keys, *extra, *cells).unpivot(ids, names, "c", "value")
    aggs = [F.count("*").alias("n")]
    if extra:
        aggs.append(F.min("first").alias("first"))
    return (
        long.filter(F.col("value").isNotNull()).groupBy(*["g"] * len(keys), "c", "value").agg(*aggs)
    )


def frequency_summary(
    df: DataFrame,
    columns: list[str],
    group: str | None = None,
    strict: bool = False,
    first: Column | None = None,
) -> dict[tuple, tuple[int, str | None]]:
    """A3-A5: distinct filled cells and the text of the most frequent one, per column.

    Ties go to the first appearance where `first` gives an order, else to the
    smallest value.
    """
    result = {}
    kinds = {name: _kind(df.schema[name].dataType) for name in columns}
    for kind in dict.fromkeys(kinds.values()):
        chunk = [c for c in columns if kinds[c] == kind]
        counts = value_counts(df, chunk, group, strict, first)
        order = [F.col("first")] if first is not None else []
        best = F.min(F.struct((-F.col("n")).alias("n"), *order, "value")).alias("best")
        keys = ["g", "c"] if group else ["c"]
        found = counts.groupBy(*keys).agg(F.count("*").alias("distinct"), best)
        shown = found.withColumn("text", F.col("best.value").cast("string"))
        for r in shown.collect():
            name, value = chunk[int(r["c"][1:])], r["text"]
            if kind == "string" and value[PREFIX : PREFIX + 1] == _MARK:
                rest = df.filter(col(group) == r["g"]) if group else df
                value = _whole_text(rest, name, strict, r["best"], first)
            result[(r["g"], name) if group else (name,)] = (r["distinct"], value)
    return result


def _whole_text(df: DataFrame, name: str, strict: bool, best, first: Column | None) -> str:
    """The text behind a compact form; texts that tie on their prefix are compared whole."""
    text = filled(df, name, strict)
    same = df.filter(F.substring(text, 1, PREFIX) == best["value"][:PREFIX])
    if first is not None:
        # Appearance decided already, and the digest names the text.
        return same.filter(compact(text) == best["value"]).select(F.min(text)).first()[0]
    counts = same.groupBy(text.alias("value")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") == -best["n"]).select(F.min("value")).first()[0]
