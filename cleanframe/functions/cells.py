"""Cell-level expressions: blank test, number parsing and formatting, text forms.

Everything here builds plain Spark columns, so the expressions fuse with their
neighbours. A filter pushed below a projection repeats the projected expression
at every mention, and chains of steps would multiply; expensive ones are
therefore bound with `once`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Words read as true and as false, compared in lower case.
TRUE_WORDS = ["true", "1", "yes", "y"]
FALSE_WORDS = ["false", "0", "no", "n"]

# How a double may be written, white space around it included.
_DECIMAL = r"(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?"
_HEX = r"0[xX](?:[0-9a-fA-F]++\.?[0-9a-fA-F]*+|\.[0-9a-fA-F]++)[pP][+-]?\d++"
_DOUBLE = (
    r"\A[\x00-\x20]*+[+-]?(?:NaN|Infinity|(?:" + _HEX + "|" + _DECIMAL + r")[fFdD]?)[\x00-\x20]*+\z"
)

# The characters that trimming removes.
CONTROLS = "".join(chr(i) for i in range(0x21))

LONG_MAX = 2**63 - 1
LONG_MIN = -(2**63)


def col(name: str) -> Column:
    """Column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f(c)` with `c` evaluated a single time per row, however often `f` mentions it."""
    return F.transform(F.array(c), lambda x: f(x))[0]


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_blank(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """NULL, or text without a single non-whitespace character."""
    if not is_text(dtype):
        return c.isNull()
    return ~is_filled(c)


def is_filled(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\P{javaWhitespace}"), F.lit(False))


def blank_to_null(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    if not is_text(dtype):
        return c
    return F.when(is_filled(c), c)


def parse_double(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """the cell as a double, NULL where the text is no number.

    The pattern comes first because `try_cast` also reads words such as `inf`,
    and because it pays for every text that is no number with an exception.
    """
    if is_number(dtype):
        return c.cast("double")
    if not is_text(dtype):
        return F.lit(None).cast("double")
    return F.when(c.rlike(_DOUBLE), c.try_cast("double"))


def format_double(d: Column) -> Column:
    """six decimals, trailing zeros cut but one decimal kept; NaN is missing.

    Between the bounds the shortest text of the rounded double has this form
    already; only very small and very large numbers need a formatter.
    """
    fixed = F.regexp_replace(F.format_string("%.6f", d), r"(\.\d+?)0+$", "$1")
    plain = (F.abs(d) >= 0.001) & (F.abs(d) < 9_999_999)
    return F.when(plain, F.round(d, 6).cast("string")).when(d.isNotNull() & ~F.isnan(d), fixed)


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a cell as the lenient form sees it."""
    if is_text(dtype):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def trim_controls(c: Column) -> Column:
    """cut every character up to U+0020 from both ends."""
    return F.btrim(c, F.lit(CONTROLS))


def contains_ignore_case(c: Column, needle: str) -> Column:
    """literal, case-insensitive substring test."""
    return F.contains(F.lower(c), F.lower(F.lit(needle)))


def as_boolean(c: Column, dtype: T.DataType) -> Column:
    """Only the listed words, untrimmed, anything else is NULL."""
    if isinstance(dtype, T.BooleanType):
        return c
    word = F.lower(cell_text(c, dtype))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def as_long(c: Column, dtype: T.DataType) -> Column:
    """Through double, cut toward zero, saturating; NaN becomes 0."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    d = parse_double(c, dtype)
    return (
        F.when(F.isnan(d), F.lit(0).cast("bigint"))
        .when(d >= float(LONG_MAX), F.lit(LONG_MAX).cast("bigint"))
        .when(d <= float(LONG_MIN), F.lit(LONG_MIN).cast("bigint"))
        .otherwise(d.try_cast("bigint"))
    )


def flat_text(c: Column) -> Column:
    """tab, CR and LF inside a cell become one space each."""
    return F.translate(c, "\t\r\n", "   ")


def regex_replace(c: Column, pattern: str, replacement: str | None) -> Column:
    """replace all; `$1` style groups; blank cells are left alone."""
    replaced = F.regexp_replace(c, F.lit(pattern), F.lit(replacement or ""))
    return F.when(is_filled(c), replaced).otherwise(c)


def row_text(df: DataFrame, names: list[str]) -> Column:
    """A row as one composite-value literal: `(a,"b c",)`; NULL is empty.

    A field is quoted when empty or when it holds a comma, parenthesis,
    quote, backslash or white space; quotes and backslashes are doubled.
    """
    fields = []
    for name in names:
        dtype, s = df.schema[name].dataType, col(name).cast("string")
        if is_number(dtype):
            fields.append(F.coalesce(s, F.lit("")))
            continue
        doubled = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""'))
        quoted = F.concat(F.lit('"'), doubled, F.lit('"'))
        needs_quotes = s.rlike(r'[,()"\\\s]|\A\z')
        fields.append(F.coalesce(F.when(needs_quotes, quoted).otherwise(s), F.lit("")))
    return F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")"))


def row_hash(df: DataFrame, names: list[str]) -> Column:
    """F8: md5 of the row text."""
    return F.md5(row_text(df, names))


def descending_text(c: Column) -> Column:
    """A text key whose ascending order is the descending order of `c`.

    Hex digits are mirrored and closed by `G`, which sorts after every digit,
    so that a prefix sorts after its extensions.
    """
    mirrored = F.translate(F.hex(c.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(mirrored, F.lit("G"))
