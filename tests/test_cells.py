import math

import pytest
from pyspark.sql import functions as F

from cleanframe.functions import cells

NUMBERS = {
    "1e3": 1000.0, " 5 ": 5.0, "\t7\n": 7.0, "1d": 1.0, "1f": 1.0, "0x1p3": 8.0, ".5": 0.5, "+5": 5.0,
    "-0.0": -0.0, "1e999": math.inf, "Infinity": math.inf, "-Infinity": -math.inf, "NaN": math.nan,
    " NaN ": math.nan, "nan": None, "inf": None, "infinity": None, "abc": None, "1_0": None, "": None,
    "12,5": None, "n1": None, "InfinityNaN": None, "5.": 5.0, ".": None, "1e": None, "0x.8p1": 1.0, "0x1": None,
    "-1.5e-3": -0.0015, "1 2": None, "--1": None, "1.2.3": None, "+Infinity": math.inf, "-NaN": math.nan,
    "0x1.8p0": 1.5, "0x1.p1d": 2.0, "9" * 400: math.inf, "1" * 5000 + "x": None, "\u0661": None, "1\u00a0": None,
}


def same(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == b


def evaluate(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_double(spark):
    got = evaluate(spark, list(NUMBERS), cells.parse_double)
    for (text, want), have in zip(NUMBERS.items(), got):
        assert same(want, have), text


def test_blank_is_javas_idea_of_white_space(spark):
    values = ["", " ", "\t\n", " ", " ", "\u0085", "a", " a ", None, "\n\n"]
    got = evaluate(spark, values, cells.is_blank)
    assert got == [True, True, True, True, False, False, False, False, True, True]


@pytest.mark.parametrize(
    "number, text",
    [
        (5.0, "5.0"), (0.1234565, "0.123457"), (-0.0, "-0.0"), (-1e-9, "-0.0"), (1e20, "1" + "0" * 20 + ".0"),
        (math.inf, "Infinity"), (math.nan, None), (None, None), (123456.7, "123456.7"), (1 / 3, "0.333333"),
        (100.0, "100.0"), (0.0005, "0.0005"), (9999999.5, "9999999.5"), (-2.5, "-2.5"),
    ],
)
def test_format_double(spark, number, text):
    assert evaluate(spark, [number], cells.format_double, "double") == [text]


def test_format_double_agrees_with_the_formatter(spark):
    d = (F.rand(1) - 0.5) * F.pow(F.lit(10.0), F.rand(2) * 12 - 4)
    df = spark.range(50_000).select(d.alias("d"))
    fixed = F.regexp_replace(F.format_string("%.6f", "d"), r"(\.\d+?)0+$", "$1")
    assert df.filter(cells.format_double(F.col("d")) != fixed).count() == 0


def test_as_long_saturates(spark):
    values = ["3.7", "-3.7", "1e30", "-1e30", "NaN", "x", " 8 "]
    got = evaluate(spark, values, lambda c: cells.as_long(c, cells.T.StringType()))
    assert got == [3, -3, cells.LONG_MAX, cells.LONG_MIN, 0, None, 8]


def test_row_text_quotes_like_a_composite_literal(spark):
    df = spark.createDataFrame([(1, 'a,"b\\', None), (2, "", "x y")], "a int, b string, c string")
    got = [r[0] for r in df.select(cells.row_text(df, df.columns)).collect()]
    assert got == ['(1,"a,""b\\\\",)', '(2,"","x y")']


def test_descending_text_reverses_the_order(spark):
    words = ["", "a", "ab", "b", "é", "zz", "z", "A", "a b", "中"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    up = [r["w"] for r in df.orderBy("w").collect()]
    down = [r["w"] for r in df.orderBy(cells.descending_text(F.col("w"))).collect()]
    assert down == up[::-1]


def test_flat_text_and_trim(spark):
    assert evaluate(spark, ["a\tb\r\nc"], cells.flat_text) == ["a b  c"]
    assert evaluate(spark, ["\x00 a b \t", " x"], cells.trim_controls) == ["a b", " x"]
