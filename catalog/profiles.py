"""Profiles, aggregates and chart data: P1-P7, A1-A6, H1, H2, X1, X2."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    LINEITEM,
    PRICES,
    lineitem,
    orders,
    prices,
    quartiles6,
    query,
    rounded,
    table,
)
from cleanframe.operators import charts, profile as p
from cleanframe.operators.quantiles import LINEAR7, WEIBULL6
from cleanframe.operators.statistics import frequency_summary, moments, quartiles
from cleanframe.session import small_table, table_schema
from pyspark.sql import types as T

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")


def _mode(column: str, source: str = "li") -> str:
    return f"""(SELECT {column} FROM {source} WHERE {column} IS NOT NULL
      AND trim(CAST({column} AS VARCHAR)) <> '' GROUP BY {column}
      ORDER BY count(*) DESC, {column} LIMIT 1)"""


def _numeric_profile(column: str) -> str:
    return f"""
  SELECT '{column}' AS name, 'NUMERIC' AS data_type, count(*) AS total_count,
         count(*) - count({column}) AS null_count,
         round((count(*) - count({column})) * 100.0 / count(*), 6) AS null_percent,
         count(DISTINCT {column}) AS unique_count,
         CAST({_mode(column)} AS VARCHAR) AS most_common,
         round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std_dev,
         min({column}) AS "min", max({column}) AS "max",
         round(any_value(q.median), 6) AS median, round(any_value(q.q1), 6) AS q1,
         round(any_value(q.q3), 6) AS q3,
         round(any_value(q.q3 - q.q1), 6) AS iqr,
         round(any_value(q.q1 - 1.5 * (q.q3 - q.q1)), 6) AS lower_fence,
         round(any_value(q.q3 + 1.5 * (q.q3 - q.q1)), 6) AS upper_fence
  FROM li CROSS JOIN ({quartiles6('li', column)}) q"""


_TEXT_PROFILE = f"""
  SELECT 'l_returnflag', 'TEXT', count(*), count(*) - count(nullif(trim(l_returnflag), '')),
         round((count(*) - count(nullif(trim(l_returnflag), ''))) * 100.0 / count(*), 6),
         count(DISTINCT nullif(trim(l_returnflag), '')), {_mode('l_returnflag')},
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM li"""

PROFILE = " UNION ALL ".join([*[_numeric_profile(c) for c in NUMBERS], _TEXT_PROFILE])


def _profile(spark, sf_dir):
    return p.profile(lineitem(spark, sf_dir), [*NUMBERS, "l_returnflag"])


@query(f"WITH {LINEITEM} {PROFILE}")
def profile_columns(spark, sf_dir):
    numbers = ("null_percent", "mean", "std_dev", "median", "q1", "q3", "iqr", "lower_fence", "upper_fence")
    return rounded(_profile(spark, sf_dir).drop("position"), *numbers)


_KINDS = """
kinds AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Yes' WHEN event_id % 3 = 1 THEN 'n' END AS answer,
         CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END AS bit,
         CASE WHEN event_id % 2 = 0 THEN ' ' END AS nothing,
         event_type, CAST(value AS VARCHAR) AS amount
  FROM events)"""


@query("""SELECT * FROM (VALUES ('event_id', 'NUMERIC'), ('answer', 'BOOLEAN'), ('bit', 'NUMERIC'),
  ('nothing', 'UNKNOWN'), ('event_type', 'TEXT'), ('amount', 'NUMERIC')) t(name, data_type)
  WHERE (SELECT count(*) FROM events) > 0""")
def profile_infer_type(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    third, half = F.col("event_id") % 3, F.col("event_id") % 2
    df = e.select(
        "event_id",
        F.when(third == 0, "Yes").when(third == 1, "n").alias("answer"),
        F.when(half == 0, "1").otherwise("0").alias("bit"),
        F.when(half == 0, " ").alias("nothing"),
        "event_type",
        F.col("value").cast("string").alias("amount"),
    )
    return p.profile(df, exact_distinct=False).select("name", "data_type")


def _shown(expression: str) -> str:
    return f"""CASE WHEN {expression} IS NULL THEN '—' WHEN {expression} = floor({expression})
      THEN CAST(CAST({expression} AS BIGINT) AS VARCHAR) ELSE CAST(CAST(CAST(CAST({expression}
      AS VARCHAR) AS DECIMAL(38, 18)) AS DECIMAL(38, 4)) AS VARCHAR) END"""


@query(f"""WITH {LINEITEM}, p AS (
  SELECT 'l_quantity' AS name, count(*) AS n, count(l_quantity) AS k, count(DISTINCT l_quantity) AS d,
         avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, min(l_quantity) AS lo,
         max(l_quantity) AS hi, median(l_quantity) AS med, CAST({_mode('l_quantity')} AS VARCHAR) AS best FROM li
  UNION ALL
  SELECT 'l_discount', count(*), count(l_discount), count(DISTINCT l_discount),
         avg(l_discount), stddev_samp(l_discount), min(l_discount),
         max(l_discount), median(l_discount), CAST({_mode('l_discount')} AS VARCHAR) FROM li)
SELECT name AS "Column", 'NUMERIC' AS "Type", n AS "Total", n - k AS "Nulls",
  printf('%.1f%%', (n - k) * 100.0 / n) AS "Null %", d AS "Unique", {_shown('mean')} AS "Mean",
  {_shown('med')} AS "Median", {_shown('sd')} AS "Std Dev", {_shown('lo')} AS "Min",
  {_shown('hi')} AS "Max", best AS "Most Common" FROM p""")
def profile_display(spark, sf_dir):
    return p.display_table(p.profile(lineitem(spark, sf_dir), ["l_quantity", "l_discount"]))


@query(f"""WITH {LINEITEM}, q AS ({quartiles6('li', 'l_extendedprice')}),
m AS (SELECT avg(l_extendedprice) AS mean, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM li)
SELECT 'l_extendedprice' AS name, printf(
  'Mean %#.4g   Median %#.4g   Q1 %#.4g   Q3 %#.4g   Min %#.4g   Max %#.4g   Missing %.1f%%',
  mean, median, q1, q3, lo, hi, 0.0::DOUBLE) AS stats FROM q, m""")
def profile_stats_strip(spark, sf_dir):
    return p.stats_strip(p.profile(lineitem(spark, sf_dir), ["l_extendedprice"]))


@query("""SELECT * FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount')) t(name)
  WHERE (SELECT count(*) FROM lineitem) > 0""")
def profile_numeric_columns(spark, sf_dir):
    return p.numeric_columns(_profile(spark, sf_dir)).select("name")


@query(f"""WITH {PRICES} SELECT count(v) AS n, round(avg(v), 6) AS mean,
  round(stddev_samp(v), 6) AS sd, min(v) AS low, max(v) AS high FROM pr""")
def column_statistics(spark, sf_dir):
    m = moments(prices(spark, sf_dir), ["price"])["price",]
    schema = table_schema(
        n=T.LongType(), mean=T.DoubleType(), sd=T.DoubleType(), low=T.DoubleType(), high=T.DoubleType()
    )
    return rounded(small_table(spark, [(m.n, m.mean, m.sd, m.low, m.high)], schema), "mean", "sd")


def _quartile_frame(spark, df, columns, method):
    q = quartiles(df, columns, moments(df, columns), method)
    schema = table_schema(
        name=T.StringType(), q1=T.DoubleType(), median=T.DoubleType(), q3=T.DoubleType()
    )
    return rounded(small_table(spark, [(c, *q[c,]) for c in columns], schema), "q1", "median", "q3")


@query(f"WITH {LINEITEM} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 "
    f"FROM ({quartiles6('li', c)})" for c in NUMBERS))
def quantiles_weibull(spark, sf_dir):
    return _quartile_frame(spark, lineitem(spark, sf_dir), list(NUMBERS), WEIBULL6)


@query(f"WITH {LINEITEM} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, round(quantile_cont({c}, 0.25), 6) AS q1, "
    f"round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM li"
    for c in NUMBERS))
def quantiles_linear(spark, sf_dir):
    return _quartile_frame(spark, lineitem(spark, sf_dir), list(NUMBERS), LINEAR7)


_FREQUENCY = table_schema(name=T.StringType(), unique_count=T.LongType(), most_common=T.StringType())


@query(f"""WITH {LINEITEM}
SELECT 'l_returnflag' AS name, count(DISTINCT l_returnflag) AS unique_count,
       {_mode('l_returnflag')} AS most_common FROM li WHERE trim(l_returnflag) <> ''
UNION ALL SELECT 'l_discount', count(DISTINCT l_discount), CAST({_mode('l_discount')} AS VARCHAR) FROM li
UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey), CAST({_mode('l_orderkey')} AS VARCHAR) FROM li""")
def mode_and_distinct(spark, sf_dir):
    columns = ["l_returnflag", "l_discount", "l_orderkey"]
    found = frequency_summary(lineitem(spark, sf_dir), columns)
    return small_table(spark, [(c, *found[c,]) for c in columns], _FREQUENCY)


@query("""SELECT 'o_totalprice' AS name, count(DISTINCT o_totalprice) AS unique_count,
  (SELECT CAST(o_totalprice AS VARCHAR) FROM orders GROUP BY o_totalprice
   ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1) AS most_common FROM orders""")
def mode_by_first_appearance(spark, sf_dir):
    df = orders(spark, sf_dir)
    found = frequency_summary(df, ["o_totalprice"], first=F.col("o_orderkey"))
    return small_table(spark, [("o_totalprice", *found["o_totalprice",])], _FREQUENCY)


@query("SELECT count(*) AS row_count, 11 AS column_count FROM lineitem")
def table_size(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


@query(f"""WITH {PRICES}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM pr),
b AS (SELECT CASE WHEN v < hi THEN least(19, CAST(floor((v - lo) / (hi - lo) * 20) AS BIGINT)) ELSE 19 END AS bin
      FROM pr, s WHERE v IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT r.range AS bin, round(lo + r.range * ((hi - lo) / 20), 6) AS lower,
  round(CASE WHEN r.range = 19 THEN hi ELSE lo + (r.range + 1) * ((hi - lo) / 20) END, 6) AS upper,
  coalesce(n, 0) AS "count" FROM range(20) r CROSS JOIN s LEFT JOIN c ON c.bin = r.range""")
def histogram(spark, sf_dir):
    return rounded(charts.histogram(prices(spark, sf_dir), "price", 20), "lower", "upper")


_SPIKED = """CASE WHEN event_id % 50 = 0 THEN 'Infinity' WHEN event_id % 77 = 0 THEN '-Infinity' ELSE CAST(value AS VARCHAR) END"""


@query(f"""WITH e AS (SELECT CAST({_SPIKED} AS DOUBLE) AS v FROM events),
s AS (SELECT min(v) AS lo, max(v) AS hi FROM e WHERE isfinite(v)),
b AS (SELECT CASE WHEN v < lo THEN 0 WHEN v < hi THEN least(19, CAST(floor((v - lo) / (hi - lo) * 20) AS BIGINT)) ELSE 19 END AS bin
      FROM e, s WHERE v IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT r.range AS bin, round(lo + r.range * ((hi - lo) / 20), 6) AS lower,
  round(CASE WHEN r.range = 19 THEN hi ELSE lo + (r.range + 1) * ((hi - lo) / 20) END, 6) AS upper,
  coalesce(n, 0) AS "count" FROM range(20) r CROSS JOIN s LEFT JOIN c ON c.bin = r.range""")
def histogram_infinite_cells(spark, sf_dir):
    """Bins over the finite cells; infinite ones count at the ends."""
    spiked = F.when(F.col("event_id") % 50 == 0, "Infinity").when(F.col("event_id") % 77 == 0, "-Infinity").otherwise(F.col("value").cast("string"))
    return rounded(charts.histogram(table(spark, sf_dir, "events").select(spiked.alias("cell")), "cell", 20), "lower", "upper")


@query(f"WITH {PRICES} SELECT round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM pr")
def histogram_markers(spark, sf_dir):
    return rounded(charts.histogram_markers(prices(spark, sf_dir), "price"), "mean", "median")


@query(f"""WITH {LINEITEM} """ + " UNION ALL ".join(f"""
  SELECT '{c}' AS name, round(m.mean, 6) AS mean, round(median, 6) AS median, round(q1, 6) AS q1,
    round(q3, 6) AS q3, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 6) AS lower_whisker,
    round(least(hi, q3 + 1.5 * (q3 - q1)), 6) AS upper_whisker
  FROM ({quartiles6('li', c)}) q,
       (SELECT avg({c}) AS mean, min({c}) AS lo, max({c}) AS hi FROM li) m""" for c in NUMBERS))
def box_plot(spark, sf_dir):
    plot = charts.box_plot(_profile(spark, sf_dir))
    return rounded(plot, "mean", "median", "q1", "q3", "lower_whisker", "upper_whisker")


@query(f"WITH {PRICES} SELECT v AS value FROM pr WHERE v IS NOT NULL")
def chart_values(spark, sf_dir):
    return charts.chart_values(prices(spark, sf_dir), "price")
