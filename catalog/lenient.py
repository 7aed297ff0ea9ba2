"""The seventeen steps, lenient form."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.cells import ROW_TEXT
from catalog.registry import (
    LINEITEM,
    ORDERS,
    PRICES,
    every,
    lineitem,
    orders,
    prices,
    quartiles6,
    query,
    rounded,
    table,
)
from cleanframe.operators.ordering import number_rows
from cleanframe.operators.split import train_test_split
from cleanframe.plans.pipeline import fit, run_steps
from cleanframe.plans.spec import Op, PipelineSpec, Step

KEYS = "l_orderkey, l_linenumber"


@query(f"WITH {LINEITEM} SELECT * FROM li WHERE l_discount IS NOT NULL AND trim(l_returnflag) <> ''")
def drop_missing_rows(spark, sf_dir):
    return run_steps(lineitem(spark, sf_dir), Step(Op.DROP_MISSING_ROWS))


@query(f"""WITH {LINEITEM} SELECT {KEYS},
  round(coalesce(l_discount, (SELECT avg(l_discount) FROM li)), 6) AS l_discount FROM li""")
def fill_missing_mean(spark, sf_dir):
    df = run_steps(lineitem(spark, sf_dir), Step(Op.FILL_MISSING_MEAN, "l_discount"))
    return rounded(df.select("l_orderkey", "l_linenumber", "l_discount"), "l_discount")


@query(f"""WITH {PRICES} SELECT {KEYS}, CASE WHEN price IS NULL OR price = ' '
  THEN regexp_replace(printf('%.6f', (SELECT avg(v) FROM pr)), '0+$', '') ELSE price END AS price FROM pr""")
def fill_missing_mean_text(spark, sf_dir):
    return run_steps(prices(spark, sf_dir), Step(Op.FILL_MISSING_MEAN, "price"))


@query(f"""WITH {LINEITEM} SELECT {KEYS},
  coalesce(l_discount, (SELECT median(l_discount) FROM li)) AS l_discount FROM li""")
def fill_missing_median(spark, sf_dir):
    df = run_steps(lineitem(spark, sf_dir), Step(Op.FILL_MISSING_MEDIAN, "l_discount"))
    return df.select("l_orderkey", "l_linenumber", "l_discount")


@query(f"""WITH {LINEITEM} SELECT {KEYS}, coalesce(nullif(trim(l_returnflag), ''),
  (SELECT l_returnflag FROM li WHERE trim(l_returnflag) <> '' GROUP BY l_returnflag
   ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag FROM li""")
def fill_missing_mode(spark, sf_dir):
    df = run_steps(lineitem(spark, sf_dir), Step(Op.FILL_MISSING_MODE, "l_returnflag"))
    return df.select("l_orderkey", "l_linenumber", "l_returnflag")


@query(f"""WITH {LINEITEM} SELECT {KEYS}, coalesce(l_discount, 0.5) AS l_discount,
  coalesce(nullif(trim(l_returnflag), ''), 'none') AS l_returnflag FROM li""")
def fill_missing_custom(spark, sf_dir):
    df = run_steps(
        lineitem(spark, sf_dir),
        Step(Op.FILL_MISSING_CUSTOM, "l_discount", "0.5"),
        Step(Op.FILL_MISSING_CUSTOM, "l_returnflag", "none"),
    )
    return df.select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag")


@query(f"""WITH {LINEITEM} SELECT DISTINCT l_quantity, l_discount,
  nullif(trim(l_returnflag), '') AS l_returnflag FROM li""")
def remove_duplicates(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("l_quantity", "l_discount", "l_returnflag")
    return run_steps(df, Step(Op.REMOVE_DUPLICATES))


# The fourth power of the price has a long upper tail, so that some rows fall outside.
_POWERS = f"""{PRICES}, pw AS (SELECT l_orderkey, l_linenumber, v * v * v * v AS v FROM pr)"""


@query(f"""WITH {_POWERS}, q AS ({quartiles6('pw', 'v')})
SELECT l_orderkey, l_linenumber, round(pw.v / 1e12, 3) AS number FROM pw, q
WHERE pw.v IS NULL OR pw.v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def remove_outliers_iqr(spark, sf_dir):
    v = F.col("l_extendedprice")
    power = (
        F.when(every("l_orderkey", 11), None)
        .when(every("l_orderkey", 13), " ")
        .when(every("l_orderkey", 17), "n/a")
        .otherwise((v * v * v * v).cast("string"))
    )
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", power.alias("price"))
    kept = run_steps(df, Step(Op.REMOVE_OUTLIERS_IQR, "price"))
    shown = F.round(F.col("price").try_cast("double") / 1e12, 3)
    return kept.select("l_orderkey", "l_linenumber", shown.alias("number"))


def _scaled(spark, sf_dir, op):
    df = run_steps(lineitem(spark, sf_dir), Step(op, "l_discount"), Step(op, "l_extendedprice"))
    columns = ("l_discount", "l_extendedprice")
    return rounded(df.select("l_orderkey", "l_linenumber", *columns), *columns)


@query(f"""WITH {LINEITEM} SELECT {KEYS}, """ + ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}"
    for c in ("l_discount", "l_extendedprice")) + " FROM li")
def normalize_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, Op.NORMALIZE_MINMAX)


@query(f"""WITH {LINEITEM} SELECT {KEYS}, """ + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}"
    for c in ("l_discount", "l_extendedprice")) + " FROM li")
def normalize_zscore(spark, sf_dir):
    return _scaled(spark, sf_dir, Op.NORMALIZE_ZSCORE)


@query(f"""WITH {LINEITEM}, a AS ({quartiles6('li', 'l_discount')}),
b AS ({quartiles6('li', 'l_extendedprice')})
SELECT {KEYS}, round((l_discount - a.median) / (a.q3 - a.q1), 6) AS l_discount,
  round((l_extendedprice - b.median) / (b.q3 - b.q1), 6) AS l_extendedprice FROM li, a, b""")
def normalize_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, Op.NORMALIZE_ROBUST)


@query(f"""WITH {PRICES}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM pr)
SELECT {KEYS}, CASE WHEN v IS NULL THEN price ELSE
  regexp_replace(regexp_replace(printf('%.6f', (v - lo) / (hi - lo)), '0+$', ''), '\\.$', '.0') END AS price
FROM pr, s""")
def normalize_minmax_text(spark, sf_dir):
    return run_steps(prices(spark, sf_dir), Step(Op.NORMALIZE_MINMAX, "price"))


SIX_DECIMALS = """regexp_replace(regexp_replace(printf('%.6f', {}), '0+$', ''), '\\.$', '.0')"""


@query(f"""WITH {PRICES}, s AS (SELECT avg(v) AS mean, stddev_samp(v) AS sd FROM pr)
SELECT {KEYS}, CASE WHEN v IS NULL THEN price ELSE {SIX_DECIMALS.format('(v - mean) / sd')} END AS price FROM pr, s""")
def normalize_zscore_text(spark, sf_dir):
    return run_steps(prices(spark, sf_dir), Step(Op.NORMALIZE_ZSCORE, "price"))


@query(f"""WITH {PRICES}, q AS ({quartiles6('pr', 'v')})
SELECT {KEYS}, CASE WHEN v IS NULL THEN price ELSE {SIX_DECIMALS.format('(v - median) / (q3 - q1)')} END AS price
FROM pr, q""")
def normalize_robust_text(spark, sf_dir):
    return run_steps(prices(spark, sf_dir), Step(Op.NORMALIZE_ROBUST, "price"))


@query(f"SELECT {KEYS}, CASE WHEN l_linenumber = 7 THEN '9' ELSE '5' END AS x FROM lineitem")
def normalize_robust_text_no_iqr(spark, sf_dir):
    """Without a quartile range the column stays as it is, whatever its spread."""
    x = F.when(F.col("l_linenumber") == 7, "9").otherwise("5").alias("x")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x)
    return run_steps(df, Step(Op.NORMALIZE_ROBUST, "x"))


@query(f"""WITH {PRICES}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM pr WHERE l_orderkey % 2 = 0)
SELECT {KEYS}, CASE WHEN v IS NULL THEN price ELSE {SIX_DECIMALS.format('(v - lo) / (hi - lo)')} END AS price
FROM pr, s""")
def scaling_fitted_on_other_texts(spark, sf_dir):
    """Fitted on numbers only, applied to a table with words."""
    df = prices(spark, sf_dir)
    numbers = df.filter(every("l_orderkey", 2) & F.col("price").try_cast("double").isNotNull())
    return fit(numbers, PipelineSpec((Step(Op.NORMALIZE_MINMAX, "price"),))).transform(df)


@query(f"""WITH {ORDERS}, f AS (
  SELECT o_orderpriority AS p, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code
  FROM od WHERE trim(o_orderpriority) <> '' GROUP BY 1)
SELECT o_orderkey AS key, 'same' AS o_orderkey, CAST(code AS BIGINT) AS o_orderpriority
FROM od LEFT JOIN f ON o_orderpriority = p""")
def label_encode_after_rewriting_the_order(spark, sf_dir):
    """Rows keep the order they came in, also when a step overwrites the column that told it."""
    df = orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), "o_orderkey", "o_orderpriority")
    steps = (Step.regex("o_orderkey", "^.*$", "same"), Step(Op.LABEL_ENCODE, "o_orderpriority"))
    coded = run_steps(df, *steps, order_by="o_orderkey")
    return coded.withColumn("o_orderpriority", F.col("o_orderpriority").cast("bigint"))


@query(f"""WITH {ORDERS} SELECT o_orderkey AS key,
  row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS position FROM od""")
def sort_after_encoding_the_order(spark, sf_dir):
    df = orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), "o_orderkey", "o_orderstatus")
    steps = (Step(Op.CAST_COLUMN, "o_orderkey", "boolean"), Step(Op.SORT_COLUMN, "o_orderstatus", "ascending"))
    return number_rows(run_steps(df, *steps, order_by="o_orderkey"), "position").select("key", "position")


@query("SELECT '-0.0' AS zero, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def sort_negative_zeros(spark, sf_dir):
    """Few different rows, many copies of each: sorting changes no cell and drops no copy."""
    df = table(spark, sf_dir, "lineitem").select((F.abs("l_discount") * F.lit(-0.0)).alias("zero"), "l_returnflag")
    placed = run_steps(df, Step(Op.SORT_COLUMN, "l_returnflag", "ascending"))
    return placed.groupBy(F.col("zero").cast("string").alias("zero"), "l_returnflag").agg(F.count("*").alias("n"))


def _digits(spark, sf_dir):
    """Texts that are whole numbers, fractions, words, blank or missing."""
    digits = F.regexp_extract("props", "[0-9]+", 0)
    text = (
        F.when(every("event_id", 7), "bad")
        .when(every("event_id", 11), " ")
        .when(every("event_id", 13), None)
        .when(every("event_id", 5), F.concat(digits, F.lit(".75")))
        .when(every("event_id", 17), F.lit("-1e30"))
        .otherwise(digits)
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


_DIGITS = """
dg AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 11 = 0 THEN ' '
    WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN regexp_extract(props, '[0-9]+') || '.75'
    WHEN event_id % 17 = 0 THEN '-1e30' ELSE regexp_extract(props, '[0-9]+') END AS text
  FROM events)"""


@query(f"""WITH {_DIGITS} SELECT event_id, CASE WHEN text = '-1e30' THEN -9223372036854775808
  ELSE CAST(trunc(TRY_CAST(text AS DOUBLE)) AS BIGINT) END AS text FROM dg""")
def cast_integer(spark, sf_dir):
    return run_steps(_digits(spark, sf_dir), Step(Op.CAST_COLUMN, "text", "int"))


@query(f"WITH {_DIGITS} SELECT event_id, TRY_CAST(text AS DOUBLE) AS text FROM dg")
def cast_float(spark, sf_dir):
    return run_steps(_digits(spark, sf_dir), Step(Op.CAST_COLUMN, "text", "float"))


def _words(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("TRUE", "n", "Yes", "0", "t", " yes", "")])
    picked = F.element_at(words, (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", picked.alias("word"))


_WORDS = """
wd AS (SELECT event_id, ['TRUE', 'n', 'Yes', '0', 't', ' yes', ''][event_id % 7 + 1] AS word FROM events)"""


@query(f"""WITH {_WORDS} SELECT event_id, CASE WHEN lower(word) IN ('true', '1', 'yes', 'y') THEN TRUE
  WHEN lower(word) IN ('false', '0', 'no', 'n') THEN FALSE END AS word FROM wd""")
def cast_boolean(spark, sf_dir):
    return run_steps(_words(spark, sf_dir), Step(Op.CAST_COLUMN, "word", "boolean"))


@query(f"""WITH {_WORDS} SELECT event_id, trim(word) AS word FROM wd""")
def cast_string(spark, sf_dir):
    return run_steps(_words(spark, sf_dir), Step(Op.CAST_COLUMN, "word", "string"))


@query(f"WITH {_WORDS} SELECT event_id, word FROM wd")
def cast_unknown_type(spark, sf_dir):
    return run_steps(_words(spark, sf_dir), Step(Op.CAST_COLUMN, "word", "money"))


@query(f"""SELECT o_orderkey, o_orderpriority, CASE WHEN cume_dist() OVER (ORDER BY md5({ROW_TEXT})) <= 0.8
  THEN 'train' ELSE 'test' END AS split_set FROM orders""")
def train_test_split_rows(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return train_test_split(df, 0.8)


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def train_test_split_step(spark, sf_dir):
    """As a step of a lenient pipeline the split leaves the table unchanged."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return run_steps(df, Step(Op.TRAIN_TEST_SPLIT, None, "0.8"))


@query(f"""WITH {ORDERS}, c AS (
  SELECT o_orderpriority AS p, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code
  FROM od WHERE trim(o_orderpriority) <> '' GROUP BY 1)
SELECT o_orderkey, code AS o_orderpriority FROM od LEFT JOIN c ON o_orderpriority = p""")
def label_encode(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return run_steps(df, Step(Op.LABEL_ENCODE, "o_orderpriority"), order_by="o_orderkey")


@query("""WITH c AS (
  SELECT l_partkey AS p, row_number() OVER (ORDER BY min(l_extendedprice), l_partkey) - 1 AS code
  FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, code AS l_partkey FROM lineitem JOIN c ON l_partkey = p""")
def label_encode_many_values(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    step = Step(Op.LABEL_ENCODE, "l_partkey")
    return run_steps(df, step, order_by="l_extendedprice").drop("l_extendedprice")


@query(f"WITH {ORDERS} SELECT o_orderkey, " + ", ".join(
    f"CAST(coalesce(o_orderpriority = '{v}', FALSE) AS INTEGER) AS \"o_orderpriority_{v}\""
    for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM od")
def one_hot_encode(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return run_steps(df, Step(Op.ONE_HOT_ENCODE, "o_orderpriority"))


def _balances(spark, sf_dir):
    balance = F.when(every("c_custkey", 9), None).when(every("c_custkey", 10), "")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", balance.otherwise(F.col("c_acctbal").cast("string")).alias("balance")
    )


@query("""SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 10 <> 0
  THEN c_acctbal END ASC NULLS LAST, c_custkey) - 1 AS position FROM customer""")
def sort_ascending_numbers(spark, sf_dir):
    step = Step(Op.SORT_COLUMN, "balance", "ascending")
    df = run_steps(_balances(spark, sf_dir), step, order_by="c_custkey")
    return number_rows(df, "position").select("c_custkey", "position")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 10 <> 0
  THEN c_acctbal END DESC NULLS LAST, c_custkey) - 1 AS position FROM customer""")
def sort_descending_numbers(spark, sf_dir):
    step = Step(Op.SORT_COLUMN, "balance", "descending")
    df = run_steps(_balances(spark, sf_dir), step, order_by="c_custkey")
    return number_rows(df, "position").select("c_custkey", "position")


@query(f"""WITH {ORDERS} SELECT o_orderkey, row_number() OVER (ORDER BY
  nullif(trim(o_orderpriority), '') DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey) - 1 AS position
FROM od""")
def sort_stable_texts(spark, sf_dir):
    """A later sort keeps the order of an earlier one among equal cells."""
    df = run_steps(
        orders(spark, sf_dir),
        Step(Op.SORT_COLUMN, "o_totalprice", "ascending"),
        Step(Op.SORT_COLUMN, "o_orderpriority", "descending"),
        order_by="o_orderkey",
    )
    return number_rows(df, "position").select("o_orderkey", "position")


def _filtered(spark, sf_dir, operator, value):
    return run_steps(prices(spark, sf_dir), Step.filter("price", operator, value))


@query(f"WITH {PRICES} SELECT {KEYS}, price FROM pr WHERE v IS NULL OR v > 50000.5")
def filter_greater(spark, sf_dir):
    return _filtered(spark, sf_dir, ">", "50000.5")


@query(f"WITH {PRICES} SELECT {KEYS}, price FROM pr WHERE v IS NULL OR v <= 20000")
def filter_at_most(spark, sf_dir):
    return _filtered(spark, sf_dir, "<=", " 2e4 ")


@query(f"WITH {PRICES} SELECT {KEYS}, price FROM pr")
def filter_with_no_number(spark, sf_dir):
    return _filtered(spark, sf_dir, "<", "cheap")


@query(f"WITH {PRICES} SELECT {KEYS}, price FROM pr WHERE price IS NULL OR price = ' ' OR price = 'n/a'")
def filter_equal_text(spark, sf_dir):
    return _filtered(spark, sf_dir, "==", "n/a")


@query(f"WITH {LINEITEM} SELECT * FROM li WHERE l_discount IS NULL OR l_discount <> 0.05")
def filter_not_equal_number(spark, sf_dir):
    return run_steps(lineitem(spark, sf_dir), Step.filter("l_discount", "!=", "0.05"))


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')""")
def filter_contains(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return run_steps(df, Step.filter("p_name", "contains", "RED"))


@query(r"""SELECT c_custkey, regexp_replace(c_name, '(\w+)#0*(\d+)', '\2-\1', 'g') AS c_name FROM customer""")
def regex_replace(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return run_steps(df, Step.regex("c_name", r"(\w+)#0*(\d+)", "$2-$1"))
