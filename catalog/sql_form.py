"""The seventeen steps, SQL form (Q0-Q17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.cells import ROW_TEXT
from catalog.lenient import KEYS
from catalog.registry import LINEITEM, ORDERS, every, lineitem, orders, query, rounded, table
from cleanframe.operators.ordering import number_rows
from cleanframe.plans.pipeline import run_steps
from cleanframe.plans.spec import Op, Step


def _sql(df, *steps, **options):
    return run_steps(df, *steps, form="sql", **options)


@query(f"WITH {LINEITEM} SELECT * FROM li")
def sql_empty_pipeline(spark, sf_dir):
    return _sql(lineitem(spark, sf_dir))


@query(f"WITH {LINEITEM} SELECT * FROM li WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL")
def sql_drop_missing_rows(spark, sf_dir):
    return _sql(lineitem(spark, sf_dir), Step(Op.DROP_MISSING_ROWS))


def _discounts(spark, sf_dir, step):
    df = _sql(lineitem(spark, sf_dir), step)
    return rounded(df.select("l_orderkey", "l_linenumber", "l_discount"), "l_discount")


@query(f"""WITH {LINEITEM} SELECT {KEYS},
  round(coalesce(l_discount, (SELECT avg(l_discount) FROM li)), 6) AS l_discount FROM li""")
def sql_fill_missing_mean(spark, sf_dir):
    return _discounts(spark, sf_dir, Step(Op.FILL_MISSING_MEAN, "l_discount"))


@query(f"""WITH {LINEITEM} SELECT {KEYS}, round(coalesce(l_discount,
  (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY l_discount) FROM li)), 6) AS l_discount FROM li""")
def sql_fill_missing_median(spark, sf_dir):
    return _discounts(spark, sf_dir, Step(Op.FILL_MISSING_MEDIAN, "l_discount"))


@query(f"""WITH {LINEITEM} SELECT {KEYS}, round(coalesce(l_discount,
  (SELECT l_discount FROM li WHERE l_discount IS NOT NULL GROUP BY l_discount
   ORDER BY count(*) DESC, l_discount LIMIT 1)), 6) AS l_discount FROM li""")
def sql_fill_missing_mode(spark, sf_dir):
    return _discounts(spark, sf_dir, Step(Op.FILL_MISSING_MODE, "l_discount"))


@query(f"""WITH {LINEITEM} SELECT {KEYS}, round(coalesce(l_discount, 0.5), 6) AS l_discount FROM li""")
def sql_fill_missing_custom(spark, sf_dir):
    return _discounts(spark, sf_dir, Step(Op.FILL_MISSING_CUSTOM, "l_discount", "0.5"))


@query(f"WITH {LINEITEM} SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM li")
def sql_remove_duplicates(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("l_quantity", "l_discount", "l_returnflag")
    return _sql(df, Step(Op.REMOVE_DUPLICATES))


@query(f"""WITH {LINEITEM}, sq AS (SELECT l_orderkey, l_linenumber, l_discount * l_discount AS d FROM li),
s AS (SELECT quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3 FROM sq)
SELECT l_orderkey, l_linenumber, round(d, 6) AS d FROM sq, s
WHERE d BETWEEN q1 - 0.5 * 3 * (q3 - q1) AND q3 + 0.5 * 3 * (q3 - q1)""")
def sql_remove_outliers_iqr(spark, sf_dir):
    square = F.col("l_discount") * F.col("l_discount")
    df = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", square.alias("d"))
    return rounded(_sql(df, Step(Op.REMOVE_OUTLIERS_IQR, "d")), "d")


def _scaled(spark, sf_dir, op):
    """Two columns with spread, and one constant column, which turns NULL."""
    df = lineitem(spark, sf_dir).withColumn("flat", F.lit(3.5))
    columns = ("l_discount", "l_extendedprice", "flat")
    df = _sql(df, *[Step(op, c) for c in columns])
    return rounded(df.select("l_orderkey", "l_linenumber", *columns), *columns)


_SCALE = f"WITH {LINEITEM}, fl AS (SELECT *, 3.5 AS flat FROM li) SELECT {KEYS}, "


@query(_SCALE + ", ".join(
    f"round((1.0 * ({c} - min({c}) OVER ())) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 6) AS {c}"
    for c in ("l_discount", "l_extendedprice")) + ", CAST(NULL AS DOUBLE) AS flat FROM fl")
def sql_normalize_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, Op.NORMALIZE_MINMAX)


@query(_SCALE + ", ".join(
    f"round((1.0 * ({c} - avg({c}) OVER ())) / nullif(stddev_samp({c}) OVER (), 0), 6) AS {c}"
    for c in ("l_discount", "l_extendedprice")) + ", CAST(NULL AS DOUBLE) AS flat FROM fl")
def sql_normalize_zscore(spark, sf_dir):
    return _scaled(spark, sf_dir, Op.NORMALIZE_ZSCORE)


@query(f"WITH {LINEITEM}, s AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.5) AS {c}_2, quantile_cont({c}, 0.75) AS {c}_3"
    for c in ("l_discount", "l_extendedprice")) + f" FROM li) SELECT {KEYS}, " + ", ".join(
    f"round((1.0 * ({c} - {c}_2)) / nullif({c}_3 - {c}_1, 0), 6) AS {c}"
    for c in ("l_discount", "l_extendedprice")) + ", CAST(NULL AS DOUBLE) AS flat FROM li, s")
def sql_normalize_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, Op.NORMALIZE_ROBUST)


@query("""SELECT event_id, CAST(value AS INTEGER) AS value, CAST(event_id % 2 = 0 AS BOOLEAN) AS even,
  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS number, CAST(user_id AS VARCHAR) AS user_id FROM events""")
def sql_cast(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        "event_id",
        "value",
        (F.col("event_id") % 2 == 0).cast("string").alias("even"),
        F.regexp_extract("props", "[0-9]+", 0).alias("number"),
        "user_id",
    )
    return _sql(
        df,
        Step(Op.CAST_COLUMN, "value", "int"),
        Step(Op.CAST_COLUMN, "even", "boolean"),
        Step(Op.CAST_COLUMN, "number", "float"),
        Step(Op.CAST_COLUMN, "user_id", "string"),
    )


@query(f"""SELECT o_orderkey, o_orderpriority, CASE WHEN cume_dist() OVER (ORDER BY md5({ROW_TEXT})) <= 0.7
  THEN 'train' ELSE 'test' END AS split_set FROM orders""")
def sql_train_test_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return _sql(df, Step(Op.TRAIN_TEST_SPLIT, None, "0.7"))


@query("""WITH c AS (SELECT event_type || ',' || (user_id % 20) AS kind FROM events)
SELECT kind, CASE WHEN cume_dist() OVER (ORDER BY md5('("' || kind || '")')) <= 0.5
  THEN 'train' ELSE 'test' END AS split_set FROM c""")
def sql_train_test_split_copies(spark, sf_dir):
    """Few distinct rows with many copies each: copies stay on one side."""
    kind = F.concat_ws(",", "event_type", (F.col("user_id") % 20).cast("string"))
    df = table(spark, sf_dir, "events").select(kind.alias("kind"))
    return _sql(df, Step(Op.TRAIN_TEST_SPLIT, None, "0.5"))


@query(f"""WITH {ORDERS} SELECT o_orderkey,
  dense_rank() OVER (ORDER BY o_orderpriority NULLS LAST) - 1 AS o_orderpriority FROM od""")
def sql_label_encode(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return _sql(df, Step(Op.LABEL_ENCODE, "o_orderpriority"))


@query("""SELECT o_orderkey, dense_rank() OVER (ORDER BY o_totalprice) - 1 AS o_totalprice FROM orders""")
def sql_label_encode_many_values(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return _sql(df, Step(Op.LABEL_ENCODE, "o_totalprice"))


@query(f"WITH {ORDERS} SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS o_orderpriority_{n}"
    for v, n in (("1-URGENT", "1_URGENT"), ("2-HIGH", "2_HIGH"), ("3-MEDIUM", "3_MEDIUM"),
                 ("4-NOT SPECIFIED", "4_NOT_SPECIFIED"), ("5-LOW", "5_LOW"))) + " FROM od")
def sql_one_hot_encode(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderpriority", "o_orderkey")
    return _sql(df, Step(Op.ONE_HOT_ENCODE, "o_orderpriority"), order_by="o_orderkey")


def _positions(spark, sf_dir, direction):
    balance = F.when(~every("c_custkey", 9), F.col("c_acctbal"))
    df = table(spark, sf_dir, "customer").select("c_custkey", balance.alias("balance"))
    df = _sql(df, Step(Op.SORT_COLUMN, "balance", direction), order_by="c_custkey")
    return number_rows(df, "position").select("c_custkey", "position")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END
  ASC NULLS LAST, c_custkey) - 1 AS position FROM customer""")
def sql_sort_ascending(spark, sf_dir):
    return _positions(spark, sf_dir, "ascending")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END
  DESC NULLS FIRST, c_custkey) - 1 AS position FROM customer""")
def sql_sort_descending(spark, sf_dir):
    return _positions(spark, sf_dir, "descending")


@query(f"WITH {LINEITEM} SELECT * FROM li WHERE l_discount >= 0.05 AND l_quantity <> 10 AND l_returnflag = 'A'")
def sql_filter(spark, sf_dir):
    return _sql(
        lineitem(spark, sf_dir),
        Step.filter("l_discount", ">=", "0.05"),
        Step.filter("l_quantity", "!=", "10"),
        Step.filter("l_returnflag", "==", "A"),
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%R_D%'")
def sql_filter_contains(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return _sql(df, Step.filter("p_name", "contains", "R_D"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '([a-z]+)[.,]', '<\1>', 'g')) AS digest FROM documents""")
def sql_regex_replace(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = _sql(df, Step.regex("text", "([a-z]+)[.,]", "<$1>"))
    return df.select("doc_id", F.md5("text").alias("digest"))
