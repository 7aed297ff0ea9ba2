"""Cell expressions F1-F8 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import LINEITEM, PRICES, lineitem, prices, query, table
from cleanframe.functions import cells


@query(f"WITH {LINEITEM} SELECT l_orderkey, l_linenumber, "
       "l_returnflag IS NULL OR trim(l_returnflag) = '' AS blank FROM li")
def cell_is_blank(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", cells.is_blank(F.col("l_returnflag")).alias("blank"))


@query(f"WITH {PRICES} SELECT l_orderkey, l_linenumber, v AS number FROM pr")
def cell_parse_double(spark, sf_dir):
    df = prices(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", cells.parse_double(F.col("price")).alias("number"))


@query("""SELECT l_orderkey, l_linenumber,
  regexp_replace(regexp_replace(printf('%.6f', l_extendedprice / 7), '0+$', ''), '\\.$', '.0') AS shown
FROM lineitem""")
def cell_format_double(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    shown = cells.format_double(F.col("l_extendedprice") / 7)
    return df.select("l_orderkey", "l_linenumber", shown.alias("shown"))


@query("SELECT doc_id, contains(lower(text), 'the') AS found FROM documents")
def cell_contains(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", cells.contains_ignore_case(F.col("text"), "The").alias("found"))


@query(r"""SELECT conv_id, turn, md5(regexp_replace('  ' || text || chr(10) || ' ',
  '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS trimmed FROM conversations""")
def cell_trim(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    padded = F.concat(F.lit("  "), "text", F.lit("\n "))
    return df.select("conv_id", "turn", F.md5(cells.trim_controls(padded)).alias("trimmed"))


@query(r"""SELECT doc_id, md5(CASE WHEN trim(text) = '' THEN text
  ELSE regexp_replace(text, '([a-z]+) ([a-z]+)', '\2 \1', 'g') END) AS swapped FROM documents""")
def cell_regex_replace(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    swapped = cells.regex_replace(F.col("text"), "([a-z]+) ([a-z]+)", "$2 $1")
    return df.select("doc_id", F.md5(swapped).alias("swapped"))


@query("SELECT doc_id, md5(translate(text, chr(9) || chr(13) || chr(10), '   ')) AS flat FROM documents")
def cell_flat_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", F.md5(cells.flat_text(F.col("text"))).alias("flat"))


ROW_TEXT = r"""'(' || o_orderkey || ',' || CASE
    WHEN o_orderpriority IS NULL THEN ''
    WHEN o_orderpriority = '' OR regexp_matches(o_orderpriority, '[,()"\\\s]')
    THEN '"' || replace(replace(o_orderpriority, '\', '\\'), '"', '""') || '"'
    ELSE o_orderpriority END || ')'"""


@query(f"SELECT o_orderkey, md5({ROW_TEXT}) AS digest FROM orders")
def cell_row_hash(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    digest = cells.row_hash(df, ["o_orderkey", "o_orderpriority"])
    return df.select("o_orderkey", digest.alias("digest"))
