"""Readers, writers and row limits: S1-S4, K1, K2, L1, U1."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from catalog.registry import LINEITEM, every, lineitem, orders, query, table
from cleanframe.session import scratch_path
from cleanframe.sources import readers, writers

TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"

_DOCUMENTS = f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang,
  md5(nullif({TRIM.format('text')}, '')) AS digest FROM documents"""


@query(_DOCUMENTS)
def csv_round_trip(spark, sf_dir):
    """Whole documents, with their line breaks, quotes and commas, through CSV files."""
    path = scratch_path(spark, "documents.csv")
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    back = readers.read_table(spark, path, "csv")
    return back.select("doc_id", "lang", F.md5("text").alias("digest"))


# Documents per file of the query below.
DOCUMENTS_PER_FILE = 2_000


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, '5" pipe ' || doc_id AS note,
  md5(nullif({TRIM.format('text')}, '')) AS digest FROM documents""")
def csv_line_breaks_and_stray_quotes(spark, sf_dir):
    """Cells with line breaks and cells with a quote in the middle, in splits of files; some files have no line breaks."""
    path = scratch_path(spark, "pipes.csv")
    docs = table(spark, sf_dir, "documents")
    cell = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.concat(F.lit('5" pipe '), F.col("doc_id").cast("string")), cell)
    plain = ~F.contains("text", F.lit("\n"))
    lines = docs.select(F.floor(F.col("doc_id") / DOCUMENTS_PER_FILE).alias("file"), plain.alias("plain"), line.alias("line"))
    bodies = lines.groupBy("file", "plain").agg(F.concat_ws("\n", F.collect_list("line")).alias("body"))
    content = F.concat(F.lit("doc_id,note,text\n"), "body").alias("value")
    bodies.select(content, "file", "plain").repartition("file", "plain").write.partitionBy("file", "plain").text(path)
    back = readers.read_table(spark, f"{path}/*/*/*", "csv")
    return back.select("doc_id", "note", F.md5("text").alias("digest"))


@query(f"""WITH {LINEITEM} SELECT nullif(trim(l_returnflag), '') AS l_returnflag, count(*) AS n
FROM li GROUP BY 1""")
def csv_single_column(spark, sf_dir):
    """Rows whose only cell is missing are rows."""
    path = scratch_path(spark, "flags.csv")
    writers.write_csv(lineitem(spark, sf_dir).select("l_returnflag"), path)
    return readers.read_csv(spark, path).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 19 <> 0 THEN o_orderpriority END AS o_orderpriority,
  o_orderstatus FROM orders""")
def csv_blank_cells(spark, sf_dir):
    path = scratch_path(spark, "orders.csv")
    writers.write_csv(orders(spark, sf_dir), path)
    return readers.read_csv(spark, path)


@query("""SELECT row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS position,
  CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer""")
def csv_row_positions(spark, sf_dir):
    """Rows of a file in the order in which they were written."""
    from cleanframe.operators.ordering import with_position

    path = scratch_path(spark, "customer.csv")
    key = F.col("c_custkey").cast("string")
    writers.write_csv(table(spark, sf_dir, "customer").select(key.alias("c_custkey")).orderBy(key), path)
    df = readers.read_csv(spark, path, position=True)
    return with_position(df, [F.col(readers.POSITION)], "position").select("position", "c_custkey")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  md5(translate(text, chr(9) || chr(13) || chr(10), '   ')) AS digest FROM documents""")
def tsv_flat_cells(spark, sf_dir):
    """TSV lines hold one row each, however many line breaks the cells had."""
    path = scratch_path(spark, "documents.tsv")
    writers.write_tsv(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    cells = F.split("value", "\t")
    lines = spark.read.text(path).filter(F.col("value") != "doc_id\ttext")
    return lines.select(cells[0].alias("doc_id"), F.md5(cells[1]).alias("digest"))


# Orders per file: bounds what one task gathers to write a JSON array or a workbook.
PER_FILE = 5_000


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 19 <> 0 THEN o_orderpriority END AS o_orderpriority,
  o_orderstatus FROM orders""")
def json_arrays(spark, sf_dir):
    """Files that hold an array of objects; keys are absent where cells are missing."""
    path = scratch_path(spark, "orders.json")
    objects = orders(spark, sf_dir).select(
        F.floor(F.col("o_orderkey") / PER_FILE).alias("file"),
        F.to_json(F.struct("o_totalprice", "o_orderkey", "o_orderpriority", "o_orderstatus")).alias("o"),
    )
    arrays = objects.groupBy("file").agg(F.concat_ws(",\n", F.collect_list("o")).alias("body"))
    array = F.concat(F.lit("["), "body", F.lit("]")).alias("value")
    # One file per array: a file is read as a whole.
    arrays.select(array, "file").repartition("file").write.partitionBy("file").text(path)
    return readers.read_table(spark, f"{path}/*/*", "json")


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
  CAST(value AS VARCHAR) AS value FROM events""")
def json_lines(spark, sf_dir):
    path = scratch_path(spark, "events.json")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    df = readers.read_json(spark, path)
    return df.withColumn("event_id", F.col("event_id").cast("bigint"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id0, CAST(user_id AS VARCHAR) AS "Id1", event_type FROM events""")
def json_keys_by_case(spark, sf_dir):
    """Keys that differ in case only are columns of their own."""
    path = scratch_path(spark, "cases.json")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    keys = [("id", "event_id"), ("Id", "user_id"), ("event_type", "event_type")]
    members = [F.concat(F.lit(f'"{k}":'), quoted(c)) for k, c in keys]
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("value"))
    lines.write.text(path)
    return readers.read_json(spark, path)


@query("""SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, md5(text) AS digest
  FROM conversations""")
def json_pretty_arrays(spark, sf_dir):
    """Objects that span lines are put together, each in its split."""
    path = scratch_path(spark, "conversations.json")
    shown = F.to_json(F.struct("conv_id", "turn", "text"), {"pretty": "true"})
    objects = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / PER_FILE).alias("file"), shown.alias("o")
    )
    arrays = objects.groupBy("file").agg(F.concat_ws(",\n", F.collect_list("o")).alias("body"))
    array = F.concat(F.lit("["), "body", F.lit("]")).alias("value")
    arrays.select(array, "file").repartition("file").write.partitionBy("file").text(path)
    back = readers.read_json(spark, f"{path}/*/*")
    return back.select("conv_id", "turn", F.md5("text").alias("digest"))


def _workbook(rows) -> bytes:
    """A minimal workbook with inline texts, numbers and booleans."""

    def cell(v):
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    return _book("".join("<row>" + "".join(cell(v) for v in row) + "</row>" for row in rows))


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _book(body: str, more: dict[str, str] | None = None, comment: bytes = b"") -> bytes:
    """A workbook whose only sheet has the rows `body`; `more` are further parts."""
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{office}"><sheets>'
        '<sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}">'
        '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
    } | (more or {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
        book.comment = comment
    return out.getvalue()


def _workbook_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [
        (int(k), float(t), p, s == "F")
        for k, t, p, s in zip(
            pdf["o_orderkey"], pdf["o_totalprice"], pdf["o_orderpriority"], pdf["o_orderstatus"]
        )
    ]
    header = ("o_orderkey", "o_totalprice", "o_orderpriority", "finished")
    return pd.DataFrame([(f"orders-{key[0]}.xlsx", _workbook([header, *rows]))], columns=["path", "content"])


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
       ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 19 <> 0 THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS finished FROM orders""")
def workbook_rows(spark, sf_dir):
    """A workbook per PER_FILE orders, made and read back inside tasks."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keyed = orders(spark, sf_dir).withColumn("file", F.floor(F.col("o_orderkey") / PER_FILE))
    books = keyed.groupBy("file").applyInPandas(_workbook_of, "path string, content binary")
    names = ["o_orderkey", "o_totalprice", "o_orderpriority", "finished"]
    return readers.workbook_rows(books, names)


# Day zero of the serial numbers by which workbooks keep dates.
DAY_ZERO = "1899-12-30"


def _stored_book_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A workbook as office programs write it: shared strings, date styles, formulas with their values, error cells."""
    shared: dict[str, int] = {}

    def text(at: str, v: str) -> str:
        return f'<c r="{at}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'

    header = ("o_orderkey", "placed", "day", "twice", "name", "o_orderpriority", "finished")
    rows = ['<row r="1">' + "".join(text(f"{c}1", h) for c, h in zip("ABCDEFG", header)) + "</row>"]
    for r, (k, day, p, s) in enumerate(zip(pdf["o_orderkey"], pdf["day"], pdf["o_orderpriority"], pdf["o_orderstatus"]), 2):
        cells = [
            f'<c r="A{r}"><v>{k}</v></c>',
            f'<c r="B{r}" s="1"><v>{day + k % 86_400 / 86_400!r}</v></c>',
            f'<c r="C{r}" s="1"><f>INT(B{r})</f><v>{day}</v></c>',
            f'<c r="D{r}"><f>A{r}*2</f><v>{2 * k}</v></c>',
            f'<c r="E{r}" t="str"><f>"no. "&amp;A{r}</f><v>no. {k}</v></c>',
            f'<c r="F{r}" t="e"><v>#N/A</v></c>' if p is None else text(f"F{r}", p),
        ]
        if s == "F":  # others have no cell there
            cells.append(f'<c r="G{r}" t="b"><v>1</v></c>')
        rows.append(f'<row r="{r}">' + "".join(cells) + "</row>")
    items = "".join(f'<si><t xml:space="preserve">{escape(v)}</t></si>' for v in shared)
    more = {
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">{items}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
    }
    # The line end that the text writer adds is the comment at the end of the archive.
    return pd.DataFrame([(key[0], _book("".join(rows), more, b"\n")[:-1])], columns=["file", "content"])


@query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) + to_seconds(o_orderkey % 86400) AS t FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderkey % 60 = 0 THEN strftime(t, '%Y-%m-%dT%H:%M') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S') END AS placed,
  CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) AS day,
  CAST(2 * o_orderkey AS VARCHAR) AS twice, 'no. ' || o_orderkey AS name,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 19 <> 0 THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderstatus = 'F' THEN 'true' END AS finished FROM o""")
def workbook_files(spark, sf_dir):
    """A workbook file per PER_FILE orders, with dates, shared strings, formulas and error cells, read by `read_table`."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    path = scratch_path(spark, "workbooks")
    priority = F.when(~every("o_orderkey", 7), F.when(every("o_orderkey", 19), " ").otherwise(F.col("o_orderpriority")))
    keyed = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / PER_FILE).alias("file"),
        "o_orderkey",
        F.datediff("o_orderdate", F.lit(DAY_ZERO).cast("date")).alias("day"),
        priority.alias("o_orderpriority"),
        "o_orderstatus",
    )
    books = keyed.groupBy("file").applyInPandas(_stored_book_of, "file long, content binary")
    # A row for each file; its bytes are written as they are.
    books.select(F.col("content").cast("string").alias("value"), "file").repartition("file").write.partitionBy("file").text(path)
    return readers.read_table(spark, f"{path}/*/*", "xlsx")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100")
def preview_rows(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return readers.preview(df, 100, ["c_acctbal", "c_custkey"])


@query("""SELECT c_custkey AS id, c_name AS name FROM customer
  UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def append_rows(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return readers.append_rows(customers, suppliers)
