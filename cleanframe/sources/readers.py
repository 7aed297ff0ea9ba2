"""Readers: every cell arrives as text, blank cells as NULL.

`position=True` adds the hidden column POSITION, which orders rows as they
stand in their files, also when a file is read in several splits.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import unquote

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cleanframe.functions.cells import CONTROLS, blank_to_null, col, is_filled, trim_controls
from cleanframe.operators.state import HIDDEN, POSITION
from cleanframe.plans.spec import SpecError
from cleanframe.sources import splits, xlsx

# These functions travel with their tasks, so executors need no installed package.
cloudpickle.register_pickle_by_value(xlsx)
cloudpickle.register_pickle_by_value(splits)

HEADER_JOBS = 16
FORMATS = ("csv", "xlsx", "json", "parquet")


def format_of(path: str) -> str:
    """The lower-cased extension decides."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." not in name:
        raise SpecError(f"the name tells no format: {name}")
    ext = name.rsplit(".", 1)[-1].lower()
    if ext not in FORMATS:
        raise SpecError(f"there is no reader for {ext} files")
    return ext


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by extension, or as `fmt`."""
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    return {"csv": read_csv, "xlsx": read_xlsx, "json": read_json}[fmt](spark, path, **options)


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def file_position() -> Column:
    """Rows of one split keep their order in the id; splits follow their offset."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def tidy(name: str) -> str:
    """A header without the white space that quotes may have kept."""
    return name.strip(CONTROLS) or name


@dataclass(frozen=True)
class CsvFile:
    path: str
    header: tuple[str, ...]
    multi_line: bool  # a quoted cell spans lines, so the file cannot be split
    fewest: int | None = None  # cells of the shortest row, where lines tell


def csv_header(spark: SparkSession, paths: list[str] | str, multi_line: bool = False) -> list[str]:
    """Column names of the first file; Spark reads no further than its first row."""
    reader = spark.read.options(
        header=True,
        multiLine=multi_line,
        escape='"',
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    return reader.csv(paths).columns


def header_names(line: str) -> list[str]:
    """The column names of a header line: empty and repeated ones get their place, as Spark's reader does it."""
    cells = [c.strip(CONTROLS) for c in next(csv.reader([line]))]
    repeated = {c for c, n in Counter(c.lower() for c in cells).items() if n > 1}
    return [f"_c{i}" if not c else f"{c}{i}" if c.lower() in repeated else c for i, c in enumerate(cells)]


def scan_csv(spark: SparkSession, paths: list[str]) -> list[CsvFile]:
    """Header of every file, whether it must be read as a whole, and its shortest row; one job for all files.

    Only a file whose header itself holds a line break needs a look of its own.
    """
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    bare = F.when(quotes > 0, F.regexp_replace(value, '"[^"]*"', "")).otherwise(value)
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        (F.col("_metadata.file_block_start") == 0).alias("head"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        (quotes % 2 == 1).cast("int").alias("odd"),
        F.when(is_filled(value), cells).alias("cells"),
    )
    first = F.when(F.col("head") & F.col("cells").isNotNull(), F.col("at"))
    found = lines.groupBy("path").agg(
        F.max("odd").alias("odd"), F.min("cells").alias("fewest"), F.min_by("value", first).alias("line")
    )

    def inspect(r) -> CsvFile:
        line, whole = r["line"], bool(r["odd"])
        if line is None:
            return CsvFile(r["path"], (), whole)
        if line.count('"') % 2 or line.startswith("\ufeff"):
            return CsvFile(r["path"], tuple(csv_header(spark, literal_path(unquote(r["path"])), whole)), whole)
        return CsvFile(r["path"], tuple(header_names(line)), whole, None if whole else r["fewest"])

    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        return list(pool.map(inspect, sorted(found.collect(), key=lambda r: r["path"])))


def literal_path(path: str) -> str:
    """The path with characters that globs give a meaning escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_csv(
    spark: SparkSession,
    paths: list[str] | str,
    multi_line: bool | None = None,
    position: bool = False,
    short_rows: str = "null",
) -> DataFrame:
    """Header row, trimmed cells, empty lines skipped, doubled quotes inside quotes.

    All files are read in splits. One pass over the text finds the files in which cells hold line breaks; their lines are
    joined to records first, each split with the quotes that are open at its start. `multi_line` saves the pass: False says
    that there are no such files, True reads every file as a whole. Files whose header differs from the first one's raise.
    `short_rows` says what a row shorter than the header does: `null` pads it, `error` raises.
    """
    broken = splits.broken_files(spark, paths) if multi_line is None else []
    names = csv_header(spark, paths, bool(multi_line or broken))
    if not names:
        raise SpecError(f"No CSV header found in {paths}")
    if not broken:
        return csv_frame(spark, paths, names, bool(multi_line), position, short_rows)
    plain = lambda path: unquote(re.sub(r"^file:/+", "/", path))
    joined = {plain(f) for f in broken}
    others = [literal_path(unquote(f)) for f in spark.read.text(paths).inputFiles() if plain(f) not in joined]
    frames = [joined_frame(spark, [literal_path(unquote(f)) for f in broken], names, position, short_rows)]
    if others:
        frames.append(csv_frame(spark, others, names, False, position, short_rows))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def joined_frame(spark: SparkSession, paths: list[str], names: list[str], position: bool, short_rows: str) -> DataFrame:
    """CSV files with line breaks in cells, read in splits."""
    checked = None if _renamed(names) else [n.lower() for n in names]

    def header(file: str, record: str) -> None:
        cells = [c.strip() for c in next(csv.reader([record.removeprefix("\ufeff")]))]
        if checked is not None and [c.lower() for c in cells] != checked:
            raise ValueError(f"the header of {file} is not that of the first file: {cells}")

    records = splits.csv_records(spark, paths, header)
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "columnNameOfCorruptRecord": _CORRUPT}
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(_CORRUPT, T.StringType())])
    # Positions are taken for names here, which may repeat in all but case.
    rows = records.select(F.struct("file", "block", "line").alias(POSITION), F.from_csv("record", fields.simpleString(), options).alias("r"))
    rows = rows.select(POSITION, "r.*")
    if short_rows == "error":
        rows = rows.withColumn("c0", F.when(~_is_short(names), F.col("c0")).otherwise(_raise()))
    cells = [blank_to_null(trim_controls(F.col(f"c{i}"))).alias(tidy(n)) for i, n in enumerate(names)]
    return rows.select(*cells, *([POSITION] if position else []))


def _renamed(names: list[str]) -> bool:
    """Did Spark rename empty or repeated headers? Then files cannot be checked by name."""
    stems = [n[: -len(str(i))] for i, n in enumerate(names) if n.endswith(str(i))]
    return "_c" in stems or len(set(stems)) < len(stems)


_CORRUPT = f"{HIDDEN}corrupt"
_END = "\u0001end"


def _is_short(names: list[str]) -> Column:
    """Does a row of the wrong length end before the header does?

    Parsed once more with an end mark appended, such a row shows the mark
    within the header's columns; a longer row, whose extra cells are ignored,
    does not.
    """
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv(F.concat(F.col(_CORRUPT), F.lit("," + _END)), fields, {"escape": '"'})
    marked = F.lit(False)
    for i in range(len(names)):
        marked = marked | F.coalesce(parsed[f"c{i}"] == _END, F.lit(False))
    return F.col(_CORRUPT).isNotNull() & marked


def _raise() -> Column:
    message = F.concat(F.lit("Row shorter than the header: "), F.col(_CORRUPT))
    return F.raise_error(message).cast("string")


def csv_frame(
    spark: SparkSession,
    paths: list[str] | str,
    names: list[str],
    multi_line: bool,
    position: bool = False,
    short_rows: str = "null",
    source: str | None = None,
) -> DataFrame:
    """CSV files that share the header `names`; `source` names a column for the file path."""
    raw = (
        spark.read.schema(text_schema(names))
        .option("header", True)
        .option("enforceSchema", _renamed(names))
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("columnNameOfCorruptRecord", _CORRUPT)
    )
    if short_rows == "error":
        raw = raw.schema(text_schema([*names, _CORRUPT])).csv(paths)
        raw = raw.withColumn(names[0], F.when(~_is_short(names), col(names[0])).otherwise(_raise()))
    else:
        raw = raw.csv(paths)
    extra = [file_position().alias(POSITION)] if position else []
    if source:
        extra.append(F.col("_metadata.file_path").alias(source))
    # Spark trims cells outside quotes only.
    cells = [blank_to_null(trim_controls(col(n))).alias(tidy(n)) for n in names]
    return raw.select(*cells, *extra)


@dataclass(frozen=True)
class JsonFile:
    path: str
    header: tuple[str, ...]
    whole: bool  # objects span lines and must be put together
    valid: bool


def _json_objects(spark: SparkSession, paths: list[str] | str, whole: bool) -> DataFrame:
    """Rows `(at, item, object, line)`: the objects of every file as JSON text.

    With `whole` a file is a JSON array whose objects span lines. Otherwise every line
    holds an object or nothing, and may add the brackets and commas of an array around them.
    """
    if whole:
        found = splits.json_objects(spark, [paths] if isinstance(paths, str) else paths)
        place = F.struct("file", "block", "line").alias("at")
        return found.select(place, F.col("line").alias("item"), "object", F.lit(None).cast("string").alias("line"))
    text = spark.read.text(paths).select("value", file_position().alias("at"))
    line = trim_controls(F.col("value"))
    inner = F.regexp_replace(F.regexp_replace(line, r"\A\[", ""), r"[,\]]\z", "")
    return text.select("at", F.col("at.line").alias("item"), trim_controls(inner).alias("object"), line.alias("line"))


def scan_json(spark: SparkSession, paths: list[str]) -> list[JsonFile]:
    """Object keys of every file in the order of their first appearance.

    Files with an object per line, bracketed as an array or not, are recognised
    in a pass over their lines; in the others objects are put together first.
    """
    by_line = _json_shapes(_json_objects(spark, paths, whole=False), by_line=True)
    rest = [literal_path(unquote(f.path)) for f in by_line if not f.valid]
    if not rest:
        return by_line
    whole = _json_shapes(_json_objects(spark, rest, whole=True), by_line=False)
    return [*[f for f in by_line if f.valid], *whole]


def _json_shapes(objects: DataFrame, by_line: bool) -> list[JsonFile]:
    present = F.coalesce(F.length("object") > 0, F.lit(False))
    one = F.json_array_length(F.concat(F.lit("["), "object", F.lit("]"))) == 1
    keys = F.when(one, F.json_object_keys("object"))
    line = F.col("line")
    counted = {
        "objects": present,
        "bad": present & keys.isNull(),
        "open": line.startswith("["),
        "close": line.endswith("]") | line.endswith("],"),
        "comma": line.endswith(","),
        "missing": F.col("object").isNull(),
    }
    # Objects share few key lists: count those first, and take only them apart.
    shapes = objects.groupBy(
        F.col("at.file").alias("path"), F.col("at.block").alias("block"), keys.alias("keys")
    ).agg(F.min("item").alias("item"), *[F.count_if(c).alias(n) for n, c in counted.items()])
    parts = shapes.select(
        "path", "block", "item", *counted, F.posexplode_outer("keys").alias("n", "key")
    )
    once_per_shape = F.coalesce("n", F.lit(0)) == 0
    found = (
        parts.groupBy("path", "key")
        .agg(
            F.min(F.struct("block", "item", "n")).alias("first"),
            *[F.sum(F.when(once_per_shape, F.col(n)).otherwise(0)).alias(n) for n in counted],
        )
        .orderBy("path", "first")
        .collect()
    )
    files = []
    for path, rows in groupby(found, key=lambda r: r["path"]):
        rows = list(rows)
        total = {n: sum(r[n] for r in rows) for n in counted}
        if by_line:
            array = total["open"] == total["close"] == 1 and total["comma"] == max(total["objects"] - 1, 0)
            bare = total["open"] == total["close"] == total["comma"] == 0 < total["objects"]
            valid = total["bad"] == 0 and (array or bare)
        else:
            # A file that is no array of objects has missing ones.
            valid = total["bad"] == 0 and total["missing"] == 0
        names = tuple(r["key"] for r in rows if r["key"] is not None)
        files.append(JsonFile(path, names, not by_line, valid))
    return files


def read_json(spark: SparkSession, paths: list[str] | str, position: bool = False) -> DataFrame:
    """S3: an array of objects per file, or one object per line.

    Columns are the union of all keys, in the order of their first appearance.
    """
    files = scan_json(spark, paths)
    broken = [f.path for f in files if not f.valid]
    if broken:
        raise SpecError(f"Not a JSON array of objects: {broken}")
    names = list(dict.fromkeys(k for f in files for k in f.header))
    if not any(f.whole for f in files):
        return json_frame(spark, paths, names, False, position)
    # Files of both kinds are read each in its own way.
    kinds = {whole: [literal_path(unquote(f.path)) for f in files if f.whole is whole] for whole in (True, False)}
    frames = [json_frame(spark, ps, names, whole, position) for whole, ps in kinds.items() if ps]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def json_frame(
    spark: SparkSession,
    paths: list[str] | str,
    names: list[str],
    whole: bool,
    position: bool = False,
    source: str | None = None,
) -> DataFrame:
    """JSON files with the keys `names`; nested values arrive as JSON text. Keys that differ only in case get their place
    appended, as repeated CSV headers do."""
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    objects = _json_objects(spark, paths, whole).filter(F.length("object") > 0)
    lower = Counter(n.lower() for n in names)
    titles = [f"{n}{i}" if lower[n.lower()] > 1 else n for i, n in enumerate(names)]
    alike = titles != names
    # A map tells keys apart by case, a struct does not.
    shape = T.MapType(T.StringType(), T.StringType()) if alike else text_schema(names)
    parsed = F.from_json("object", shape, {"mode": "FAILFAST"})
    rows = objects.select("at", "item", parsed.alias("o"))
    field = (lambda n: F.get(F.map_values(F.map_filter("o", lambda k, v: k == n)), F.lit(0))) if alike else F.col("o").getField
    cells = [blank_to_null(field(n)).alias(t) for n, t in zip(names, titles)]
    if position:
        line = F.col("item").cast("bigint").alias("line")
        cells.append(F.struct("at.file", "at.block", line).alias(POSITION))
    if source:
        cells.append(F.col("at.file").alias(source))
    return rows.select(*cells)


def read_xlsx(
    spark: SparkSession, paths: list[str] | str, position: bool = False
) -> DataFrame:
    """First sheet of every workbook; the workbooks must share one header."""
    headers = {h for _, h, _ in xlsx_headers(spark, paths)}
    if len(headers) != 1 or None in headers:
        raise SpecError(f"Workbooks differ in their headers or cannot be read: {headers}")
    return xlsx_frame(spark, paths, list(headers.pop()), position)


def _workbooks(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def xlsx_headers(spark: SparkSession, paths: list[str] | str) -> list[tuple]:
    """`(path, header or None, error or None)` of every workbook."""
    schema = "path string, header array<string>, error string"
    rows = _workbooks(spark, paths).mapInPandas(xlsx.header_batches, schema).collect()
    return [
        (r["path"], tuple(r["header"]) if r["header"] is not None else None, r["error"])
        for r in rows
    ]


def xlsx_frame(
    spark: SparkSession,
    paths: list[str] | str,
    names: list[str],
    position: bool = False,
    source: str | None = None,
) -> DataFrame:
    return workbook_rows(_workbooks(spark, paths), names, position, source)


def workbook_rows(
    workbooks: DataFrame, names: list[str], position: bool = False, source: str | None = None
) -> DataFrame:
    """Data rows of `workbooks(path, content)` that share the header `names`."""
    fields = [f"c{i}" for i in range(len(names))]
    schema = "path string, line long, " + ", ".join(f"{f} string" for f in fields)
    rows = workbooks.mapInPandas(xlsx.row_batches(len(names)), schema)
    cells = [blank_to_null(F.col(f)).alias(n) for f, n in zip(fields, names)]
    extra = []
    if position:
        at = F.struct(F.col("path").alias("file"), F.lit(0).cast("bigint").alias("block"), "line")
        extra.append(at.alias(POSITION))
    if source:
        extra.append(F.col("path").alias(source))
    return rows.select(*cells, *extra)


def preview(df: DataFrame, limit: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """L1: the first rows; with `order_by` a distributed top-k."""
    rows = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    return rows.limit(max(1, limit))


def append_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of another table below, matched by position."""
    return df.union(other)
