"""One pipeline over many files: own statistics per file, one Spark job per header.

Files with the same header run together, with the file as grouping key of every
statistic, so that a thousand small files cost a handful of jobs and one huge
file is still read, aggregated and written by many tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cleanframe.functions.cells import col
from cleanframe.operators.state import HIDDEN
from cleanframe.plans.pipeline import reads_statistics, run
from cleanframe.plans.spec import Op, PipelineSpec, SpecError
from cleanframe.session import small_table, table_schema, written
from cleanframe.sources import readers
from cleanframe.sources.writers import write_csv

SUCCESS, SKIPPED, FAILED = "SUCCESS", "SKIPPED", "FAILED"

# Files per job; bounds the per-file statistics a job keeps and broadcasts.
FILES_PER_JOB = 1_000

_SOURCE = f"{HIDDEN}source"
_SHUFFLING = (Op.REMOVE_DUPLICATES, Op.LABEL_ENCODE)

_RESULT = table_schema(
    source=T.StringType(),
    output=T.StringType(),
    row_count=T.LongType(),
    status=T.StringType(),
    message=T.StringType(),
)


@dataclass(frozen=True)
class _File:
    uri: str  # as Spark's row metadata writes it
    kind: str
    header: tuple[str, ...]
    whole: bool  # cannot be read in splits
    name: str = ""

    @property
    def path(self) -> str:
        return unquote(self.uri)

    @property
    def pattern(self) -> str:
        return readers.literal_path(self.path)


class _Report:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, source, status, output=None, rows=0, message="") -> None:
        self.rows.append((source, output, rows, status, message))


def cleaned_name(path: str) -> str:
    """`<stem>_cleaned.csv`, with characters that folder names cannot hold replaced."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if name.rfind(".") > 0 else name
    return re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{}\[\]^]", "_", stem) + "_cleaned.csv"


def process(spark: SparkSession, paths: list[str] | str, spec: PipelineSpec, out_dir: str) -> DataFrame:
    """B1/B2: clean every file and report `(source, output, row_count, status, message)`.

    Output is one CSV folder per file below `out_dir`. A file that cannot be
    read or lacks a column is reported and stops nothing.
    """
    report = _Report()
    ready = []
    for f in _name_outputs(_inspect(spark, _listing(spark, paths, report), report)):
        warnings = spec.column_warnings([readers.tidy(h) for h in f.header])
        if warnings:
            report.add(f.path, SKIPPED, message="; ".join(warnings))
        else:
            ready.append(f)

    def shape(f: _File):
        return f.kind, f.header, f.whole

    one_by_one = any(s.operation is Op.ONE_HOT_ENCODE for s in spec.steps)
    size = 1 if one_by_one else FILES_PER_JOB
    for _, same in groupby(sorted(ready, key=shape), key=shape):
        files = list(same)
        for at in range(0, len(files), size):
            _run(spark, files[at : at + size], spec, out_dir, report)
    # One row per file; the list of files came through the driver as well.
    return small_table(spark, report.rows, _RESULT)


def status_counts(report: DataFrame) -> DataFrame:
    """B2: files per status."""
    return report.groupBy("status").agg(F.count("*").alias("files"))


def folder_column(columns: list[str]) -> str:
    """Name of the folders `<name>=<file>`: `output`, or `output_file`, ... where the table has such a column."""
    name, taken = "output", {c.lower() for c in columns}
    while name in taken:
        name += "_file"
    return name


def _listing(spark: SparkSession, paths: list[str] | str, report: _Report) -> list[str]:
    def files(p):
        return sorted(_plain(u) for u in spark.read.format("binaryFile").load(p).inputFiles())

    given = [paths] if isinstance(paths, str) else list(paths)
    try:
        return files(given)
    except AnalysisException:
        found = []
        for p in given:
            try:
                found += files(p)
            except AnalysisException as e:
                report.add(p, FAILED, message=_first_line(e))
        return found


def _first_line(e: Exception) -> str:
    return (str(e).strip().splitlines() or ["Unknown error"])[0]


def _inspect(spark: SparkSession, paths: list[str], report: _Report) -> list[_File]:
    """Header of every file, all files of one kind in one job."""
    by_kind: dict[str, list[str]] = {"csv": [], "json": [], "xlsx": []}
    for p in paths:
        try:
            kind = readers.format_of(p)
            if kind not in by_kind:
                raise SpecError(f"batches do not read {kind} files")
            by_kind[kind].append(p)
        except SpecError as e:
            report.add(unquote(p), FAILED, message=str(e))
    patterns = {k: [_File(u, k, (), True).pattern for u in uris] for k, uris in by_kind.items()}
    files = []
    if by_kind["csv"]:
        known = {_plain(f.path): f for f in readers.scan_csv(spark, patterns["csv"])}
        for uri in by_kind["csv"]:
            file = known.get(uri)
            if file is not None and file.fewest is not None and file.fewest < len(file.header):
                report.add(unquote(uri), FAILED, message=f"Row shorter than the header: {file.fewest} of {len(file.header)} cells")
            elif file is not None and file.header:
                files.append(_File(uri, "csv", known[uri].header, known[uri].multi_line))
            else:
                report.add(unquote(uri), FAILED, message="The file has no header")
    if by_kind["json"]:
        known = {_plain(f.path): f for f in readers.scan_json(spark, patterns["json"])}
        for uri in by_kind["json"]:
            if uri in known and known[uri].valid:
                files.append(_File(uri, "json", known[uri].header, known[uri].whole))
            else:
                report.add(unquote(uri), FAILED, message="The file is no JSON array of objects")
    if by_kind["xlsx"]:
        heads = {_plain(p): (h, e) for p, h, e in readers.xlsx_headers(spark, patterns["xlsx"])}
        for uri in by_kind["xlsx"]:
            header, error = heads.get(unquote(uri), (None, "The file is empty"))
            if header is None:
                report.add(unquote(uri), FAILED, message=error)
            else:
                files.append(_File(uri, "xlsx", header, True))
    return files


def _plain(path: str) -> str:
    """One spelling for local paths, which come as `file:/x` and `file:///x`."""
    return re.sub(r"^file:/+", "file:/", path)


def _name_outputs(files: list[_File]) -> list[_File]:
    used: dict[str, int] = {}
    named = []
    for f in files:
        base = cleaned_name(f.path)
        n = used[base.lower()] = used.get(base.lower(), 0) + 1
        name = base if n == 1 else base.replace("_cleaned.csv", f"_cleaned_{n}.csv")
        named.append(_File(f.uri, f.kind, f.header, f.whole, name))
    return named


def _load(spark: SparkSession, files: list[_File], position: bool) -> DataFrame:
    first, paths = files[0], [f.pattern for f in files]
    names = list(first.header)
    if first.kind == "csv":
        return readers.csv_frame(
            spark, paths, names, first.whole, position, short_rows="error", source=_SOURCE
        )
    if first.kind == "json":
        return readers.json_frame(spark, paths, names, first.whole, position, _SOURCE)
    return readers.xlsx_frame(spark, paths, names, position, source=_SOURCE)


def _run(
    spark: SparkSession, files: list[_File], spec: PipelineSpec, out_dir: str, report: _Report
) -> None:
    """Clean files of one shape. Short rows were found before, where lines tell; for other errors the list is halved until
    the file is found."""
    try:
        folder, counts = _clean(spark, files, spec, out_dir)
    except (PySparkException, Py4JJavaError, SpecError) as e:
        if len(files) == 1:
            report.add(files[0].path, FAILED, message=_first_line(e))
            return
        half = len(files) // 2
        _run(spark, files[:half], spec, out_dir, report)
        _run(spark, files[half:], spec, out_dir, report)
        return
    for f in files:
        report.add(f.path, SUCCESS, f"{out_dir}/{folder}={f.name}", counts.get(f.name, 0))


def _clean(
    spark: SparkSession, files: list[_File], spec: PipelineSpec, out_dir: str
) -> tuple[str, dict[str, int]]:
    """Name of the folder column, and rows by output name."""
    if not files[0].header:
        return "output", {}
    group = f"{HIDDEN}output"
    by_appearance = any(s.operation is Op.LABEL_ENCODE for s in spec.steps)
    order = readers.POSITION if by_appearance else None
    # At most FILES_PER_JOB rows.
    names = small_table(
        spark,
        [(f.path if f.kind == "xlsx" else f.uri, f.name) for f in files],
        table_schema(path=T.StringType(), **{group: T.StringType()}),
    )
    table = _load(spark, files, position=by_appearance)
    same_path = F.regexp_replace(col(_SOURCE), "^file:/+", "file:/") == F.col("path")
    table = table.join(F.broadcast(names), same_path).drop("path", _SOURCE)

    if reads_statistics(spec):
        # Parse the files once; statistics then read single columns.
        table = written(table, "batch")

    if len(files) == 1:
        cleaned = run(table.drop(group), spec, order_by=order).withColumn(group, F.lit(files[0].name))
    else:
        cleaned = run(table, spec, order_by=order, group=group)
    sorted_ = any(s.operation is Op.SORT_COLUMN for s in spec.steps)
    if not sorted_ and any(s.operation in _SHUFFLING for s in spec.steps):
        # Read twice below. Rows of a file are gathered, yet a large file stays split.
        cleaned = written(cleaned.hint("rebalance", group), "cleaned")
    counts = {r[group]: r["n"] for r in cleaned.groupBy(group).agg(F.count("*").alias("n")).collect()}

    output = folder_column([c for c in cleaned.columns if c != group])
    for f in files:
        if not counts.get(f.name):
            empty = cleaned.limit(0).drop(group).coalesce(1)
            write_csv(empty, f"{out_dir}/{output}={f.name}", decimals=True, mode="overwrite")
    write_csv(
        cleaned.withColumnRenamed(group, output),
        out_dir,
        decimals=True,
        mode="overwrite",
        partition_by=[output],
    )
    return output, counts
