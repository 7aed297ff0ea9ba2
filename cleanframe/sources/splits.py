"""Rows that span lines, read in splits: CSV records with line breaks in cells, and objects of JSON arrays.

Whether a line begins inside a quoted cell, or how deep in brackets, depends on everything before it. Each split first tells
what it does to either beginning (for CSV: open or closed quotes; for JSON: how much deeper it ends); joined in the order of
the splits, one short row for each, that gives the beginning of every split. A second pass then cuts the splits into rows at
once. Only what crosses the border of two splits is brought together, by the split in which it begins.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Path, offset of the split and place of the line in it.
PLACE = ["file", "block", "line"]


def text_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, block, line, value) of every line; lines of a split come in order."""
    meta = lambda n: F.col(f"_metadata.{n}")
    return spark.read.text(paths).select(
        meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )


# States at a place of a CSV line: at the start of a cell or in one without quotes before it, inside quotes, behind a quote
# that closes them or stands for one with the next, in a cell that no quote can open any more.
_START, _INSIDE, _QUOTE, _BEGUN = range(4)


def _open_after(start: int) -> Column:
    """Does the line end inside quotes, if it begins in the state `start`?"""
    parts = F.split("value", '"')
    blank_last = lambda s: s.rlike(r"(^|,)[ \t]*$")
    blank_after_comma = lambda s: s.rlike(r",[ \t]*$")

    def text(state: Column, s: Column) -> Column:
        outside = F.when(blank_after_comma(s), _START).otherwise(_BEGUN)
        return (
            F.when(state == _START, F.when(blank_last(s), _START).otherwise(_BEGUN))
            .when((state == _BEGUN) | ((state == _QUOTE) & (s != "")), outside)
            .otherwise(state)
        )

    def quote(state: Column) -> Column:
        return F.when((state == _START) | (state == _QUOTE), _INSIDE).when(state == _INSIDE, _QUOTE).otherwise(state)

    first = text(F.lit(start), F.get(parts, F.lit(0)))
    last = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), first, lambda state, s: text(quote(state), s))
    return last == _INSIDE


def quote_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines with `closed` and `opened`: are quotes open at their end, if they are closed or open at their start?"""
    quoted = F.contains("value", F.lit('"'))
    return text_lines(spark, paths).withColumns(
        {
            "closed": F.when(quoted, _open_after(_START)).otherwise(False),
            "opened": F.when(quoted, _open_after(_INSIDE)).otherwise(True),
        }
    )


def _split_effects(batches):
    """Of each split: quotes open at its end from either start, and whether open ones are closed in between."""
    key, effect, rows = None, None, []
    for batch in batches:
        for file, block, closed, opened in zip(*(batch.column(n).to_pylist() for n in ("file", "block", "closed", "opened"))):
            if (file, block) != key:
                if key:
                    rows.append((*key, *effect))
                key, effect = (file, block), [False, True, False]
            effect[0], effect[1] = (opened if effect[0] else closed), (opened if effect[1] else closed)
            effect[2] |= not effect[1]
    if key:
        rows.append((*key, *effect))
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    columns = list(zip(*rows)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "closed", "opened", "closes"])


def open_splits(spark: SparkSession, paths: list[str] | str) -> dict[str, list[tuple[int, int | None]]]:
    """For each file with line breaks in cells: (split, split in which the record that is open at its end begins, or None),
    where that changes. Lines that leave quotes as they are say nothing and stay where they are."""
    telling = quote_lines(spark, paths).filter(F.col("closed") | ~F.col("opened"))
    found = telling.select(*PLACE, "closed", "opened").mapInArrow(_split_effects, "file string, block long, closed boolean, opened boolean, closes boolean")
    by_file: dict[str, dict[int, tuple]] = {}
    for r in found.collect():  # at most a row for each split of a file
        by_file.setdefault(r["file"], {})[r["block"]] = (r["closed"], r["opened"], r["closes"])
    out = {}
    for file, effects in by_file.items():
        begun, changes, broken = None, [], False
        for block in sorted(effects):
            closed, opened, closes = effects[block]
            if begun is None:
                after = block if closed else None
            else:
                after = (block if closes else begun) if opened else None
            # A split that ends closed may still hold whole records over several lines.
            if after != begun:
                changes.append((block, after))
            begun = after
        out[file] = changes
    return out


def broken_files(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """Files in which a cell opened on one line goes on in the next."""
    opening = quote_lines(spark, paths).filter("closed")
    return sorted(r["file"] for r in opening.select("file").distinct().collect())


def _record_rows(starts: dict[str, list[tuple[int, int | None]]], header):
    """Lines to records. `piece` marks parts of a record that crosses splits, `origin` the split in which it begins, `head`
    the file's first record."""
    names = ["file", "block", "line", "record", "piece", "origin", "head"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_()]

    def begun_before(file: str, block: int) -> int | None:
        changes = starts.get(file, [])
        i = bisect_left(changes, (block,))
        return changes[i - 1][1] if i else None

    def run(batches):
        key, held, origin, first, head, out = None, [], None, 0, False, []

        def put(piece: bool) -> None:
            nonlocal held, origin, head
            record = "\n".join(held)
            if piece or record.strip():
                if head and not piece:
                    header(key[0], record)
                else:
                    out.append((*key, first, record, piece, key[1] if origin is None else origin, head))
                if origin is None:
                    head = False
            held, origin = [], None

        for batch in batches:
            for file, block, line, value, closed, opened in zip(*(batch.column(n).to_pylist() for n in (*PLACE, "value", "closed", "opened"))):
                if (file, block) != key:
                    if held:
                        put(True)
                    key, head = (file, block), block == 0
                    origin = begun_before(file, block)
                    inside = origin is not None
                if not held:
                    first = line
                held.append(value)
                inside = opened if inside else closed
                if not inside:
                    put(origin is not None)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names)
            out.clear()
        if held:
            put(True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names)

    return run


def _whole(rows: DataFrame, text: str, joint: str) -> DataFrame:
    """Rows that lie in a split as they are, and those brought together from pieces, as (file, block, line, <text>)."""
    own = rows.filter("not piece").select(*PLACE, text)
    parts = rows.filter("piece").groupBy("file", "origin").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", text))), lambda x: x[text]), joint).alias(text),
        F.min_by("line", "block").alias("line"),
        F.bool_or("head").alias("head"),
    )
    return own.unionByName(parts.filter("not head").select("file", F.col("origin").alias("block"), "line", text))


def csv_records(spark: SparkSession, paths: list[str], header) -> DataFrame:
    """(file, block, line, record) of all records but the headers, which `header(file, record)` gets in the task."""
    rows = quote_lines(spark, paths).mapInArrow(
        _record_rows(open_splits(spark, paths), header), "file string, block long, line long, record string, piece boolean, origin long, head boolean"
    )
    return _whole(rows, "record", "\n")


_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],]')
_BRACKETS = re.compile(r"[{}\[\]]")


def _bracket_effects(batches):
    """Of each split: how much deeper it ends than it starts, and how far it comes up in between."""
    key, deeper, lowest, rows = None, 0, 0, []
    for batch in batches:
        for file, block, brackets in zip(*(batch.column(n).to_pylist() for n in ("file", "block", "brackets"))):
            if (file, block) != key:
                if key:
                    rows.append((*key, deeper, lowest))
                key, deeper, lowest = (file, block), 0, 0
            for ch in brackets:
                deeper += 1 if ch in "{[" else -1
                lowest = min(lowest, deeper)
    if key:
        rows.append((*key, deeper, lowest))
    columns = list(zip(*rows)) or [[]] * 4
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "deeper", "lowest"])


def json_depths(spark: SparkSession, paths: list[str]) -> dict[str, dict[int, tuple[int, int | None]]]:
    """For each file: the depth in brackets at the start of each split, and the split in which the object begins that is open
    there. JSON strings cannot hold line breaks, so every line tells its brackets by itself. A file whose brackets do not match
    has no splits."""
    bare = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), r'"[^"]*"', "")
    lines = text_lines(spark, paths).select("file", "block", F.regexp_replace(bare, r"[^{}\[\]]", "").alias("brackets"))
    effects: dict[str, dict[int, tuple[int, int]]] = {}
    for r in lines.mapInArrow(_bracket_effects, "file string, block long, deeper long, lowest long").collect():  # a row for each split
        effects.setdefault(r["file"], {})[r["block"]] = (r["deeper"], r["lowest"])
    out: dict[str, dict[int, tuple[int, int | None]]] = {}
    for file, splits in effects.items():
        depth, begun, own = 0, None, {}
        for block in sorted(splits):
            deeper, lowest = splits[block]
            own[block] = (depth, begun)
            if depth + deeper <= 1:
                begun = None
            elif depth <= 1 or depth + lowest <= 1:
                begun = block
            depth += deeper
        out[file] = own if depth == 0 else {}
    return out


def _object_rows(starts: dict[str, dict[int, tuple[int, int | None]]]):
    """Lines to the objects of an array, cut where the depth comes back to one. A NULL object tells of anything else there."""
    names = ["file", "block", "line", "object", "piece", "origin", "head"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_()]

    def run(batches):
        key, held, origin, depth, first, last, out = None, [], None, 0, 0, None, []

        def put(piece: bool) -> None:
            nonlocal held
            out.append((*key, first, "\n".join(held), piece, key[1] if origin is None else origin, False))
            held = []

        def wrong() -> None:
            out.append((*key, first, None, False, key[1], False))

        for batch in batches:
            for file, block, line, value in zip(*(batch.column(n).to_pylist() for n in (*PLACE, "value"))):
                if (file, block) != key:
                    if held:
                        put(True)
                    key, last = (file, block), None
                    depth, origin = starts.get(file, {}).get(block, (None, None))
                    if depth is None:
                        wrong()
                    elif block == 0:
                        value = value.removeprefix("\ufeff")
                if depth is None:
                    continue
                if depth > 1 and not _BRACKETS.search(value):
                    held.append(value)
                    continue
                begin, at = (0 if depth > 1 else None), 0
                for m in _TOKENS.finditer(value):
                    token = m.group()
                    if depth <= 1 and value[at : m.start()].strip():
                        wrong()
                    at = m.end()
                    if token in "{[":
                        if depth == 1 and token == "{":
                            begin, first, held, origin = m.start(), max(first + 1, line), [], None
                            if last == "object":
                                wrong()
                        elif depth == 1 or (depth == 0 and (token == "{" or last == "]")):
                            wrong()
                        depth += 1
                        last = "[" if depth == 1 else last
                    elif token in "}]":
                        depth -= 1
                        if depth == 1:
                            if begin is not None:
                                held.append(value[begin : m.end()])
                                put(origin is not None)
                            begin, origin, last = None, None, "object"
                        elif depth == 0:
                            if last == ",":
                                wrong()
                            last = "]"
                        elif depth < 0:
                            wrong()
                            depth = 0
                    elif depth <= 1:
                        if token != "," or depth == 0 or last in (",", "["):
                            wrong()
                        last = ","
                if depth > 1 and begin is not None:
                    held.append(value[begin:])
                elif depth <= 1 and value[at:].strip():
                    wrong()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names)
            out.clear()
        if held:
            put(True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names)

    return run


def json_objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, line, object) of all objects of the arrays; NULL objects for whatever else stands there."""
    rows = text_lines(spark, paths).mapInArrow(
        _object_rows(json_depths(spark, paths)), "file string, block long, line long, object string, piece boolean, origin long, head boolean"
    )
    return _whole(rows, "object", "\n")
