"""Pipeline specifications: an ordered list of steps, kept as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from enum import Enum

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

SCHEMA_VERSION = 1


class Op(str, Enum):
    """The operation names of the pipeline format."""

    DROP_MISSING_ROWS = "DROP_MISSING_ROWS"
    FILL_MISSING_MEAN = "FILL_MISSING_MEAN"
    FILL_MISSING_MEDIAN = "FILL_MISSING_MEDIAN"
    FILL_MISSING_MODE = "FILL_MISSING_MODE"
    FILL_MISSING_CUSTOM = "FILL_MISSING_CUSTOM"
    REMOVE_DUPLICATES = "REMOVE_DUPLICATES"
    REMOVE_OUTLIERS_IQR = "REMOVE_OUTLIERS_IQR"
    NORMALIZE_MINMAX = "NORMALIZE_MINMAX"
    NORMALIZE_ZSCORE = "NORMALIZE_ZSCORE"
    CAST_COLUMN = "CAST_COLUMN"
    TRAIN_TEST_SPLIT = "TRAIN_TEST_SPLIT"
    LABEL_ENCODE = "LABEL_ENCODE"
    ONE_HOT_ENCODE = "ONE_HOT_ENCODE"
    SORT_COLUMN = "SORT_COLUMN"
    FILTER_ROWS = "FILTER_ROWS"
    NORMALIZE_ROBUST = "NORMALIZE_ROBUST"
    REGEX_REPLACE = "REGEX_REPLACE"


class SpecError(ValueError):
    """A pipeline that cannot be read or run."""


@dataclass(frozen=True)
class RegexRule:
    pattern: str
    replacement: str | None = ""

    def to_param(self) -> str:
        return json.dumps({"pattern": self.pattern, "replacement": self.replacement})

    @staticmethod
    def from_param(param: str | None) -> RegexRule:
        try:
            rule = json.loads(param or "")
            return RegexRule(rule["pattern"], rule.get("replacement"))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise SpecError("a regex rule is a JSON object with a pattern") from e


@dataclass(frozen=True)
class Step:
    operation: Op
    column: str | None = None
    param: str | None = None

    @staticmethod
    def regex(column: str, pattern: str, replacement: str | None = "") -> Step:
        return Step(Op.REGEX_REPLACE, column, RegexRule(pattern, replacement).to_param())

    @staticmethod
    def filter(column: str, operator: str, value: str) -> Step:
        return Step(Op.FILTER_ROWS, column, f"{operator}|{value}")

    def filter_parts(self) -> tuple[str, str]:
        """Operator and value; without an operator before the first pipe it is `==`."""
        raw = "==|" if self.param is None else self.param
        operator, pipe, value = raw.partition("|")
        return (operator if pipe and operator else "=="), (value if pipe else "")

    def split_ratio(self) -> float:
        return float(self.param) if self.param is not None else 0.8

    def ascending(self) -> bool:
        return self.param != "descending"

    def regex_rule(self) -> RegexRule:
        return RegexRule.from_param(self.param)

    def validate(self, spark: SparkSession | None = None) -> None:
        """PL6: checks made when a step is added to a pipeline."""
        if self.operation is Op.TRAIN_TEST_SPLIT:
            try:
                ratio = self.split_ratio()
            except ValueError:
                raise SpecError(f"the share of training rows is no number: {self.param}") from None
            if not 0 < ratio < 1:
                raise SpecError(f"the share of training rows must lie inside (0, 1): {ratio}")
        elif self.operation is Op.FILTER_ROWS:
            if not self.filter_parts()[1].strip():
                raise SpecError("a filter needs a value to compare with")
        elif self.operation is Op.REGEX_REPLACE:
            pattern = self.regex_rule().pattern
            if not pattern:
                raise SpecError("a regex rule needs a pattern")
            if spark is not None:
                check_pattern(spark, pattern, self.regex_rule().replacement)


def check_pattern(spark: SparkSession, pattern: str, replacement: str | None = "") -> None:
    """Let the engine's own regex compiler judge a rule before any job starts.

    The query has no table, so it is answered while it is planned. The empty alternative makes the rule match the empty
    text, which puts the replacement's group references to the test as well.
    """
    query = "SELECT regexp_replace('', :pattern, '') AS a, regexp_replace('', concat(:pattern, '|'), :replacement) AS b"
    try:
        spark.sql(query, args={"pattern": pattern, "replacement": replacement or ""}).collect()
    except (PySparkException, Py4JJavaError) as e:
        raise SpecError(f"Invalid regex rule: {pattern!r} to {replacement!r}") from e


@dataclass(frozen=True)
class PipelineSpec:
    steps: tuple[Step, ...] = field(default_factory=tuple)

    def to_json(self) -> str:
        steps = [
            {"operation": s.operation.value, "column": s.column, "param": s.param}
            for s in self.steps
        ]
        doc = {"schemaVersion": SCHEMA_VERSION, "createdBy": "cleanframe", "steps": steps}
        return json.dumps(doc, indent=2)

    @staticmethod
    def from_json(text: str) -> PipelineSpec:
        """PL4: unknown versions, operations or layouts are errors."""
        try:
            doc = json.loads(text)
        except ValueError as e:
            raise SpecError(f"the pipeline is not JSON: {e}") from e
        if not isinstance(doc, dict):
            raise SpecError("a pipeline is a JSON object")
        version = doc.get("schemaVersion", SCHEMA_VERSION)
        if version != SCHEMA_VERSION:
            raise SpecError(f"this version of the pipeline format cannot be read: {version}")
        if not isinstance(doc.get("steps"), list):
            raise SpecError("a pipeline has a list of steps")
        steps = []
        for item in doc["steps"]:
            name = item.get("operation") if isinstance(item, dict) else None
            if not isinstance(name, str) or name not in Op.__members__:
                raise SpecError(f"there is no operation {name}")
            column, param = item.get("column"), item.get("param")
            if not all(x is None or isinstance(x, str) for x in (column, param)):
                raise SpecError(f"column and parameter of {name} must be texts")
            steps.append(Step(Op(name), column, param))
        spec = PipelineSpec(tuple(steps))
        spec.validate()
        return spec

    def validate(self) -> None:
        """PL6 for every step; patterns are judged when the pipeline meets its table."""
        for s in self.steps:
            s.validate()

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """PL3: a file of the driver, or with a session a folder wherever Spark can write."""
        if spark is not None:
            spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
            return
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> PipelineSpec:
        if spark is not None:
            # A specification is a list of steps that somebody wrote: one row.
            parts = spark.read.option("wholetext", True).text(path).collect()
            return PipelineSpec.from_json("".join(r["value"] for r in parts))
        with open(path, encoding="utf-8") as f:
            return PipelineSpec.from_json(f.read())

    def column_warnings(self, columns: list[str]) -> list[str]:
        """PL5: one warning per step whose column is not among the input columns."""
        return [
            f"the table has no column {s.column} for {s.operation.value}"
            for s in self.steps
            if s.column and s.column.strip() and s.column not in columns
        ]


_DECIMAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def numeric_literal(text: str | None) -> int | float | None:
    """The number a parameter spells, or None where it is text."""
    if text is None or not _DECIMAL.fullmatch(text.strip()):
        return None
    stripped = text.strip()
    if re.fullmatch(r"[+-]?\d+", stripped) and abs(int(stripped)) < 2**63:
        return int(stripped)
    return float(stripped)
