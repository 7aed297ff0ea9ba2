"""What a step works on: the table so far, its row order, and fitted statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cleanframe.functions.cells import cell_text, col, descending_text, is_number
from cleanframe.operators.labels import LabelCodes
from cleanframe.operators.statistics import Moments
from cleanframe.session import small_table

# Columns with this prefix travel with the rows but are no user data.
HIDDEN = "__cf_"

# The place of a row in its file, which readers add on request.
POSITION = f"{HIDDEN}pos"


@dataclass(frozen=True)
class SortKey:
    name: str
    ascending: bool
    nulls_last: bool

    def column(self) -> Column:
        c = col(self.name)
        if self.ascending:
            return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()
        return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()


@dataclass(frozen=True)
class State:
    """`sorts` holds the keys of sorting steps, latest first; rows are ordered at the end."""

    df: DataFrame
    form: str = "engine"
    order_by: tuple[str, ...] = ()
    group: str | None = None
    max_categories: int | None = None
    split: bool = False
    sorts: tuple[SortKey, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def strict(self) -> bool:
        return self.form == "sql"

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def with_df(self, df: DataFrame) -> State:
        return replace(self, df=df)

    def with_column(self, name: str, value: Column) -> State:
        return self.with_df(self.df.withColumn(name, value))

    def row_order(self) -> Column | None:
        """The current row order as one column that compares ascending."""
        fields = []
        for s in self.sorts:
            c, dtype = col(s.name), self.dtype(s.name)
            fields.append(F.when(c.isNull(), int(s.nulls_last)).otherwise(int(not s.nulls_last)))
            if s.ascending:
                fields.append(c)
            elif is_number(dtype):
                d = c.cast("double")
                fields.append(F.when(F.isnan(d), float("-inf")).otherwise(-d))
            else:
                fields.append(descending_text(cell_text(c, dtype)))
        fields += [col(o) for o in self.order_by]
        if not self.order_by:
            return None
        if len(fields) == 1:
            # A plain column can be aggregated by hashing, a struct only by sorting.
            return fields[0]
        return F.struct(*[f.alias(f"k{i}") for i, f in enumerate(fields)])


@dataclass
class Statistics:
    """Fitted values of one barrier. Keys are `(*group, column)`."""

    group: str | None
    moments: dict[tuple, Moments]
    quartiles: dict[tuple, list[float | None]]
    modes: dict[tuple, tuple[int, str | None]]
    categories: dict[str, list[str]]
    codes: dict[str, LabelCodes]
    cuts: dict[tuple[str, ...], str]
    wanted: list[tuple[str, str]]

    def raw(self, column: str, field: str, key: tuple = ()):
        at = (*key, column)
        if field in ("q1", "median", "q3"):
            q = self.quartiles.get(at)
            return q[("q1", "median", "q3").index(field)] if q else None
        if field == "mode":
            return self.modes.get(at, (0, None))[1]
        m = self.moments.get(at)
        return getattr(m, field) if m else None

    def value(self, column: str, field: str) -> Column:
        """The statistic as a column: a literal, or the row's own group's value."""
        if self.group:
            return F.col(self._slot(column, field))
        return F.lit(self.raw(column, field)).cast(_field_type(field))

    def _slot(self, column: str, field: str) -> str:
        return f"{HIDDEN}stat{self.wanted.index((column, field))}"

    def attach(self, df: DataFrame) -> DataFrame:
        """Give every row its group's statistics, by a join with one row per group."""
        if not self.group or not self.wanted:
            return df
        groups = {k[0] for d in (self.moments, self.modes) for k in d}
        key = f"{HIDDEN}group"
        schema = T.StructType(
            [T.StructField(key, df.schema[self.group].dataType)]
            + [T.StructField(self._slot(c, f), _field_type(f)) for c, f in self.wanted]
        )
        rows = [(g, *[self.raw(c, f, (g,)) for c, f in self.wanted]) for g in groups]
        table = small_table(df.sparkSession, rows, schema)
        # NULL is a group of its own.
        return df.join(F.broadcast(table), col(self.group).eqNullSafe(col(key)), "left").select(
            *[col(c) for c in df.columns], *[col(self._slot(c, f)) for c, f in self.wanted]
        )

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(*[self._slot(c, f) for c, f in self.wanted]) if self.group else df


def _field_type(field: str) -> T.DataType:
    if field == "mode":
        return T.StringType()
    if field == "all_numeric":
        return T.BooleanType()
    return T.DoubleType()
