"""Fit a pipeline in as few scans as possible, then apply it lazily.

Steps that need statistics share one set of jobs ("barrier") as long as the
statistics can be read off the table as it stood before the first of them: no
step in between drops or reorders rows they depend on, and their column was not
rewritten. Fitted statistics become literals, so everything between barriers
is a plain projection or filter that Catalyst collapses and pushes down, and a
pipeline with k statistics scans its input O(k) times instead of 2^k.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from cleanframe.functions.cells import col, is_number, is_text, row_hash
from cleanframe.operators import lenient, strict
from cleanframe.operators.labels import group_label_codes, label_codes
from cleanframe.operators.ordering import sort_rows
from cleanframe.operators.quantiles import LINEAR7, WEIBULL6
from cleanframe.operators.split import split_cut
from cleanframe.operators.state import HIDDEN, POSITION, State, Statistics
from cleanframe.operators.statistics import frequency_summary, moments, quartiles
from cleanframe.plans.spec import Op, PipelineSpec, SpecError, Step, check_pattern
from cleanframe.session import written

FORMS = {"engine": lenient.STEPS, "sql": strict.STEPS}

_SCALAR_NEEDS = {
    Op.FILL_MISSING_MEAN: ("mean",),
    Op.FILL_MISSING_MEDIAN: ("median",),
    Op.FILL_MISSING_MODE: ("mode",),
    Op.REMOVE_OUTLIERS_IQR: ("q1", "q3"),
    Op.NORMALIZE_MINMAX: ("low", "spread"),
    Op.NORMALIZE_ZSCORE: ("mean", "sd"),
    Op.NORMALIZE_ROBUST: ("q1", "median", "q3"),
}
_DROPS_ROWS = {Op.DROP_MISSING_ROWS, Op.REMOVE_DUPLICATES, Op.REMOVE_OUTLIERS_IQR, Op.FILTER_ROWS}
_KEEPS_CELLS = _DROPS_ROWS | {Op.SORT_COLUMN, Op.TRAIN_TEST_SPLIT}
_CHANGES_COLUMNS = {Op.ONE_HOT_ENCODE, Op.TRAIN_TEST_SPLIT}
_SHUFFLES = {Op.REMOVE_DUPLICATES, Op.LABEL_ENCODE}


def reads_statistics(spec: PipelineSpec) -> bool:
    """Does fitting the pipeline scan its input?"""
    fitting = (Op.LABEL_ENCODE, Op.ONE_HOT_ENCODE, Op.SORT_COLUMN)
    return any(s.operation in _SCALAR_NEEDS or s.operation in fitting for s in spec.steps)


@dataclass(frozen=True)
class _Needs:
    """What a step must know: scalars of its column, and larger fitted objects."""

    scalars: tuple[str, ...] = ()
    categories: bool = False
    codes: bool = False
    cut: bool = False

    def __bool__(self) -> bool:
        return bool(self.scalars) or self.categories or self.codes or self.cut


def _needs(state: State, step: Step) -> _Needs:
    op = step.operation
    if op is Op.TRAIN_TEST_SPLIT:
        return _Needs(cut=state.strict or state.split)
    if op in (Op.LABEL_ENCODE, Op.ONE_HOT_ENCODE):
        return _Needs(codes=op is Op.LABEL_ENCODE, categories=op is Op.ONE_HOT_ENCODE)
    if op is Op.SORT_COLUMN and not state.strict and is_text(state.dtype(step.column)):
        return _Needs(scalars=("all_numeric",))
    return _Needs(scalars=_SCALAR_NEEDS.get(op, ()))


def _barrier(state: State, steps: list[Step], on_missing: str) -> tuple[list[Step], int]:
    """The steps, from the first on, that one set of fitting jobs serves."""
    segment: list[Step] = []
    rows_changed = reordered = columns_changed = False
    rewritten: set[str] = set()
    for at, step in enumerate(steps):
        needs_column = step.operation not in (
            Op.DROP_MISSING_ROWS, Op.REMOVE_DUPLICATES, Op.TRAIN_TEST_SPLIT,
        )
        if needs_column and step.column not in state.df.columns:
            if columns_changed:
                return segment, at
            if on_missing == "error":
                raise SpecError(f"the table has no column {step.column} for {step.operation.value}")
            continue
        if columns_changed and needs_column:
            return segment, at
        needs = _needs(state, step)
        if needs:
            any_rewritten = bool(rewritten) or columns_changed
            stale = rows_changed or step.column in rewritten
            stale = stale or (needs.cut and any_rewritten)
            stale = stale or (reordered and (needs.codes or needs.categories))
            if stale:
                return segment, at
        elif step.operation is Op.SORT_COLUMN and step.column in rewritten:
            # Its key kind depends on the type the earlier steps give the column.
            return segment, at
        if step.operation is Op.REGEX_REPLACE:
            rule = step.regex_rule()
            check_pattern(state.df.sparkSession, rule.pattern, rule.replacement)
        step.validate()
        segment.append(step)
        rows_changed |= step.operation in _DROPS_ROWS
        reordered |= step.operation is Op.SORT_COLUMN
        columns_changed |= step.operation in _CHANGES_COLUMNS
        if step.operation not in _KEEPS_CELLS and step.column:
            rewritten.add(step.column)
    return segment, len(steps)


def _measure(state: State, segment: list[Step]) -> Statistics:
    """Run the fitting jobs of one barrier on the table as it stands."""
    df, group, is_strict = state.df, state.group, state.strict
    wanted: list[tuple[str, str]] = []
    stats = Statistics(group, {}, {}, {}, {}, {}, {}, wanted)
    for step in segment:
        needs = _needs(state, step)
        for field in needs.scalars:
            if (step.column, field) not in wanted:
                wanted.append((step.column, field))
        if needs.categories and step.column not in stats.categories:
            stats.categories[step.column] = _categories(state, step.column)
        if needs.codes and step.column not in stats.codes:
            stats.codes[step.column] = _codes(state, step.column)
        if needs.cut:
            columns = tuple(state.columns)
            hashed = row_hash(df, list(columns))
            stats.cuts[columns] = split_cut(df, hashed, step.split_ratio())
    by_quartile = list(dict.fromkeys(c for c, f in wanted if f in ("q1", "median", "q3")))
    by_moment = list(dict.fromkeys(c for c, f in wanted if f != "mode"))
    by_mode = list(dict.fromkeys(c for c, f in wanted if f == "mode"))
    if is_strict:
        usable = by_moment
    else:
        usable = [c for c in by_moment if _may_hold_numbers(state, c)]
    if usable:
        stats.moments = moments(df, usable, group, is_strict)
    by_quartile = [c for c in by_quartile if c in usable]
    if by_quartile:
        method = LINEAR7 if is_strict else WEIBULL6
        stats.quartiles = quartiles(df, by_quartile, stats.moments, method, group, is_strict)
    if by_mode:
        stats.modes = frequency_summary(df, by_mode, group, is_strict)
    return stats


def _may_hold_numbers(state: State, column: str) -> bool:
    dtype = state.dtype(column)
    return is_text(dtype) or is_number(dtype)


def _categories(state: State, column: str) -> list[str]:
    if state.group:
        raise SpecError("one-hot columns differ per group; run the groups one by one")
    order = state.row_order() if state.strict else None
    return lenient.category_values(state.df, column, state.max_categories, order)


def _codes(state: State, column: str):
    if state.strict:
        return label_codes(state.df, column, None, strict=True)
    order = state.row_order()
    if order is None:
        raise SpecError(
            "LABEL_ENCODE numbers values by first appearance: pass order_by, "
            "or use form='sql' to number them by value"
        )
    if state.group:
        return group_label_codes(state.df, column, order, state.group)
    return label_codes(state.df, column, order)


def _run_segment(state: State, segment: list[Step], stats: Statistics) -> State:
    state = state.with_df(stats.attach(state.df))
    for step in segment:
        state = FORMS[state.form][step.operation](state, step, stats)
    return state.with_df(stats.detach(state.df))


@dataclass(frozen=True)
class FittedPipeline:
    """Segments of steps with their statistics; `transform` starts no fitting job."""

    segments: tuple[tuple[tuple[Step, ...], Statistics], ...]
    start: State
    frozen: tuple[tuple[str, str], ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        state = replace(self.start, df=_frozen(df, self.frozen))
        for segment, stats in self.segments:
            state = _run_segment(state, list(segment), stats)
        return _finish(state)


def _frozen(df: DataFrame, names: tuple[tuple[str, str], ...]) -> DataFrame:
    """df with hidden copies of the columns that tell the row order."""
    return df.withColumns({hidden: col(c) for c, hidden in names}) if names else df


def _finish(state: State, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sort once, by the latest sorting step first, and drop the hidden columns."""
    df = state.df
    if state.sorts:
        group = [col(state.group)] if state.group else []
        ties = [col(o) for o in state.order_by]
        keys = [*group, *[s.column() for s in state.sorts]]
        df = sort_rows(df, keys, ties, distinct_rows=POSITION in state.order_by)
    return df.drop(*[c for c in df.columns if c.startswith(HIDDEN) and c not in keep])


def _fit_and_run(
    df: DataFrame,
    spec: PipelineSpec,
    form: str,
    order_by: list[str] | str | None,
    on_missing: str,
    split: bool,
    max_categories: int | None,
    group: str | None,
) -> tuple[State, State, list, tuple]:
    if form not in FORMS:
        raise SpecError(f"Unknown form: {form}")
    order = (order_by,) if isinstance(order_by, str) else tuple(order_by or ())
    # Rows keep the order they came in: where a step rewrites a column of that order, a hidden copy stands in for it.
    rewritten = {s.column for s in spec.steps if s.operation not in _KEEPS_CELLS}
    frozen = tuple((c, f"{HIDDEN}order{i}") for i, c in enumerate(order) if c in rewritten)
    names = dict(frozen)
    start = State(
        _frozen(df, frozen),
        form=form,
        order_by=tuple(names.get(c, c) for c in order),
        group=group,
        split=split,
        max_categories=max_categories,
    )
    state, rest, segments = start, list(spec.steps), []
    shuffled = False
    while rest:
        segment, used = _barrier(state, rest, on_missing)
        if shuffled and any(_needs(state, s) for s in segment):
            # Later scans re-read a written table instead of repeating a shuffle.
            state = state.with_df(written(state.df, "barrier"))
            shuffled = False
        stats = _measure(state, segment)
        state = _run_segment(state, segment, stats)
        segments.append((tuple(segment), stats))
        shuffled |= any(s.operation in _SHUFFLES for s in segment)
        rest = rest[used:]
    return start, state, segments, frozen


def fit(
    df: DataFrame,
    spec: PipelineSpec,
    form: str = "engine",
    order_by: list[str] | str | None = None,
    on_missing: str = "skip",
    split: bool = False,
    max_categories: int | None = None,
) -> FittedPipeline:
    """Statistics of every step, read off `df`."""
    start, _, segments, frozen = _fit_and_run(
        df, spec, form, order_by, on_missing, split, max_categories, None
    )
    return FittedPipeline(tuple(segments), replace(start, df=None), frozen)


def run(
    df: DataFrame,
    spec: PipelineSpec,
    form: str = "engine",
    order_by: list[str] | str | None = None,
    on_missing: str = "skip",
    split: bool = False,
    max_categories: int | None = None,
    group: str | None = None,
) -> DataFrame:
    """PL1: the steps in order, with statistics of the table itself.

    With `group`, every statistic is taken per value of that column.
    """
    _, state, _, _ = _fit_and_run(
        df, spec, form, order_by, on_missing, split, max_categories, group
    )
    return _finish(state, keep=(group,) if group else ())


def run_steps(df: DataFrame, *steps: Step, **options) -> DataFrame:
    return run(df, PipelineSpec(tuple(steps)), **options)
