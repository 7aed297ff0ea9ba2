"""Conversation structure repair: cheapest edits that make the roles of a conversation alternate.

The first letters of the roles must read `(s?(ua)+)?`. Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert
(an empty turn of user or assistant) 5. Blank and duplicate turns must go; a truncated turn that stays costs 5 more. Of the
cheapest edits the ones whose letters (D, I, K, R) come first in ASCII order are taken.

A turn is a symbol, its role and its first fault. Reading a symbol is a min-plus matrix over four states (nothing read, after
s, after u, after a). Equal consecutive symbols are a run, and the costs before a run are those after it, advanced through
cached binary powers of the symbol's matrix. The choices are then unrolled forwards from the costs.

Turns are sorted by conversation and turn into range partitions, so that a long conversation spreads over tasks, and packed
into segments of consecutive turns of a batch. Only the first and last segment of a batch can belong to a conversation that
goes on elsewhere: matrices of those are multiplied from behind and their state maps composed from the front, partition by
partition, after which every segment is unrolled by itself.

Defined results: turns of equal number stand in the order of role and text digest. A NULL turn number comes first. NULL roles
and texts count as one space, so a NULL text is blank. NULL conversation ids are one conversation. Repeated rows are
duplicates. Very long texts pass through in batches bounded by bytes; an empty table gives an empty table. Other columns are
ignored. The digest of a conversation is one stream of one task, the only step that cannot be split.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cleanframe.llm.common import bound_arrow_batches, scanned, struct_type, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: States: 0 nothing read, 1 after s, 2 after u, 3 after a. The state after the next user or assistant turn:
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
FAR = 1 << 40
OK, CUT, BLANK, DUPLICATE = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
Matrix = tuple[tuple[int, ...], ...]
UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def applied(m: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(m[i][j] + costs[j] for j in range(4)) for i in range(4))


def _inserts() -> Matrix:
    once = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else FAR for j in range(4)) for i in range(4))
    return times(times(once, once), once)


INSERTS = _inserts()
#: Costs from each state when no turn is left: what must be inserted until the conversation may end.
END = applied(INSERTS, (0, FAR, FAR, 0))


def _kept(code: int, state: int) -> int | None:
    """The state after the turn as it is, None if it may not stand there."""
    role = code // 4
    if role == 0:
        return 1 if state == 0 else None
    if role == 1:
        return 2 if state != 2 else None
    return 3 if role == 2 and state == 2 else None


@lru_cache(maxsize=4096)
def power(code: int, exponent: int) -> Matrix:
    """The matrix of 2 ** exponent turns of one symbol."""
    if exponent:
        half = power(code, exponent - 1)
        return times(half, half)
    fault = code % 4
    more = TRUNCATED if fault == CUT else 0
    rows = []
    for state in range(4):
        row = [FAR] * 4
        row[state] = DELETE
        if fault not in (BLANK, DUPLICATE):
            row[NEXT[state]] = min(row[NEXT[state]], REROLE + more)
            after = _kept(code, state)
            if after is not None:
                row[after] = min(row[after], KEEP + more)
        rows.append(tuple(row))
    return times(INSERTS, tuple(rows))


def runs(codes: list[int]) -> list[tuple[int, int]]:
    return [(code, sum(1 for _ in same)) for code, same in groupby(codes)]


def advance(code: int, count: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before `count` turns of a symbol from the costs after them."""
    exponent = 0
    while count:
        if count & 1:
            costs = applied(power(code, exponent), costs)
        count, exponent = count >> 1, exponent + 1
    return costs


def product(codes: list[int]) -> Matrix:
    whole = UNIT
    for code, count in runs(codes):
        exponent = 0
        while count:
            if count & 1:
                whole = times(whole, power(code, exponent))
            count, exponent = count >> 1, exponent + 1
    return whole


def relative(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Only differences decide, so equal ones share their cached choices."""
    low = min(costs)
    return tuple(c - low for c in costs)


@lru_cache(maxsize=100_000)
def before(code: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    return relative(applied(power(code, 0), costs))


@lru_cache(maxsize=100_000)
def choices(code: int, after: tuple[int, ...]) -> tuple[tuple[tuple[str, ...], int, int], ...]:
    """For each state: the edits at a turn (inserts first), the state after it and what they cost; `after` holds the costs
    of what follows."""
    here = applied(power(code, 0), after)
    fault, out = code % 4, []
    more = TRUNCATED if fault == CUT else 0
    for state in range(4):
        edits, cost = [], 0
        while True:
            if DELETE + after[state] == here[state]:
                out.append(((*edits, "D"), state, cost + DELETE))
                break
            if INSERT + here[NEXT[state]] == here[state]:
                state = NEXT[state]
                edits.append("I" + ROLES[state])
                cost += INSERT
                continue
            kept = _kept(code, state)
            if kept is not None and KEEP + more + after[kept] == here[state]:
                out.append(((*edits, "K"), kept, cost + KEEP + more))
                break
            out.append(((*edits, "R" + ROLES[NEXT[state]]), NEXT[state], cost + REROLE + more))
            break
    return tuple(out)


def _followed(codes: list[int], end: tuple[int, ...]):
    """(code, costs after it) for each turn in order. Costs at the ends of runs come from powers, those inside a run step by step."""
    found, costs = [], relative(end)
    for code, count in reversed(runs(codes)):
        found.append((code, count, costs))
        costs = relative(advance(code, count, costs))
    for code, count, costs in reversed(found):
        inner = [costs]
        for _ in range(count - 1):
            inner.append(before(code, inner[-1]))
        for after in reversed(inner):
            yield code, after


def states_after(codes: list[int], end: tuple[int, ...]) -> list[int]:
    """The state after the turns for each state before them."""
    states = [0, 1, 2, 3]
    for code, after in _followed(codes, end):
        row = choices(code, after)
        states = [row[s][1] for s in states]
    return states


def unrolled(codes: list[int], start: int, end: tuple[int, ...], last: bool) -> tuple[list[tuple[str, ...]], tuple[str, ...], int]:
    """The edits of each turn, those after the last turn, and the cost."""
    edits, state, cost = [], start, 0
    for code, after in _followed(codes, end):
        own, state, more = choices(code, after)[state]
        edits.append(own)
        cost += more
    rest = []
    while last and state in (1, 2):
        state = NEXT[state]
        rest.append("I" + ROLES[state])
        cost += INSERT
    return edits, tuple(rest), cost


def _packed(names: list[str]):
    """Sorted rows to segments: consecutive rows of a batch that belong to one conversation."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("c").to_pylist()
            starts = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
            ends = [*starts[1:], len(ids)]
            codes = batch.column("code").to_pylist()
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            for a, b in zip(starts[1:-1], ends[1:-1]):  # whole conversations
                seen = set()
                for i in range(a, b):
                    if codes[i] % 4 != BLANK and keys[i] in seen:
                        codes[i] = codes[i] // 4 * 4 + DUPLICATE
                    seen.add(keys[i])
            offsets = pa.array([*starts, len(ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(codes, pa.int32()), *map(batch.column, ("k1", "k2", "role", "text")))]
            edge = [i in (0, len(starts) - 1) for i in range(len(starts))]
            first = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("c").take(first), batch.column("at").take(first), pa.array(edge, pa.bool_()), *lists], names)

    return run


def _repaired(names: list[str], digest: bool):
    """Segments with (start, end costs, last, class before) to their edits, repaired turns and counts."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                codes = row["codes"]
                for i in row["repeats"] or ():
                    if codes[i] % 4 != BLANK:
                        codes[i] = codes[i] // 4 * 4 + DUPLICATE
                edits, rest, cost = unrolled(codes, row["start"], tuple(row["ends"]), row["last"])
                turns = []
                for own, role, text in zip(edits, row["roles"], row["texts"]):
                    for edit in own:
                        if edit == "K":
                            turns.append((role, text))
                        elif edit[0] == "R":
                            turns.append((edit[1:], text))
                        elif edit[0] == "I":
                            turns.append((edit[1:], ""))
                turns += [(edit[1:], "") for edit in rest]
                classes = [c // 4 for c in codes]
                prior = [row["prior"], *classes[:-1]] if row["prior"] >= 0 else classes[:-1]
                pairs = zip(prior, classes if row["prior"] >= 0 else classes[1:])
                faults = [c % 4 for c in codes]
                rows.append(
                    {
                        "c": row["c"],
                        "at": row["at"],
                        "audit": "".join(e[0] for own in edits for e in own) + "I" * len(rest),
                        "cost": cost,
                        "blank": faults.count(BLANK),
                        "duplicate": faults.count(DUPLICATE),
                        "truncated": faults.count(CUT),
                        "illegal": sum(p not in LEGAL for p in pairs),
                        "roles": [r for r, _ in turns],
                        "texts": [t for _, t in turns],
                    }
                )
            columns = [pa.array([r[n] for r in rows], batch.schema.field(n).type if n in ("c", "at") else _KINDS[n]) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


_KINDS = {
    **dict.fromkeys(("cost", "blank", "duplicate", "truncated", "illegal"), pa.int64()),
    **dict.fromkeys(("roles", "texts"), pa.list_(pa.string())),
    "audit": pa.string(),
    "repaired_sha256": pa.string(),
}
_COUNTS = ("cost", "blank", "duplicate", "truncated", "illegal")


def _joined(names: list[str]):
    """Segments sorted by conversation and place to one row for each conversation; texts stream through a digest."""

    def run(batches):
        held = None

        def row(kind):
            values = [held["c"], *(held[n] for n in _COUNTS), "".join(held["audit"]), held["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], kind if n == "c" else _KINDS[n]) for n, v in zip(names, values)], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("c").type
            for i in range(batch.num_rows):
                one = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if held is None or one["c"] != held["c"]:
                    if held is not None:
                        yield row(kind)
                    held = {"c": one["c"], "audit": [], "sha": hashlib.sha256(), "any": False, **dict.fromkeys(_COUNTS, 0)}
                held["audit"].append(one["audit"])
                for n in _COUNTS:
                    held[n] += one[n]
                for role, text in zip(one["roles"], one["texts"]):
                    held["sha"].update((("\n" if held["any"] else "") + f"{role}:{text}").encode())
                    held["any"] = True
        if held is not None:
            yield row(kind)

    return run


class Repair:
    """The repaired turns of a table of conversations and what the repair found."""

    def __init__(self, turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        bound_arrow_batches(turns.sparkSession)
        self.kind = turns.schema[conversation].dataType
        blank_for_null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        self.source = turns.select(
            F.col(conversation).alias("c"), F.col(turn).alias("t"), blank_for_null(role).alias("role"), blank_for_null(text).alias("text"), F.monotonically_increasing_id().alias("row")
        )
        stripped = F.rtrim("text", F.lit(SPACE))
        letter = F.substring("role", 1, 1)
        place = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
        fault = F.when(stripped == "", BLANK).when(F.substring(stripped, -1, 1).isin(".", "!", "?"), OK).otherwise(CUT)
        coded = self.source.select(
            "c", "t", "row", "role", "text", (place * 4 + fault).cast("int").alias("code"), F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2")
        )
        order = ["c", "t", "role", "k1", "k2", "row"]
        ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        texts = T.ArrayType(T.StringType())
        self.shape = struct_type(
            c=self.kind, at=T.LongType(), edge=T.BooleanType(), codes=T.ArrayType(T.IntegerType()), k1=T.ArrayType(T.LongType()), k2=T.ArrayType(T.LongType()), roles=texts, texts=texts
        )
        packed = ordered.select("c", "at", "code", "k1", "k2", "role", "text").mapInArrow(_packed(self.shape.names), self.shape)
        self.segments = written(packed, "conversation-segments")

    def _repeats(self, edges: DataFrame) -> DataFrame:
        """(at, repeats): places in the edge segments whose role and text stand earlier in the conversation."""
        each = edges.select("c", "at", F.posexplode(F.arrays_zip("k1", "k2")).alias("i", "k")).select("c", "at", "i", "k.k1", "k.k2")
        firsts = each.groupBy("c", "k1", "k2").agg(F.min(F.struct("at", "i")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        firsts = firsts.select(F.col("c").alias("fc"), F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first")
        later = each.join(firsts, F.col("c").eqNullSafe(F.col("fc")) & (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")))
        later = later.filter((F.col("at") != F.col("first.at")) | (F.col("i") != F.col("first.i")))
        return later.groupBy("at").agg(F.collect_list("i").alias("repeats"))

    def repaired(self) -> DataFrame:
        """(c, at, edge, audit, counts, roles, texts) of each segment; `at` gives the order in a conversation."""
        edges = self.segments.filter("edge")
        edges = edges.join(self._repeats(edges), "at", "left")
        codes = written(edges.select("c", "at", (F.shiftright("at", 33)).alias("block"), "codes", "repeats"), "conversation-edges")

        def faults(row) -> list[int]:
            found = row["codes"]
            for i in row["repeats"] or ():
                if found[i] % 4 != BLANK:
                    found[i] = found[i] // 4 * 4 + DUPLICATE
            return found

        def matrices(batches):
            for batch in batches:
                values = [[*(x for line in product(faults(r)) for x in line), 1] for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("c", "block", "at")), pa.array(values, pa.list_(pa.int64()))], ["c", "block", "at", "value"])

        def maps(batches):
            for batch in batches:
                values = []
                for r in batch.to_pylist():
                    found = faults(r)
                    values.append([*states_after(found, _ends(r["rest"])), found[-1] // 4])
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("c", "block", "at")), pa.array(values, pa.list_(pa.int64()))], ["c", "block", "at", "value"])

        kind = struct_type(c=self.kind, block=T.LongType(), at=T.LongType(), value=T.ArrayType(T.LongType()))
        behind = scanned(codes.mapInArrow(matrices, kind), [*(x for line in UNIT for x in line), 0], _product_of, backwards=True)
        behind = written(behind.withColumnRenamed("before", "rest"), "conversation-costs")
        ahead = scanned(codes.join(behind, "at").mapInArrow(maps, kind), [0, 1, 2, 3, -1], _composed, backwards=False)
        ahead = ahead.select("at", F.col("before")[0].cast("int").alias("start"), F.col("before")[4].cast("int").alias("prior"))

        def costs(batches):
            for batch in batches:
                rest = batch.column("rest").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("at"), pa.array([list(_ends(r)) for r in rest], pa.list_(pa.int64())), pa.array([r[16] == 0 for r in rest], pa.bool_())], ["at", "ends", "last"]
                )

        ends = behind.mapInArrow(costs, "at long, ends array<long>, last boolean")
        known = codes.select("at", "repeats").join(ends, "at").join(ahead, "at")
        wanted = ["c", "at", "codes", "roles", "texts", "repeats", "start", "ends", "last", "prior"]
        alone = self.segments.filter("not edge").select(
            "c", "at", "codes", "roles", "texts", F.lit(None).cast("array<int>").alias("repeats"), F.lit(0).alias("start"),
            F.array(*[F.lit(x).cast("long") for x in END]).alias("ends"), F.lit(True).alias("last"), F.lit(-1).alias("prior"),
        )
        linked = self.segments.filter("edge").select("c", "at", "codes", "roles", "texts").join(known, "at").select(*wanted)
        texts, long = T.ArrayType(T.StringType()), T.LongType()
        shape = struct_type(c=self.kind, at=long, audit=T.StringType(), **dict.fromkeys(_COUNTS, long), roles=texts, texts=texts)
        mended = lambda df: df.mapInArrow(_repaired(shape.names, True), shape)
        return mended(alone.select(*wanted)).withColumn("edge", F.lit(False)).unionByName(mended(linked).withColumn("edge", F.lit(True)))

    def turns(self) -> DataFrame:
        """The repaired turns (conversation, seq, role, text); seq gives their order."""
        each = self.repaired().select("c", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "turn"))
        return each.select(F.col("c").alias("conversation"), F.struct("at", "i").alias("seq"), F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))

    def conversations(self) -> DataFrame:
        """One row for each conversation: c, cost, blank, duplicate, truncated, illegal, audit, repaired_sha256, gaps."""
        shape = struct_type(c=self.kind, **dict.fromkeys(_COUNTS, T.LongType()), audit=T.StringType(), repaired_sha256=T.StringType())
        segments = self.repaired()
        columns = ["c", "at", "audit", *_COUNTS, "roles", "texts"]
        split = segments.filter("edge").select(*columns).repartition("c").sortWithinPartitions("c", "at").mapInArrow(_joined(shape.names), shape)
        lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
        whole = segments.filter("not edge").select("c", *_COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
        found = whole.unionByName(split)
        numbers = self.source.groupBy("c").agg((F.max("t") - F.min("t") + 1 - F.countDistinct("t")).cast("long").alias("gaps"))
        numbers = numbers.select(F.col("c").alias("nc"), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"))
        return found.join(numbers, F.col("c").eqNullSafe(F.col("nc"))).drop("nc")


def _ends(rest: list[int]) -> tuple[int, ...]:
    """Costs after a segment from the product of the matrices behind it."""
    return applied(tuple(tuple(rest[4 * i : 4 * i + 4]) for i in range(4)), END)


def _product_of(a: list[int], b: list[int]) -> list[int]:
    """The later segment's matrix stands on the right; the numbers of segments add up."""
    whole = times(tuple(tuple(a[4 * i : 4 * i + 4]) for i in range(4)), tuple(tuple(b[4 * i : 4 * i + 4]) for i in range(4)))
    return [*(x for line in whole for x in line), a[16] + b[16]]


def _composed(a: list[int], b: list[int]) -> list[int]:
    """State map of a, then b; the class of the last turn."""
    return [*(b[s] for s in a[:4]), b[4] if b[4] >= 0 else a[4]]


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    return Repair(turns, conversation, turn, role, text)
