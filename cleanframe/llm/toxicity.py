"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, windows that tell quotation from abuse.

`fit` learns a lexicon of terms and open stems (a stem matches any word that begins with it) from a bounded sample
of labelled texts. `score` finds lexicon entries in whole texts. The trie of the lexicon is intersected with the
Levenshtein automata of its entries: a state is a set of (trie node, errors so far); states are made once, on first
use, so that looking up a word costs one step for each letter and most words end in the dead state after a few.

Defined results: a NULL or empty text has no hits and gets the score of a text without hits. NULL labels are not
learned from. Without a positive label the lexicon is empty and every score is 0. Repeated rows are scored one by one.
Columns beyond id and text are ignored by `score`; `keep_clean` returns all columns of its input unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from cleanframe.llm.common import bound_arrow_batches, returning_memory, smallest, written

#: Marks and words that introduce a quotation.
QUOTES = frozenset("\"'`«»“”„‘’‹›")
REPORTS = frozenset(
    "said says wrote called calls quote quoted quotes term word slur sagte schrieb nannte zitat wort "
    "dit disait appelle citation mot dijo llamó cita palabra".split()
)
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’‹›…–—¿¡"
#: Log odds under which a match says nothing: clean texts hold such words by chance.
NOISE = 2.5
PARTS = re.compile(r"[^\w]+")
#: Pieces that a task counts before it hands the counts on; their sums do not depend on it.
HELD_PIECES = 200_000


def edits(entry: str) -> int:
    """Errors that a misspelling of the entry may hold."""
    return 0 if len(entry) < 4 else 1 if len(entry) < 8 else 2


@dataclass
class Automaton:
    """The lexicon's trie intersected with Levenshtein automata, made deterministic step by step.

    entries: (text, open); an open entry also matches words that go on after it.
    """

    entries: list[tuple[str, bool]]
    max_states: int = 200_000
    trie: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, int] = field(default_factory=dict)
    room: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for i, (text, _) in enumerate(self.entries):
            node = 0
            for ch in text:
                self.room[node] = max(self.room[node], edits(text))
                if ch not in self.trie[node]:
                    self.trie.append({})
                    self.room.append(0)
                    self.trie[node][ch] = len(self.trie) - 1
                node = self.trie[node][ch]
            self.room[node] = max(self.room[node], edits(text))
            self.ends[node] = i
        self._clear()

    def _clear(self):
        self.steps: dict[tuple, frozenset] = {}
        self.start = self._close({(0, 0)})

    def _close(self, states: set) -> frozenset:
        """Adds what skipping letters of the entry reaches; keeps the fewest errors for each node."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, errors = todo.pop()
            if errors > self.room[node] or best.get(node, 99) <= errors:
                continue
            best[node] = errors
            todo.extend((child, errors + 1) for child in self.trie[node].values())
        return frozenset(best.items())

    def _step(self, state: frozenset, ch: str) -> frozenset:
        reached = set()
        for node, errors in state:
            reached.add((node, errors + 1))  # a letter too many
            for letter, child in self.trie[node].items():
                reached.add((child, errors + (letter != ch)))
        return self._close(reached)

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, errors) with the fewest errors, then the longest entry, then the first; None without a match."""
        state, found = self.start, None
        for ch in word:
            key = (state, ch)
            after = self.steps.get(key)
            if after is None:
                if len(self.steps) >= self.max_states:
                    self._clear()
                after = self.steps[key] = self._step(state, ch)
            state = after
            if not state:
                return found
            for node, errors in state:
                i = self.ends.get(node)
                if i is not None and self.entries[i][1] and errors <= edits(self.entries[i][0]):
                    found = self._better(found, (i, errors))
        for node, errors in state:
            i = self.ends.get(node)
            if i is not None and errors <= edits(self.entries[i][0]):
                found = self._better(found, (i, errors))
        return found

    def _better(self, a: tuple[int, int] | None, b: tuple[int, int]) -> tuple[int, int]:
        rank = lambda x: (x[1], -len(self.entries[x[0]][0]), x[0])
        return b if a is None or rank(b) < rank(a) else a


class Words(dict):
    """Matches of written words, at most `room` kept at a time."""

    def __init__(self, automaton: Automaton, room: int = 200_000):
        self.automaton, self.room = automaton, room

    def __missing__(self, raw: str):
        if len(self) >= self.room:
            self.clear()
        core = raw.strip(STRIP)
        found = self.automaton.match(core) if core else None
        if found is None and core and not core.isalnum():
            parts = [m for p in PARTS.split(core) if p and (m := self.automaton.match(p))]
            found = min(parts, key=lambda m: m[1], default=None)
        self[raw] = found
        return found


def quoted(tokens: list[str], at: int, window: int) -> bool:
    """Whether the token stands in a quotation: marks around it or a reporting word before it, within the window."""
    opens = closes = False
    for t in tokens[max(0, at - window) : at + 1]:
        opens = t[0] in QUOTES or (opens and not (t[-1] in QUOTES and t is not tokens[at]))
    for t in tokens[at : at + window + 1]:
        if t.rstrip(".,;:!?)")[-1:] in QUOTES and t.rstrip(".,;:!?)")[-1:]:
            closes = True
            break
    if opens and closes:
        return True
    return any(t.strip(STRIP) in REPORTS for t in tokens[max(0, at - 4) : at])


def hits(text: str | None, words: Words, window: int) -> list[tuple[int, int, int, bool]]:
    """(token position, entry, errors, quoted) of each lexicon hit of a whole text."""
    tokens = text.lower().split() if text else []
    found = list(map(words.__getitem__, tokens))
    return [(i, m[0], m[1], quoted(tokens, i, window)) for i, m in enumerate(found) if m is not None]


@dataclass(frozen=True)
class ToxicityModel:
    """entries and their weights by number of errors; bias and slopes of abusive and quoted evidence."""

    entries: tuple[tuple[str, bool], ...]
    weights: tuple[tuple[float, ...], ...]
    bias: float
    abusive: float
    in_quotes: float
    window: int

    def evidence(self, found: list[tuple[int, int, int, bool]]) -> tuple[float, float]:
        sums = [0.0, 0.0]
        for _, entry, errors, in_quotes in found:
            sums[in_quotes] += self.weights[entry][errors]
        return math.log1p(sums[0]), math.log1p(sums[1])

    def score(self, found: list[tuple[int, int, int, bool]]) -> float:
        if not self.entries:
            return 0.0
        a, q = self.evidence(found)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + self.abusive * a + self.in_quotes * q))))


def _signatures(batches):
    """Adds the smallest hash of a text's three-word runs: near copies mostly share it."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        keys = []
        for text in texts:
            w = text.lower().split()
            runs = zip(w, w[1:], w[2:]) if len(w) > 2 else [tuple(w)]
            keys.append(min(map(_stable, runs)))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("text"), pa.array(keys, pa.int64())], ["toxic", "text", "key"])


def _stable(run: tuple[str, ...]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(" ".join(run)) >> 1


def _pieces(shortest: int, longest: int):
    """Counts the texts that hold a word (marked by its end) or a beginning of one, by label."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                own = set()
                for raw in set(text.lower().split()):
                    word = raw.strip(STRIP)
                    if len(word) > 1:
                        own.add(word + "\n")
                        own.update(word[:n] for n in range(shortest, min(len(word), longest) + 1))
                counts.update((p, toxic) for p in own)
                if len(counts) > HELD_PIECES:
                    yield _rows(counts)
                    counts = Counter()
        yield _rows(counts)

    return returning_memory(run)


def _rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in counts], pa.string()),
            pa.array([k[1] for k in counts], pa.int32()),
            pa.array(list(counts.values()), pa.int64()),
        ],
        ["piece", "toxic", "n"],
    )


def lexicon(support: dict[str, int], shortest: int) -> list[tuple[str, bool]]:
    """Entries from pieces that mark toxic texts: smallest beginnings, drawn out while the support stays."""
    entries, taken = [], set()
    for piece in sorted(support, key=lambda p: (len(p), p)):
        if piece.endswith("\n") and len(piece) - 1 >= shortest:
            continue
        if any(piece[:n] in taken for n in range(shortest, len(piece))):
            continue
        taken.add(piece)
        text, n = piece, support[piece]
        while not text.endswith("\n"):
            longer = [p for p in support if len(p) == len(text) + 1 and p.startswith(text) and support[p] >= 0.95 * n]
            if not longer:
                break
            text = max(longer, key=lambda p: (support[p], p))
        entries.append((text.rstrip("\n"), not text.endswith("\n")))
    return sorted(set(entries))


def _evidence(automaton: Automaton, window: int):
    def run(batches):
        words = Words(automaton)
        for batch in batches:
            found = [hits(t, words, window) for t in batch.column("text").to_pylist()]
            rows = [[f"{e}:{k}:{int(q)}" for _, e, k, q in h] for h in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.string()))], ["toxic", "hits"])

    return returning_memory(run)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_per_class: int = 4000,
    min_share: float = 0.005,
    window: int = 12,
) -> ToxicityModel:
    """Learns from at most `sample_per_class` labelled texts of each class (those with the smallest id hash).

    Near copies in the sample count once. A piece enters the lexicon if at least `min_share` of the toxic texts
    (and four) hold it, and clean texts hold it at most a fiftieth as often.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    order = (F.xxhash64("id"), F.col("id"))
    chosen = smallest(known.filter("toxic = 1"), sample_per_class, *order).unionAll(smallest(known.filter("toxic = 0"), sample_per_class, *order))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).filter("text is not null")
    sample = texts.join(F.broadcast(chosen), "id").select("toxic", "text")
    shape = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
    keyed = sample.mapInArrow(_signatures, T.StructType([*shape, T.StructField("key", T.LongType())]))
    sample = written(keyed.groupBy("toxic", "key").agg(F.min("text").alias("text")).select("toxic", "text"), "toxic-sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad:
        return ToxicityModel((), (), 0.0, 0.0, 0.0, window)
    shortest = 3
    counts = sample.mapInArrow(_pieces(shortest, 10), "piece string, toxic int, n long").groupBy("piece").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
    )
    least = max(min(4, bad), math.ceil(min_share * bad))
    marked = counts.filter((F.col("bad") >= least) & (F.col("good") * 50.0 * bad <= F.col("bad") * float(max(good, 1))))
    # At most (pieces of a text) / min_share rows: each needs that share of the sampled toxic texts.
    support = {r["piece"]: r["bad"] for r in marked.select("piece", "bad").collect()}
    entries = lexicon(support, shortest)
    found = sample.mapInArrow(_evidence(Automaton(entries), window), "toxic int, hits array<string>").collect()
    return _weights(entries, [(r["toxic"], [tuple(map(int, h.split(":"))) for h in r["hits"]]) for r in found], bad, good, window)


def _weights(entries, found, bad: int, good: int, window: int) -> ToxicityModel:
    held: dict = defaultdict(lambda: [0, 0])
    for toxic, rows in found:
        for key in {(e, k) for e, k, _ in rows}:
            held[key][toxic] += 1

    def weight(entry: int, errors: int) -> float:
        clean, toxic = held[entry, errors]
        odds = math.log((toxic + 0.5) / (bad + 1)) - math.log((clean + 0.5) / (good + 1))
        if errors and not clean:  # a misspelling that clean texts never show counts as much as two thirds of the entry
            odds = max(odds, 2 / 3 * weight(entry, 0))
        return odds if odds >= NOISE else 0.0

    weights = tuple(tuple(weight(i, k) for k in range(edits(t) + 1)) for i, (t, _) in enumerate(entries))
    model = ToxicityModel(tuple(entries), weights, 0.0, 0.0, 0.0, window)
    x = np.array([(1.0, *model.evidence([(0, e, k, bool(q)) for e, k, q in rows])) for _, rows in found])
    y = np.array([float(toxic) for toxic, _ in found])
    beta = np.zeros(3)
    for _ in range(50):  # ridge-penalised logistic regression of three numbers, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        gradient = x.T @ (y - p) - 0.05 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return ToxicityModel(model.entries, weights, float(beta[0]), float(max(beta[1], 0)), float(max(beta[2], 0)), window)


def _scores(model: ToxicityModel, names: list[str]):
    def run(batches):
        words = Words(Automaton(list(model.entries)))
        for batch in batches:
            found = [hits(t, words, model.window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([model.score(h) for h in found], pa.float64()),
                    pa.array([len(h) for h in found], pa.int64()),
                    pa.array([sum(q for *_, q in h) for h in found], pa.int64()),
                ],
                names,
            )

    return returning_memory(run)


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, score (0 to 1), n_hits, n_quoted."""
    kind = docs.schema[id_column].dataType
    out = T.StructType(
        [T.StructField(id_column, kind), T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("n_quoted", T.LongType())]
    )
    bound_arrow_batches(docs.sparkSession, 4 << 20)
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(_scores(model, out.names), out)


def _clean(model: ToxicityModel, threshold: float):
    def run(batches):
        words = Words(Automaton(list(model.entries)))
        for batch in batches:
            yield pa.array([model.score(hits(t.as_py(), words, model.window)) < threshold for t in batch], pa.bool_())

    return run


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns as they were. Only texts go to Python, and one boolean
    for each comes back."""
    bound_arrow_batches(docs.sparkSession, 4 << 20)

    @arrow_udf("boolean")
    def is_clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from returning_memory(_clean(model, threshold))(batches)

    return docs.filter(is_clean(F.col(text)))
