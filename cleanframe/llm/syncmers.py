"""Document fingerprints from closed syncmers, compared by positions.

A k-mer of code points is an anchor if the smallest of its inner s-mers (the leftmost of equals) stands at either edge. That
depends on the k-mer alone, so equal passages have equal anchors wherever they stand, and any k - s + 1 consecutive k-mers
hold at least one. A text that is shorter than k, but not empty, is one anchor of its own.

A fingerprint holds the `size` anchors with the smallest hashes, each with its position, in the order of the text. Two
fingerprints are complete samples of their texts' anchors up to the smaller of their largest hashes; of the anchors below
that, those of equal hash are matched and the longest chain that runs forwards in both texts counts. Likeness is twice the
chain over the anchors of both, an estimate of the share of text that both have in the same order.

Documents are dealt to ranges of (id, text digest), split at quantiles of a bounded sample; each range also gets the first
document of the next range, so that a stream over the sorted range sees every document with its successor. Texts move once.

Defined results: NULL texts are empty. Empty texts have the empty fingerprint, whose likeness to another empty one is 1 and
to any other 0. Rows of equal id follow each other by text digest, NULL ids come first. Repeated rows are rows of their own.
Of a very long text one task holds the code points and, block by block, the hashes. An empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from cleanframe.llm.common import bound_arrow_batches, struct_type

K, S, SIZE = 16, 6, 64
#: K-mers whose hashes are held at once.
BLOCK = 1 << 16
#: Documents sampled for each range, to find where ranges end.
SAMPLED = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Powers of the multiplier, the highest first.
FACTORS = np.cumprod(np.full(63, MULTIPLIER, np.uint64), dtype=np.uint64)[::-1]
FACTORS = np.append(FACTORS, np.uint64(1))


def _hashes(points: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` code points."""
    n = len(points) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * MULTIPLIER + points[i : i + n]
    return _mixed(total + np.uint64(width))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every run of `width`, from runs twice as long each time."""
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    return low


@dataclass(frozen=True)
class Anchors:
    """Positions (ascending) and hashes of the anchors of a text."""

    at: np.ndarray
    key: np.ndarray

    def within(self, start: int, end: int, shift: int, k: int) -> Anchors:
        """Those whose k-mers lie in [start, end), moved by shift."""
        a, b = np.searchsorted(self.at, (start, max(start, end - k + 1)))
        return Anchors(self.at[a:b] + shift, self.key[a:b])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def anchors(points: np.ndarray, k: int = K, s: int = S) -> Anchors:
    """The closed syncmers of a text."""
    n = len(points) - k + 1
    found = []
    for start in range(0, max(n, 0), BLOCK):
        part = points[start : min(n, start + BLOCK) + k - 1]
        inner = _hashes(part, s)
        rest = _lowest(inner, k - s)  # of every run of k - s inner hashes
        here = np.flatnonzero((inner[: s - k] <= rest[1:]) | (inner[k - s :] < rest[:-1]))
        found.append((here + start, _mixed(part[here[:, None] + np.arange(k)] @ FACTORS[-k:] + np.uint64(k))))
    if not found:
        return Anchors(np.empty(0, np.int64), np.empty(0, np.uint64))
    return Anchors(*(np.concatenate(x) for x in zip(*found)))


def whole(points: np.ndarray) -> Anchors:
    """The one anchor of a text that is shorter than k."""
    if not len(points):
        return Anchors(np.empty(0, np.int64), np.empty(0, np.uint64))
    return Anchors(np.zeros(1, np.int64), _hashes(points, len(points)))


def sketch(found: Anchors, size: int = SIZE) -> np.ndarray:
    """(hash, position) of the anchors with the smallest 32-bit hashes, the first position of each, in text order."""
    keys, first = np.unique((found.key >> np.uint64(32)).astype(np.uint32), return_index=True)
    keys, places = keys[:size], found.at[first[:size]]
    order = np.argsort(places, kind="stable")
    return np.stack([keys[order].astype(np.int64), places[order]], axis=1)


def written_out(marks: np.ndarray) -> str:
    """Four bytes of hash and four of position for each anchor, in base64."""
    return base64.b64encode(marks.astype("<u4").tobytes()).decode()


def read_back(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Twice the longest chain of common anchors over the anchors of both, as far as both sketches are complete."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    limit = min(x[:, 0].max() if len(x) == size else np.inf for x in (a, b))
    a, b = a[a[:, 0] <= limit], b[b[:, 0] <= limit]
    where = dict(b.tolist())
    tails: list[int] = []
    for key, _ in a.tolist():
        place = where.get(key)
        if place is not None:
            i = bisect_left(tails, place)
            tails[i : i + 1] = [place]
    return 2 * len(tails) / (len(a) + len(b))


@dataclass(frozen=True)
class Document:
    """A text with its code points, anchors and sketch; each is computed once."""

    text: str
    points: np.ndarray
    found: Anchors
    marks: np.ndarray

    @classmethod
    def of(cls, text: str) -> Document:
        points = code_points(text)
        found = anchors(points)
        return cls(text, points, found, sketch(found if len(points) >= K else whole(points)))

    def edited(self, after: Document) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by the start of the next one, and its sketch: anchors of both parts are
        those of the whole texts, only the k-mers across the seam are new."""
        n = len(self.points)
        keep = n - n // 2
        take = min(n // 2, len(after.points))
        text = self.text[:keep] + after.text[:take]
        seam = max(0, keep - K + 1)
        joint = np.concatenate([self.points[seam:keep], after.points[: min(take, K - 1)]])
        if keep + take < K:
            return text, sketch(whole(joint))
        across = anchors(joint)
        parts = [self.found.within(0, keep, 0, K), Anchors(across.at + seam, across.key), after.found.within(0, take, keep, K)]
        return text, sketch(Anchors(np.concatenate([p.at for p in parts]), np.concatenate([p.key for p in parts])))


def _fingerprints(names: list[str]):
    """Sorted rows of ranges to one row for each document; the one row that is only looked at ends its range."""

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key, part, only = (batch.column(c)[i].as_py() for c in ("id", "part", "only"))
                document = Document.of(batch.column("text")[i].as_py())
                if held is not None and held[1] == part:
                    out.append((held[0], *_compared(held[2], document)))
                held = None if only else (key, part, document)
            kinds = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kinds[0]), *map(pa.array, columns[1:], kinds[1:])], names)

    return run


def _compared(document: Document, after: Document) -> tuple:
    text, marks = document.edited(after)
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return len(document.points), digest, written_out(document.marks), written_out(marks), likeness(document.marks, marks), likeness(document.marks, after.marks)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", ranges: int = 0) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row: the edited text has
    its last half replaced by the start of the next document, after the last comes the first. `ranges` are four for each
    shuffle partition by default."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * tasks
    kind = docs.schema[id_column].dataType
    own = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = own.select("id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    total = docs.count()
    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    shape = struct_type(**{id_column: kind}, n_chars=T.LongType(), edited_sha256=T.StringType(), fingerprint=T.StringType(), edited_fingerprint=T.StringType(), near_edited=T.DoubleType(), near_next=T.DoubleType())
    # A bounded sample of keys, about SAMPLED for each range.
    picked = keyed.select("id", "k1", "k2")
    if total > ranges * SAMPLED:
        picked = picked.filter(F.pmod(F.xxhash64(F.lit(2), "id", "k1"), F.lit(1 << 30)) < int((1 << 30) * ranges * SAMPLED / total))
    sampled = sorted(_order(*r) for r in picked.limit(2 * ranges * SAMPLED).collect())
    splits = sorted({sampled[i * len(sampled) // ranges] for i in range(1, ranges)}) if sampled else []

    @arrow_udf("int")
    def range_of(ids: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array([bisect_right(splits, _order(*r)) for r in zip(*(x.to_pylist() for x in (ids, one, two)))], pa.int32())

    # The first key of each range: a row for each range.
    low = keyed.select("id", "k1", "k2", range_of("id", "k1", "k2").alias("part")).groupBy("part").agg(F.min(F.struct("id", "k1", "k2")).alias("low")).collect()
    firsts = {r["part"]: _order(*r["low"]) for r in low}
    parts = sorted(firsts)
    earlier = {p: parts[i - 1] for i, p in enumerate(parts)}  # before the first comes the last

    @arrow_udf("array<int>")
    def places(ids: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        """The range of a row; for the first of a range also the range before it, as the row to look at."""
        out = []
        for r in zip(*(x.to_pylist() for x in (ids, one, two))):
            key = _order(*r)
            part = bisect_right(splits, key)
            out.append([part, earlier[part]] if firsts[part] == key else [part])
        return pa.array(out, pa.list_(pa.int32()))

    placed = keyed.select("id", "text", "k1", "k2", F.posexplode(places("id", "k1", "k2")).alias("only", "part"))
    placed = placed.select("id", "text", "k1", "k2", (F.col("only") == 1).alias("only"), "part")
    sorted_rows = placed.repartition("part").sortWithinPartitions("part", "only", "id", "k1", "k2")
    return sorted_rows.select("id", "text", "part", "only").mapInArrow(_fingerprints(names), shape)


def _order(key, one: int, two: int) -> tuple:
    """Orders keys like Spark does: NULL ids first."""
    return (key is not None, key if key is not None else 0, one, two)
