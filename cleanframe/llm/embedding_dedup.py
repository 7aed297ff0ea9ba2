"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, and reranking with the original vectors.

A rotation of the centred principal axes is learned so that signs of the rotated coordinates make balanced codes with
little loss (a bounded sample serves to learn it; every vector is indexed). Each code is cut into substrings, one table for
each. Two vectors meet in a table if their substrings differ in two bits at most: both sides look up their substring and
all with one bit changed. Pairs whose whole codes are close enough are compared by cosine in double precision. The
number of tables and the radius follow from pairs at the threshold that are made from the sample and coded by the learned
rotations, so that the recall also holds where all vectors share a common part.

Vectors are compared only within equal labels and dimensions. Equal vectors of a label are one node that is indexed once;
their number counts for links, so a group of copies is never expanded.

Defined results: a row whose label or vector is NULL, or whose vector is empty, zero, or holds a NULL or non-finite
component, links with nothing and is its own component. Repeated rows are rows of their own and link with each other. Ids may be
NULL; the smallest id that is not NULL names a component. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cleanframe.llm.common import salted_join, smallest, struct_type, written
from cleanframe.llm.components import components

#: Bits that two substrings may differ in and still meet: one changed on each side.
REACH = 2


def learn_rotation(vectors: np.ndarray, seed: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the matrix whose products' signs are the code. Alternates codes and the rotation that fits them best."""
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    projected = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((projected.shape[1],) * 2))
    for _ in range(rounds):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ codes)
        rotation = left @ right
    return mean, axes @ rotation


def substring_width(rows: int) -> int:
    """Grows with the logarithm of the rows, to keep the lists of a table short."""
    return min(24, max(12, math.ceil(math.log2(max(rows, 2)))))


def fewest_tables(width: int, cosine: float, recall: float) -> int:
    """Tables that reach the recall if codes differ in the share of bits that the angle itself gives: a start."""
    p = math.acos(cosine) / math.pi
    met = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(REACH + 1))
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 2


def partners(x: np.ndarray, groups: np.ndarray, cosine: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, vectors at just this cosine, groups) made from a sample: moved in any direction, and moved towards another
    vector of the group, as real neighbours are where all vectors share a common part."""
    rng = np.random.default_rng(seed)
    out = []
    mates = np.arange(len(x))
    for g in np.unique(groups):
        own = np.flatnonzero(groups == g)
        mates[own] = np.roll(own, 1)
    for towards in (rng.standard_normal(x.shape), x[mates] - x):
        across = towards - (towards * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(across, axis=1)
        fit = size > 1e-9
        y = cosine * x[fit] + math.sqrt(max(0.0, 1 - cosine**2)) * across[fit] / size[fit, None]
        out.append((x[fit], y, groups[fit]))
    return [pair for pair in out if len(pair[0])]


def code_bits(x: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    return np.concatenate([(x - mean) @ turn >= 0 for mean, turn in models], axis=1)[:, :bits]


#: A group with fewer sampled vectors is measured together with all others.
MEASURED = 50


def measured_recall(pairs, models, width: int, tables: int) -> tuple[float, int]:
    """The smallest share of made pairs that meet in a table, over the ways to make them and the groups; and a radius of
    whole codes that holds them all."""
    least, radius = 1.0, 0
    for x, y, groups in pairs:
        apart = code_bits(x, models, width * tables) != code_bits(y, models, width * tables)
        met = (apart.reshape(len(x), tables, width).sum(axis=2) <= REACH).any(axis=1)
        shares = [met.mean()] + [met[groups == g].mean() for g, n in zip(*np.unique(groups, return_counts=True)) if n >= MEASURED]
        least = min(least, *map(float, shares))
        total = apart.sum(axis=1)
        radius = max(radius, math.ceil(total.max() + total.std()))
    return least, radius


def rotations(x: np.ndarray, number: int, centred: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Learned ones, or random ones around the origin, whose codes differ by the angle alone."""
    if centred:
        return [learn_rotation(x, seed) for seed in range(number)]
    turn = lambda seed: np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1],) * 2))[0]
    return [(np.zeros(x.shape[1]), turn(seed)) for seed in range(number)]


def learned(x: np.ndarray, pairs, width: int, cosine: float, recall: float) -> tuple[int, bool]:
    """Tables that reach the recall with learned rotations. Where four times the tables that the angle asks for do not (vectors
    that hardly differ from their mean), codes are taken around the origin instead."""
    start = tables = fewest_tables(width, cosine, recall)
    if len(x) >= MEASURED and pairs:
        models: list[tuple[np.ndarray, np.ndarray]] = []
        while tables <= 4 * start:
            models += [learn_rotation(x, seed) for seed in range(len(models), -(-width * tables // x.shape[1]))]
            if measured_recall(pairs, models, width, tables)[0] >= recall:
                return tables, True
            tables += max(1, tables // 4)
    return start, False


def _sound(vector: str, kind: T.DataType) -> Column:
    column = F.col(vector)
    largest = F.lit(float("inf"))
    return F.coalesce(
        (F.size(column) > 0)
        & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < largest))
        & F.exists(column, lambda x: x != 0),
        F.lit(False),
    )


def _codes(models: dict[int, list[tuple[np.ndarray, np.ndarray]]], width: int, tables: int):
    """Rows (node, group, subs): the substrings of each vector's code."""

    def run(batches):
        weights = 1 << np.arange(width, dtype=np.int64)
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            out = []
            for v in vectors:
                x = np.array(v, np.float64)
                scale = np.abs(x).max()
                x = x / scale
                x /= np.linalg.norm(x)
                bits = np.concatenate([(x - mean) @ turn >= 0 for mean, turn in models[len(v)]])[: width * tables]
                out.append((bits.reshape(tables, width) * weights).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("group"), pa.array(out, pa.list_(pa.int64()))], ["node", "group", "subs"])

    return run


def _cosines(threshold: float):
    """Pairs (a, b, va, vb) whose cosine in double precision reaches the threshold; all pairs of a batch at once."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for name in ("va", "vb"):
                lists = batch.column(name)
                starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
                values = np.asarray(lists.flatten(), np.float64)
                scale = np.maximum.reduceat(np.abs(values), starts)
                sides.append(values / np.repeat(scale, np.diff(np.append(starts, len(values)))))
            x, y = sides
            total = lambda v: np.add.reduceat(v, starts)
            part = batch.filter(pa.array(total(x * y) / np.sqrt(total(x * x) * total(y * y)) >= threshold, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"])

    return run


class Quantised:
    """The nodes of a table of vectors, their codes, and the links found through them."""

    def __init__(self, vectors: DataFrame, id_column: str, vector: str, label: str, cosine: float, sample_rows: int = 20_000, recall: float = 0.995):
        if not 0 < cosine <= 1:
            raise ValueError("the cosine must be in (0, 1]")
        self.cosine = cosine
        kind = vectors.schema[vector].dataType
        own = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
        own = own.withColumn("sound", F.col("label").isNotNull() & _sound("vector", kind))
        key = (F.xxhash64("label", "vector").alias("k1"), F.xxhash64(F.lit(1), "vector", "label").alias("k2"))
        self.rows = written(own.select("id", "sound", "vector", *key, F.xxhash64("label", F.size("vector")).alias("group")), "vector-rows")
        nodes = self.rows.filter("sound").groupBy("k1", "k2").agg(
            F.min("id").alias("id"), F.count("*").alias("copies"), F.first("group").alias("group"), F.first("vector").alias("vector")
        )
        self.nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
        self.width = substring_width(self._largest_group())
        self.tables, self.radius, self.models = self._learn(sample_rows, recall)

    def _largest_group(self) -> int:
        return self.nodes.groupBy("group").count().agg(F.max("count")).first()[0] or 0

    def _learn(self, sample_rows: int, recall: float) -> tuple[int, int, dict[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """Tables, radius, and for each dimension (a table has few) rotations enough for all bits, from at most `sample_rows`
        vectors each. Tables are added until pairs at the threshold, made from the sample and coded by the learned rotations,
        meet as often as the recall asks: how far codes differ depends on what the vectors have in common."""
        samples = {}
        for (dimension,) in self.nodes.select(F.size("vector")).distinct().collect():
            chosen = smallest(self.nodes.filter(F.size("vector") == dimension), sample_rows, F.xxhash64("k1"), F.col("k1"), F.col("k2"))
            rows = chosen.select("vector", "group").collect()
            x = np.array([r[0] for r in rows], np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            few = slice(0, 4000)
            samples[dimension] = x, partners(x[few], np.array([r[1] for r in rows])[few], self.cosine)
        found = {d: learned(x, pairs, self.width, self.cosine, recall) for d, (x, pairs) in samples.items()}
        tables, radius, models = max((t for t, _ in found.values()), default=2), 0, {}
        for dimension, (x, pairs) in samples.items():
            models[dimension] = rotations(x, -(-self.width * tables // dimension), found[dimension][1])
            radius = max(radius, measured_recall(pairs, models[dimension], self.width, tables)[1])
        return tables, radius, models

    def _apart(self, t: int) -> Column:
        """Bits in which the substrings of table t differ."""
        return F.bit_count(F.get("sa", F.lit(t)).bitwiseXOR(F.get("sb", F.lit(t))))

    def candidates(self) -> DataFrame:
        """Distinct pairs (a, b) of nodes whose codes are within the radius."""
        shape = struct_type(node=T.LongType(), group=T.LongType(), subs=T.ArrayType(T.LongType()))
        codes = written(self.nodes.select("node", "group", "vector").mapInArrow(_codes(self.models, self.width, self.tables), shape), "vector-codes")
        entries = codes.select("node", "group", "subs", F.posexplode("subs").alias("t", "sub"))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(self.width)])
        probes = entries.select("node", "group", "subs", "t", F.explode(F.transform(flips, lambda f: F.col("sub").bitwiseXOR(f))).alias("key"))
        counted = probes.groupBy("group", "t", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        probes = probes.join(counted, ["group", "t", "key"])
        a = probes.select("group", "t", "key", F.col("node").alias("a"), F.col("subs").alias("sa"))
        b = probes.select("group", "t", "key", F.col("node").alias("b"), F.col("subs").alias("sb"))
        # A pair is told by its first table and there by its smallest common key only.
        first = F.lit(self.tables)
        for t in reversed(range(self.tables)):
            first = F.when(self._apart(t) <= REACH, F.lit(t)).otherwise(first)
        at = lambda side: F.get(side, F.col("t"))
        changed = at("sa").bitwiseXOR(at("sb"))
        lowest = changed.bitwiseAND(-changed)
        one, two = at("sa").bitwiseXOR(lowest), at("sb").bitwiseXOR(lowest)
        told = F.when(F.bit_count(changed) == REACH, F.least(one, two)).when(F.bit_count(changed) == 1, F.least(at("sa"), at("sb"))).otherwise(at("sa"))
        close = sum((self._apart(t) for t in range(1, self.tables)), self._apart(0)) <= self.radius
        pairs = a.join(b, ["group", "t", "key"]).filter((F.col("a") < F.col("b")) & close & (first == F.col("t")) & (told == F.col("key")))
        return pairs.select("a", "b")

    def links(self) -> DataFrame:
        """Pairs of nodes whose cosine reaches the threshold."""
        pairs = written(self.candidates(), "vector-pairs")
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("vector").alias(f"v{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return written(both.select("a", "b", "va", "vb").mapInArrow(_cosines(self.cosine), "a long, b long"), "vector-links")

    def classes(self) -> DataFrame:
        """(id, n_links, component_id) of every row."""
        links = self.links()
        copies = self.nodes.select("node", "copies")
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        linked = ends.join(copies.select(F.col("node").alias("other"), F.col("copies").alias("n")), "other").groupBy("node").agg(F.sum("n").alias("n"))
        placed = self.nodes.join(linked, "node", "left").join(components(links), "node", "left")
        placed = placed.select("k1", "k2", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
        placed = written(placed, "vector-classes")
        names = placed.groupBy("component").agg(F.min("id").alias("component_id"))
        named = salted_join(placed, names, "component").select(F.struct("k1", "k2").alias("k"), "n_links", "component_id")
        rows = self.rows.filter("sound").select("id", F.struct("k1", "k2").alias("k"))
        sound = salted_join(rows, written(named, "vector-names"), "k").select("id", "n_links", "component_id")
        return sound.unionByName(self.rows.filter(~F.col("sound")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))


def link(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """One row for each row of vectors: id, n_links (other vectors linked directly), component_id, kept."""
    found = Quantised(vectors, id_column, vector, label, cosine).classes()
    return found.select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
