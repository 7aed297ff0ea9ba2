"""A uniform shuffle of a table into shards of exact sizes, without sorting it as a whole.

The rows of each source partition are dealt to the shards by a matrix of counts drawn from the multivariate hypergeometric
law, the law of a uniform permutation: its rows sum to the partitions' sizes, its columns to the shards' sizes. The matrix
is drawn by halving the list of partitions; each split has its own seed, so that every task draws the one row it needs and
nobody holds the matrix. A partition permutes its rows locally and hands each shard its count; after the exchange the rows of
a shard are permuted again, in pieces of bounded size.

Defined results: repeated rows are rows of their own; NULLs in any column stay. An empty table gives an empty table.
Input columns named `shard` or `slot` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from cleanframe.llm.common import packed_rows, written

#: numpy draws hypergeometric numbers from urns up to this size.
URN = 10**9
#: Fixed value: pi with more digits than are used.
PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899")


def log_factorial(k: int) -> Decimal:
    """ln(k!) to about thirty decimals, by Stirling's series; within a context of fifty digits."""
    if k < 1000:
        return Decimal(math.factorial(k)).ln()
    x = Decimal(k)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x + Decimal("0.5")) * x.ln() - x + (2 * PI).ln() / 2 + series


def drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n balls drawn from an urn are good. Urns too large for numpy: ratio of uniforms on the log density, which is
    computed with fifty digits, so that terms of any size cancel without a trace."""
    if n == 0 or good == 0:
        return 0
    if bad == 0 or n == good + bad:
        return good if bad else n
    total = good + bad
    if total < URN:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    share = good / total
    mean = n * share
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(mean * (1 - share) * (total - n) / (total - 1) + 0.5) + 3 - 2 * math.sqrt(3 / math.e)

    def density(k: int) -> Decimal:
        with localcontext(prec=50):
            return -sum(map(log_factorial, (k, good - k, n - k, bad - n + k)))

    top = density(min(high, max(low, (n + 1) * (good + 1) // (total + 2))))
    while True:
        u = rng.random()
        k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u) if u > 0 else -1
        if low <= k <= high and 2 * math.log(u) <= float(density(k) - top):
            return k


def dealt(rng: np.random.Generator, urn: np.ndarray, n: int) -> np.ndarray:
    """A draw of n balls without replacement from an urn of several colours."""
    total = int(urn.sum())
    if total < URN:
        return rng.multivariate_hypergeometric(urn, n, method="marginals") if total else np.zeros_like(urn)
    out = np.zeros_like(urn)
    for i, own in enumerate(urn):
        total -= int(own)
        out[i] = drawn(rng, int(own), total, n)
        n -= int(out[i])
    return out


def matrix_row(p: int, ends: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """Row p of the matrix: how many rows of partition p go to each shard. ends: running totals of the partitions' sizes."""
    low, high, urn = 0, len(ends), shards
    before = lambda i: int(ends[i - 1]) if i else 0
    while high - low > 1:
        middle = (low + high) // 2
        left = dealt(np.random.default_rng([seed, low, high]), urn, before(middle) - before(low))
        if p < middle:
            urn, high = left, middle
        else:
            urn, low = urn - left, middle
    return urn


def even_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, piece_rows: int = 2048) -> DataFrame:
    """df with `shard` (int) and `slot` (long, gapless from 0 in each shard): a uniform permutation, cut into shards
    whose sizes are at most one apart. The same input partitions and seed give the same result."""
    if shards < 1:
        raise ValueError("at least one shard")
    spark = df.sparkSession
    own, unpacked = packed_rows(df.drop("shard", "slot"))
    tagged = own.select("row", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_at"))
    staged = written(tagged, "shard-input")  # fixes each row's partition and place, whatever is computed again later
    sizes = {r["_p"]: r["n"] for r in staged.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    if not sizes:
        return staged.select(*unpacked(), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    order = sorted(sizes)
    rank = {p: i for i, p in enumerate(order)}
    ends = np.cumsum([sizes[p] for p in order], dtype=np.int64)
    wanted = np.array(even_sizes(int(ends[-1]), shards), np.int64)
    shared = spark.sparkContext.broadcast((rank, ends, wanted))

    @pandas_udf("int")
    def shard_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rank, ends, wanted = shared.value
        own: dict[int, np.ndarray] = {}

        def dealing(p: int) -> np.ndarray:
            i = rank[p]
            row = matrix_row(i, ends, wanted, seed)
            hand = np.repeat(np.arange(len(row), dtype=np.int32), row)
            return np.random.default_rng([seed, 1 << 40, i]).permutation(hand)

        for part, at in batches:
            out = np.empty(len(part), np.int32)
            values, place = part.to_numpy(), at.to_numpy() & ((1 << 33) - 1)
            for p in np.unique(values):
                if p not in own:
                    if len(own) > 8:
                        own.clear()
                    own[p] = dealing(int(p))
                here = values == p
                out[here] = own[p][place[here]]
            yield pd.Series(out)

    pieces = max(1, -(-int(wanted[0]) // piece_rows))
    given = staged.withColumn("shard", shard_of("_p", "_at")).withColumn("_piece", F.pmod(F.xxhash64(F.lit(seed), F.lit("piece"), "_at"), F.lit(pieces)))
    dealer = written(given.groupBy("shard", "_piece").count(), "shard-pieces")
    first = F.sum("count").over(Window.partitionBy("shard").orderBy("_piece")) - F.col("count")
    starts = written(dealer.select("shard", "_piece", first.alias("_start")), "shard-starts")
    if starts.count() <= 500_000:
        starts = F.broadcast(starts)
    turn = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy(F.xxhash64(F.lit(seed), F.lit("turn"), "_at"), "_at"))
    placed = given.withColumn("_turn", turn).join(starts, ["shard", "_piece"])
    return placed.select(*unpacked(), "shard", (F.col("_start") + F.col("_turn") - 1).alias("slot"))
