from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanframe.llm import sharding as S


def test_matrix_has_its_margins_and_law():
    """4000 drawn matrices of 3 partitions and 2 shards against the exact probabilities."""
    ends, shards, seen = np.cumsum([3, 2, 4]), np.array([5, 4]), Counter()
    for seed in range(4000):
        rows = [S.matrix_row(i, ends, shards, seed) for i in range(3)]
        assert [r.sum() for r in rows] == [3, 2, 4] and list(sum(rows)) == [5, 4]
        seen[tuple(int(r[0]) for r in rows)] += 1
    for (a, b, c), n in seen.items():
        assert abs(n / 4000 - comb(3, a) * comb(2, b) * comb(4, c) / comb(9, 5)) < 0.03


def test_large_urns(monkeypatch):
    monkeypatch.setattr(S, "URN", 10)
    rng = np.random.default_rng(0)
    drawn = [S.drawn(rng, 60, 40, 30) for _ in range(5000)]
    assert abs(np.mean(drawn) - 18) < 0.15 and abs(np.var(drawn) - 30 * 0.6 * 0.4 * 70 / 99) < 0.4
    row = S.dealt(rng, np.array([50, 0, 30, 20]), 40)
    assert row.sum() == 40 and all(0 <= x <= y for x, y in zip(row, [50, 0, 30, 20]))
    assert S.drawn(rng, 5, 0, 5) == 5 and S.drawn(rng, 0, 5, 3) == 0 and S.drawn(rng, 3, 4, 7) == 3


@pytest.mark.parametrize("n, shards", [(1001, 8), (5, 8), (1, 1)])
def test_exact_sizes_and_gapless_slots(spark, n, shards):
    df = spark.range(n).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), F.lit("same text").alias("text"), F.col("id").alias("own"), F.lit("x").alias("slot"), F.lit(1).alias("_p2"))
    out = S.shuffle_into_shards(df.repartition(7), shards, seed=3, piece_rows=20).collect()
    assert sorted(r.own for r in out) == list(range(n))
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[i]) for i in range(shards)]
    assert sizes == S.even_sizes(n, shards) and max(sizes) - min(sizes) <= 1


def test_places_are_uniform(spark):
    """Each of 12 rows stands in each of 12 places about equally often over many seeds."""
    df = spark.range(12).coalesce(1).repartition(3)
    seen = Counter()
    for seed in range(60):
        for r in S.shuffle_into_shards(df, 2, seed=seed, piece_rows=3).collect():
            seen[r.id, r.shard, r.slot // 3] += 1
    assert len(seen) == 48 and max(seen.values()) < 35


def test_empty_and_bad(spark):
    empty = S.shuffle_into_shards(spark.createDataFrame([], "doc_id long, shard string"), 4)
    assert empty.collect() == [] and empty.columns == ["doc_id", "shard", "slot"]
    with pytest.raises(ValueError):
        S.shuffle_into_shards(spark.range(3), 0)


def test_large_urns_have_an_exact_density():
    import math
    from decimal import Decimal, localcontext

    from cleanframe.llm import sharding

    with localcontext(prec=50):
        for k in (5, 999, 1000, 123_456, 10**12):
            assert abs(sharding.log_factorial(k + 1) - sharding.log_factorial(k) - Decimal(k + 1).ln()) < Decimal("1e-25")
    assert float(sharding.log_factorial(2000)) == pytest.approx(math.lgamma(2001), rel=1e-12)


def test_draws_from_large_urns_follow_the_law():
    import numpy as np

    from cleanframe.llm import sharding

    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 7 * 10**9, 10**6
    values = np.array([sharding.drawn(rng, good, bad, n) for _ in range(600)], float)
    deviation = (n * 0.3 * 0.7 * (1 - n / 10**10)) ** 0.5
    assert abs(values.mean() - 0.3 * n) < 4 * deviation / 600**0.5 and 0.85 < values.std() / deviation < 1.15
