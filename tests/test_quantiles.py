import math
import random

import pytest

from cleanframe.operators import quantiles as q
from cleanframe.operators.statistics import moments, quartiles


def brute(values, p, method):
    xs = sorted(v for v in values if not math.isnan(v))
    n = len(xs)
    if not n:
        return None
    pos = p * (n + 1) if method == q.WEIBULL6 else p * (n - 1) + 1
    if pos < 1:
        return xs[0]
    if pos >= n:
        return xs[-1]
    k = math.floor(pos)
    return xs[k - 1] + (pos - k) * (xs[k] - xs[k - 1])


@pytest.mark.parametrize("method", [q.WEIBULL6, q.LINEAR7])
def test_every_small_size_as_groups(spark, method):
    rng = random.Random(5)
    rows = [(f"n{n}", round(rng.gauss(0, 10), 1)) for n in range(1, 30) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = quartiles(df, ["x"], moments(df, ["x"], "g"), method, "g")
    for n in range(1, 30):
        values = [x for g, x in rows if g == f"n{n}"]
        assert got[f"n{n}", "x"] == pytest.approx([brute(values, p, method) for p in (0.25, 0.5, 0.75)])


def test_narrowing_finds_exact_ranks_among_extreme_values(spark, monkeypatch):
    monkeypatch.setattr(q, "DIRECT", 30)
    rng = random.Random(1)
    kinds = [
        lambda: rng.uniform(-1e300, 1e300), lambda: rng.gauss(0, 1), lambda: 5.0, lambda: 0.0,
        lambda: 10 ** rng.uniform(-320, 300), lambda: -(10 ** rng.uniform(-320, 300)),
    ]
    xs = sorted([rng.choice(kinds)() for _ in range(5000)] + [math.inf] * 5 + [-math.inf] * 3)
    df = spark.createDataFrame([("k", x) for x in xs], "c string, v double")
    ranks = sorted({1, 2, 3, 4, 5, len(xs) - 5, len(xs) - 4, len(xs), *rng.sample(range(1, len(xs)), 25)})
    summary = {("k",): q.Summary(len(xs), xs[0], xs[-1])}
    got = q.order_statistics(df, summary, {("k",): ranks}, ["c"])
    assert {r: got[("k",), r] for r in ranks} == {r: xs[r - 1] for r in ranks}


def test_hot_value_and_hot_group(spark, monkeypatch):
    monkeypatch.setattr(q, "DIRECT", 10)
    rng = random.Random(2)
    rows = [("hot", 7.0)] * 2000 + [("hot", rng.uniform(0, 20)) for _ in range(2000)]
    rows += [(f"g{i % 5}", rng.uniform(0, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = quartiles(df, ["x"], moments(df, ["x"], "g"), q.WEIBULL6, "g")
    for g in {g for g, _ in rows}:
        values = [x for h, x in rows if h == g]
        assert got[g, "x"] == pytest.approx([brute(values, p, q.WEIBULL6) for p in (0.25, 0.5, 0.75)])


def test_no_numbers_at_all(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert quartiles(df, ["x"], moments(df, ["x"]))["x",] == [None, None, None]


def test_moments_of_text(spark):
    df = spark.createDataFrame([("1",), ("2",), (" ",), ("x",), ("NaN",), (None,)], "x string")
    m = moments(df, ["x"])["x",]
    assert (m.rows, m.filled, m.numeric, m.n, m.low, m.high) == (6, 4, 3, 2, 1.0, 2.0)
    assert math.isnan(m.mean) and not m.all_numeric
    one = moments(df.limit(1), ["x"])["x",]
    assert one.sd == 0.0
