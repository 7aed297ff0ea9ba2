import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanframe.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=0.93):
    parent, links, groups = list(range(len(rows))), [0] * len(rows), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups.setdefault((label, len(v)), []).append(k)
    for group in groups.values():
        x = np.array([rows[k][1] for k in group], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= cosine):
            if a != b:
                links[group[a]] += 1
                parent[root(group[a])] = root(group[b])
    names = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            names[root(k)] = min(names.get(root(k), i), i)
    return sorted(((i, links[k], names.get(root(k))) for k, (i, *_) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Clusters of all widths, 300 copies of three vectors, unsound vectors, two dimensions, NULL and repeated ids."""
    rng = np.random.default_rng(0)
    centres, out = rng.standard_normal((100, 32)), []
    for i in range(1200):
        v = centres[rng.integers(100)]
        v = v / np.linalg.norm(v) + rng.standard_normal(32) * rng.choice([0, 0.03, 0.05, 0.06, 0.07])
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    out += [(5000 + i, out[i % 3][1], out[i % 3][2]) for i in range(300)]
    odd = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [], [float("inf")] + [1.0] * 31]
    out += [(9000 + i, v, 1) for i, v in enumerate(odd)] + [(9010, [1.0] * 32, None), (9011, [1.0, 2.0], 1), (9012, [2.0, 4.0], 1)]
    return out + [(None, [1.0] * 32, 1), (9013, [1.0] * 32, 1), out[0], out[0]]


def test_recall_and_precision(spark, rows):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"n_links": F.lit("own"), "node": F.lit(1), "k1": F.lit("own")})
    found = E.link(vectors).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr)
    want = plain(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    by_id = {g[0]: g for g in got}
    assert all(by_id[9000 + i][1:] == (0, 9000 + i) for i in range(6)) and by_id[9010][1:] == (0, 9010)
    assert by_id[9012][1:] == (1, 9011) and by_id[9013][1:] == (1, 9013)


def test_links_reach_the_threshold(spark, rows):
    run = E.Quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 0.93)
    vectors = {r.node: np.array(r.vector, float) for r in run.nodes.collect()}
    for a, b in run.links().collect():
        assert vectors[a] @ vectors[b] / np.sqrt((vectors[a] @ vectors[a]) * (vectors[b] @ vectors[b])) >= 0.93


def test_rotation_makes_balanced_codes():
    x = np.random.default_rng(1).standard_normal((500, 16)) @ np.diag(np.linspace(0.2, 2, 16))
    mean, turn = E.learn_rotation(x, 0)
    assert np.allclose(turn.T @ turn, np.eye(16), atol=1e-8)
    assert np.all(np.abs(((x - mean) @ turn >= 0).mean(axis=0) - 0.5) < 0.12)


def test_empty_table_and_bad_threshold(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert E.link(empty).collect() == []
    with pytest.raises(ValueError):
        E.link(empty, cosine=0)


def common_mean(share, n, seed, dimension=64):
    """Unit vectors whose mean has the squared norm `share`, and partners at cosine 0.93 to 0.94 that differ in their own part."""
    rng = np.random.default_rng(seed)
    shared = np.zeros(dimension)
    shared[0] = 1.0
    own = rng.standard_normal((n, dimension))
    own[:, 0] = 0
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    x = np.sqrt(share) * shared + np.sqrt(1 - share) * own
    other = rng.standard_normal((n, dimension))
    other[:, 0] = 0
    other -= (other * own).sum(axis=1, keepdims=True) * own
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    inner = (rng.uniform(0.93, 0.94, (n, 1)) - share) / (1 - share)
    y = np.sqrt(share) * shared + np.sqrt(1 - share) * (inner * own + np.sqrt(1 - inner**2) * other)
    return x, y


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 0.7])
def test_recall_with_a_common_mean(share):
    x, _ = common_mean(share, 6000, 1)
    a, b = common_mean(share, 4000, 2)
    width, pairs = E.substring_width(10**6), E.partners(x[:4000], np.zeros(4000), 0.93)
    tables, centred = E.learned(x, pairs, width, 0.93, 0.995)
    models = E.rotations(x, -(-width * tables // x.shape[1]), centred)
    reached, radius = E.measured_recall(pairs, models, width, tables)
    apart = E.code_bits(a, models, width * tables) != E.code_bits(b, models, width * tables)
    met = (apart.reshape(len(a), tables, width).sum(axis=2) <= E.REACH).any(axis=1) & (apart.sum(axis=1) <= radius)
    assert met.mean() >= 0.99, (tables, met.mean())


def test_links_with_a_common_mean(spark):
    x, y = common_mean(0.6, 500, 3)
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(np.concatenate([x, y]))]
    got = {r.vec_id: r.n_links for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert sum(got.values()) >= 0.99 * wanted.sum() and all(got[i] <= wanted[i] for i in got)
