import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cleanframe.llm import ngram_join as N
from cleanframe.session import scratch, shared_dir


def sets(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < words else frozenset(zip(*(w[i:] for i in range(words))))


def plain(rows, words, num, den=100):
    """(id, set size, smallest id of the component) for each row, from all pairs that share a shingle."""
    own = [sets(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(own):
        shared = Counter()
        for x in s:
            shared.update(holders[x])
            holders[x].append(k)
        for other, n in shared.items():
            if den * n >= num * (len(s) + len(own[other]) - n):
                parent[root(k)] = root(other)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[root(k)] = min(names.get(root(k), i), i)
    return sorted(((i, len(own[k]), names.get(root(k))) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Near copies, a line that many texts share, a hot group of copies, NULLs, empty texts, repeated ids and rows."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [rng.choices(vocabulary, k=rng.randint(1, 60)) for _ in range(20)]
    line = rng.choices(vocabulary, k=8)
    out = []
    for i in range(400):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            words = line + words
        text = rng.choice([" ", "\n", "\t"]).join(words).title()
        out.append((rng.choice([i, i, i, None, 5]), text if rng.random() < 0.95 else rng.choice(["", None, "  "])))
    out += [(700 + i, "one Hot text of a few words that comes again") for i in range(150)]
    return out + out[:10]


@pytest.mark.parametrize("words, num", [(3, 90), (5, 80)])
def test_components_equal_all_pairs(spark, rows, words, num, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.withColumns({"n_shingles": F.lit("own"), "node": F.lit(1), "id": F.lit("own")})
    got = N.link(docs, words=words, num=num)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, words, num)


def test_one_of_each_component_stays(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key2", F.lit("own"))
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    groups = plain(numbered, 5, 80)
    whole = {c for _, n, c in groups if n}
    assert len(texts) == len(whole) + sum(n == 0 for _, n, _ in groups)
    component = {}
    for (k, n, c), (_, t) in zip(sorted(groups), numbered):
        component[t] = c
    assert Counter(component[t] for t in texts if sets(t, 5)) == Counter(whole)


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.link(empty).collect() == [] and N.keep_one(empty).collect() == []
    long = " ".join(f"x{i}" for i in range(50_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.link(docs).collect()} == {1: (49_996, 1), 2: (49_997, 1), 3: (1, 3), 4: (0, 4)}


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        N.link(spark.createDataFrame([], "doc_id long, text string"), num=0)


def test_links_inside_components_are_counted(spark, rows):
    got = N.link(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90, counted=True)
    own = [sets(t, 3) for _, t in rows]
    near = lambda a, b: len(a & b) * 100 >= 90 * len(a | b)
    want = [(i, len(s), sum(near(s, o) for o in own) - 1 if s else 0) for (i, _), s in zip(rows, own)]
    found = [(r.doc_id, r.n_shingles, r.n_links) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_hashes_of_rows_and_tables_of_the_join_are_not_kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    top = f"{shared_dir(spark)}/cleanframe".removeprefix("file:")
    names = lambda: set(os.listdir(top)) if os.path.isdir(top) else set()
    before = names()
    with scratch(spark):
        kept = N.keep_one(docs)
        assert [n.rsplit("-", 1)[0] for n in names() - before] == ["ngram-classes"]
        assert 0 < kept.count() < len(rows)
        join = N.GroupedPrefixJoin(docs.withColumnRenamed("doc_id", "id"), 5, 80, 100)
        assert join.rows.columns == ["id", "n", "digest"] and join.rows.count() == len(rows)
        assert sorted(n.rsplit("-", 1)[0] for n in names() - before) == ["ngram-classes", "ngram-nodes", "ngram-rows"]
