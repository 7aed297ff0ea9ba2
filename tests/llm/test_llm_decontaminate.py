import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cleanframe import session
from cleanframe.llm import decontaminate as D
from cleanframe.llm.common import salted_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(1)
    vocabulary = ["a", "B", "é", "É", "c1", "D", "x", "y", "z", "qq"]
    passage = " ".join(rng.choices(vocabulary, k=14))
    items = [(1, "a b c1 d"), (2, "É a"), (3, "É"), (None, "x Y z"), (4, None), (5, "... "), (6, passage), (7, "y y"), (8, "y y y y"), (1, "z qq z qq z"), (9, "nowhere a")]
    docs = []
    for i in range(200):
        text = rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 40))) if rng.random() < 0.95 else None
        docs.append((rng.choice([i, None, 3]), (text or "") + " " + passage if rng.random() < 0.1 else text))
    return docs + docs[:20] + [(900, "b " * 20_000 + "A B C1 D")], items


@pytest.mark.parametrize("size", [1, 4, 10])
def test_hits_equal_plain_search(spark, tables, size):
    docs, items = tables
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"k1": F.lit("own"), "term": F.lit(1), "n_hit": F.lit("own")})
    got = D.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), size).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == plain(docs, items, size)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("limit", ["BROADCAST_ROWS", "BROADCAST_BYTES"])
def test_hits_without_broadcast(spark, tables, monkeypatch, limit):
    """Lists beyond either limit go by shuffles; the words of the longest text are salted."""
    monkeypatch.setattr(D, limit, 0)
    monkeypatch.setattr(D, "salted_join", lambda many, listed, on: salted_join(many, listed, on, 500))
    docs, items = tables
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(*frames, 4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == plain(docs, items, 4)


def test_lists_are_measured_in_rows_and_bytes(spark, monkeypatch):
    table = spark.createDataFrame([(1, ["abc"] * 50), (2, None)], "k long, v array<string>")
    assert D.small(table) and D.small(table.limit(0))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 200)
    assert not D.small(table) and D.small(table.filter("k = 2"))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 1)
    assert not D.small(table)


@pytest.mark.parametrize("rows", [200_000, 100])
def test_lists_are_written_in_files_by_their_rows(spark, tables, monkeypatch, rows):
    """However many shuffle partitions there are. Postings keep the partitions of the texts."""
    monkeypatch.setattr(D, "ROWS_PER_FILE", rows, raising=False)
    monkeypatch.setattr(session, "_MADE", [])
    docs, items = tables
    before = {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = D.contamination(*frames, 4).collect()
        made = {p: (len(list(Path(p.removeprefix("file:")).glob("part-*"))), spark.read.parquet(p).count()) for p in session._MADE}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == plain(docs, items, 4)
    lists = {Path(p).name.rsplit("-", 1)[0]: n for p, n in made.items() if not Path(p).name.startswith("postings-")}
    assert len(lists) >= 9 and lists["phrase-matches"][1] > 100
    if rows == 200_000:
        assert {files for files, _ in lists.values()} == {1}
    else:
        assert lists["phrase-matches"][0] > 1


def test_clean_rows_stay(spark, tables):
    docs, items = tables
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k1", F.lit("own"))
    kept = D.keep_clean(frame, spark.createDataFrame(items[:1], "item_id long, text string"), 10)
    assert kept.columns == frame.columns
    clean = [(i, t) for i, t in docs if plain([(i, t)], items[:1], 10)[0][2] == 0]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(t, s) for t, s in zip(tables, ("doc_id long, text string", "item_id long, text string")))
    assert D.contamination(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in D.contamination(docs, items.limit(0)).collect()} == {0}


def test_proximity(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=40))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = D.Benchmark(spark.createDataFrame([(1, "a h c"), (2, "e")], "item_id long, text string"), "item_id", "text", 10)
    index = D.PositionalIndex(frame, "doc_id", "text", benchmark.vocabulary)
    keys = {tuple(r)[1:]: r.doc_id for r in frame.select("doc_id", *D.row_keys("doc_id", "text")).collect()}
    named = {r.phrase: r.words for r in benchmark.named.collect()}
    counts = {w: sum(t.split().count(w) for _, t in docs) for w in "ahce"}
    got = {(keys[r.k1, r.k2], tuple(named[r.phrase]), r["at"]) for r in index.proximity(benchmark.terms, 3).collect()}
    rare = {("a", "h", "c"): min("ahc", key=lambda w: (counts[w], "ahc".index(w))), ("e",): "e"}
    want = set()
    for i, t in docs:
        w = t.split()
        for phrase, anchor in rare.items():
            for k, x in enumerate(w):
                if x == anchor and all(p in w[max(0, k - 2) : k + 3] for p in phrase):
                    want.add((i, phrase, k))
    assert got == want
