"""Columns that are called like an operator's own come back as they were."""

from cleanframe.llm import decontaminate, ngram_join, pii, sharding, toxicity

NAMES = ["_a", "_b", "_key", "_k1", "k1", "k2", "key_a", "hit_a", "_piece", "_at", "_p", "_turn", "_new", "_names", "_after", "row", "id", "a.b", "others"]
WORDS = "one two three four five six seven eight nine ten eleven twelve"


def table(spark):
    rows = [(i, f"{text} {i % 2}", *[f"{n}-{i}" for n in NAMES]) for i, text in enumerate([WORDS, WORDS, WORDS, "write to Mr. John Smith or jo@example.org today", "", "short"])]
    return spark.createDataFrame(rows, ["doc_id", "text", *NAMES])


def by_id(df):
    return {r["doc_id"]: {c: r[c] for c in NAMES} for r in df.collect()}


def test_other_columns_come_back(spark):
    docs = table(spark)
    before = by_id(docs)
    items = spark.createDataFrame([("i", WORDS)], "item_id string, text string")
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and by_id(clean) == {k: before[k] for k in (3, 4, 5)}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and by_id(kept) == {k: before[k] for k in (0, 3, 4, 5)}
    changed = pii.replace(docs, "key")
    assert changed.columns == [*docs.columns, "n_entities"] and by_id(changed) == before
    dealt = sharding.shuffle_into_shards(docs, 2)
    assert dealt.columns == [*docs.columns, "shard", "slot"] and by_id(dealt) == before
    clean = toxicity.keep_clean(docs, toxicity.ToxicityModel((("short", False),), ((9.0, 0.0),), -5.0, 9.0, 0.0, 12))
    assert clean.columns == docs.columns and by_id(clean) == {k: before[k] for k in range(5)}
