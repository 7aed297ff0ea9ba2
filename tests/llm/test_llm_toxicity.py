import random

from pyspark.sql import functions as F

from cleanframe.llm import toxicity as X


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_match(word, entries):
    found = []
    for i, (text, is_open) in enumerate(entries):
        ends = range(len(word) + 1) if is_open else [len(word)]
        errors = min(distance(word[:n], text) for n in ends)
        if errors <= X.edits(text):
            found.append((errors, -len(text), i))
    return (min(found)[2], min(found)[0]) if found else None


def test_automaton_finds_what_distances_say():
    entries = [("idiot", False), ("scum", False), ("worthless", False), ("lowei", True), ("id", False), ("idle", True)]
    automaton = X.Automaton(entries, max_states=50)
    rng = random.Random(5)
    words = ["idiot", "idi0t", "idoit", "worthles", "wrthlss", "loweischaft", "lwei", "", "id", "scums"]
    for _ in range(1500):
        word = list(rng.choice(entries)[0])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "o", "i"])
        words.append("".join(word))
    for word in words:
        assert automaton.match(word) == plain_match(word, entries), word


def test_quotation_lowers_the_score():
    model = X.ToxicityModel((("idiot", False),), ((5.0, 3.0),), -4.0, 4.0, 0.5, 12)
    words = X.Words(X.Automaton([("idiot", False)]))
    score = lambda text: model.score(X.hits(text, words, 12))
    assert score("you are an idiot") > 0.9
    assert score("you are an id1ot") > 0.7
    assert score('he used the "idiot" there') < 0.5
    assert score("they called him idiot once") < 0.5
    assert score("nothing here") == score("") == score(None) < 0.1


def corpus(spark):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grubber", "stenk" + rng.choice("abcdefgh") + "or"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "grubber"), (1002, "gruber"), (1002, "gruber"), (1003, "x" * 200_000 + " grubber")]
    labels += [(1000, 1), (1001, None), (None, 1), (5000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_lexicon_and_scores(spark):
    docs, labels = corpus(spark)
    model = X.fit(docs, labels)
    assert {text for text, _ in model.entries} >= {"grubber"}
    assert any(is_open and "stenk".startswith(text) or text == "stenk" for text, is_open in model.entries)
    extra = docs.withColumns({"score": F.lit("own"), "n_hits": F.lit(1), "toxic": F.lit(1)}).repartition(3)
    got = X.score(extra, model).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 400:
            assert (r.score >= 0.7) == bool(truth[r.doc_id])
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1000] == by_id[1001] < 0.7 <= by_id[1003]
    assert by_id[None] >= 0.7
    kept = X.keep_clean(extra, model)
    assert kept.columns == extra.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.score < 0.7)


def test_empty_tables(spark):
    docs, labels = corpus(spark)
    none = X.fit(docs, labels.limit(0))
    assert none.entries == () and {r.score for r in X.score(docs, none).collect()} == {0.0}
    assert X.fit(docs.limit(0), labels).entries == ()
    assert X.score(docs.limit(0), none).collect() == []
