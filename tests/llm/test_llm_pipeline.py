"""The whole pipeline on a small folder, against plain versions of its stages."""

import random

import public_tokenizers
import pytest
import tiktoken
from test_llm_decontaminate import plain as plain_hits
from test_llm_ngram_join import plain as plain_classes

import corpus_pipeline as C
from cleanframe.llm import bpe, toxicity
from cleanframe.llm.common import written


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    item = " ".join(rng.choices(vocabulary, k=16))
    docs, labels = [], []
    for i in range(260):
        words = rng.choices(vocabulary, k=rng.randint(8, 70))
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["grubber", "stenkling"]))
        if i % 9 == 0:
            words[3:3] = item.split()[2:14]
        if i % 7 == 0:
            words.insert(2, f"mail{i % 21}@host.org")
        labels.append((i, 1, int(i % 5 == 0)))
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, docs[i % 4][1] + (" tail" if i % 2 else "")) for i in range(40)]
    docs += [(2000, None), (2001, ""), (2002, "w1 W1"), (2003, "w1 w1"), (2003, "w1 w1"), (2004, "grubber " * 3000)]
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in docs]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, item


def test_stages_against_plain_versions(spark, folder):
    path, docs, item = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    model = C.toxicity_model(spark, frame, path)
    words = toxicity.Words(toxicity.Automaton(list(model.entries)))
    kept = [(i, t) for i, t in docs if model.score(toxicity.hits(t, words, model.window)) < 0.7]
    assert not [i for i, t in kept if t and {"grubber", "stenkling"} & set(t.split())]
    by_text = {}
    for k, (i, t) in sorted(enumerate(kept), key=lambda x: (x[1][0], x[0])):
        by_text.setdefault(k, (i, t))
    numbered = [(i * 1000 + k, t) for k, (i, t) in enumerate(kept)]
    heads = {i for i, n, c in plain_classes(numbered, 5, 80) if n == 0 or i == c}
    kept = [(i // 1000, t) for i, t in numbered if i in heads]
    kept = [(i, t) for i, t in kept if not plain_hits([(i, t)], [(1, item)], 10)[0][2]]

    stages, tables = dict(C.STAGES), []
    for name in ("toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"):
        frame = written(stages[name](spark, frame, path), f"test-{name}")
        tables.append(frame)
    assert all(t.columns == ["doc_id", "text", "lang", "source", "n_chars"] for t in tables[:4])
    assert sorted(((r.doc_id, r.text) for r in tables[2].collect()), key=repr) == sorted(kept, key=repr)

    before, after = {r.doc_id: r for r in tables[2].collect()}, {r.doc_id: r for r in tables[3].collect()}
    mapped = {}
    for i, r in after.items():
        assert r.n_chars == (None if r.text is None else len(r.text))
        for a, b in zip((before[i].text or "").split(), (r.text or "").split()):
            assert ("@" in a) == ("@" in b) and (a != b) == ("@" in a)
            if "@" in a:
                assert mapped.setdefault(a, b) == b
    assert len(set(mapped.values())) == len(mapped) > 1

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r.doc_id: r for r in tables[4].collect()}
    assert set(last) == set(after)
    for i, r in last.items():
        assert list(r.ids) == library.encode_ordinary(after[i].text or "") and r.n_tokens == len(r.ids)
        assert r.decoded == (after[i].text or "")


def test_run_gives_the_last_stage(spark, folder):
    path, docs, _ = folder
    assert C.run(spark, path).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert C.ORACLE_SQL is None and 4 <= len(C.STAGES) <= 5
