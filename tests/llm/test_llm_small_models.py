"""URL filter, token counts and language identification."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from cleanframe.llm import language_id as L, token_counts as C, url_filter as U

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("com/de/", "allow")]
URLS = [None, "", "nothing", "http://", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/2", "x://y://z/en/1"]
URLS += ["http://notorg/a", "http://org", "http://org/", "http://a.com/de/", "http://com/de/Q#/fr/", "http://a.com/DE/", "http://h?x/de/", "http://h#y", "http://" + "é" * 5000 + "/" + "p" * 50_000]


def plain_rule(url):
    rest = (url or "").partition("://")[2]
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    best = max(fits, key=lambda r: len(r[0]), default=(None, None))
    return host, path, best[0], best[1]


def test_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS + URLS[:3])), "page_id long, url string").withColumns({"host": F.lit("own"), "grams": F.lit(1), "verdict": F.lit("x")})
    got = {r.page_id: r for r in U.UrlFilter(RULES, None, "allow").judge(pages, "page_id").collect()}
    for i, url in enumerate(URLS + URLS[:3]):
        host, path, rule, verdict = plain_rule(url)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow")


def test_model_judges_the_rest(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        bad = i % 2
        rows.append((f"http://{rng.choice(['casino', 'poker'] if bad else ['school', 'library'])}{rng.randint(1, 99)}.net/{'win' if bad else 'read'}/{i}", "block" if bad else "allow"))
    train = spark.createDataFrame(rows + [(None, "allow"), ("http://x.net", None), ("http://y.net", "odd")], "url string, verdict string")
    judge = U.UrlFilter.fit(train, [("casino7.net/", "allow")], buckets=4096)
    pages = spark.createDataFrame([(1, "http://casino5.net/win/7777"), (2, "https://school7.net/read/1234"), (3, "http://casino7.net/win/1"), (4, None)], "page_id long, url string")
    got = {r.page_id: r for r in judge.judge(pages, "page_id").collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["block", "allow", "allow"] and got[3].p_block is None and 0 <= got[4].p_block <= 1
    only = U.UrlFilter.fit(train.filter("verdict = 'block'"), [])
    assert {r.verdict for r in only.judge(pages, "page_id").collect()} == {"block"}
    none = U.UrlFilter.fit(train.limit(0), [])
    assert {r.verdict for r in none.judge(pages, "page_id").collect()} == {"allow"} and none.judge(pages.limit(0), "page_id").collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    return C.UnigramVocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def tokenizer(vocabulary):
    """The same pieces and scores in another library; byte pieces score lowest so that they match no text."""
    low = min(s for _, s in vocabulary.pieces)
    pieces = [("<unk>", low), *vocabulary.pieces, *((f"<0x{i:02X}>", low) for i in range(256))]
    return Tokenizer(models.Unigram(pieces, 0, True))


def test_counts_equal_the_library(spark, vocabulary):
    rng, other = random.Random(1), tokenizer(vocabulary)
    rows = [(i if i % 5 else None, "".join(rng.choices("ab ▁ é中😀\x01\nthe 12", k=rng.randint(1, 60)))) for i in range(800)]
    rows += [(9000, None), (9001, ""), (9002, " "), (9003, "word " * 30_000)] + rows[:4]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("own"))
    got = sorted((tuple(r) for r in C.count_tokens(docs.repartition(3), vocabulary).collect()), key=repr)
    count = lambda t: len(other.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
    assert got == sorted(((i, count(t)) for i, t in rows), key=repr)
    assert C.count_tokens(docs.limit(0), vocabulary).collect() == []


def test_ties_unknown_runs_and_empty_vocabulary():
    counter = C.Counter(C.UnigramVocabulary((("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0)), False))
    assert counter.viterbi("aa") == 1 and counter.viterbi("aab") == 2  # equal scores: the piece that starts first
    assert counter.viterbi("a??b?") == 4  # a run of unknown characters is one token
    assert C.Counter(C.UnigramVocabulary((), False)).tokens("xyz") == 1
    assert C.Counter(C.UnigramVocabulary((), True)).tokens("é") == 5


SENTENCES = {
    "en": "the house of the old man stands near the river and with the other houses there",
    "de": "das haus des alten mannes steht nahe am fluss und mit den anderen häusern dort",
    "fr": "la maison du vieil homme est près de la rivière et avec les autres maisons là",
}


def texts(rng, lang, n):
    return " ".join(rng.choices(SENTENCES[lang].split(), k=n))


def test_language_sets(spark):
    rng = random.Random(1)
    rows = [(i, texts(rng, lang, 40), lang) for i, lang in enumerate(sorted(SENTENCES) * 40)] + [(900, None, "en"), (901, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.languages == ("de", "en", "fr")
    probe = [(i, texts(rng, lang, 30)) for i, lang in enumerate(sorted(SENTENCES) * 10)]
    mixed = [(100, texts(rng, "en", 60) + " " + texts(rng, "fr", 30)), (101, None), (102, ""), (103, "12 ²³ --"), (None, texts(rng, "de", 400)), (104, "é" * 60_000), (105, texts(rng, "de", 9).upper())]
    frame = spark.createDataFrame(probe + mixed + mixed[:1], "doc_id long, text string").withColumns({"lang_pred": F.lit("own"), "languages": F.lit(1)})
    found = L.predict(frame.repartition(3), model).collect()
    assert len(found) == len(probe) + len(mixed) + 1
    got = {r.doc_id: r for r in found}
    assert all(got[i].lang_pred == sorted(SENTENCES)[i % 3] and len(got[i].languages) == 1 for i, _ in probe)
    assert got[100].lang_pred == "en" and {x.lang for x in got[100].languages} == {"en", "fr"}
    assert abs(got[100].languages[0].share - 2 / 3) < 0.1
    assert [got[i].lang_pred for i in (101, 102, 103)] == ["und"] * 3 and got[101].score == 0
    assert got[None].lang_pred == got[105].lang_pred == "de" and all(0 <= r.score <= 1 for r in found)
    empty = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.predict(frame, empty).collect()} == {"und"} and L.predict(frame.limit(0), model).collect() == []
