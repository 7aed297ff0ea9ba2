import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cleanframe.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab A'st\n\t  éßЖ中文😀\u0085 　٣²½!!..--12<|endoftext|>‍́\x1c\x1f"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.load_ranks(PATH), special_tokens={})


def test_words_merge_as_the_library_does(library):
    ranks, rng = B.load_ranks(PATH), random.Random(1)
    words = ["é" * 3000, "ab" * 5000, "x"] + ["".join(rng.choices("abcdefghéß中 ", k=rng.randint(1, 30))) for _ in range(500)]
    for word in words:
        assert B.encode_word(word.encode(), ranks) == library._encode_single_piece(word.encode())


def test_round_trip_equals_the_library(spark, library):
    rng = random.Random(2)
    rows = [(None if i % 7 == 0 else f"r{i % 300}", "".join(rng.choices(ALPHABET, k=rng.randint(0, 60)))) for i in range(600)]
    rows += [("n", None), ("e", ""), ("long", "x" * 30_000), ("long", "ab" * 20_000 + " " * 5000)] + rows[:5]
    rows += [("hot", "one hot text")] * 300
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5).withColumns({"ids": F.lit("own"), "block": F.lit(1), "word": F.lit(2)})
    encoded = B.encode(docs, PATH, public_tokenizers.PATTERN, block=500)
    got = [(r.doc_id, list(r.ids), bytes(r.ids_bytes), bytes(r.decoded)) for r in B.decode(encoded, PATH).collect()]
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, ids, struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    encoded = B.encode(docs, PATH, public_tokenizers.PATTERN)
    assert encoded.collect() == [] and B.decode(encoded, PATH).collect() == []
