import hashlib
import random

import numpy as np

from cleanframe.llm import syncmers as sy


def plain_anchors(text, k=sy.K, s=sy.S):
    """Positions of closed syncmers, k-mer by k-mer."""
    points = sy.code_points(text)
    inner = sy._hashes(points, s).tolist() if len(points) >= s else []
    found = []
    for i in range(len(points) - k + 1):
        window = inner[i : i + k - s + 1]
        if window.index(min(window)) in (0, k - s):
            found.append(i)
    return found


def texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "größer", "日本語", "δοκιμή", "x", "the", "of", "👍"]
    out = ["", "a", "short text", "exactly16letters", "fifteen letters", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    out += [" ".join(rng.choices(words, k=n)) for n in (3, 8, 20, 50, 200, 900, 900, 20)]
    return out


def test_anchors_are_closed_syncmers(monkeypatch):
    monkeypatch.setattr(sy, "BLOCK", 37)
    for text in texts():
        found = sy.anchors(sy.code_points(text))
        assert found.at.tolist() == plain_anchors(text)
        for a, b in zip(found.at, found.at[1:]):
            assert b - a <= sy.K - sy.S + 1
        assert [int(x) for x in found.key] == [int(sy._hashes(sy.code_points(text[i : i + sy.K]), sy.K)[0]) for i in found.at]


def test_edited_sketch_is_that_of_the_edited_text():
    for one in texts():
        for other in texts():
            text, marks = sy.Document.of(one).edited(sy.Document.of(other))
            n = len(one)
            assert text == one[: n - n // 2] + other[: n // 2]
            assert np.array_equal(marks, sy.Document.of(text).marks)


def test_likeness():
    a, b = sy.Document.of(texts()[-3]), sy.Document.of("".join(random.Random(4).choices("abcdefg ", k=5000)))
    assert sy.likeness(a.marks, a.marks) == 1.0
    assert sy.likeness(a.marks, b.marks) < 0.1
    assert len(a.text) < 5000
    half = sy.Document.of(a.text[: len(a.text) // 2] + b.text[: len(a.text) // 2])
    assert 0.3 < sy.likeness(a.marks, half.marks) < 0.7
    none = sy.Document.of("")
    assert sy.likeness(none.marks, none.marks) == 1.0 and sy.likeness(none.marks, a.marks) == 0.0
    assert np.array_equal(sy.read_back(sy.written_out(a.marks)), a.marks)


def expected(rows):
    own = [sy.Document.of(t or "") for _, t in rows]
    out = []
    for i, (key, _) in enumerate(rows):
        after = own[(i + 1) % len(own)]
        n = len(own[i].text)
        text = own[i].text[: n - n // 2] + after.text[: n // 2]
        edited = sy.Document.of(text)
        out.append((key, n, hashlib.sha256(text.encode()).hexdigest(), sy.written_out(own[i].marks), sy.written_out(edited.marks), sy.likeness(own[i].marks, edited.marks), sy.likeness(own[i].marks, after.marks)))
    return out


def test_every_document_meets_the_next(spark):
    rng = random.Random(8)
    pool = texts() + [None]
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(150)]
    rows = [(i, rng.choice(pool)) for i in ids] + [(None, "a single row without an id, long enough")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).selectExpr("*", "'x' as part", "1 as only", "2 as k1")
    wanted = expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    for ranges in (1, 5, 64):
        got = [tuple(r) for r in sy.fingerprints(df, ranges=ranges).collect()]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_repeated_rows_single_row_and_empty_table(spark):
    same = [(1, "one and the same text, twice in the table")] * 3
    got = sy.fingerprints(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r.near_next == 1.0 and r.near_edited < 1.0 for r in got)
    one = sy.fingerprints(spark.createDataFrame([(1, "all alone")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sy.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
