import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from cleanframe.llm import token_alignment as ta

FILES = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def sizes(libraries):
    a, b = libraries
    byte_of = ta._byte_of()
    size_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    size_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return size_a, size_b


def plain(libraries, texts):
    """Rows without ids: whole texts by the libraries, all pairs of tokens compared."""
    a, b = libraries
    bytes_a, bytes_b = sizes(libraries)
    rows, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        x, y = [bytes_a(i) for i in ids_a], [bytes_b(i) for i in ids_b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            rows.append(None)
            continue
        spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        sa, sb = spans(x), spans(y)
        links = [(i, j) for (a0, a1), i in zip(sa, ids_a) for (b0, b1), j in zip(sb, ids_b) if a0 < b1 and b0 < a1]
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for end in common:
            inside = lambda spans, ids: ",".join(str(i) for (_, e), i in zip(spans, ids) if start < e <= end)  # noqa: E731, B023
            groups.append(f"{inside(sa, ids_a)}|{inside(sb, ids_b)}")
            start = end
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), links, groups))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = row
            out.append((n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(11)
    words = ["the", "Entsprechung", "naïve", "don't", "it's", "3.14", "x=1;", "日本語の文", "😀😀", "<|endoftext|>", "<s>", "hello,world", "e.g.", "a\nb", "\n\n", "", "  ", "½3", "été", "<0x41>"]
    made = [rng.choice([" ", "\n", "  ", ""]).join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    pool = list(" \n\t.,;:!?'-_0123abcZéÿ½²中日ع́👍\u3000\r")
    made += ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(60)]
    return [*made, *made[:5], "", None, "has a ▁ of its own", "   ", "x" * 300, "中" * 200, " ".join(rng.choices(words[:3], k=400))]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk, margin, fan, shared", [(65536, 4096, 8, 200_000), (64, 24, 2, 20)])
def test_agrees_with_the_libraries(spark, libraries, monkeypatch, chunk, margin, fan, shared):
    monkeypatch.setattr(ta, "SHARED_UNITS", shared)
    own = texts()
    rows = [(i if i else None, t) for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as unit").repartition(3)
    found = ta.Alignment(df, *FILES, P.PATTERN, chunk=chunk, margin=margin, fan=fan)
    assert (found.chunks.agg({"n_chunks": "max"}).first()[0] > 4) == (chunk == 64)
    got = rows_of(found.texts())
    wanted = sorted(((i, *row) for (i, _), row in zip(rows, plain(libraries, own))), key=repr)
    assert got == wanted


def test_empty_table(spark):
    assert ta.align(spark.createDataFrame([], "doc_id long, text string"), *FILES, P.PATTERN).collect() == []


def test_units_are_safe(libraries):
    """Tokens of units are those of whole texts, whatever spaces and marks stand between them."""
    a, b = libraries
    tokenizers = ta.Tokenizers(*FILES, P.PATTERN)
    rng = random.Random(21)
    pool = list(" \n\t.,;:!?'-_0b÷×Zéÿ½中д\u3000\u00a0\u2003\r\u0085s")
    made = ["".join(rng.choices(pool, weights=[12, 12, 3] + [2] * (len(pool) - 3), k=rng.randint(1, 30))) for _ in range(20_000)]
    for text in [*made, "x\n  y", "x\n\ny", "x.\n\ny", " \ny", "foo\n bar", "it's,don't;"]:
        data = np.frombuffer((" " + text).encode(), np.uint8)
        cuts = [0, *ta.borders(data).tolist(), len(data)]
        units = [bytes(data[i:j]).decode() for i, j in zip(cuts, cuts[1:])]
        found = tokenizers.tokens(units)
        assert [i for x, _ in found for i in x] == a.encode(" " + text, add_special_tokens=False).ids, text
        assert [i for _, y in found for i in y] == b.encode(text), text


def test_joining_fragments_is_associative():
    tokenizers = ta.Tokenizers(*FILES, P.PATTERN)
    unit = " Wörterverzeichnisanfang中文字"
    size = len(unit.encode())
    groups = [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b, _ in tokenizers.groups(unit)]
    rng = random.Random(2)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, size), 3))
        parts = [ta.Fragment() for _ in range(4)]
        for i, (low, high) in enumerate(zip([0, *cuts], [*cuts, size])):
            at = 0
            for x, y, end in tokenizers.groups(unit):
                own = tuple(ta._ending(z, s, at, low, high) for z, s in ((x, tokenizers.a_size), (y, tokenizers.b_size)))
                if own[0] or own[1]:
                    parts[i] = parts[i].joined(ta.Fragment(own, low < end <= high))
                at = end
        one, two, three, four = parts
        for joined in (one.joined(two).joined(three).joined(four), one.joined(two.joined(three.joined(four))), one.joined(two).joined(three.joined(four))):
            assert joined.finished().groups == ";".join(groups)


def test_a_model_that_crosses_units_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(FILES[1], "rb").read())
    model.pieces[500].piece = "the▁end"
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="border"):
        ta.Tokenizers(FILES[0], str(tmp_path / "m.model"), P.PATTERN)


def test_remembered_units_are_bounded_and_right(monkeypatch):
    monkeypatch.setattr(ta, "REMEMBERED", 300)
    remembered, rng = ta.Memory(ta.Tokenizers(*FILES, P.PATTERN)), random.Random(5)
    pool = [f" word{i}" for i in range(2_000)] + [" " + "x" * n for n in range(60, 70)]
    for size in (0, 100, 250, 800, 100, 0, 300):
        units = rng.sample(pool, size)
        got = [x.to_pylist() for x in remembered.ids(ta.pa.array(units, ta.pa.large_string()))]
        assert list(zip(*got)) == remembered.tokenizers.tokens(units)
        assert len(remembered.units) <= 300 and not any(len(u) > ta.LONGEST for u in remembered.units.to_pylist())
        again = [x.to_pylist() for x in remembered.ids(ta.pa.array(units, ta.pa.large_string()))]
        assert again == got


def test_a_remembered_unit_takes_some_tens_of_bytes():
    remembered = ta.Memory(ta.Tokenizers(*FILES, P.PATTERN))
    remembered.ids(ta.pa.array([f" word{i}" for i in range(20_000)], ta.pa.large_string()))
    held = remembered.units.nbytes + remembered.used.nbytes + sum(x.nbytes for x in remembered.lists)
    assert len(remembered.units) == 20_000 and held < 100 * 20_000
