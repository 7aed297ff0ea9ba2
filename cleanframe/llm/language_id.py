"""Language identification of documents that may mix languages.

`fit` counts byte trigrams of letters by language over all labelled texts. For a document, expectation-maximisation
estimates the share of each language from the likelihoods of its trigrams. Languages then leave one by one, smallest
share first, as long as the penalised likelihood does not fall; what stays is the document's set of languages.

Defined results: a NULL text and one without any letter get `und` and score 0. Without a labelled text every document
is `und`. Equal likelihoods go to the language that sorts first. Repeated rows are judged one by one; NULL labels are not
learned from; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cleanframe.llm.common import struct_type

#: Trigrams are counted in this many buckets, so a language is this many numbers whatever the corpus.
BUCKETS = 1 << 16
UNDETERMINED = "und"
#: ASCII characters that are no letters, as blanks.
TO_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the letters of a whole text; runs of other ASCII characters count as one blank."""
    data = np.frombuffer(b" " + text.lower().encode().translate(TO_BLANK) + b" ", np.uint8)
    blank = data == 32
    data = data[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    code = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _counts(batches):
    """Trigram counts of a partition by language, as sparse rows; at most 64 languages are held at a time."""
    held: dict[str, np.ndarray] = {}

    def rows():
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"]
            )

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if lang not in held:
                if len(held) >= 64:
                    yield from rows()
                    held.clear()
                held[lang] = np.zeros(BUCKETS, np.int64)
            held[lang] += np.bincount(grams(text.as_py()), minlength=BUCKETS)
    yield from rows()


@dataclass(frozen=True)
class LanguageModel:
    """Sorted languages, and the probability of each bucket in each of them."""

    languages: tuple[str, ...]
    probability: np.ndarray

    def mixture(self, text: str | None, rounds: int = 25, penalty: float = 1.0) -> list[tuple[str, float, float]]:
        """The selected languages with their share and how sure each is against the others alone, largest share first."""
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return []
        counts = np.bincount(grams(text), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        n = counts[at].astype(float)
        total = n.sum()
        p = self.probability[:, at]
        # A letter stands in three trigrams, so likelihoods count a third.
        alone = np.log(p) @ n / 3
        sure = np.exp(alone - alone.max())
        sure /= sure.sum()
        chosen = np.arange(len(self.languages))
        share, fit = self._maximise(p, n, np.full(len(chosen), 1 / len(chosen)), rounds)
        while len(chosen) > 1:
            out = len(share) - 1 - int(np.argmin(share[::-1]))
            fewer = np.delete(chosen, out)
            if len(fewer) == 1:
                less, worse = np.ones(1), alone[fewer[0]]
            else:
                start = np.delete(share, out) + 1e-6
                less, worse = self._maximise(p[fewer], n, start / start.sum(), rounds)
            if fit - worse > penalty * 0.5 * np.log(total + 1):
                break
            chosen, share, fit = fewer, less, worse
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], -sure[chosen[i]], chosen[i]))
        return [(self.languages[chosen[i]], float(share[i]), float(sure[chosen[i]])) for i in order]

    def _maximise(self, p: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        total = n.sum()
        for _ in range(rounds):
            mixed = share @ p
            after = share * (p @ (n / mixed)) / total
            done = np.abs(after - share).max() < 1e-3
            share = after / after.sum()
            if done:
                break
        return share, float(np.log(share @ p) @ n / 3)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learns from all rows with a text and a label. The driver gets at most 65,536 numbers for each language."""
    own = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    counted = own.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    n = np.zeros((len(languages), BUCKETS))
    index = {x: i for i, x in enumerate(languages)}
    rows = np.fromiter((index[x] for x in table.column("lang").to_pylist()), np.int64, table.num_rows)
    n[rows, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    n += smoothing
    return LanguageModel(tuple(languages), (n / n.sum(axis=1, keepdims=True)) if languages else n)


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, lang_pred, score, languages (selected, with shares)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.probability))

    def run(batches):
        judge = LanguageModel(*shared.value)
        for batch in batches:
            found = [judge.mixture(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0][0] if f else UNDETERMINED for f in found], pa.string()),
                    pa.array([f[0][1] * f[0][2] if f else 0.0 for f in found], pa.float64()),
                    pa.array([[{"lang": x, "share": s} for x, s, _ in f] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                ],
                names,
            )

    part = struct_type(lang=T.StringType(), share=T.DoubleType())
    out = T.StructType(
        [T.StructField(id_column, docs.schema[id_column].dataType), *struct_type(lang_pred=T.StringType(), score=T.DoubleType(), languages=T.ArrayType(part))]
    )
    names = out.names
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, out)
