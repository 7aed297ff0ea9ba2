"""Token counts of a unigram vocabulary by a Viterbi pass that keeps scores and counts only.

An Aho-Corasick automaton of the vocabulary lists all pieces that end at each character; for each end the best score and
its number of pieces are kept, no back pointers. Ties go to the piece that starts first (the longest), as candidates come
in that order and only a strictly better score replaces one. A character that is no piece costs the lowest score less 10;
with byte pieces in the vocabulary it counts as its UTF-8 bytes, otherwise runs of such characters count as one.

Blanks become the mark U+2581, one is put before the text. If no piece holds the mark after another character, texts are
cut before such marks: no segmentation crosses there, so the counts of the cuts add up to those of the whole text.

Defined results: NULL and empty texts have no tokens. Repeated rows are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

MARK = "▁"
UNKNOWN_COST = 10.0


@dataclass(frozen=True)
class UnigramVocabulary:
    """Pieces that match text, with their scores, and whether bytes stand in for unknown characters."""

    pieces: tuple[tuple[str, float], ...]
    byte_pieces: bool

    @classmethod
    def load(cls, path: str) -> UnigramVocabulary:
        """Pieces and scores of a SentencePiece file, whatever it was trained as; control, byte and unused pieces match no text."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usual = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls(tuple((model.id_to_piece(i), model.get_score(i)) for i in usual), any(map(model.is_byte, ids)))


class Counter(dict):
    """Token counts of cuts of texts; at most `room` are kept at a time."""

    def __init__(self, vocabulary: UnigramVocabulary, room: int = 300_000):
        self.room, self.byte_pieces = room, vocabulary.byte_pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_COST
        inside = any(MARK in p.lstrip(MARK) for p, _ in vocabulary.pieces)
        self.cuts = None if inside else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __missing__(self, cut: str) -> int:
        if len(self) >= self.room:
            self.clear()
        self[cut] = n = self.viterbi(cut)
        return n

    def viterbi(self, text: str) -> int:
        score = [0.0] * (len(text) + 1)
        count = [0] * (len(text) + 1)
        unknown_end = [False] * (len(text) + 1)
        reached = 0  # all ends up to here are settled

        def settle(end: int, best: float | None, n: int) -> None:
            ch = text[end - 1]
            if ch not in self.single:
                other = score[end - 1] + self.unknown
                if best is None or other > best:
                    best, unknown_end[end] = other, True
                    if self.byte_pieces:
                        n = count[end - 1] + len(ch.encode())
                    else:
                        n = count[end - 1] + (not unknown_end[end - 1])
            score[end], count[end] = best, n

        best, n = None, 0
        if len(self.automaton):
            for last, (length, own) in self.automaton.iter(text):
                while reached < last:  # an end at which no piece ends, or the one before is complete
                    reached += 1
                    settle(reached, best, n)
                    best, n = None, 0
                start = last + 1 - length
                total = score[start] + own
                if best is None or total > best:
                    best, n = total, count[start] + 1
        while reached < len(text):
            reached += 1
            settle(reached, best, n)
            best, n = None, 0
        return count[len(text)]

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if self.cuts is None:
            return self.viterbi(marked)
        return sum(map(self.__getitem__, self.cuts.findall(marked)))


def count_tokens(docs: DataFrame, vocabulary: UnigramVocabulary, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.pieces, vocabulary.byte_pieces))  # fixed size: a row for each piece

    def run(batches):
        counter = Counter(UnigramVocabulary(*shared.value))
        for batch in batches:
            counts = [counter.tokens(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [id_column, "n_tokens"])

    out = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, out)
