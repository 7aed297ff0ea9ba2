"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is byte-level BPE (a JSON file), B is BPE of pieces with byte fallback (a model file). Both read a space and the
text. Where tokens of both end at the same byte, the text is cut into groups; in a group every token of A overlaps the tokens
of B it meets, (tokens of A) + (tokens of B) - 1 links in all.

Chunks of a text are byte ranges. The fragment of a chunk holds the tokens that end in it: those up to the first common end
(open prefix), whole groups, and those after the last common end (open suffix). Joining fragments closes the group between
them; it is associative, so the fragments of a very long text are made by different tasks and joined as a tree.

Both tokenizers cut at the borders of units (mostly a word with the spaces before it, or a run of marks): A's pattern cuts
there, and no piece of B holds a space behind another character or mixes letters with marks, for which the model file is
checked. So each distinct unit is tokenized once for the corpus counts, and once in a while by the tasks that put texts
together. How often a pair of ids is linked is summed over distinct units. What a unit's links are worth (count, and whether
it is the highest of the B id) is shared with every task for the most frequent units, a list of bounded size, and joined for
the others.

Defined results: NULL and empty texts, and texts with the character that B writes for a space (its bytes would differ), have no
tokens. Repeated rows are rows of their own and count. Ids may repeat or be NULL. Very long texts are split into chunks, save
units without a border for MARGIN characters, which stay in one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from cleanframe.llm.common import bound_arrow_batches, give_back, returning_memory, salted_join, struct_type, written

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?\n"
#: The character that stands for a space in pieces of B.
ESCAPED = "▁"
CHUNK, MARGIN = 1 << 16, 1 << 12
#: Units whose worth is shared with every task; the others are joined.
SHARED_UNITS = 200_000
#: Units that a Python worker remembers, none of more bytes than LONGEST; those not used for long go when they are full.
REMEMBERED = 600_000
LONGEST = 64
#: Bits of a B id in a link.
SHIFT = 24

_ASCII, _MARK, _POINT, _SOLID, _C3, _AFTER_C3, _LEAD, _NEXT = (1 << i for i in range(8))


def _classes() -> np.ndarray:
    """What a byte can be: an ASCII letter, a mark, a mark that is no space, a character that is no space, the first and the
    second byte of a letter from À to ÿ, the first byte of a character of two bytes that is no space, a later byte."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        ch = chr(b)
        out[b] = (
            (_ASCII if ch.isascii() and ch.isalpha() else 0)
            | (_MARK if ch in MARKS else 0)
            | (_POINT if ch in MARKS and ch != "\n" else 0)
            | (_SOLID if 33 <= b <= 126 else 0)
            | (_C3 if b == 0xC3 else 0)
            | (_AFTER_C3 if 0x80 <= b <= 0xBF and b not in (0x97, 0xB7) else 0)
            | (_LEAD if 0xC3 <= b <= 0xDF else 0)
            | (_NEXT if 0x80 <= b <= 0xBF else 0)
        )
    return out


CLASSES = _classes()


def borders(data: np.ndarray) -> np.ndarray:
    """Positions (from 1) in UTF-8 bytes where a unit begins: a space after a character that is none; a mark after a letter; a
    letter after a mark, where the mark is no line break or the only space there. No lookahead of A's pattern passes them."""
    if len(data) < 2:
        return np.empty(0, np.int64)
    kind = CLASSES[data]
    has = lambda x, flag: (x & flag) != 0
    shifted = lambda x, n: np.concatenate([np.zeros(n, x.dtype), x[:-n]]) if n < len(x) else np.zeros_like(x)
    before, twice = shifted(kind, 1), shifted(kind, 2)
    behind = np.append(kind[1:], 0).astype(np.uint8)
    letter_ended = has(before, _ASCII) | (has(before, _AFTER_C3) & has(twice, _C3))
    solid_ended = has(before, _SOLID) | (has(before, _NEXT) & has(twice, _LEAD))
    letter_begins = has(kind, _ASCII) | (has(kind, _C3) & has(behind, _AFTER_C3))
    mark_ended = has(before, _POINT) | ((shifted(data, 1) == 10) & has(twice, _SOLID))
    cut = ((data == 32) & solid_ended) | (has(kind, _MARK) & letter_ended) | (letter_begins & mark_ended)
    cut[0] = False
    return np.flatnonzero(cut)


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Tokenizers:
    """Both tokenizers, for units and whole texts."""

    def __init__(self, a_file: str, b_file: str, pattern: str):
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2

        byte_of = _byte_of()
        with open(a_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte_of[ch] for ch in token): number for token, number in vocabulary.items()}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            self.a_size[number] = len(token)
        model = sentencepiece_model_pb2.ModelProto()
        with open(b_file, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("the model changes texts, so its tokens need not cover their bytes")
        marks = re.escape(MARKS)
        mixed = re.compile(rf"[^{ESCAPED}]{ESCAPED}|[{LETTER}][{marks}]|[{marks}][{LETTER}]")
        # types 1 and 4: ordinary pieces and those a user added
        if any(p.type in (1, 4) and mixed.search(p.piece) for p in model.pieces):
            raise ValueError("a piece of the model crosses the border of units")
        self.b_size = np.array([1 if p.type == 6 else len(p.piece.replace(ESCAPED, " ").encode()) for p in model.pieces], np.int64)
        normal.add_dummy_prefix = False  # units bring their own spaces
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def tokens(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        return list(zip(map(self.a.encode_ordinary, units), self.b.encode(units, num_threads=1)))

    def groups(self, unit: str):
        """(tokens of A, tokens of B, end) of each group of a unit."""
        (a, b), = self.tokens([unit])
        both = Aligned(self, np.array(a, np.int64), np.array(b, np.int64))
        i = j = 0
        for x, y in zip(both.last_a, both.last_b):
            yield a[i : x + 1], b[j : y + 1], int(both.ends_a[x])
            i, j = x + 1, y + 1

    @property
    def names(self) -> pa.Array:
        """The ids written out: A followed by a comma or, at the end of a group, a bar; B by a comma or a semicolon."""
        if not hasattr(self, "_names"):
            a = [f"{i}{x}" for i in range(len(self.a_size)) for x in ",|"]
            b = [f"{i}{x}" for i in range(len(self.b_size)) for x in ",;"]
            self._names = pa.array(a + b, pa.large_string())
        return self._names


class Aligned:
    """Two token streams over the same bytes; unit borders are common ends, so the streams of many texts may be one."""

    def __init__(self, tokenizers: Tokenizers, a: np.ndarray, b: np.ndarray):
        self.tokenizers, self.a, self.b = tokenizers, a, b
        self.ends_a, self.ends_b = np.cumsum(tokenizers.a_size[a]), np.cumsum(tokenizers.b_size[b])
        size = int(self.ends_a[-1]) + 1 if len(a) else 1
        if size != (int(self.ends_b[-1]) + 1 if len(b) else 1):
            raise ValueError("the tokens of both do not cover the same bytes")
        self.at_a, self.at_b = np.zeros(size, bool), np.zeros(size, bool)
        self.at_a[self.ends_a] = True
        self.at_b[self.ends_b] = True
        self.closes_a, self.closes_b = self.at_b[self.ends_a], self.at_a[self.ends_b]
        self.last_a, self.last_b = np.flatnonzero(self.closes_a), np.flatnonzero(self.closes_b)

    def links(self) -> np.ndarray:
        """a << SHIFT | b of each stretch between neighbouring ends, in order: one for each overlapping pair."""
        ends = np.flatnonzero(self.at_a | self.at_b)
        place = lambda at: np.cumsum(at)[ends - 1] if len(ends) else ends
        return self.a[place(self.at_a)] << SHIFT | self.b[place(self.at_b)]

    def written_out(self) -> tuple[memoryview, np.ndarray]:
        """All groups as text, each ended by a semicolon, and where each of them ends."""
        group_a, group_b = np.cumsum(self.closes_a) - self.closes_a, np.cumsum(self.closes_b) - self.closes_b
        places = np.empty(len(self.a) + len(self.b), np.int64)
        places[np.arange(len(self.a)) + np.append(0, self.last_b + 1)[group_a]] = self.a * 2 + self.closes_a
        offset = 2 * len(self.tokenizers.a_size)
        places[np.arange(len(self.b)) + (self.last_a + 1)[group_b]] = offset + self.b * 2 + self.closes_b
        taken = self.tokenizers.names.take(pa.array(places))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
        data = memoryview(taken.buffers()[2]) if len(taken) else memoryview(b"")
        return data, ends[self.last_a + self.last_b + 2]


class Memory:
    """Token ids of units, kept for later tasks of the same Python worker; bounded, recently used ones stay. Kept in Arrow arrays,
    about fifty bytes a unit."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.batch = tokenizers, 0
        self.units, self.lists, self.used = pa.array([], pa.large_string()), (_lists([]), _lists([])), np.empty(0, np.int32)

    def ids(self, units: pa.LargeStringArray) -> list[pa.ListArray]:
        """Ids of A and of B of each of these distinct units, as 32-bit numbers."""
        place = pc.index_in(units, value_set=self.units)
        new = place.is_null()
        missing = units.filter(new)
        tokens = self.tokenizers.tokens(missing.to_pylist())
        lists = [pa.concat_arrays([old, _lists([t[k] for t in tokens])]) for k, old in enumerate(self.lists)]
        where = place.fill_null(0).to_numpy().astype(np.int64)
        where[new.to_numpy(zero_copy_only=False)] = np.arange(len(self.units), len(self.units) + len(missing))
        taken = pa.array(where)
        out = [x.take(taken) for x in lists]
        self._remember(missing, lists, where)
        return out

    def _remember(self, missing: pa.LargeStringArray, lists: list[pa.ListArray], where: np.ndarray) -> None:
        self.batch += 1
        self.used[where[where < len(self.used)]] = self.batch
        used = np.append(self.used, np.full(len(missing), self.batch, np.int32))
        stays = np.append(np.ones(len(self.units), bool), pc.less_equal(pc.binary_length(missing), LONGEST).to_numpy(zero_copy_only=False))
        if stays.sum() > REMEMBERED:
            kept = np.flatnonzero(stays)
            stays[kept[np.argsort(-used[kept], kind="stable")[REMEMBERED // 2 :]]] = False
        at = pa.array(np.flatnonzero(stays))
        self.units = pa.concat_arrays([self.units, missing]).take(at)
        self.lists, self.used = tuple(x.take(at) for x in lists), used[stays]


@lru_cache(maxsize=2)
def memory(files: tuple[str, str, str]) -> Memory:
    made = Memory(Tokenizers(*files))
    give_back()  # what reading the files took
    return made


def _lists(parts: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.fromiter((i for x in parts for i in x), np.int32, int(offsets[-1]))))


class Units:
    """The units of a column of texts: `all` are all of them in order, those of text i from first[i] to first[i + 1];
    `start` and `end` are their bytes in their text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:high]
        offsets = offsets - low
        filled = np.unique(offsets[:-1][np.diff(offsets) > 0])
        at = np.union1d(borders(data), filled)
        ends = np.append(at[1:], len(data)) if len(at) else at
        self.first = np.searchsorted(at, offsets)
        counts = np.diff(self.first)
        self.start = at - np.repeat(offsets[:-1], counts)
        self.end = ends - np.repeat(offsets[:-1], counts)
        self.counts = counts
        buffers = [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)]
        self.all = pa.LargeStringArray.from_buffers(len(at), buffers[1], buffers[2]) if len(at) else pa.array([], pa.large_string())

    def begun(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which units begin in the byte range of their text."""
        return (self.start >= np.repeat(low, self.counts)) & (self.start < np.repeat(high, self.counts))


@dataclass
class Fragment:
    """Tokens that end in a byte range. Without a common end all of them are in the prefix, and `closed` is false."""

    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    closed: bool = False
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: str = ""
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))

    def close(self, a: list[int], b: list[int]) -> None:
        """Adds a whole group."""
        self.add(len(a), len(b), 1, f"{','.join(map(str, a))}|{','.join(map(str, b))}")

    def add(self, n_a: int, n_b: int, n_groups: int, groups: str) -> None:
        if n_groups:
            self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups
            self.groups = f"{self.groups};{groups}" if self.groups else groups

    def joined(self, other: Fragment) -> Fragment:
        """This range and the next one; associative, and an empty fragment changes nothing."""
        plus = lambda x, y: (x[0] + y[0], x[1] + y[1])
        if not self.closed:
            return Fragment(plus(self.prefix, other.prefix), other.closed, other.n_a, other.n_b, other.n_groups, other.groups, other.suffix)
        if not other.closed:
            return Fragment(self.prefix, True, self.n_a, self.n_b, self.n_groups, self.groups, plus(self.suffix, other.prefix))
        out = Fragment(self.prefix, True, self.n_a, self.n_b, self.n_groups, self.groups, other.suffix)
        out.close(*plus(self.suffix, other.prefix))
        out.add(other.n_a, other.n_b, other.n_groups, other.groups)
        return out

    def finished(self) -> Fragment:
        """The fragment of a whole text: its start is a common end, so the prefix is a group, and nothing is left open."""
        if not self.closed:
            return Fragment()
        out = Fragment(closed=True)
        out.close(*self.prefix)
        out.add(self.n_a, self.n_b, self.n_groups, self.groups)
        return out

    @property
    def n_links(self) -> int:
        return self.n_a + self.n_b - self.n_groups


def fragment_of(tokenizers: Tokenizers, first: str, skip: int, inner: tuple[int, int, int, str], last: str, stop: int) -> Fragment:
    """The fragment of the bytes behind `skip` bytes of the unit `first`, of whole units (their numbers of tokens and groups,
    their groups) and of `stop` bytes of the unit `last`."""
    out = Fragment()

    def cut(unit: str, low: int, high: int) -> Fragment:
        part, at = Fragment(), 0
        for a, b, end in tokenizers.groups(unit):
            own = _ending(a, tokenizers.a_size, at, low, high), _ending(b, tokenizers.b_size, at, low, high)
            if own[0] or own[1]:
                part = part.joined(Fragment(own, low < end <= high))
            at = end
        return part

    if first:
        out = out.joined(cut(first, skip, 1 << 60))
    n_a, n_b, n_groups, groups = inner
    if n_groups:
        # The first group of whole units closes whatever is open before it.
        head, _, rest = groups.partition(";")
        a, b = (list(map(int, x.split(","))) for x in head.split("|"))
        middle = Fragment((a, b), True)
        middle.add(n_a - len(a), n_b - len(b), n_groups - 1, rest)
        out = out.joined(middle)
    return out.joined(cut(last, 0, stop)) if last else out


def _ending(tokens: list[int], sizes: np.ndarray, at: int, low: int, high: int) -> list[int]:
    """The tokens, the first of which begins at `at`, that end in the range."""
    out = []
    for t in tokens:
        at += int(sizes[t])
        if low < at <= high:
            out.append(t)
    return out


def chunks(docs: DataFrame, id_column: str, text: str, size: int, margin: int) -> DataFrame:
    """(row, id, chunk, n_chunks, slice, low, high): the parts of each sound text, with a margin around the bytes from low to
    high, and an empty slice for the others.

    A text is cut at multiples of `size` characters, where a border of units lies within `margin` on both sides."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).alias("text"))
    sound = F.coalesce((F.length("text") > 0) & ~F.contains("text", F.lit(ESCAPED)), F.lit(False))
    spaced = own.select("row", "id", F.when(sound, F.concat(F.lit(" "), "text")).alias("text"))
    length = F.length("text")
    border = f"[{LETTER}] [{LETTER}]"

    def good(x):
        left = F.substring(F.col("text"), x - margin + 1, F.lit(margin))
        right = F.substring(F.col("text"), x + 1, F.lit(margin))
        return left.rlike(border) & right.rlike(border)

    cuts = F.when(length > size + margin, F.filter(F.sequence(F.lit(size), length - margin, F.lit(size)), good)).otherwise(F.array().cast("array<int>"))
    ends = spaced.select("row", "id", "text", F.concat(F.array(F.lit(0)), cuts, F.array(F.coalesce(length, F.lit(0)))).alias("ends"))
    each = ends.select("row", "id", "text", "ends", F.explode(F.sequence(F.lit(0), F.size("ends") - 2)).alias("chunk"))
    start, end = F.get("ends", F.col("chunk")), F.get("ends", F.col("chunk") + 1)
    before = F.greatest(start - margin, F.lit(0))
    part = F.when(F.size("ends") == 2, F.col("text")).otherwise(F.substring("text", before + 1, end + margin - before))
    cut = each.select("row", "id", "chunk", (F.size("ends") - 1).alias("n_chunks"), part.alias("slice"), (start - before).alias("low"), (end - before).alias("high"))
    size_of = lambda n: F.when(F.col("n_chunks") == 1, F.when(F.col(n) > 0, F.octet_length("slice")).otherwise(0)).otherwise(F.octet_length(F.substring("slice", F.lit(1), F.col(n))))
    return cut.select("row", "id", "chunk", "n_chunks", F.coalesce("slice", F.lit("")).alias("slice"), *[F.coalesce(size_of(n), F.lit(0)).cast("long").alias(n) for n in ("low", "high")])


def _begun(batch: pa.RecordBatch) -> pa.RecordBatch:
    """How often each unit begins in the chunks of a batch."""
    units = Units(batch.column("slice"))
    begun = units.begun(*(batch.column(n).to_numpy() for n in ("low", "high")))
    counts = units.all.filter(pa.array(begun)).value_counts()
    return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["unit", "n"])


@returning_memory
def _counted(batches):
    for batch in batches:
        yield _begun(batch)
        give_back()


def _unit_links(files):
    def run(batches):
        tokenizers = memory(files).tokenizers
        for batch in batches:
            tokens = tokenizers.tokens(batch.column("unit").to_pylist()) if batch.num_rows else []
            both = Aligned(tokenizers, *(np.fromiter((i for t in tokens for i in t[k]), np.int64) for k in (0, 1)))
            groups = np.cumsum(both.closes_a)
            ends = [np.cumsum([len(t[k]) for t in tokens]).astype(np.int64) for k in (0, 1)]
            # links up to a border: tokens of both less the groups
            upto = np.append(0, ends[0] + ends[1] - groups[ends[0] - 1]) if tokens else np.zeros(1, np.int64)
            links = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(both.links()))
            yield pa.RecordBatch.from_arrays([*batch.columns, links], ["unit", "n", "links"])

    return returning_memory(run)


def _put_together(files, shared, names: list[str], kinds: dict):
    """Chunks to fragments and what their links are worth: shared units are summed here, the others listed."""

    def made_of(batch: pa.RecordBatch, remembered: Memory, frequent: pa.LargeStringArray, worth: np.ndarray) -> pa.RecordBatch:
        tokenizers = remembered.tokenizers
        units = Units(batch.column("slice"))
        coded = units.all.dictionary_encode()
        distinct, place = coded.dictionary, coded.indices.to_numpy()
        a, b = remembered.ids(distinct)
        taken = pa.array(place)
        both = Aligned(tokenizers, *(x.take(taken).flatten().to_numpy().astype(np.int64) for x in (a, b)))
        running = lambda x: np.append(0, np.cumsum(x))
        # Tokens, groups and characters of written groups before each unit.
        tokens_a, tokens_b = (running(np.diff(x.offsets.to_numpy())[place]) for x in (a, b))
        groups = running(both.closes_a)[tokens_a]
        text, group_ends = both.written_out()
        chars = np.append(0, group_ends)[groups]
        value = worth[pc.index_in(distinct, value_set=frequent).fill_null(len(frequent)).to_numpy()]
        low, high = (batch.column(n).to_numpy() for n in ("low", "high"))
        begun, rare = units.begun(low, high), (value[:, 0] < 0)[place]
        known = (begun & ~rare)[:, None] * value[place]
        best, total = running(known[:, 0]), running(known[:, 1])
        listed = begun & rare
        others = pa.ListArray.from_arrays(pa.array(running(listed)[units.first], pa.int32()), units.all.filter(pa.array(listed)).cast(pa.string()))
        out = {n: [] for n in ("n_a", "n_b", "n_groups", "closed", "prefix_a", "prefix_b", "suffix_a", "suffix_b", "groups", "digest")}
        chunked = batch.column("n_chunks").to_pylist()
        for i, (u, v) in enumerate(zip(units.first[:-1].tolist(), units.first[1:].tolist())):
            first = last = ""
            skip = stop = 0
            if chunked[i] > 1:
                # Only units within the range, and those that cross its ends.
                start, end = units.start[u:v], units.end[u:v]
                crossing = np.flatnonzero((start < low[i]) & (end > low[i]))
                if len(crossing):
                    first, skip = units.all[u + int(crossing[0])].as_py(), int(low[i] - start[crossing[0]])
                crossing = np.flatnonzero((start < high[i]) & (end > high[i]))
                if len(crossing):
                    last, stop = units.all[u + int(crossing[0])].as_py(), int(high[i] - start[crossing[0]])
                u, v = u + int(np.searchsorted(start, low[i])), u + int(np.searchsorted(end, high[i], "right"))
            numbers = [int(x[v] - x[u]) for x in (tokens_a, tokens_b, groups)]
            whole = text[chars[u] : chars[v] - 1] if numbers[2] else b""
            if chunked[i] > 1:
                made = fragment_of(tokenizers, first, skip, (*numbers, bytes(whole).decode()), last, stop)
                digest = None
            else:
                made = Fragment(([], []), numbers[2] > 0, *numbers)
                digest = hashlib.sha256(whole).hexdigest() if numbers[2] else ""
            for n, x in zip(out, (made.n_a, made.n_b, made.n_groups, made.closed, *made.prefix, *made.suffix, made.groups, digest)):
                out[n].append(x)
        ready = {n: pa.array(x, kinds[n]) for n, x in out.items()} | {"units": others}
        ready |= {n: pa.array(x[units.first[1:]] - x[units.first[:-1]]) for n, x in (("best", best), ("total", total))}
        ready |= {n: batch.column(n) for n in ("row", "id", "chunk", "n_chunks")}
        return pa.RecordBatch.from_arrays([ready[n] for n in names], names)

    def run(batches):
        remembered, (frequent, worth) = memory(files), shared.value
        for batch in batches:
            yield made_of(batch, remembered, frequent, worth)
            give_back()

    return returning_memory(run)


_FRAGMENT = dict(
    n_a=T.LongType(), n_b=T.LongType(), n_groups=T.LongType(), closed=T.BooleanType(), prefix_a=T.ArrayType(T.IntegerType()), prefix_b=T.ArrayType(T.IntegerType()),
    suffix_a=T.ArrayType(T.IntegerType()), suffix_b=T.ArrayType(T.IntegerType()), groups=T.StringType(),
)


def _tree(fan: int):
    """Joins up to `fan` neighbouring fragments of a text."""

    def run(table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        whole = Fragment()
        for r in own:
            whole = whole.joined(Fragment((r["prefix_a"], r["prefix_b"]), r["closed"], r["n_a"], r["n_b"], r["n_groups"], r["groups"], (r["suffix_a"], r["suffix_b"])))
        row = {"row": own[0]["row"], "chunk": own[0]["chunk"] // fan, "n_a": whole.n_a, "n_b": whole.n_b, "n_groups": whole.n_groups, "closed": whole.closed,
               "prefix_a": whole.prefix[0], "prefix_b": whole.prefix[1], "suffix_a": whole.suffix[0], "suffix_b": whole.suffix[1], "groups": whole.groups}
        return pa.Table.from_pylist([row], schema=table.select(list(row)).schema)

    return run


def _finished(batches):
    names = ["row", "n_a", "n_b", "n_groups", "digest"]
    kinds = [pa.int64()] * 4 + [pa.string()]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            whole = Fragment((r["prefix_a"], r["prefix_b"]), r["closed"], r["n_a"], r["n_b"], r["n_groups"], r["groups"], (r["suffix_a"], r["suffix_b"])).finished()
            out.append((r["row"], whole.n_a, whole.n_b, whole.n_groups, hashlib.sha256(whole.groups.encode()).hexdigest()))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class Alignment:
    """Corpus counts of linked ids, and the alignment of every text."""

    def __init__(self, docs: DataFrame, a_file: str, b_file: str, pattern: str, id_column: str = "doc_id", text: str = "text", chunk: int = CHUNK, margin: int = MARGIN, fan: int = 8):
        if margin * 2 > chunk:
            raise ValueError("a chunk must be at least two margins long")
        bound_arrow_batches(docs.sparkSession, 2 << 20)
        self.docs, self.files, self.fan = docs, (a_file, b_file, pattern), fan
        Tokenizers(*self.files)  # fails here, not in a task
        self.chunks = chunks(docs, id_column, text, chunk, margin)
        counted = self.chunks.select("slice", "low", "high", "n_chunks").mapInArrow(_counted, "unit string, n long")
        units = counted.groupBy("unit").agg(F.sum("n").alias("n"))
        self.units = written(units.mapInArrow(_unit_links(self.files), "unit string, n long, links array<long>"), "alignment-units")
        self.each = self.units.select("unit", "n", F.explode("links").alias("link"))
        counts = self.each.groupBy("link").agg(F.sum("n").alias("n_links"))
        b_id = F.col("link").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int")
        self.pairs = written(counts.select(F.shiftright("link", SHIFT).cast("int").alias("a"), b_id.alias("b"), "link", "n_links"), "alignment-pairs")

    def counts(self) -> DataFrame:
        """(a, b, n_links, best): how often two ids are linked in the corpus, and whether no other is more often with b."""
        top = self.pairs.groupBy("b").agg(F.max("n_links").alias("most"))  # a row for each id of B
        return self.pairs.join(top, "b").select("a", "b", "link", "n_links", (F.col("n_links") == F.col("most")).alias("best"))

    def worth(self) -> DataFrame:
        """(unit, n, n_best, count_sum): what the links of one occurrence of a unit add up to."""
        valued = salted_join(self.each, self.counts().select("link", "n_links", F.col("best").cast("long").alias("best")), "link", 500_000)
        return written(valued.groupBy("unit").agg(F.max("n").alias("n"), F.sum("best").alias("n_best"), F.sum("n_links").alias("count_sum")), "alignment-worth")

    def _frequent(self, worth: DataFrame) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The units above a frequency that at most SHARED_UNITS reach, by counts in steps of an eighth of a doubling; what each
        is worth, and (-1, 0) behind them for all others."""
        step = F.floor(F.log2("n") * 8)
        sizes = sorted(((r["step"], r["count"]) for r in worth.groupBy(step.alias("step")).count().collect()), reverse=True)
        room, least = SHARED_UNITS, None
        for own, count in sizes:
            room -= count
            if room < 0:
                break
            least = own
        chosen = worth.filter(step >= least) if least is not None else worth.limit(0)
        found = chosen.select("unit", "n_best", "count_sum").toArrow()
        units = found["unit"].cast(pa.large_string()).combine_chunks()
        values = np.column_stack([found[n].to_numpy() for n in ("n_best", "count_sum")]).astype(np.int64)
        return units, np.append(values, [[-1, 0]], axis=0)

    def texts(self) -> DataFrame:
        """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
        spark = self.docs.sparkSession
        worth = self.worth()
        shared = spark.sparkContext.broadcast(self._frequent(worth))
        long = T.LongType()
        kind = self.chunks.schema["id"].dataType
        shape = struct_type(
            row=long, id=kind, chunk=T.IntegerType(), n_chunks=T.IntegerType(), **_FRAGMENT, digest=T.StringType(), best=long, total=long, units=T.ArrayType(T.StringType())
        )
        names = ["row", "id", "chunk", "n_chunks", "n_a", "n_b", "n_groups", "closed", "prefix_a", "prefix_b", "suffix_a", "suffix_b", "groups", "digest", "best", "total", "units"]
        shape = T.StructType([shape[n] for n in names])
        put = self.chunks.mapInArrow(_put_together(self.files, shared, names, {f.name: to_arrow_type(f.dataType) for f in shape}), shape)
        parts = written(put, "alignment-texts")
        fragment = [*_FRAGMENT]
        long_ones = parts.filter("n_chunks > 1").select("row", "chunk", *fragment)
        most = parts.agg(F.max("n_chunks")).first()[0] or 1
        while most > 1:
            shape = struct_type(row=long, chunk=T.IntegerType(), **_FRAGMENT)
            long_ones = long_ones.groupBy("row", F.floor(F.col("chunk") / self.fan).alias("next")).applyInArrow(_tree(self.fan), shape)
            most = -(-most // self.fan)
        ended = long_ones.mapInArrow(_finished, "row long, n_a long, n_b long, n_groups long, digest string")
        short = parts.filter("n_chunks = 1").select("row", "n_a", "n_b", "n_groups", "digest")
        found = short.unionByName(ended)
        rare = parts.select("row", F.explode("units").alias("unit"))
        joined = rare.join(worth.select("unit", "n_best", "count_sum"), "unit")
        more = joined.select("row", F.col("n_best").alias("best"), F.col("count_sum").alias("total"))
        sums = parts.select("row", "best", "total").unionByName(more).groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
        ids = parts.filter("chunk = 0").select("row", "id")
        return ids.join(found, "row").join(sums, "row").select(
            "id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), "n_best", "count_sum", F.col("digest").alias("groups_sha256")
        )


def align(docs: DataFrame, a_file: str, b_file: str, pattern: str, id_column: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """One row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = Alignment(docs, a_file, b_file, pattern, id_column, text, **sizes).texts()
    return found.withColumnRenamed("id", id_column)
