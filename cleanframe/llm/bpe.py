"""Byte-level BPE: a shuffle of distinct words, after which every text is put together from the ids of its words.

1. Texts are split into pre-tokens. A block of texts keeps its distinct words once, and each text as the positions of its
   pre-tokens in that list, so that what is shuffled later grows with distinct words and not with tokens.
2. The words of all blocks are exploded into buckets by hash; equal words meet, and each distinct word is encoded once.
3. The ids go back to the blocks, where the texts are reassembled by position. Blocks are written in buckets, so that only
   the ids move for that. Words keep their order inside a bucket on both ways, so their numbers stay with the block.
Decoding joins each id with the table of token bytes (one row for each id of the vocabulary) and joins the bytes.

Defined results: NULL and empty texts have no ids and decode to no bytes. Repeated rows are encoded one by one. Special
tokens are ordinary text. Ids may be of any type, repeat or be NULL; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from cleanframe.llm.common import bound_arrow_batches, bucketed, returning_memory, struct_type

#: Pre-tokens of a block: its words and positions are handled together in one task.
BLOCK = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of lowest rank, the first of several, until none is in the vocabulary."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    parts = [word[i : i + 1] for i in range(len(word))]
    after = list(range(1, len(parts))) + [-1]
    before = list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[j])))

    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two was merged meanwhile
        parts[i] += parts[j]
        parts[j] = b""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [ranks[p] for p in parts if p]


class Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _packed(numbers: array) -> bytes:
    """Low and high halves of 32-bit numbers apart, compressed: the high halves are mostly zero."""
    halves = np.frombuffer(numbers, np.uint32).view(np.uint16).reshape(-1, 2).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(halves).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    halves = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint16).reshape(2, -1)
    return np.ascontiguousarray(halves.T).view(np.uint32).ravel()


def _packed_words(words: list[bytes]) -> bytes:
    """Sorted words: their lengths and their bytes, compressed."""
    lengths = _packed(array("I", map(len, words)))
    return struct.pack("<I", len(lengths)) + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def _unpacked_words(data: bytes) -> list[bytes]:
    size = struct.unpack_from("<I", data)[0]
    lengths = _unpacked(data[4 : 4 + size])
    text = zstandard.ZstdDecompressor().decompress(data[4 + size :])
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _bucketed(numbers: dict[str, int], buckets: int) -> list[dict]:
    """The words of a block by bucket, sorted, with their numbers."""
    dealt: dict[int, list[tuple[bytes, int]]] = {}
    for word, number in numbers.items():
        data = word.encode()
        dealt.setdefault(zlib.crc32(data) % buckets, []).append((data, number))
    rows = []
    for bucket, own in dealt.items():
        own.sort()
        rows.append({"bucket": bucket, "words": _packed_words([w for w, _ in own]), "numbers": _packed(array("I", [n for _, n in own]))})
    return rows


def _blocks(pattern: str, size: int, buckets: int, id_type: pa.DataType):
    def run(batches):
        split = regex.compile(pattern)
        task, made = TaskContext.get().partitionId(), 0
        ids, counts, positions, numbers = [], [], array("I"), Numbers()

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 24) + made], pa.int64()),
                    pa.array([ids], pa.list_(id_type)),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([_packed(positions)], pa.binary()),
                    pa.array([_bucketed(numbers, buckets)], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("numbers", pa.binary())]))),
                ],
                ["block", "ids", "counts", "positions", "dealt"],
            )

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = split.findall(text) if text else []
                ids.append(key)
                counts.append(len(found))
                positions.extend(map(numbers.__getitem__, found))
                if len(positions) >= size or len(ids) >= size:
                    yield block()
                    made += 1
                    ids, counts, positions, numbers = [], [], array("I"), Numbers()
        if ids:
            yield block()

    return returning_memory(run)


def _encoded(ranks):
    """Rows (bucket, block, words) sorted by bucket to the dictionaries of their blocks: lengths and ids, in the order of the
    words. The words of one bucket are held at a time, each encoded once."""

    def run(batches):
        table, at, known = ranks.value, None, {}
        for batch in batches:
            for bucket, block, words in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if bucket != at:
                    at, known = bucket, {}
                lengths, ids = array("I"), array("I")
                for word in _unpacked_words(words):
                    own = known.get(word)
                    if own is None:
                        own = known[word] = encode_word(word, table)
                    lengths.append(len(own))
                    ids.extend(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (_packed(lengths), _packed(ids)))],
                    ["block", "bucket", "lengths", "ids"],
                )

    return returning_memory(run)


def _ragged(lengths: np.ndarray, values: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists `take` of the lists given by lengths and values: offsets and values."""
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(values))
    taken = lists.take(pa.array(take))
    return np.asarray(taken.offsets), np.asarray(taken.values)


def _texts(out: pa.Schema):
    """Puts the texts of a block together from its positions and its dictionary."""

    def run(key, blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        order, lengths, values, numbers = [], [], [], {}
        for row in blocks.select(["bucket", "numbers"]).to_pylist():
            numbers.update(zip(row["bucket"], row["numbers"]))
        for row in chunks.select(["bucket", "lengths", "ids"]).to_pylist():
            order.append(_unpacked(numbers[row["bucket"]]))
            lengths.append(_unpacked(row["lengths"]))
            values.append(_unpacked(row["ids"]))
        joined = lambda x: np.concatenate(x) if x else np.empty(0, np.uint32)
        order, lengths, values = joined(order), joined(lengths), joined(values).astype(np.int32)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        results = []
        for row in blocks.select(["ids", "counts", "positions"]).to_pylist():
            positions = _unpacked(row["positions"])
            offsets, ids = _ragged(lengths, values, place[positions])
            ends = np.concatenate([[0], np.cumsum(row["counts"])]).astype(np.int64)
            bounds = offsets[ends] if len(positions) else np.zeros(len(ends), np.int64)
            # Slices of a block's ids, so that list offsets stay within 32 bits in every table.
            results.append(
                pa.table([pa.array(row["ids"], out.field(0).type), pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(ids[bounds[0] : bounds[-1]], pa.int32()))], names=out.names)
            )
        return pa.concat_tables(results) if results else out.empty_table()

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text: str = "text", block: int = BLOCK, buckets: int = 0) -> DataFrame:
    """(id, ids): the token ids of every whole text. Words are dealt to `buckets`, by default four for each shuffle
    partition; a task holds the distinct words of one bucket."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    bound_arrow_batches(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))  # fixed size: a row for each token
    kind = docs.schema[id_column].dataType
    dealt = struct_type(bucket=T.IntegerType(), words=T.BinaryType(), numbers=T.BinaryType())
    shape = struct_type(
        block=T.LongType(), ids=T.ArrayType(kind), counts=T.ArrayType(T.LongType()), positions=T.BinaryType(), dealt=T.ArrayType(dealt)
    )
    own = docs.select(F.col(id_column), F.col(text))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(own.mapInArrow(_blocks(pattern, block, buckets, to_arrow_type(kind)), shape), "block", tasks, "bpe-blocks")
    words = blocks.select("block", F.explode(F.arrays_zip("dealt.bucket", "dealt.words")).alias("own")).select("own.bucket", "block", "own.words")
    dealt = words.repartition("bucket").sortWithinPartitions("bucket")
    chunks = dealt.mapInArrow(_encoded(ranks), struct_type(block=T.LongType(), bucket=T.IntegerType(), lengths=T.BinaryType(), ids=T.BinaryType()))
    out = T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow = pa.schema([pa.field(id_column, to_arrow_type(kind)), pa.field("ids", pa.list_(pa.int32()))])
    left = blocks.select("block", "ids", "counts", "positions", "dealt.bucket", "dealt.numbers").groupBy("block")
    return left.cogroup(chunks.groupBy("block")).applyInArrow(_texts(arrow), out)


def _decoded(table, names: list[str]):
    def run(batches):
        tokens = pa.array(table.value, pa.large_binary())
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column(1)
                offsets = np.asarray(ids.offsets)
                flat = ids.values.slice(offsets[0], offsets[-1] - offsets[0])
                taken = tokens.take(flat)
                ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
                data = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] is not None else b""
                bounds = ends[offsets - offsets[0]]
                numbers = np.asarray(flat).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([numbers[a:b].tobytes() for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0])], pa.binary()),
                        pa.array([data[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    names,
                )

    return returning_memory(run)


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, ids_bytes, decoded): ids as little-endian unsigned 32-bit integers, and the bytes of the text."""
    ranks = load_ranks(vocabulary)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    out = T.StructType([encoded.schema[id_column], encoded.schema["ids"], T.StructField("ids_bytes", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return encoded.select(id_column, "ids").mapInArrow(_decoded(shared, out.names), out)
