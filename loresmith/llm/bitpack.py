"""Token ids in fixed-width bit fields, in binary shards that allow random access.

A shard is a run of blocks, then a footer with the byte offset of each block.
A block holds whole documents in ascending id order::

    b"TIB1"  bits u4  documents u4  ids u8         (little-endian throughout)
    id known u1[documents]   document id i8[documents]   ids of each u8[documents]
    fields: 64 ids make `bits` 64-bit words, the last group padded with zeros

The footer is ``offset u8[blocks]``, ``blocks u8`` and ``b"TIBF"``.  One byte
(a line feed) follows each block and the footer.  Id ``k`` of a block stands at
bit ``k * bits``, so one field can be read without the others.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import until_exit
from .staging import shared_folder, small, stage
from .textkernel import frugal
from .word_ids import word_ids

_HEAD = struct.Struct("<4sIIQ")
_TAIL = struct.Struct("<Q4s")
BLOCK_IDS = 1 << 16
#: Bytes of blocks after which a shard is closed.
SHARD_BYTES = 32 << 20


def width(vocabulary: int) -> int:
    """The least bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as fields of ``bits`` bits (1 to 32)."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    rows = -(-len(ids) // 64)
    lanes = np.zeros((rows, 64), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((rows, bits), np.uint64)
    for k in range(64):
        at, shift = divmod(k * bits, 64)
        out[:, at] |= lanes[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, at + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of :func:`pack`'s bytes."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        at, shift = divmod(k * bits, 64)
        field = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            field = field | (words[:, at + 1] << np.uint64(64 - shift))
        out[:, k] = field & mask
    return out.ravel()[:count]


def field(data: bytes, k: int, bits: int) -> int:
    """Id ``k`` alone."""
    group, lane = divmod(k, 64)
    bit = lane * bits
    base = group * bits * 8
    value = int.from_bytes(data[base + bit // 8 : base + (bit + bits + 7) // 8], "little")
    return value >> bit % 8 & (1 << bits) - 1


def block(known: list[bool], names: list[int], parts: list[np.ndarray], bits: int) -> bytes:
    lengths = np.array([len(x) for x in parts], "<u8")
    fields = pack(np.concatenate(parts), bits)
    return b"".join((_HEAD.pack(b"TIB1", bits, len(parts), int(lengths.sum())), np.array(known, np.uint8).tobytes(), np.array(names, "<i8").tobytes(), lengths.tobytes(), fields))


def footer(offsets: list[int]) -> bytes:
    return np.array(offsets, "<u8").tobytes() + _TAIL.pack(len(offsets), b"TIBF")


def block_offsets(shard: bytes) -> np.ndarray:
    if not shard:
        return np.zeros(0, np.uint64)
    count, magic = _TAIL.unpack_from(shard, len(shard) - 1 - _TAIL.size)
    if magic != b"TIBF":
        raise ValueError("not a token shard")
    return np.frombuffer(shard, "<u8", count, len(shard) - 1 - _TAIL.size - 8 * count)


def read_block(shard: bytes, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each document's id is known, the ids, the lengths, and the block's token ids."""
    magic, bits, documents, count = _HEAD.unpack_from(shard, offset)
    if magic != b"TIB1":
        raise ValueError(f"no block at byte {offset}")
    at = offset + _HEAD.size
    known = np.frombuffer(shard, np.uint8, documents, at)
    names = np.frombuffer(shard, "<i8", documents, at + documents)
    lengths = np.frombuffer(shard, "<u8", documents, at + 9 * documents)
    at += 17 * documents
    return known, names, lengths, unpack(shard[at : at + -(-count // 64) * bits * 8], count, bits)


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES) -> str:
    """Encode whole texts and write them in ascending id order; returns the folder (without one given, a shared one that goes with the application).

    Documents are dealt by ranges of their id, sorted, encoded and packed task by
    task; Spark's own writer commits the shards, so a task that is run again
    leaves no second copy and any store that Spark writes can hold them.  A
    shard is closed once its blocks come to ``shard_bytes``, whatever the number
    of tasks, so none is larger than that and one more block.  Null text counts
    as empty and gives the end id alone; null ids come first and stay null; rows
    with the same id stand side by side, ordered by text, and are dealt by the
    beginning of the text, so that many of them (null ids, say) are no one task.
    Other columns are ignored.  An empty table gives a folder without documents.
    """
    spark = docs.sparkSession
    target = folder or shared_folder(spark)

    @frugal
    def encode(batches):
        coder = word_ids(tokenizer)
        bits = width(coder.size)
        blocks, size = [], 0
        known, names, parts, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            at = np.r_[0, np.cumsum([len(x) + 1 for x in blocks])][:-1]
            return pa.RecordBatch.from_pydict({"value": pa.array([b"\n".join([*blocks, footer(at.tolist())])], pa.binary())})

        def close() -> int:
            blocks.append(block(known, names, parts, bits))
            for x in (known, names, parts):
                x.clear()
            return len(blocks[-1]) + 1

        for batch in batches:
            every = iter(batch.column(0).to_pylist())
            for ids, bounds in coder.encode(batch.column(1), end_id):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    name = next(every)
                    known.append(name is not None)
                    names.append(name or 0)
                    parts.append(ids[a:b])
                    held += b - a
                    if held >= block_ids:
                        size, held = size + close(), 0
                        if size >= shard_bytes:
                            yield shard()
                            blocks, size = [], 0
        if parts:
            close()
        if blocks:
            yield shard()

    order = F.col("id").asc_nulls_first()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(order, F.expr("left(text, 32)")).sortWithinPartitions(order, "text")
    # the text writer puts the bytes of a string down as they are, whatever they are; a row is a shard
    out = rows.mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
    out.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", "none").text(target)
    return target if folder else until_exit(spark, target)


def read_token_shards(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: the id, its shard, ``start`` over all shards, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit).

    Ids that were null or repeat are given as they were written; shards follow
    one another by task and by number within it; a folder without documents
    gives no rows.
    """

    @frugal
    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = content.as_py()
                before = 0
                for offset in block_offsets(shard).tolist():
                    known, names, lengths, ids = read_block(shard, offset)
                    ends = np.cumsum(lengths.astype(np.int64))
                    starts = ends - lengths.astype(np.int64)
                    data = ids.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(names), pa.string()), pa.array(names, pa.int64(), mask=known == 0), pa.array(starts + before, pa.int64()), pa.array(lengths.astype(np.int64)),
                        pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ], ["shard", id_col, "at", "n_tokens", "ids"])
                    before += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    told = lambda k: F.regexp_extract("path", r"part-(\d+)-[^/]*?(?:-c(\d+))?\.[^/]*$", k)
    name = F.concat_ws("-", F.lpad(told(1), 9, "0"), F.lpad(told(2), 9, "0"))
    totals_from = files.select(name.alias("shard"), "content").mapInArrow(_totals, "shard string, total long")
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals_from.select("shard", F.coalesce(before, F.lit(0)).alias("before"))  # one row per shard
    rows = files.select(name.alias("shard"), "content").mapInArrow(decode, f"shard string, {id_col} long, at long, n_tokens long, ids binary")
    return rows.join(small(stage(totals), 32), "shard").select(id_col, "shard", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def _totals(batches):
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = content.as_py()
            total = sum(_HEAD.unpack_from(shard, x)[3] for x in block_offsets(shard).tolist())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([name], pa.string()), "total": pa.array([total], pa.int64())})
