"""Token-id files: patched frame-of-reference blocks, written in id order and read back.

A segment holds whole documents one after another, each with an end id. Its ids are cut into blocks of 128. A block
keeps its minimum, a bit width chosen so that a given share of its differences fits, those differences packed at that
width, and an exception list of (place, full difference) for the outliers; an index of block starts lets a reader
unpack one block alone. Segments are rows of a Parquet data set in the shared folder, so a write commits or fails as a
whole and a lost executor costs one task.

Edge cases: a null text is empty and holds the end id alone; a null id comes first; rows of equal ids are ordered by
their texts, and equal rows are interchangeable; an empty table gives an empty file set. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwise.llm.common import by_bytes, short_batches, slices, text_of, written
from headwise.llm.tokens import library_tokens

BLOCK = 128
#: Share of a block's differences that must fit the packed width; the rest are exceptions.
FITTING = 0.9
#: Ids of a segment, unless one document alone is longer.
SEGMENT = 1 << 16
#: Bytes of text that are tokenized at a time.
AT_ONCE = 1 << 21

_HEAD = struct.Struct("<4sIII")  # name, ids, blocks, exceptions
_MAGIC = b"PFR1"


def pack(ids: np.ndarray) -> bytes:
    """Encode ids (unsigned 32-bit) as patched frame-of-reference blocks.

    Layout: head; for each block its minimum (u32), width (u8), number of exceptions (u8), start of its packed bits
    (u32); places (u8) and differences (u32) of all exceptions; packed bits, block after block.
    """
    ids = np.asarray(ids, dtype=np.uint32)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return _HEAD.pack(_MAGIC, 0, 0, 0)
    padded = np.full(blocks * BLOCK, ids[-1], dtype=np.uint32)
    padded[:n] = ids
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    above = grid - low[:, None]
    kept = np.partition(above, int(np.ceil(FITTING * BLOCK)) - 1, axis=1)[:, int(np.ceil(FITTING * BLOCK)) - 1]
    width = np.frexp(kept.astype(np.float64))[1].astype(np.uint8)  # bits of the percentile
    outlier = above >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    row, place = np.nonzero(outlier)
    extra = above[row, place]
    above[row, place] = 0
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        if not w:
            continue
        of = np.nonzero(width == w)[0]
        bits = np.unpackbits(above[of].astype("<u4").view(np.uint8).reshape(len(of), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(of), -1), axis=1, bitorder="little")
        for i, b in zip(of, packed, strict=True):
            parts[i] = b.tobytes()
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype("<u4")
    return b"".join([
        _HEAD.pack(_MAGIC, n, blocks, len(row)),
        low.astype("<u4").tobytes(),
        width.tobytes(),
        np.bincount(row, minlength=blocks).astype(np.uint8).tobytes(),
        starts.tobytes(),
        place.astype(np.uint8).tobytes(),
        extra.astype("<u4").tobytes(),
        *parts,
    ])


class Reader:
    """Random access to the ids of one packed segment."""

    def __init__(self, data: bytes):
        magic, self.n, self.blocks, exceptions = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.low = np.frombuffer(data, "<u4", self.blocks, at)
        self.width = np.frombuffer(data, np.uint8, self.blocks, at := at + 4 * self.blocks)
        self.count = np.frombuffer(data, np.uint8, self.blocks, at := at + self.blocks)
        self.starts = np.frombuffer(data, "<u4", self.blocks, at := at + self.blocks)
        self.place = np.frombuffer(data, np.uint8, exceptions, at := at + 4 * self.blocks)
        self.extra = np.frombuffer(data, "<u4", exceptions, at := at + exceptions)
        self.first = np.concatenate(([0], np.cumsum(self.count, dtype=np.int64)))
        self.bits = np.frombuffer(data, np.uint8, offset=at + 4 * exceptions)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop, unpacking only the blocks they lie in."""
        stop = self.n if stop is None else stop
        if stop <= start:
            return np.empty(0, dtype=np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        grid = np.repeat(self.low[a:b, None], BLOCK, axis=1).astype(np.uint32)
        for w in np.unique(self.width[a:b]):
            if not w:
                continue
            of = np.nonzero(self.width[a:b] == w)[0]
            size = BLOCK * int(w) // 8
            packed = self.bits[self.starts[a:b][of].astype(np.int64)[:, None] + np.arange(size)]
            bits = np.zeros((len(of), BLOCK, 32), dtype=np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(of), BLOCK, int(w))
            grid[of] += np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
        lo, hi = self.first[a], self.first[b]
        row = np.repeat(np.arange(b - a), self.count[a:b])
        grid[row, self.place[lo:hi]] += self.extra[lo:hi]
        return grid.reshape(-1)[start - a * BLOCK : stop - a * BLOCK]


_SEGMENTS = "part int, segment int, first_id long, n_ids long, docs array<struct<doc_id:bigint,n_tokens:bigint>>, data binary"


def write(df: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize and write all texts in ascending id order; ``first_id`` counts the ids before a segment in its part."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = library_tokens(vocabulary), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        segment, first, docs, held, n = 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            data = pack(np.frombuffer(b"".join(held), "<u4"))
            docs_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([n], pa.int64()),
                    pa.array([docs], docs_type),
                    pa.array([data], pa.binary()),
                ],
                names=["part", "segment", "first_id", "n_ids", "docs", "data"],
            )

        for batch in by_bytes(batches, "text", AT_ONCE):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(batch.column("text"), end).to_pylist(), strict=True):
                size = len(ids) // 4
                if n and n + size > SEGMENT:
                    yield row()
                    segment, first, docs, held, n = segment + 1, first + n, [], [], 0
                docs.append({"doc_id": doc_id, "n_tokens": size})
                held.append(ids)
                n += size
        if n:
            yield row()

    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    with short_batches(df.sparkSession):
        ordered.mapInArrow(segments, _SEGMENTS).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a file set: id, ids of all documents before it, number of ids, and the ids as binary (u32)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                ids = Reader(row["data"]).read().astype("<u4", copy=False)
                lengths = np.array([d["n_tokens"] for d in row["docs"]], dtype=np.int64)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d["doc_id"] for d in row["docs"]], pa.int64()),
                        pa.array([row["part"]] * len(ends), pa.int32()),
                        pa.array(row["first_id"] + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([ids[e - k : e].tobytes() for e, k in zip(ends, lengths, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "part", "in_part", "n_tokens", "ids"],
                )

    files = spark.read.schema(_SEGMENTS).parquet(folder)
    # One row for each part that was written, however long the parts are.
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = written(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "token-parts")
    found = files.mapInArrow(documents, "doc_id long, part int, in_part long, n_tokens long, ids binary")
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids")
