"""Token-ID output in bit or byte planes.

A segment holds the ids of consecutive documents. Its ids are cut into blocks of a fixed
size; a block is transposed into byte planes (or bit planes), so that like bits lie side by side, and
each plane is compressed with zstandard. A footer holds the chunk index, by which a block can
be read alone, and the documents with their lengths::

    "IXPL" | planes of block 0 | planes of block 1 | ... | footer | footer size (u32) | "IXPL"

Spark stores segments as rows (part, segment, n_docs, n_ids, payload), committed by its own
writer, so a lost executor leaves no half-written file behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ixlake.llm.common import shared_root, slices
from ixlake.llm.tokens import END_ID, SLICE_BYTES, TOKENIZER, encoder

MAGIC = b"IXPL"
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
LEVEL = 3

_SEGMENTS = "part int, segment int, n_docs long, n_ids long, payload binary"


def _planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits(raw[:, k] >> b & 1, bitorder="little").tobytes() for k in range(4) for b in range(8)]


def _from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        one = np.frombuffer(plane, np.uint8)
        if bits:
            raw[:, k // 8] |= np.unpackbits(one, count=n, bitorder="little") << (k % 8)
        else:
            raw[:, k] = one
    return raw.reshape(-1).view("<u4")


def write_segment(
    doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: bool = False, block_ids: int = BLOCK_IDS
) -> bytes:
    """One segment of documents with their ids, in order."""
    pack = zstandard.ZstdCompressor(level=LEVEL)
    out, sizes, at = [MAGIC], [], len(MAGIC)
    for start in range(0, len(ids), block_ids):
        for plane in _planes(ids[start : start + block_ids], bits):
            packed = pack.compress(plane)
            sizes.append(len(packed))
            at += len(packed)
            out.append(packed)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    footer = struct.pack("<BIQQI", bits, block_ids, len(ids), len(doc_ids), len(sizes))
    footer += pack.compress(
        np.array(sizes, "<u4").tobytes() + known.tobytes() + numbers.tobytes() + counts.astype("<u8").tobytes()
    )
    return b"".join([*out, footer, struct.pack("<I", len(footer)), MAGIC])


class Segment:
    """A segment read back: documents, lengths, and ids by range."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC or payload[-4:] != MAGIC:
            raise ValueError("not a segment")
        self.payload = payload
        (size,) = struct.unpack("<I", payload[-8:-4])
        footer = payload[-8 - size : -8]
        head = struct.calcsize("<BIQQI")
        bits, self.block_ids, self.n_ids, n_docs, n_planes = struct.unpack("<BIQQI", footer[:head])
        self.bits = bool(bits)
        self.unpack = zstandard.ZstdDecompressor()
        rest = self.unpack.decompress(footer[head:])
        sizes = np.frombuffer(rest, "<u4", n_planes).astype(np.int64)
        at = 4 * n_planes
        known = np.frombuffer(rest, np.uint8, n_docs, at)
        numbers = np.frombuffer(rest, "<i8", n_docs, at + n_docs)
        self.counts = np.frombuffer(rest, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.doc_ids = [d if k else None for d, k in zip(numbers.tolist(), known.tolist(), strict=True)]
        self.ends = len(MAGIC) + np.cumsum(sizes)
        self.sizes = sizes

    def block(self, number: int) -> np.ndarray:
        """The ids of one block, reading its planes only."""
        each = 32 if self.bits else 4
        n = min(self.block_ids, self.n_ids - number * self.block_ids)
        planes = []
        for k in range(number * each, (number + 1) * each):
            end = int(self.ends[k])
            planes.append(self.unpack.decompress(self.payload[end - int(self.sizes[k]) : end]))
        return _from_planes(planes, n, self.bits)

    def ids(self) -> np.ndarray:
        blocks = -(-self.n_ids // self.block_ids)
        return np.concatenate([self.block(k) for k in range(blocks)]) if blocks else np.zeros(0, "<u4")


def _segments(tokenizer: str, end_id: int, bits: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        n_held = 0

        def flushed() -> pa.RecordBatch:
            nonlocal segment, n_held
            doc_ids = [d for x in held for d in x[0]]
            counts = np.concatenate([x[1] for x in held])
            ids = np.concatenate([x[2] for x in held])
            payload = write_segment(doc_ids, counts, ids, bits)
            row = [[part], [segment], [len(doc_ids)], [len(ids)], [payload]]
            held.clear()
            segment, n_held = segment + 1, 0
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, kinds, strict=True)],
                ["part", "segment", "n_docs", "n_ids", "payload"],
            )

        for batch in batches:
            for piece in slices(batch, limit=SLICE_BYTES):
                starts, ids = encoder(tokenizer, end_id).encode(piece.column("text"))
                doc_ids, first = piece.column("doc_id").to_pylist(), 0
                while first < len(doc_ids):
                    room = starts[first] + max(1, SEGMENT_IDS - n_held)
                    last = max(first + 1, int(np.searchsorted(starts, room, "right")) - 1)
                    held.append(
                        (doc_ids[first:last], np.diff(starts[first : last + 1]), ids[starts[first] : starts[last]].copy())
                    )
                    n_held += int(starts[last] - starts[first])
                    first = last
                    if n_held >= SEGMENT_IDS:
                        yield flushed()
        if held:
            yield flushed()

    return write


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, bits: bool = False
) -> None:
    """Write the ids of every row of (doc_id, text) in ascending doc_id order, null first.

    Rows with one doc_id lie together, in the order of a hash of their texts. A null or empty text has the end
    id only. No rows make a table without segments.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    ordered.mapInArrow(_segments(tokenizer, end_id, bits), _SEGMENTS).write.mode("overwrite").option(
        "compression", "none"
    ).option("parquet.block.size", 16 << 20).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            segment = Segment(payload)
            ids = memoryview(np.ascontiguousarray(segment.ids(), "<u4")).cast("B")
            ends = np.cumsum(segment.counts)
            starts = ends - segment.counts
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()),
                    pa.array([number] * n, pa.int32()),
                    pa.array(segment.doc_ids, pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(segment.counts, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document."""
    stored = spark.read.schema(_SEGMENTS).parquet(path)
    # Ids before a segment: those of earlier parts, of which there are as many as
    # shuffle partitions, and those of earlier segments of its part.
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    bases = (
        stored.select("part", "segment", earlier.alias("earlier"))
        .join(before, "part")
        .select("part", "segment", (F.col("before") + F.col("earlier")).alias("base"))
    )
    return (
        stored.select("part", "segment", "payload")
        .mapInArrow(_read, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")
        .join(bases, ["part", "segment"])
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def round_trip(docs: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """Write all documents, then read the stored segments back."""
    spark = docs.sparkSession
    path = path or f"{shared_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    return read_tokens(spark, path)
