"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are worked on in slices of so many bytes, whatever a batch holds, so that the
# arrays derived from them stay small. A longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only a local master, as in tests, may
    leave it unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ixlake-shared-"))
    return context.getCheckpointDir().rstrip("/")


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, and the work before it is done once, although several steps
    read the result or executors are lost.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`saved` wrote and that nothing will read again.

    Whatever was made of them has to be written by now: a lost executor cannot make it anew.
    """
    for table in tables:
        path = getattr(table, "saved_path", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def with_least(rows: DataFrame, group: str, spread: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """``rows`` with ``name``, the least ``value`` of the row's group; null groups have none.

    A group of any size is dealt into ``parts`` by a hash of ``spread``, here and in the join.
    """
    salted = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    cells = salted.where(F.col(group).isNotNull()).groupBy(group, "__part").agg(F.min(value).alias("__own"))
    whole = cells.groupBy(group).agg(F.min("__own").alias(name))
    told = cells.select(group, "__part").join(whole, group)
    return salted.join(told, [group, "__part"], "left").drop("__part")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words of every text, between the six ASCII white space characters.

    Returns where each text's words begin in the flat array of all words, with the end as
    last entry, and that array. A null text has no words.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
    flat = pc.list_flatten(lists)
    flat = flat.filter(pc.not_equal(flat, ""))
    starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    return starts, flat


def coded(flat: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the strings of an array, and the distinct strings behind the codes."""
    encoded = flat.dictionary_encode()
    words = encoded.dictionary.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    first = int(ends[0]) if len(words) else 0
    raw = memoryview(words.buffers()[2])[first : int(ends[-1])].tobytes() if len(words) and ends[-1] > first else b""
    at = (ends - first).tolist()
    return encoded.indices.to_numpy(zero_copy_only=False), [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def hashed(flat: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings of an array; each distinct string is hashed once."""
    codes, distinct = coded(flat)
    if not distinct:
        return np.zeros(0, np.uint64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def windows(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and the text of each.

    A text with fewer words, but at least one, gives its whole sequence as one run.
    """
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(hashes)) - starts[owner]
    # A run's hash is a polynomial in the word hashes; equal runs of any text are equal.
    total = np.zeros(len(hashes), np.uint64)
    for step in range(width):
        shifted = np.zeros(len(hashes), np.uint64)
        shifted[: len(hashes) - step] = hashes[step:] if step else hashes
        inside = offset + step < counts[owner]
        total = np.where(inside, mixed(total + shifted + np.uint64(step + 1)), total)
    short = np.minimum(counts, width)
    full = offset + short[owner] <= counts[owner]
    return total[full], owner[full]
