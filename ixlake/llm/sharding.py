"""Sharding by fixed virtual slots.

Every record hashes into one of thousands of slots, for good. A small table maps slots to
shards. Rebalancing edits that table, never the hash: whole slots move from the fullest
shard to the emptiest one, and each edit is stored as a new version.

Records with equal texts share a slot, so that copies meet in one shard. A text whose copies
weigh more than a slot may, or are more rows, is dealt by its records over as many slots as needed.

Only DataFrame functions touch records. The driver sees one row per slot and shard.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_right, insort

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ixlake.llm.common import saved, shared_root

SLOTS = 4096
OVERHEAD = 16  # bytes a record takes besides its text
PART_OF_SHARD = 8  # copies of one text may fill this fraction of a shard in one slot
TOLERANCE = 0.002  # rebalancing stops when the fullest shard is so little above the mean


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def with_slots(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of every row of (doc_id, text).

    A null text is an empty one. Rows of a text that is dealt over several slots go by id and row number, so
    null and repeated ids spread like any others. Repeated rows are records of their own.
    Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        record_size().alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(slots)).alias("text_key"),
        # Taken before the table is written, and read from it ever after.
        F.monotonically_increasing_id().alias("row"),
    )
    rows = saved(rows, "slots")
    by_text = rows.groupBy("text_key").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("group_rows"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    most_bytes, most_rows = (max(1, total[c] // (shards * PART_OF_SHARD)) for c in ("bytes", "rows"))
    parts = F.greatest(
        F.ceil(F.col("group_bytes") / F.lit(most_bytes)), F.ceil(F.col("group_rows") / F.lit(most_rows))
    ).cast("long")
    heavy = (F.col("group_bytes") > most_bytes) | (F.col("group_rows") > most_rows)
    # At most twice shards * PART_OF_SHARD texts can be as heavy as this, whatever the input.
    heavy = by_text.where((F.col("group_rows") > 1) & heavy).select("text_key", parts.alias("parts"))
    dealt = rows.join(F.broadcast(heavy), "text_key", "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")))
    slot = F.pmod(F.xxhash64("text_key", part.cast("long")), F.lit(slots)).cast("int")
    return dealt.select("doc_id", "size", "text_crc32", slot.alias("vslot"))


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt in turn, without looking at any record."""
    return [slot % shards for slot in range(slots)]


def rebalanced(slot_bytes: list[int], slot_map: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map after moving slots from the fullest shard to the emptiest.

    Each move takes the slot that comes nearest to half of the difference of the two, so
    it lessens the difference. It ends when the fullest shard is within ``tolerance`` of
    the mean or no single move helps.
    """
    edited = list(slot_map)
    loads = [0] * shards
    inside: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(edited):
        loads[shard] += slot_bytes[slot]
        insort(inside[shard], (slot_bytes[slot], slot))
    mean = sum(loads) / shards
    stuck: set[int] = set()
    for _ in range(20 * len(edited)):
        fullest = max((s for s in range(shards) if s not in stuck), key=loads.__getitem__, default=None)
        if fullest is None or loads[fullest] <= mean * (1 + tolerance):
            break
        emptiest = min(range(shards), key=loads.__getitem__)
        gap = loads[fullest] - loads[emptiest]
        at = bisect_right(inside[fullest], (gap // 2, len(edited)))
        choices = [x for x in inside[fullest][max(0, at - 1) : at + 1] if 0 < x[0] < gap]
        if not choices:
            stuck.add(fullest)
            continue
        moved = min(choices, key=lambda x: abs(x[0] - gap / 2))
        inside[fullest].remove(moved)
        insort(inside[emptiest], moved)
        edited[moved[1]] = emptiest
        loads[fullest] -= moved[0]
        loads[emptiest] += moved[0]
        stuck.discard(emptiest)
    return edited


def grown(slot_bytes: list[int], slot_map: list[int], shards: int) -> list[int]:
    """The map for one more shard, which takes slots from the fullest and gives none."""
    edited = list(slot_map)
    inside: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(edited):
        inside[shard].append((slot_bytes[slot], slot))
    heap = [(-sum(b for b, _ in own), shard) for shard, own in enumerate(inside)]
    heapq.heapify(heap)
    mean, load = sum(slot_bytes) / (shards + 1), 0
    while heap and load < mean:
        full, shard = heapq.heappop(heap)
        fits = [x for x in inside[shard] if 0 < x[0] <= mean - load]
        if not fits:
            continue
        moved = min(fits)
        inside[shard].remove(moved)
        edited[moved[1]] = shards
        load += moved[0]
        heapq.heappush(heap, (full + moved[0], shard))
    return edited


def _shard(slot_map: list[int]) -> Column:
    """The shard of a row's slot, by an array literal of one number a slot."""
    listed = F.split(F.lit(",".join(map(str, slot_map))), ",").cast("array<int>")
    return F.element_at(listed, F.col("vslot") + 1)


def _store(per_slot: DataFrame, slot_map: list[int], version: int, path: str) -> None:
    """Add a version to the stored map: vslot, shard and the slot's bytes and rows.

    Each version is a folder that is written once. Of two edits at the same time the later one fails.
    """
    rows = per_slot.select("vslot", _shard(slot_map).alias("shard"), "bytes", "rows")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str) -> DataFrame | None:
    """version, vslot, shard, bytes and rows of every version, or None where none is stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _latest(stored: DataFrame | None) -> tuple[int, list[int]]:
    """Number and slots of the newest version; 0 and no slots where there is none."""
    version = None if stored is None else stored.agg(F.max("version")).first()[0]
    if version is None:
        return 0, []
    rows = stored.where(F.col("version") == version).select("vslot", "shard").collect()  # one row a slot
    return version, [shard for _, shard in sorted(map(tuple, rows))]


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row's shard, and its place there, with shards near equal in bytes.

    Returns doc_id, size, text_crc32, law, shard, slot (the row's place in its shard,
    gapless from 0), grown_shard (null), vslot and map_version.

    The map stored at ``map_path`` is read; where it has fewer shards, new ones take slots from the fullest
    first. It is then rebalanced for these rows and stored as one more version, and older versions stay.
    Where none is stored, slots are dealt in turn as version 1. Without a path a new one is taken in
    the shared folder. Empty input gives an empty result; a slot without
    records stays where it was. A single record larger than a shard's share
    makes its shard larger, since records are never cut.
    """
    spark = docs.sparkSession
    rows = saved(with_slots(docs, shards, slots), "slotted")
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    per_slot = (
        spark.range(0, slots, 1, 8)
        .select(F.col("id").cast("int").alias("vslot"))
        .join(F.broadcast(found), "vslot", "left")
        .select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))
    )
    per_slot = saved(per_slot, "slot-bytes")
    slot_bytes, slot_rows = [0] * slots, [0] * slots
    for row in per_slot.toLocalIterator():  # one row a slot
        slot_bytes[row["vslot"]], slot_rows[row["vslot"]] = row["bytes"], row["rows"]
    path = map_path or f"{shared_root(spark)}/slot-map-{uuid.uuid4().hex}"
    version, latest = _latest(stored_map(spark, path))
    if not latest:
        version, latest = 1, first_map(slots, shards)
        _store(per_slot, latest, version, path)
    if len(latest) != slots or max(latest) >= shards:
        raise ValueError(f"the map at {path} has {len(latest)} slots and {max(latest) + 1} shards")
    for have in range(max(latest) + 1, shards):
        latest = grown(slot_bytes, latest, have)
    latest = rebalanced(slot_bytes, latest, shards)
    version += 1
    _store(per_slot, latest, version, path)
    before, offsets = [0] * shards, [0] * slots
    for slot in range(slots):
        offsets[slot] = before[latest[slot]]
        before[latest[slot]] += slot_rows[slot]
    first = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>")
    # Ranks are taken inside a slot, of which there are thousands, and shifted by the
    # rows of the slots before it in the shard.
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        _shard(latest).alias("shard"),
        (F.element_at(first, F.col("vslot") + 1) + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.lit(version).alias("map_version"),
    )
