"""MinHash near-dedup by a signature-coordinate inverted join.

A document is posted under each (coordinate, value) of its signature. Two documents that reach
the match threshold T of m coordinates agree in at least one of the m - T + 1 rarest postings of
each, so only that prefix is met; postings of a single document are skipped. Candidates that share
a posting count their collisions over whole signatures, and those with T or more are
compared on their full shingle sets.

Documents with equal sets are one node from the start, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ixlake.llm.common import discard, hashed, saved, slices, split_words, windows, with_least
from ixlake.llm.links import Side, connect, shared_postings

COORDINATES = 20
MISS = 1e-6  # most chance that a pair at the similarity threshold stays below T
SEED = 7
MARKS = 4  # longs of 64 bits each


def match_threshold(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The largest T that a pair at the threshold reaches with all but ``miss`` chance."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: where they begin, and all of them."""
    starts, flat = split_words(texts, lower=True)
    found, owner = windows(hashed(flat), starts, width)
    n = len(starts) - 1
    ends = np.cumsum(np.bincount(owner, minlength=n))
    at = 0
    for end in ends.tolist():
        if end - at > 1:
            found[at:end].sort()
        at = end
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[first], owner[first]
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=out[1:])
    return out, found


def _set_ids(starts: np.ndarray, found: np.ndarray) -> list[int | None]:
    """A 64-bit name of each set, none for the empty set."""
    raw = memoryview(np.ascontiguousarray(found)).cast("B")
    return [
        xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b], seed=b - a) - (1 << 63) if b > a else None
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)
    ]


def signatures(starts: np.ndarray, found: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima of the shingles under each of the hash functions, 32 bits of each."""
    random = np.random.default_rng(SEED)
    factors = random.integers(1, 2**63, coordinates, np.uint64) | np.uint64(1)
    terms = random.integers(0, 2**63, coordinates, np.uint64)
    out = np.zeros((len(starts) - 1, coordinates), np.int32)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        for k in range(coordinates):
            least = np.minimum.reduceat(found * factors[k] + terms[k], starts[full])
            out[full, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _signed(width: int, coordinates: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                starts, found = shingle_sets(part.column("text"), width)
                signature = signatures(starts, found, coordinates)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(_set_ids(starts, found), pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(signature) + 1) * coordinates, pa.int32()), pa.array(signature.ravel())
                        ),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "set_id", "signature"],
                )

    return signed


def _full_sets(width: int):
    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                starts, found = shingle_sets(part.column("text"), width)
                raw = found.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_set_ids(starts, found), pa.int64()), pa.array(sets, pa.binary())], ["set_id", "shingles"]
                )

    return full_sets


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "shingles", 2 << 20):
            sizes = pc.binary_length(part.column("shingles")).to_numpy(zero_copy_only=False) // 8
            found = np.frombuffer(b"".join(part.column("shingles").to_pylist()), np.int64)
            ids = part.column("set_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(found)], ["id", "shingle"])


def _able(shingles: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, apart, shared, weight, slack) and the marks of the sets that can have a link at all.

    What a set shares with any other one is among its shingles that two of the sets hold. Where
    these are too few the set has no link, so the many loosely alike documents of a
    family are never compared with each other. ``apart`` and ``shared`` are for
    :func:`_can_be_near`, ``slack`` and the marks for :func:`_may_differ_little`; ``weight`` is the shared part, which
    is largest for the documents that the others were copied from.
    """
    sized = classes.select(F.col("set_id").alias("id"), F.col("n_shingles").alias("size"))
    common = shingles.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # Each shingle flips one bit of the marks.
    place = F.pmod(F.col("shingle"), F.lit(64 * MARKS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(shingle, {64 * MARKS}) % 64 AS int))")
    marks = [
        F.coalesce(F.bit_xor(F.when(F.floor(place / 64) == n, bit)), F.lit(0).cast("long")).alias(f"mark_{n}")
        for n in range(MARKS)
    ]
    shared = shingles.join(common, "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("shared"), *marks)
    return (
        shared.join(sized, "id")
        .where(100 * F.col("shared") >= percent * F.col("size"))
        .select(
            "id",
            _apart(F.col("size"), F.col("size"), percent).alias("apart"),
            "shared",
            (F.col("shared") / F.col("size")).alias("weight"),
            _apart(F.col("size"), F.col("size") - F.col("shared"), percent).alias("slack"),
            *[f"mark_{n}" for n in range(MARKS)],
        )
    )


def _apart(size, items, percent: int):
    """How far ``items`` of a set of ``size`` shingles are from the difference that a link allows.

    Sets x and y are linked when (100 + percent) * difference <= (100 - percent) * (x + y), and of all items of
    two sets those that both have are no difference: ``apart`` of both is at most 2 * (100 + percent) * common.
    """
    return (100 + percent) * items - (100 - percent) * size


def _can_be_near(one: Side, other: Side, percent: int) -> Column:
    """Whether two postings leave room for a link: no set has more in common with one than with all."""
    return one("apart") + other("apart") <= 2 * (100 + percent) * F.least(one("shared"), other("shared"))


def _may_differ_little(one: Side, other: Side, percent: int) -> Column:
    """Whether two sets may differ in as few shingles as a link allows.

    What no other set holds is a difference. Of the rest, a bit in which the marks differ stands for at least one
    shingle that only one of the two has, so no link is lost; the marks of a pair of many more differences say so.
    """
    bits = [F.bit_count(one(f"mark_{n}").bitwiseXOR(other(f"mark_{n}"))) for n in range(MARKS)]
    return one("slack") + other("slack") + (100 + percent) * reduce(Column.__add__, bits) <= 0


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column("one"), batch.column("other"))
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in columns)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def _differing(percent: int):
    """(pivot, id, item, keep, apart) of pairs of sets: the shingles that only one of the two holds.

    With c = (100 - percent) / (100 + percent), sets x and y are linked when they differ in at most c * (x + y)
    shingles. With dx and dy shingles apart from a pivot p they then share (dx + dy - c * (x + y)) / 2
    of these at least. Where y is not linked to p, dy > c * (y + p); where it is, dy - c * y >= -c * p.
    So every set shares at least ``shared`` of its own with each set that it may be linked to, if not
    both are linked to p, and one of any dx - shared + 1 of them is among those.
    """

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "other", 1 << 20):
                items, keep, slack = [], [], []
                for p, x in zip(part.column("one"), part.column("other"), strict=True):
                    p, x = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.uint64)
                    apart = np.setxor1d(p, x, assume_unique=True).view(np.int64)
                    most = (100 - percent) * (len(x) + len(p))
                    own = (100 + percent) * len(apart)
                    # Twice (100 + percent) the number that are shared at least, which is more than this.
                    over = own - most if own > most else own + (100 - percent) * (len(p) - len(x))
                    shared = max(0, over) // (2 * (100 + percent)) + 1
                    items.append(apart)
                    keep.append(max(0, len(apart) - shared + 1))
                    slack.append(_apart(len(x), len(apart), percent))
                sizes = [len(x) for x in items]
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("pivot").take(at), part.column("id").take(at),
                        pa.array(np.concatenate(items) if items else np.zeros(0, np.int64)),
                        pa.array(np.repeat(np.array(keep, np.int64), sizes)),
                        pa.array(np.repeat(np.array(slack, np.int64), sizes)),
                    ],
                    ["pivot", "id", "item", "keep", "apart"],
                )

    return differing


def _labelled(docs: DataFrame, width: int, percent: int, coordinates: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (set_id, doc_id, first, label) of every distinct set.

    ``first`` is the row that goes before all others of the set, as (no_id, doc_id, set_id, text_hash).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(
        rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            _signed(width, coordinates),
            "doc_id long, text_hash long, n_shingles long, set_id long, signature array<int>",
        ),
        "signatures",
    )
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_id", "text_hash")
    classes = saved(
        signed.where(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("doc_id"), F.min(first).alias("first"),
            F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
        ),
        "sets",
    )
    least = match_threshold(coordinates, percent)
    tokens = classes.select(F.col("set_id").alias("id"), F.posexplode("signature").alias("at", "value")).select(
        F.xxhash64("at", "value").alias("key"), "id"
    )
    held = tokens.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # Postings of one document come first in the order by rarity and meet nobody, so of k
    # shared postings the first k - T + 1 are the rest of the prefix. A document has at most m.
    rarest = F.array_sort(F.collect_list(F.struct("n", "key")))
    prefixes = saved(
        tokens.join(held, "key")
        .groupBy("id")
        .agg(rarest.alias("rarest"))
        .where(F.size("rarest") >= least)
        .select("id", F.explode(F.slice("rarest", F.lit(1), F.size("rarest") - least + 1)).alias("posting"))
        .select(F.col("posting.key").alias("key"), "id", F.lit(True).alias("post")),
        "prefixes",
    )
    sharing = shared_postings(prefixes)
    met = sharing.select("id").distinct()
    # Full sets only of documents that share a posting, made from their texts anew.
    needed = classes.join(met.withColumnRenamed("id", "set_id"), "set_id", "left_semi").select(
        F.col("doc_id").alias("doc")
    )
    sets = saved(
        rows.join(needed, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
        .select("text")
        .mapInArrow(_full_sets(width), "set_id long, shingles binary")
        .where(F.col("set_id").isNotNull()),
        "full-sets",
    )
    discard(sharing)
    shingles = saved(sets.dropDuplicates(["set_id"]).mapInArrow(_exploded, "id long, shingle long"), "shingles")
    postings = shared_postings(prefixes.join(_able(shingles, classes, percent), "id"))
    discard(shingles, prefixes)

    def verify(pairs: DataFrame) -> DataFrame:
        side = classes.select("set_id", "n_shingles", "signature")
        agree = F.aggregate(
            F.zip_with("s.signature", "t.signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x
        )
        near = (
            pairs.join(side.alias("s"), F.col("a") == F.col("s.set_id"))
            .join(side.alias("t"), F.col("b") == F.col("t.set_id"))
            .where(
                100 * F.least("s.n_shingles", "t.n_shingles") >= percent * F.greatest("s.n_shingles", "t.n_shingles")
            )
            .where(agree >= least)
            .select("a", "b")
        )
        # A repeated row gives its set twice, and then a link twice, which does no harm.
        return (
            near.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("one")), "a")
            .join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("other")), "b")
            .mapInArrow(_linked(percent), "a long, b long")
        )

    def differ(pairs: DataFrame) -> DataFrame:
        once = sets.dropDuplicates(["set_id"])
        return (
            pairs.join(once.select(F.col("set_id").alias("pivot"), F.col("shingles").alias("one")), "pivot")
            .join(once.select(F.col("set_id").alias("id"), F.col("shingles").alias("other")), "id")
            .select("pivot", "id", "one", "other")
            .mapInArrow(_differing(percent), "pivot long, id long, item long, keep long, apart long")
        )

    def alike(one: Side, other: Side) -> Column:
        return _can_be_near(one, other, percent) & _may_differ_little(one, other, percent)

    labels = connect(postings, verify, alike, sharp=True, differ=differ, few_keys=True)
    discard(postings, sets)
    return signed, classes.select("set_id", "doc_id", "first").join(labels, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "doc_id", "first", F.coalesce("component", "set_id").alias("label")
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES
) -> DataFrame:
    """Groups of near copies among the rows of (doc_id, text).

    Words are runs of characters other than ASCII white space, with A-Z lower-cased. A set holds the distinct
    runs of ``width`` words; fewer words are one run. Two rows are linked when
    100 * intersection >= percent * union. Returns doc_id, n_shingles, component_id (the
    least doc_id reachable by links, itself included) and kept (doc_id = component_id).

    A null text or one without words has an empty set and no links. Rows with one doc_id are all
    returned. A null id is never the least; where no row reachable has an id, component_id is null and
    kept is true. Empty input gives an empty result.
    """
    signed, named = _labelled(docs, width, percent, coordinates)
    of_set = with_least(named, "label", "set_id", "doc_id", "component_id").select("set_id", "component_id")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        signed.select("doc_id", "n_shingles", "set_id")
        .join(of_set, "set_id", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        )
    )


def without_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one of each group of near copies.

    Of a group the row stays that has the least id, null last, then the least set and text hash. Rows
    without words are no copies of each other. Rows equal in id and text are one.
    """
    signed, named = _labelled(docs, width, percent, COORDINATES)
    firsts = named.groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    wordless = signed.where(F.col("set_id").isNull()).select("doc_id", "text_hash").distinct()
    times = signed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    same = F.col("n.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("n.text_hash") == F.col("f.text_hash"))
    kept = saved(times.alias("n").join(firsts.unionByName(wordless).alias("f"), same).select("n.*"), "kept")
    this = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.text_hash"))
    joined = docs.alias("d").join(kept.alias("k"), this)
    names = [F.col(f"d.`{n}`").alias(n) for n in docs.columns]
    once = joined.where(F.col("k.copies") == 1).select(names)
    repeated = joined.where(F.col("k.copies") > 1).select(names).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)
