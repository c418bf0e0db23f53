"""Conversation prefix trie, rolled up in bands of depth.

Conversations that begin alike share the nodes of their first turns. A node is known by a
128-bit key of its path: the exclusive or of one hash a turn, taken of the turn and its place.
Such keys are summed along a conversation in parts, so no conversation has to fit a task.

Totals over subtrees are rolled up by bands of ``BAND`` depths. Every node adds its own values to
its ancestors inside its band only, so a row becomes ``BAND`` rows at most. What a band's topmost nodes
then hold is rolled up the same way, with one band root standing for a band, and the completed
totals of the band roots are added to the nodes of the band above. A trie of depth D takes
about log(D) / log(BAND) such rounds.

Only DataFrame functions touch turns; a hash over member lists is streamed in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ixlake.llm.common import saved

BAND = 8
CELL = 1024  # turns of a conversation in one window, a multiple of BAND
CROWDED = 4096  # distinct turns of a cell beyond which ties are ranked by parts of their hash
BLOCK = 20  # a conversation borrows from the first one of its block
BORROWED = 4  # it borrows fewer turns than this
CHUNK_BITS = 12
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ("k1", "k2")


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two hashes of (role, text), words and how often, once for equal rows."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.xxhash64(F.lit(1), role, text).alias("a"),
            F.xxhash64(F.lit(2), role, text).alias("b"),
            F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
        )
        .groupBy("conv_id", "turn", "a", "b")
        .agg(F.count("*").alias("n"), F.max("words").alias("words"))
    )


def _before(keys: list[str], order: list[Column | str]) -> Column:
    """Sum of n over the rows before a row, in ascending order with nulls first."""
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(rows), F.lit(0))


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 0), a, b, words: turns in their order, equal rows once each.

    The order is turn, null first, then the hashes. Turns are counted in cells of ``CELL`` turn
    numbers, and these along the conversation. A cell with many more rows than that has many rows with
    one turn number; there the rows are counted by turn and a part of the hash first.
    """
    # Turns without a number are a cell of their own, before the others.
    cell = F.coalesce(F.floor(F.col("turn") / F.lit(CELL)).cast("long"), F.lit(-(1 << 62)))
    celled = turns.withColumn("cell", cell)
    cells = celled.groupBy("conv_id", "cell").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    cells = cells.select("conv_id", "cell", "rows", _before(["conv_id"], ["cell"]).alias("first"))
    joined = celled.join(cells, ["conv_id", "cell"])
    plain = joined.where(F.col("rows") <= CROWDED).select(
        "conv_id", "a", "b", "words", "n", (F.col("first") + _before(["conv_id", "cell"], ["turn", "a", "b"])).alias("at")
    )
    part = ["conv_id", "cell", "turn", "part"]
    crowded = joined.where(F.col("rows") > CROWDED).withColumn("part", F.shiftright("a", 52))
    # At most CELL * 4096 parts a cell, whatever the input.
    parts = crowded.groupBy(*part).agg(F.sum("n").alias("n"))
    parts = parts.select(*part, _before(["conv_id", "cell"], ["turn", "part"]).alias("more"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in part]
    ranked = crowded.alias("c").join(parts.alias("p"), same).select("c.*", "p.more")
    ranked = ranked.select(
        "conv_id", "a", "b", "words", "n", (F.col("first") + F.col("more") + _before(part, ["a", "b"])).alias("at")
    )
    return plain.unionByName(ranked).select(
        "conv_id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at"), "a", "b", "words"
    )


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at, a, b, words, length: every conversation with its borrowed first turns.

    Conversation c takes its first h = crc32(c) % 4 turns from the first conversation of its block of 20,
    as many as that has, and goes on with its own after the first h. Each conversation also has a row
    with at = -1, which stands for the root.
    """
    placed = saved(placed_turns(turns), "placed")
    lengths = turns.groupBy("conv_id").agg(F.sum("n").alias("n"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    donor = F.col("conv_id") - F.col("conv_id") % BLOCK
    wanted = lengths.select(
        "conv_id", "n", donor.alias("donor"), F.when(F.col("conv_id") == donor, 0).otherwise(taken).cast("long").alias("h")
    )
    donors = lengths.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("donor"), F.col("n").alias("held"))
    got = F.least("h", F.coalesce("held", F.lit(0)))
    conversations = saved(
        wanted.join(donors, "donor", "left").select(
            "conv_id", "donor", "h", (got - F.col("h")).alias("shift"),
            (got + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        ),
        "conversations",
    )
    own = placed.join(conversations, "conv_id").where(F.col("at") >= F.col("h"))
    heads = placed.where((F.col("conv_id") % BLOCK == 0) & (F.col("at") < BORROWED - 1)).withColumnRenamed("conv_id", "donor")
    borrowed = heads.join(conversations, "donor").where(F.col("at") < F.col("h"))
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv_id", F.lit(-1).cast("long").alias("at"), zero.alias("a"), zero.alias("b"), zero.alias("words"), "length")
    return (
        own.select("conv_id", (F.col("at") + F.col("shift")).alias("at"), "a", "b", "words", "length")
        .unionByName(borrowed.select("conv_id", "at", "a", "b", "words", "length"))
        .unionByName(roots)
    )


def keyed_paths(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, the node's key k1, k2, its parent's p1, p2, words and last.

    ``last`` tells the node at which the conversation ends. The root's key is (0, 0).
    """
    depth = (F.col("at") + 1).alias("depth")
    own = [F.when(F.col("at") < 0, 0).otherwise(F.xxhash64("at", c)).cast("long").alias(e) for c, e in (("a", "e1"), ("b", "e2"))]
    rows = rebuilt.select(
        "conv_id", depth, F.floor((F.col("at") + 1) / F.lit(CELL)).cast("long").alias("cell"), *own, "words", "length"
    )
    # What the cells before a row's own add to its key; only long conversations have any.
    totals = (
        rows.where(F.col("length") >= CELL)
        .groupBy("conv_id", "cell")
        .agg(F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"))
    )
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "conv_id", "cell", F.bit_xor("e1").over(earlier).alias("c1"), F.bit_xor("e2").over(earlier).alias("c2")
    )
    so_far = Window.partitionBy("conv_id", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = rows.withColumns({"s1": F.bit_xor("e1").over(so_far), "s2": F.bit_xor("e2").over(so_far)})
    for k, s, c in (("k1", "s1", "c1"), ("k2", "s2", "c2")):
        keyed = keyed if c in keyed.columns else keyed.join(carried, ["conv_id", "cell"], "left")
        keyed = keyed.withColumn(k, F.col(s).bitwiseXOR(F.coalesce(c, F.lit(0).cast("long"))))
    return keyed.select(
        "conv_id", "depth", "k1", "k2",
        F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"),
        "words", (F.col("depth") == F.col("length")).alias("last"),
    )


def _with_ancestors(paths: DataFrame) -> DataFrame:
    """depth, k1, k2 of each node, ``up`` (its band's keys down to it) and ``above``.

    ``above`` has the keys of the band before along the path, for band roots.
    """
    key = F.struct(*_KEY)
    here = F.floor(F.col("depth") / F.lit(CELL)).cast("long")
    # The end of a cell is seen from the next one too, where a band root needs it.
    ends = F.col("depth") % CELL >= CELL - BAND
    cells = F.when(ends, F.array(here, here + 1)).otherwise(F.array(here))
    seen = paths.withColumn("cell", F.explode(cells))
    rows = Window.partitionBy("conv_id", "cell").orderBy("depth")
    up = F.collect_list(key).over(rows.rowsBetween(-(BAND - 1), 0))
    above = F.collect_list(key).over(rows.rowsBetween(-BAND, -1))
    inside = (F.col("depth") % BAND + 1).cast("int")
    return (
        seen.withColumns({"up": up, "above": above})
        .where((F.col("cell") == here) & F.col("first"))
        .select(
            "depth", *_KEY, F.slice("up", -inside, inside).alias("up"),
            F.when((F.col("depth") > 0) & (F.col("depth") % BAND == 0), F.col("above")).alias("above"),
        )
    )


def _sums(rows: DataFrame, keys: str, names: list[str]) -> DataFrame:
    exploded = rows.select(F.explode(keys).alias("key"), *names).select("key.*", *names)
    return exploded.groupBy(*_KEY).agg(*[F.sum(n).alias(n) for n in names])


def rolled_up(paths: DataFrame, values: DataFrame, deepest: int) -> DataFrame:
    """(k1, k2, sums): the values of every node added up over its subtree.

    ``paths`` has conv_id, depth (0, 1, ... along every conversation), k1, k2 and ``first``, set on one of the
    rows of each node. ``values`` has a row for each node with the columns to add up.
    """
    names = [c for c in values.columns if c not in _KEY]
    nodes = saved(_with_ancestors(paths), "ancestors")
    inside = saved(_sums(nodes.join(values, list(_KEY)), "up", names), "bands")
    if deepest < BAND:
        return inside
    tops = paths.where(F.col("depth") % BAND == 0).withColumn("depth", F.floor(F.col("depth") / F.lit(BAND)).cast("long"))
    completed = rolled_up(tops, inside, deepest // BAND)
    below = _sums(nodes.where(F.col("above").isNotNull()).join(completed, list(_KEY)), "above", names)
    both = inside.unionByName(below)
    return saved(both.groupBy(*_KEY).agg(*[F.sum(n).alias(n) for n in names]), "completed")


def _streamed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's sorted chunks, which stand one behind the other."""
    held, digest = None, None

    def row() -> pa.RecordBatch:
        columns = [pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "ends_sha256"])

    for batch in batches:
        keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)
        done: list[pa.RecordBatch] = []
        for key, text in zip(keys, batch.column("ids"), strict=True):
            if key == held:
                digest.update(b",")
            else:
                if held is not None:
                    done.append(row())
                held, digest = key, hashlib.sha256()
            digest.update(text.as_buffer())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if held is not None:
        yield row()


def ending_hashes(paths: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which a conversation ends.

    Ids are joined in chunks of 4096 consecutive numbers first. A node's chunks are
    hashed one after the other, so no list of members is ever held.
    """
    chunks = (
        paths.where("last")
        .groupBy(*_KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    )
    ordered = chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk")
    return ordered.select(*_KEY, "ids").mapInArrow(_streamed_hashes, "k1 long, k2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of rebuilt conversations.

    Reads conv_id, turn, role and text; a null role or text is an empty one. Turns go by turn, null
    first; those with equal numbers by a hash of role and text, and equal rows count as often as they
    stand. Rows without conv_id belong to no conversation and are left out. A conversation
    whose turns were all replaced by none is a member of the root only. Other columns are not read.
    Empty input gives an empty result.

    Returns conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.
    """
    turns = saved(hashed_turns(conversations), "turns")
    keyed = saved(keyed_paths(rebuilt_turns(turns)), "paths")
    nodes = keyed.groupBy(*_KEY).agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    nodes = saved(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, list(_KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    values = nodes.select(
        *_KEY,
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    # A node's path is read along its smallest member.
    smallest = nodes.select("conv_id", "depth", F.lit(True).alias("first"))
    paths = keyed.select("conv_id", "depth", *_KEY).join(smallest, ["conv_id", "depth"], "left")
    paths = saved(paths.withColumn("first", F.coalesce("first", F.lit(False))), "paths")
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    totals = rolled_up(paths, values, deepest)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    return (
        nodes.join(parents, ["p1", "p2"], "left")
        .join(totals, list(_KEY))
        .join(ending_hashes(keyed), list(_KEY), "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
