"""Connected components, and links between rows that share a posting key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ixlake.llm.common import discard, saved

# Pivot rounds go on while more pairs than this share of the postings are open.
OPEN_SHARE = 1.0
# Up to this many pairs a posting are counted by their marks before a pivot round is taken.
JUDGED_SHARE = 500.0
ROUNDS = 3
FOREST_EDGES = 250_000  # edges of a task, with twice as many nodes at most
MOST_PIVOTS = 64  # pivots of a key in a round, however many ids share it


def _forest(held: int):
    """Edges (hi, lo) of a part to stars of its own components, ``held`` nodes at a time."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def flushed() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in list(up)]
            pairs = [(x, r) for x, r in pairs if x != r]
            up.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["hi", "lo"]
            )

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                if len(up) > held:
                    yield flushed()
        if up:
            yield flushed()

    return forest


def _are_stars(edges: DataFrame) -> bool:
    """Every hi has one lo, and no lo is a hi."""
    row = edges.agg(F.count("*").alias("n"), F.count_distinct("hi").alias("distinct")).first()
    if row["n"] != row["distinct"]:
        return False
    return edges.join(edges.select(F.col("lo").alias("hi")), "hi", "left_semi").isEmpty()


def components(edges: DataFrame, held: int = FOREST_EDGES) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its least node.

    Parts of the edges become stars of their own, in tasks. Then, in alternation, every
    node's larger neighbours move to its least neighbour and its smaller ones do, until all edges are
    stars. Each round is two aggregations with map-side minima and joins with them, so
    no node's neighbours are gathered.
    """
    given = saved(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")),
        "edges",
    )
    # As few parts as tasks can hold: the edges of one part need no further round.
    parts = -(-given.count() // held) or 1
    now = saved(given.repartition(parts).mapInArrow(_forest(2 * held), "hi long, lo long"), "stars")
    discard(given)
    while parts > 1 and not _are_stars(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(down, "hi")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .where(F.col("hi") != F.col("lo"))
            .unionByName(down.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        before, now = now, saved(small.mapInArrow(_forest(2 * held), "hi long, lo long"), "stars")
        discard(before)
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.unionByName(roots)


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("id"))
    return postings.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        *postings.columns, F.coalesce("component", "id").alias("label")
    )


def _open_pairs(labelled: DataFrame) -> int:
    """Pairs of ids of different labels that share a key, counted once a key."""
    by_label = labelled.groupBy("key", "label").agg(F.count("*").cast("double").alias("n"))
    by_key = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    row = by_key.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0)).alias("pairs")).first()
    return int(row["pairs"])


def shared_postings(postings: DataFrame) -> DataFrame:
    """Rows of (key, id, post), once each, of keys that two ids share, one of them with post set.

    Other columns, such as ``mark`` and ``weight``, are values of the id and go along.
    """
    groups = postings.groupBy("key").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.max("post").alias("any_post")
    )
    shared = groups.where((F.col("least") != F.col("most")) & F.col("any_post")).select("key")
    more = [F.first(c).alias(c) for c in postings.columns if c not in ("key", "id", "post")]
    return saved(postings.join(shared, "key").groupBy("key", "id").agg(F.max("post").alias("post"), *more), "postings")


def _pivots(labelled: DataFrame, turn: int) -> DataFrame:
    """A few ids of each key that has several labels: one, and more for large keys.

    Ids of more ``weight``, if there is one, come first, and others in each turn. One order for all keys, so
    a set of alike ids has the same pivots in most of its keys.
    """
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"))
        .where(F.col("least") != F.col("most"))
        .select("key", "n")
    )
    order = [F.col("weight").desc()] if "weight" in labelled.columns else []
    place = F.row_number().over(Window.partitionBy("key").orderBy(*order, F.xxhash64("id"), "id"))
    ranked = labelled.where("post").withColumn("place", place).where(F.col("place") <= MOST_PIVOTS * (turn + 1))
    each = F.greatest(F.lit(1), F.ceil(F.log2("n")) - 3)
    return ranked.join(open_keys, "key").where(
        (F.col("place") > turn * each) & (F.col("place") <= (turn + 1) * each)
    )


# Gives a column of one side of a join by its name.
Side = Callable[[str], Column]


def _met(one: DataFrame, other: DataFrame, alike: Callable[[Side, Side], Column] | None) -> DataFrame:
    """Pairs (a, b) of ids of one key with different labels that are alike."""
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
    if alike is not None:
        same = same & alike(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    return one.alias("x").join(other.alias("y"), same).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    )


def _first_shared(labelled: DataFrame) -> DataFrame:
    """The postings of keys with several labels, each with the id's smaller ones of these keys (``before``), and
    those of them that have post set (``posted``)."""
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("key")
    )
    rows = labelled.join(open_keys, "key", "left_semi")
    keys = rows.groupBy("id").agg(
        F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("post"), F.col("key"))).alias("own")
    )
    smaller = lambda name: F.filter(name, lambda k: k < F.col("key"))
    return rows.join(keys, "id").withColumns({"before": smaller("keys"), "posted": smaller("own")}).drop("keys", "own")


def _every(labelled: DataFrame, alike: Callable[[Side, Side], Column] | None, few_keys: bool) -> DataFrame:
    """All pairs of ids of one key with different labels that are alike.

    A pair is made once a key, and where ids have few keys at the smallest key only that the two share with post set in one
    of them: two ids of different labels share none but open keys, so this one is found with the smaller keys.
    """

    def made(one: Side, other: Side) -> Column:
        new = ~other("post") | (one("id") < other("id"))
        if alike is not None:
            new = new & alike(one, other)
        if not few_keys:
            return new
        shared = F.arrays_overlap(one("posted"), other("before")) | F.arrays_overlap(one("before"), other("posted"))
        return new & ~shared

    rows = _first_shared(labelled) if few_keys else labelled
    return _met(rows.where("post"), rows, made)


def _first_pivots(labelled: DataFrame) -> DataFrame:
    """(pivot, id) of the keys that still have several labels: what shares a key with its first pivot."""
    first = F.min(F.struct((-F.col("weight")).alias("less"), F.xxhash64("id").alias("turn"), "id"))
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), first.alias("first"))
        .where(F.col("least") != F.col("most"))
        .select("key", F.col("first.id").alias("pivot"))
    )
    return labelled.join(open_keys, "key").select("pivot", "id").distinct()


def _split(labelled: DataFrame, differ: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Postings of the ids in open keys under what sets them apart from the pivot.

    Of ``keep`` items of an id, rarest first, one is shared with each id that it may be linked to.
    """
    items = saved(differ(_first_pivots(labelled)), "items")
    held = saved(items.groupBy("pivot", "item").agg(F.count("*").alias("n")).where(F.col("n") > 1), "held")
    among = items.join(held, ["pivot", "item"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = Window.partitionBy("pivot", "id")
    prefix = (
        among.withColumn("place", F.row_number().over(own.orderBy("n", "item")))
        .withColumn("shared", F.sum((F.col("n") > 1).cast("long")).over(own))
        .where((F.col("place") <= F.col("keep")) & (F.col("n") > 1))
        .select(F.xxhash64("pivot", "item").alias("key"), "id", F.lit(True).alias("post"), "apart", "shared")
    )
    more = [c for c in labelled.columns if c not in ("key", "id", "post", "label", "apart", "shared")]
    values = labelled.groupBy("id").agg(*[F.first(c).alias(c) for c in more])
    out = shared_postings(prefix.join(values, "id"))
    discard(items, held)
    return out


def connect(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    alike: Callable[[Side, Side], Column] | None = None,
    sharp: bool = False,
    differ: Callable[[DataFrame], DataFrame] | None = None,
    few_keys: bool = False,
) -> DataFrame:
    """Components of the ids that ``verify`` links among those sharing a key.

    ``postings`` is what :func:`shared_postings` gives; a pair counts when one of its rows has post
    set. ``verify`` takes candidate pairs (a, b) and returns the linked ones. ``alike`` may say by other columns of
    two rows that their ids can't be linked; it is part of the join's condition, so such pairs are never made. ``sharp``
    says that it leaves few pairs, so that these are counted before a second round of pivots or a split. ``few_keys`` says that
    an id has a bounded number of keys; a pair is then made at the first key only that it shares with post set in one of the two.
    Returns (node, component) of linked ids.

    A key that many ids share isn't joined with itself at once. In each round a few pivots of a
    key meet the others; those linked get one label, and pairs inside a label need
    no test. When few pairs are left, all of them are tested, so no link between two labels
    is lost. The rounds change how many pairs are tested, never the components.

    ``differ`` takes (pivot, id) and returns (pivot, id, item, keep, apart): items in which an id differs from the
    pivot, such that two linked ids, one of which isn't linked to the pivot, share one of the first ``keep`` of each
    in any common order. Where many pairs are left after a round, ids are then posted under these items of their key's
    first pivot, so a family of alike ids without links falls apart. Every row needs ``post``, ``weight``, ``apart`` and
    ``shared``, the number of the id's items that another one has; ``alike`` reads the last two, and other columns
    stay as they are.
    """
    labels, stars = None, None
    tested: list[DataFrame] = []
    made: list[DataFrame] = []
    before, coarser, fresh = 0, None, False
    given = postings
    turn = 0
    while True:
        total = postings.count()
        labelled = saved(_labelled(postings, labels), "labelled")
        still_open = _open_pairs(labelled)
        if not still_open:
            break
        source = postings
        if fresh and still_open > before:
            discard(labelled)
            source = coarser
            labelled = saved(_labelled(source, labels), "labelled")
        every = _every(labelled, alike, few_keys and source is given)
        judged = still_open
        if sharp and turn and OPEN_SHARE * total < still_open <= JUDGED_SHARE * total:
            judged = every.count()
        few = judged <= OPEN_SHARE * total
        if differ is not None and turn and not few and not fresh:
            before, coarser, fresh = still_open, postings, True
            postings = _split(labelled, differ)
            made.append(postings)
            discard(labelled)
            continue
        # Splitting goes on as long as it halves what is open.
        stuck = turn == ROUNDS if differ is None else fresh and still_open > before / 2
        last = stuck or few
        met = every if last else _met(_pivots(labelled, turn if differ is None else 0), labelled, alike)
        met = met.distinct()
        if tested:
            # Written first: the join would otherwise be planned before the distinct, on the pairs of every key.
            found, known = saved(met, "found"), reduce(DataFrame.unionByName, tested)
            met = saved(found.join(known, ["a", "b"], "left_anti"), "pairs")
            discard(found)
        else:
            met = saved(met, "pairs")
        edges = verify(met).select("a", "b")
        if stars is not None:
            edges = edges.unionByName(stars)
        earlier, labels = labels, saved(components(edges), "labels")
        discard(labelled, earlier)
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        tested.append(met)
        if last:
            break
        fresh = False
        turn += 1
    discard(*tested, *made)
    if labels is None:
        return postings.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    return labels
