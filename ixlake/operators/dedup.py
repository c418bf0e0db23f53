"""Keyed and time-limited duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ixlake import constants as K
from ixlake.functions.text import micros
from ixlake.session import durable


def insert_ignore(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First write per key wins, first by ``order``.

    ``row_number() = 1`` is planned with a partial group limit before the exchange: a task
    ships at most one row per key, however many copies a key has.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def insert_new(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``existing`` yet; only the key columns of it are read."""
    return df.join(existing.select(*keys), keys, "left_anti")


def ttl_checks(keys: list[str], ts: str) -> dict[str, Column]:
    """Checks that reject rows without a key or a time, for ``split_quarantine``."""
    return {f"missing_{name}": F.col(name).isNotNull() for name in (*keys, ts)}


def _periods(cells: DataFrame, keys: list[str], ttl: int, split: bool) -> DataFrame:
    """(keys, cell, n, period): a key's time cells numbered by the quiet times before them.

    After a time of at least ``ttl`` without any row the next row is accepted whatever came
    before, so the rule can start anew there. Borders of the cells, one ``ttl`` wide, tell
    where; a key has one row per cell here.
    """
    if not split:
        return cells.withColumn("_period", F.lit(0).cast("bigint"))
    inside = Window.partitionBy(*keys).orderBy("_cell")
    fresh = F.col("low") - F.lag("high").over(inside) >= ttl
    return cells.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int")).select(
        *keys, "_cell", "n", F.sum("_fresh").over(inside).alias("_period")
    )


def _accepting(names: list[str], groups: list[str], ttl: int):
    """Pass over sorted rows that keeps one number: the time of the last accepted row."""

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[object] | None = None
        last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column("_t").to_pylist()
            columns = [batch.column(g) for g in groups]
            starts = np.ones(batch.num_rows, bool)
            starts[0] = held is None or held != [c[0].as_py() for c in columns]
            if batch.num_rows > 1:
                changed = np.zeros(batch.num_rows - 1, bool)
                for c in columns:
                    changed |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
                starts[1:] = changed
            kept = []
            for at, (t, start) in enumerate(zip(times, starts.tolist(), strict=True)):
                if start or t - last >= ttl:
                    kept.append(at)
                    last = t
            held = [c[batch.num_rows - 1].as_py() for c in columns]
            yield batch.select(names).take(pa.array(kept, pa.int64()))

    return accept


class _Transfer:
    """The TTL rule of long periods by transfer functions.

    A period is cut into cells one TTL wide, so a cell accepts one row at most. What it accepts depends
    on one thing only, the time accepted in the cell before it (or that there is none): the
    first row at least a TTL later. This map has a row for each time that the cell before may hand over.
    Maps of neighbouring blocks of cells are composed, two at a time, until one block is left; a composed map
    has the entries of its first cell only, so each round has half as many rows. From the top down every
    block is then told what really enters it, and each cell gives its accepted time. Rows of one period are never in one
    task, and log2(cells) rounds are taken each way.
    """

    NONE = -(1 << 62)  # nothing was accepted in the cell before; no time is so early

    def __init__(self, groups: list[str], ttl: int):
        self.groups = groups
        self.ttl = ttl

    def first_maps(self, times: DataFrame) -> DataFrame:
        """(groups, block, entry, exit): of each cell, from what enters it to what it accepts."""
        rows = times.select(*self.groups, F.col("_cell").alias("block"), F.col("_t").alias("at"), F.lit(True).alias("row"))
        entries = times.select(
            *self.groups, (F.col("_cell") + 1).alias("block"), (F.col("_t") + self.ttl).alias("at"), F.lit(False).alias("row")
        )
        # Latest first, and rows before entries of the same time: the last row seen is the first one
        # that an entry accepts.
        later = Window.partitionBy(*self.groups, "block").orderBy(F.col("at").desc(), F.col("row").desc())
        later = later.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        accepted = F.last(F.when(F.col("row"), F.col("at")), ignorenulls=True).over(later)
        entering = (
            rows.unionByName(entries)
            .withColumn("exit", F.coalesce(accepted, F.lit(self.NONE)))
            .filter(~F.col("row"))
            .select(*self.groups, "block", (F.col("at") - self.ttl).alias("entry"), "exit")
        )
        empty = rows.groupBy(*self.groups, "block").agg(F.min("at").alias("exit"))
        # Only cells with rows have a map.
        entering = entering.join(empty.select(*self.groups, "block"), [*self.groups, "block"], "left_semi")
        return entering.unionByName(empty.select(*self.groups, "block", F.lit(self.NONE).alias("entry"), "exit"))

    def looked_up(self, asked: DataFrame, entry: str, maps: DataFrame) -> DataFrame:
        """``asked`` with ``found``: what ``maps`` of its (groups, block) make of ``entry``.

        A block without a map has no rows and accepts nothing. An entry that a map doesn't have
        was accepted earlier than in the cell before it, which counts as none.
        """
        on = [*self.groups, "block"]
        exact = maps.select(*on, F.col("entry").alias(entry), F.col("exit").alias("_exact"))
        none = maps.filter(F.col("entry") == self.NONE).select(*on, F.col("exit").alias("_none"))
        joined = asked.join(exact, [*on, entry], "left").join(none, on, "left")
        return joined.withColumn("found", F.coalesce("_exact", "_none", F.lit(self.NONE))).drop("_exact", "_none")

    def composed(self, maps: DataFrame) -> DataFrame:
        """Maps of twice as many cells: the odd block's map after the even block's."""
        even = maps.filter("block % 2 = 0")
        odd = maps.filter("block % 2 = 1")
        # Where the even block has no rows, nothing is handed over.
        lonely = odd.filter(F.col("entry") == self.NONE).select(*self.groups, (F.col("block") - 1).alias("block"))
        lonely = lonely.join(even.select(*self.groups, "block"), [*self.groups, "block"], "left_anti").select(
            *self.groups, "block", F.lit(self.NONE).alias("entry"), F.lit(self.NONE).alias("exit")
        )
        asked = even.unionByName(lonely).withColumn("block", F.col("block") + 1)
        return self.looked_up(asked, "exit", odd).select(
            *self.groups, F.expr("block DIV 2").alias("block"), "entry", F.col("found").alias("exit")
        )

    def accepted(self, rows: DataFrame, tie: str) -> DataFrame:
        """The accepted ones of ``rows``, whose periods begin with cell 0."""
        levels = [durable(self.first_maps(rows.select(*self.groups, "_cell", "_t").distinct()))]
        last = rows.agg(F.max("_cell")).first()[0] or 0
        for _ in range(int(last).bit_length()):
            levels.append(durable(self.composed(levels[-1])))
        told = levels[-1].select(*self.groups, "block").distinct().withColumn("enters", F.lit(self.NONE))
        for maps in levels[-2::-1]:
            left = told.withColumn("block", F.col("block") * 2)
            right = self.looked_up(left, "enters", maps)
            right = right.select(*self.groups, (F.col("block") + 1).alias("block"), F.col("found").alias("enters"))
            told = durable(left.unionByName(right))
        times = self.looked_up(told, "enters", levels[0]).select(*self.groups, F.col("found").alias("_t"))
        times = times.filter(F.col("_t") != self.NONE)
        hit = rows.join(times, [*self.groups, "_t"], "left_semi")
        return insert_ignore(hit, [*self.groups, "_t"], [tie])


def ttl_dedup(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    ttl_seconds: int = K.TTL_SECONDS,
    split: bool = True,
    run: int = K.TTL_RUN,
) -> DataFrame:
    """Drop a row when its key was *accepted* less than ``ttl_seconds`` ago.

    A dropped row does not extend the period, so the rule is sequential per key. After a pause of a
    TTL it starts anew, whatever came before; a key's rows between two pauses are a period.
    Periods of up to ``run`` rows are exchanged, sorted by time and tie, and passed once with
    the last accepted time as the only state. Longer ones are worked on in parallel by transfer functions
    (:class:`_Transfer`). Of equal times one row, with the lowest tie, is accepted. Without ``split`` a
    key isn't cut at its pauses. The rows are the same in all cases.

    Rows without a key or a time cannot be judged and are left out: take them from
    ``split_quarantine`` with :func:`ttl_checks`.
    """
    ttl = ttl_seconds * 1_000_000
    known = F.lit(True)
    for check in ttl_checks(keys, ts).values():
        known = known & check
    rows = df.filter(known).withColumn("_t", micros(F.col(ts)))
    rows = rows.withColumn("_cell", F.floor(F.col("_t") / F.lit(ttl)).cast("bigint"))
    cells = rows.groupBy(*keys, "_cell").agg(F.min("_t").alias("low"), F.max("_t").alias("high"), F.count("*").alias("n"))
    cells = durable(_periods(cells, keys, ttl, split))
    groups = [*keys, "_period"]
    sized = cells.groupBy(*groups).agg(F.sum("n").alias("n"), F.min("_cell").alias("base"))
    found = durable(sized.filter(F.col("n") > run).select(*groups, "base"))
    passed = rows.join(cells.select(*groups, "_cell"), [*keys, "_cell"])
    any_long = not found.isEmpty()
    ordered = passed.join(found, groups, "left_anti") if any_long else passed
    ordered = ordered.repartition(*groups).sortWithinPartitions(*groups, "_t", tie)
    short = ordered.select(*df.columns, *[g for g in groups if g not in df.columns], "_t").mapInArrow(
        _accepting(df.columns, groups, ttl), df.schema
    )
    if not any_long:
        return short
    long = passed.join(found, groups).withColumn("_cell", F.col("_cell") - F.col("base")).drop("base")
    return short.unionByName(_Transfer(groups, ttl).accepted(durable(long), tie).select(*df.columns))
