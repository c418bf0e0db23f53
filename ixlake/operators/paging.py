"""Newest-first pages, ranked pages, look-ups and allow-listed filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ixlake import constants as K
from ixlake.functions.text import parse_int


def clamp_page(limit: object, offset: object, default: int, cap: int) -> tuple[int, int]:
    """Request parameters to a page: 0 <= limit <= cap, offset >= 0."""
    return (
        min(max(parse_int(limit, default), 0), cap),
        max(parse_int(offset, 0), 0),
    )


@dataclass(frozen=True)
class Page:
    """One page and the envelope a client receives with it."""

    data: DataFrame
    limit: int
    offset: int

    def envelope(self, **extra: object) -> dict:
        rows = [row.asDict(recursive=True) for row in self.data.collect()]  # <= cap rows
        return {**extra, "count": len(rows), "limit": self.limit, "offset": self.offset, "data": rows}


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset..offset+limit in ``order``; the order must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def _tail(df: DataFrame) -> list[Column]:
    """What makes an order unique: the signature, then the place in the transaction."""
    return [F.col(c).asc() for c in ("signature", "ix_index") if c in df.columns]


def _newest_slot_first(df: DataFrame) -> list[Column]:
    """Rows without a slot come last."""
    return [F.col("slot").desc_nulls_last(), *_tail(df)]


def page_by_time(df: DataFrame, limit: object = None, offset: object = None, page_size=K.LOG_PAGE, ts: str = "ts") -> Page:
    n, o = clamp_page(limit, offset, *page_size)
    return Page(page(df, [F.col(ts).desc_nulls_last(), *_tail(df)], n, o), n, o)


def page_by_slot(df: DataFrame, limit: object = None, offset: object = None, page_size=K.LOG_PAGE) -> Page:
    n, o = clamp_page(limit, offset, *page_size)
    return Page(page(df, _newest_slot_first(df), n, o), n, o)


def page_after(
    df: DataFrame, slot: int | None, signature: str, limit: object = None, page_size=K.LOG_PAGE, ix_index: int | None = None
) -> DataFrame:
    """The page behind a row: deep paging at the cost of the first page.

    The cursor is the last row seen: its slot, signature and, for a log of instructions,
    its ``ix_index``. Rows without a slot follow all others. The predicate on ``slot`` reaches the
    scan, so files of newer slots are skipped.
    """
    n, _ = clamp_page(limit, 0, *page_size)
    later = F.col("signature") > signature
    if ix_index is not None:
        later = later | ((F.col("signature") == signature) & (F.col("ix_index") > ix_index))
    if slot is None:
        behind = F.col("slot").isNull() & later
    else:
        behind = F.col("slot").isNull() | (F.col("slot") < slot) | ((F.col("slot") == slot) & later)
    return page(df.filter(behind), _newest_slot_first(df), n)


def page_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The same page of every group at once, with its ``rank``.

    The rank bound is applied before the exchange (group limit), so a group sends at most
    ``offset + limit`` rows per task.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter((F.col("rank") <= offset + limit) & (F.col("rank") > offset))


def equality_filters(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """AND of ``column = value`` over the keys that are columns; other keys are ignored.

    Values are bound as literals, never become part of a statement's text, and are compared in
    the column's type: a value that isn't of this type equals nothing.
    """
    for key, value in filters.items():
        if key in df.columns:
            df = df.filter(F.col(f"`{key}`") == F.lit(value).try_cast(df.schema[key].dataType))
    return df


def instruction_log(
    log: DataFrame,
    program_id: str,
    instruction: str,
    filters: dict[str, object] | None = None,
    limit: object = None,
    offset: object = None,
) -> Page:
    """Filtered newest-first page of one instruction's log."""
    rows = log.filter(
        (F.col("program_id") == program_id) & (F.col("instruction") == instruction.lower())
    )
    return page_by_slot(equality_filters(rows, filters or {}), limit, offset)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with this primary key, or none."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def lookup_many(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Look-up of many keys: each requested key once, ``found`` false when absent."""
    wanted = requests.select(key).distinct()
    return wanted.join(table.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )
