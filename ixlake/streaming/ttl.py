"""Time-limited duplicate removal on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ixlake import constants as K
from ixlake.streaming.ingest import use_rocksdb


def ttl_dedup_watermark(tx: DataFrame, keys: list[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """Built-in form: a repeat within ``ttl`` is dropped; one soon after it may be as well."""
    return tx.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


class _Accept(StatefulProcessor):
    """Keeps the time of the last accepted row of a key; rows of a batch go in time order."""

    def __init__(self, key_count: int, columns: list[str], ts: str, order: list[str], ttl_seconds: int):
        self.key_count = key_count
        self.columns = columns
        self.ts = ts
        self.order = order
        self.ttl = pd.Timedelta(seconds=ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "at_ns bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.accepted.get() if self.accepted.exists() else None
        last = pd.Timestamp(stored[0]) if stored is not None else None
        batch = pd.concat(rows).sort_values(self.order)
        kept = []
        for position, at in enumerate(batch[self.ts]):
            if last is None or at - last >= self.ttl:
                kept.append(position)
                last = at
        if kept:
            self.accepted.update((last.value,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((last + self.ttl).timestamp() * 1000) + 1)
            yield batch.iloc[kept][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark passed the end of the period: the key may be forgotten."""
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_dedup_exact(
    tx: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    ttl_seconds: int = K.TTL_SECONDS,
    lateness: str = "1 hour",
) -> DataFrame:
    """Exact form: a dropped row does not extend the period, and a repeat exactly at its
    end is accepted. State is one time per key, forgotten when the watermark passes it.

    A key's rows of one micro-batch are sorted in memory; the source's rate limit
    (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bounds them.
    """
    use_rocksdb(tx.sparkSession)
    columns = tx.columns
    return (
        tx.withWatermark(ts, lateness)
        .groupBy(*keys)
        .transformWithStateInPandas(
            statefulProcessor=_Accept(len(keys), columns, ts, [ts, tie], ttl_seconds),
            outputStructType=tx.schema,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
