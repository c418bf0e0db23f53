"""Heartbeat state on a stream: upsert per (root, node), OFFLINE by timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ixlake import constants as K
from ixlake.streaming.ingest import use_rocksdb

CHANGES = "merkle_root string, node_pubkey string, shard_count bigint, status string, last_heartbeat timestamp"


class _Presence(StatefulProcessor):
    """First shard count, latest heartbeat; a timer turns a silent node OFFLINE."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("presence", "shard_count bigint, last_ns bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get() if self.state.exists() else None
        first, last = (stored[0], pd.Timestamp(stored[1])) if stored is not None else (None, None)
        # Only the earliest and the latest row matter: chunks are reduced as they arrive.
        earliest = None
        for chunk in rows:
            head = chunk.loc[chunk["ts"].idxmin()]
            if earliest is None or head["ts"] < earliest["ts"]:
                earliest = head
            newest = chunk["ts"].max()
            last = newest if last is None else max(last, newest)
        if first is None:
            first = int(earliest["shard_count"])
        self.state.update((int(first), last.value))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A heartbeat exactly at the limit still counts as alive.
        self.handle.registerTimer(int(last.timestamp() * 1000) + self.minutes * 60_000 + 1)
        yield self._row(key, first, K.ONLINE, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last = self.state.get()
        yield self._row(key, first, K.OFFLINE, pd.Timestamp(last))

    @staticmethod
    def _row(key, shard_count, status, last) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "merkle_root": [key[0]],
                "node_pubkey": [key[1]],
                "shard_count": [int(shard_count)],
                "status": [status],
                "last_heartbeat": [last],
            }
        )

    def close(self) -> None:
        pass


def presence_changes(heartbeats: DataFrame, minutes: int = K.STALE_MINUTES, lateness: str = "0 seconds") -> DataFrame:
    """Stream of state changes; the latest change of a key is its present state.

    ``heartbeats`` needs merkle_root, node_pubkey, shard_count and an event-time ``ts``.
    """
    use_rocksdb(heartbeats.sparkSession)
    return (
        heartbeats.withWatermark("ts", lateness)
        .groupBy("merkle_root", "node_pubkey")
        .transformWithStateInPandas(
            statefulProcessor=_Presence(minutes),
            outputStructType=CHANGES,
            outputMode="Update",
            timeMode="EventTime",
        )
    )
