"""Heartbeat state and availability."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ixlake.operators import aggregates, state
from ixlake.plans.registry import query
from ixlake.plans.views import HB_ORDER, v_hb, with_views
from ixlake.session import shared_folder
from ixlake.sources import tables
from ixlake.streaming.rollups import HeartbeatRollups

AS_OF = "1998-06-01 00:10:00"

_STATE = """
st AS (
  SELECT merkle_root, node_pubkey, first(shard_count ORDER BY ts, feed_partition, feed_offset) AS shard_count,
    last(status ORDER BY ts, feed_partition, feed_offset) AS status, max(ts) AS last_heartbeat
  FROM v_hb GROUP BY merkle_root, node_pubkey)
"""

_SWEPT = f"""
swept AS (
  SELECT merkle_root, node_pubkey, shard_count, last_heartbeat,
    CASE WHEN status = 'ONLINE' AND last_heartbeat < TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTES
      THEN 'OFFLINE' ELSE status END AS status
  FROM st)
"""


def _over_state(body: str) -> str:
    return with_views("", "v_hb").rstrip() + "," + _STATE.rstrip() + "," + _SWEPT + body


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _state(spark, d):
    return state.shard_lock_state(v_hb(spark, d), HB_ORDER)


def _swept(spark, d):
    return state.stale_sweep(_state(spark, d), _as_of())


@query(
    "shard_lock_state",
    _over_state("SELECT merkle_root, node_pubkey, shard_count, status, last_heartbeat FROM st"),
)
def shard_lock_state(spark, d):
    return _state(spark, d)


@query(
    "stale_sweep",
    _over_state("SELECT merkle_root, node_pubkey, shard_count, status, last_heartbeat FROM swept"),
)
def stale_sweep(spark, d):
    return _swept(spark, d)


@query(
    "shard_locations",
    _over_state(
        "SELECT merkle_root, node_pubkey, shard_count, status, last_heartbeat FROM st WHERE status = 'ONLINE'"
    ),
)
def shard_locations(spark, d):
    return state.shard_locations(_state(spark, d))


@query(
    "hb_log_append",
    with_views(
        "SELECT ts AS timestamp, merkle_root, node_pubkey, shard_count, 'ONLINE' AS status FROM v_hb", "v_hb"
    ),
)
def hb_log_append(spark, d):
    """What the event log holds after two appends: one row per heartbeat, nothing merged."""
    path = f"{shared_folder(spark)}/heartbeat-log-{uuid.uuid4().hex}"
    beats = v_hb(spark, d)
    for part in (0, 1):
        tables.append_heartbeats(beats.filter(F.col("feed_partition") % 2 == part), path)
    return spark.read.parquet(path)


@query(
    "shard_lock_upsert",
    _over_state("SELECT merkle_root, node_pubkey, shard_count, status, last_heartbeat FROM st"),
)
def shard_lock_upsert(spark, d):
    """Stored state of the earlier heartbeats, then the later ones: as if all came at once."""
    beats = v_hb(spark, d)
    later = F.col("ts") >= F.lit("1995-01-01").cast("timestamp_ntz")
    stored = state.shard_lock_state(beats.filter(~later), HB_ORDER)
    return state.upsert_state(stored, beats.filter(later), HB_ORDER)


_BY_NODE = with_views(
    """
    SELECT node_pubkey, count(DISTINCT merkle_root) AS files_locked,
      sum(shard_count)::BIGINT AS total_shards, max(ts) AS last_seen, max(status) AS current_status
    FROM v_hb GROUP BY node_pubkey
    """,
    "v_hb",
)
_BY_ROOT = with_views(
    """
    SELECT merkle_root, count(DISTINCT node_pubkey) AS replication_factor,
      sum(shard_count)::BIGINT AS total_shards_distributed, max(ts) AS last_heartbeat
    FROM v_hb WHERE status = 'ONLINE' GROUP BY merkle_root
    """,
    "v_hb",
)


@query("node_availability", _BY_NODE)
def node_availability(spark, d):
    return aggregates.node_availability(v_hb(spark, d))


@query(
    "node_availability_current",
    _over_state(
        """
        SELECT node_pubkey, count(*) AS files_locked, sum(shard_count)::BIGINT AS total_shards,
          max(last_heartbeat) AS last_seen, count(*) FILTER (status = 'ONLINE') AS files_online,
          CASE WHEN bool_or(status = 'ONLINE') THEN 'ONLINE' ELSE 'OFFLINE' END AS current_status
        FROM swept GROUP BY node_pubkey
        """
    ),
)
def node_availability_current(spark, d):
    return aggregates.node_availability_current(_swept(spark, d))


@query("active_shard_map", _BY_ROOT)
def active_shard_map(spark, d):
    return aggregates.active_shard_map(v_hb(spark, d))


def _kept_rollups(spark, d):
    """Three batches, out of time order, folded after the second."""
    rollups = HeartbeatRollups(f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}", fold_every=2)
    beats = v_hb(spark, d)
    for batch_id in range(3):
        rollups(beats.filter(F.pmod(F.col("feed_offset"), F.lit(3)) == batch_id), batch_id)
    return rollups


@query("node_availability_kept", _BY_NODE)
def node_availability_kept(spark, d):
    """From stored partial rows of three batches, equal to the roll-up of the whole log."""
    return _kept_rollups(spark, d).node_availability(spark)


@query("active_shard_map_kept", _BY_ROOT)
def active_shard_map_kept(spark, d):
    return _kept_rollups(spark, d).active_shard_map(spark)
