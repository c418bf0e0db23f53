"""Replays, rankings, look-ups, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ixlake.operators import extract, feeds, paging, ranking, replay
from ixlake.plans.ingest import _LIQUIDATIONS, _NARRATIVES, _PROOFS, _over
from ixlake.plans.registry import query
from ixlake.plans.views import v_asset, v_ix, v_launch, v_tx, with_views
from ixlake.sources.tables import table


def _orders_signatures(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select(
        F.concat(F.lit("TX"), "o_orderkey", F.lit("-1")).alias("signature")
    )


@query(
    "replay_by_signature",
    _over(
        [_LIQUIDATIONS],
        """
        SELECT signature, protocol, liquidator, repaid_amount, slot, timestamp FROM liq
        WHERE signature IN (SELECT 'TX' || o_orderkey || '-1' FROM orders WHERE o_orderstatus = 'P')
        """,
    ),
)
def replay_by_signature(spark, d):
    """Listed signatures (the pending orders' first lines) through the same extractor."""
    listed = _orders_signatures(spark, d)
    return extract.LIQUIDATIONS.rows(v_tx(spark, d), lambda rows: replay.by_signature(rows, listed))


@query(
    "replay_slot_range",
    _over(
        [_NARRATIVES.replace("WHERE coalesce", "WHERE slot BETWEEN 2220000000 AND 2320000000 AND coalesce")],
        "SELECT signature, narrative, NULL::VARCHAR AS semantic_cluster, slot, timestamp FROM nar",
    ),
)
def replay_slot_range(spark, d):
    return extract.NARRATIVES.rows(replay.by_slot_range(v_tx(spark, d), 2_220_000_000, 2_320_000_000))


@query(
    "replay_recent_per_program",
    with_views(
        """
        SELECT program_id, signature, slot,
          row_number() OVER (PARTITION BY program_id ORDER BY slot DESC, signature) AS rank
        FROM (SELECT program_id, signature, max(slot) AS slot FROM v_ix GROUP BY ALL) QUALIFY rank <= 20
        """,
        "v_ix",
    ),
)
def replay_recent_per_program(spark, d):
    return replay.recent_signatures(v_ix(spark, d)).select("program_id", "signature", "slot", "rank")


def _scores(spark, d):
    return ranking.rarity_score(v_asset(spark, d))


@query(
    "rarity_score",
    with_views("SELECT mint, collection, round(rarity_score, 6) AS rarity_score FROM v_score", "v_score"),
)
def rarity_score(spark, d):
    return _scores(spark, d).withColumn("rarity_score", F.round("rarity_score", 6))


@query(
    "collection_ranking",
    with_views(
        """
        SELECT collection, mint, score AS rarity_score,
          row_number() OVER (PARTITION BY collection ORDER BY score DESC, mint) AS rank
        FROM (SELECT collection, mint, round(rarity_score, 6) AS score FROM v_score)
        QUALIFY rank BETWEEN 11 AND 110
        """,
        "v_score",
    ),
)
def collection_ranking(spark, d):
    """The second page (offset 10) of every collection, rarest first."""
    return paging.page_per_group(
        rarity_score(spark, d), ["collection"], [F.col("rarity_score").desc(), F.col("mint")], 100, 10
    ).select("collection", "mint", "rarity_score", "rank")


@query(
    "asset_lookup",
    with_views(
        """
        , wanted AS (SELECT DISTINCT 'M' || (o_custkey * 2) AS mint FROM orders)
        SELECT mint, s.collection, round(s.rarity_score, 6) AS rarity_score, s.mint IS NOT NULL AS found
        FROM wanted LEFT JOIN v_score s USING (mint)
        """.replace("s.mint IS NOT NULL", "s.collection IS NOT NULL"),
        "v_score",
    ),
)
def asset_lookup(spark, d):
    """Point look-ups for every requested key; absent keys are reported, not dropped."""
    requests = table(spark, d, "orders").select(
        F.concat(F.lit("M"), F.col("o_custkey") * 2).alias("mint")
    )
    return paging.lookup_many(requests, rarity_score(spark, d), "mint").select(
        "mint", "collection", "rarity_score", "found"
    )


@query(
    "activity_feed",
    _over(
        [_LIQUIDATIONS, _NARRATIVES, _PROOFS],
        """
        SELECT 'narrative' AS feed, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%g') || 'Z' AS head,
          '> ' || narrative AS body, NULL::VARCHAR AS badge
        FROM (FROM nar ORDER BY timestamp DESC, signature LIMIT 15)
        UNION ALL
        SELECT 'liquidation', signature[:8] || '...', protocol[:8] || '... ' ||
          regexp_replace(format('{:,.4f}', repaid_amount::DOUBLE), '\\.?0+$', ''), NULL
        FROM (FROM liq ORDER BY timestamp DESC, signature LIMIT 10)
        UNION ALL
        SELECT 'proof', signature[:8] || '...', state_root[:12] || '...', 'PENDING/yellow'
        FROM (FROM prf ORDER BY timestamp DESC, signature LIMIT 10)
        """,
    ),
)
def activity_feed(spark, d):
    tables = extract.default_registry().extract(v_tx(spark, d))
    return feeds.activity_feed(tables["narratives"], tables["liquidations"], tables["proof_logs"])


@query(
    "launch_feed",
    with_views(
        """
        SELECT coalesce(nullif(name, ''), 'ANONYMOUS_LAUNCH') AS title, signature[:8] || '...' AS signature_label,
          coalesce(symbol, '???') AS symbol_label, coalesce(creator, 'UNKNOWN')[:8] || '...' AS creator_label
        FROM v_launch ORDER BY slot DESC, signature LIMIT 10
        """,
        "v_launch",
    ),
)
def launch_feed(spark, d):
    return feeds.launch_feed(v_launch(spark, d))


@query(
    "fee_feed",
    with_views(
        """
        SELECT signature[:8] || '...' AS signature_label,
          coalesce(platform_vault, fee_share_authority, '...')[:8] || '...' AS vault_label, 'DISTRIBUTED' AS status
        FROM v_launch ORDER BY slot DESC, signature LIMIT 10
        """,
        "v_launch",
    ),
)
def fee_feed(spark, d):
    return feeds.fee_feed(v_launch(spark, d))
