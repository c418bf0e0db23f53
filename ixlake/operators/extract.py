"""Domain extractors and their registry.

An extractor is a transform from transactions to rows of one table. The engine applies
first-write-wins on the table's key to whatever it returns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ixlake import constants as K
from ixlake import schema as S
from ixlake.functions.binary import text_to_bytes
from ixlake.functions.text import or_default, prefix
from ixlake.operators.decode import heartbeat_decode
from ixlake.operators.dedup import insert_ignore
from ixlake.operators.ingest import explode_instructions, missing_key_checks, route_by_program, split_quarantine
from ixlake.session import stored

# Arrival order of the feed: slot, then the source's partition and offset.
ARRIVAL = ["slot", "feed_partition", "feed_offset"]


def liquidations(tx: DataFrame, programs: tuple[str, ...] = K.LENDING_PROGRAMS) -> DataFrame:
    ix = route_by_program(explode_instructions(tx), programs)
    return ix.filter(F.lower("name").contains(K.LIQUIDATION_WORD)).select(
        "signature",
        F.col("program_id").alias("protocol"),
        or_default(F.col("fee_payer"), K.UNKNOWN_SIGNER).alias("liquidator"),
        or_default(F.get_json_object("data", "$.repaidAmount"), K.DEFAULT_REPAID).alias("repaid_amount"),
        F.col("ts").alias("timestamp"),
        *ARRIVAL,
        "ix_index",
    )


def narratives(tx: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """One narrative per described transaction; ``kept`` names input columns to carry along."""
    text = F.concat(
        F.lit("Transaction "),
        prefix(F.col("signature")),
        F.lit(": "),
        F.col("description"),
        F.lit(" at slot "),
        F.coalesce(F.col("slot").cast("string"), F.lit(K.NO_SLOT)),
    )
    return tx.filter(F.coalesce(F.col("description"), F.lit("")) != "").select(
        "signature",
        text.alias("narrative"),
        F.lit(None).cast("string").alias("semantic_cluster"),
        F.col("ts").alias("timestamp"),
        *ARRIVAL,
        *kept,
    )


def proof_logs(tx: DataFrame, program: str = K.PROOF_PROGRAM, state_root: Column | None = None) -> DataFrame:
    root = F.lit(K.STATE_ROOT_STUB) if state_root is None else state_root
    return route_by_program(explode_instructions(tx), [program]).select(
        "signature",
        root.alias("state_root"),
        F.lit(K.PENDING).alias("verification_status"),
        F.col("ts").alias("timestamp"),
        *ARRIVAL,
        "ix_index",
    )


def heartbeats(tx: DataFrame, program: str = K.HEARTBEAT_PROGRAM, encoding: str = "base64") -> DataFrame:
    """Heartbeat log rows: every heartbeat, status ONLINE."""
    ix = route_by_program(explode_instructions(tx), [program])
    decoded = heartbeat_decode(ix.withColumn("payload", text_to_bytes(F.col("data"), encoding)))
    return decoded.select(
        "signature",
        "merkle_root",
        "node_pubkey",
        "shard_count",
        F.lit(K.ONLINE).alias("status"),
        "ts",
        *ARRIVAL,
        "ix_index",
    )


@dataclass(frozen=True)
class Extractor:
    """A module: its table's schema and key, the order of first writes, the transform."""

    id: str
    schema: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    transform: Callable[[DataFrame], DataFrame]
    name: str = ""
    description: str = ""
    checks: dict[str, Column] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [part.strip().split()[0] for part in self.schema.split(",")]

    def judged(self, tx: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The transform's rows that have a key and pass the checks, and the others with their
        ``reason``."""
        return split_quarantine(self.transform(tx), {**self.checks, **missing_key_checks(*self.keys)})

    def keyed(self, tx: DataFrame) -> DataFrame:
        return self.judged(tx)[0]

    def rows(self, tx: DataFrame, chosen: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """New rows, first write per key, in the table's columns; of those that are ``chosen`` from
        the transform's rows, if that is given."""
        first = insert_ignore(chosen(self.keyed(tx)), list(self.keys), list(self.order))
        return first.select(*self.columns)


@dataclass
class Registry:
    """Extractors by id; registering an id again changes nothing."""

    _extractors: dict[str, Extractor] = field(default_factory=dict)

    def register(self, extractor: Extractor) -> Registry:
        self._extractors.setdefault(extractor.id, extractor)
        return self

    def __iter__(self):
        return iter(self._extractors.values())

    def __len__(self) -> int:
        return len(self._extractors)

    def extract(self, tx: DataFrame, store: bool = False) -> dict[str, DataFrame]:
        """Rows of every module. Each module reads the feed; with ``store`` a feed that is costly to read
        is first stored in the shared folder, so that it is made once and not once a module."""
        feed = stored(tx, "feed") if store else tx
        return {e.id: e.rows(feed) for e in self}


LIQUIDATIONS = Extractor(
    "liquidations", S.LIQUIDATIONS, ("signature",), (*ARRIVAL, "ix_index"), liquidations
)
NARRATIVES = Extractor("narratives", S.NARRATIVES, ("signature",), tuple(ARRIVAL), narratives)
PROOF_LOGS = Extractor(
    "proof_logs", S.PROOF_LOGS, ("signature",), (*ARRIVAL, "ix_index"), proof_logs
)


HEARTBEATS = Extractor(
    "heartbeats",
    S.HEARTBEATS,
    ("signature", "ix_index"),
    tuple(ARRIVAL),
    lambda tx: heartbeats(tx, K.HEARTBEAT_PROGRAM).withColumn("timestamp", F.col("ts")),
)


def default_registry(*more: Extractor) -> Registry:
    """The fixed modules, and ``more`` such as the universal module over a catalog."""
    registry = Registry()
    for extractor in (LIQUIDATIONS, NARRATIVES, PROOF_LOGS, HEARTBEATS, *more):
        registry.register(extractor)
    return registry
