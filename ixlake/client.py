"""Named queries over the stored tables: what a client of the index asks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ixlake import constants as K
from ixlake.operators import aggregates, paging, state
from ixlake.operators.paging import Page
from ixlake.operators.universal import typed_table


def _newest(df: DataFrame, limit: object, offset: object, page_size: tuple[int, int]) -> Page:
    return paging.page_by_time(df, limit, offset, page_size, ts="timestamp")


@dataclass(frozen=True)
class Lending:
    table: DataFrame

    def liquidations(self, limit: object = None, offset: object = None) -> Page:
        return _newest(self.table, limit, offset, K.LIQUIDATION_PAGE)

    def protocol(self, protocol: str, limit: object = None, offset: object = None) -> Page:
        rows = self.table.filter(F.col("protocol") == protocol)
        return _newest(rows, limit, offset, K.LIQUIDATION_PAGE)


@dataclass(frozen=True)
class Narratives:
    table: DataFrame

    def newest(self, limit: object = None, offset: object = None) -> Page:
        return _newest(self.table, limit, offset, K.LOG_PAGE)


@dataclass(frozen=True)
class Proofs:
    table: DataFrame

    def newest(self, limit: object = None, offset: object = None) -> Page:
        return _newest(self.table, limit, offset, K.LOG_PAGE)


@dataclass(frozen=True)
class Assets:
    table: DataFrame

    def rarity(self, mint: str) -> DataFrame:
        return paging.lookup(self.table, "mint", mint)

    def collection(self, collection: str, limit: object = None, offset: object = None) -> Page:
        n, o = paging.clamp_page(limit, offset, *K.LOG_PAGE)
        rows = self.table.filter(F.col("collection") == collection)
        order = [F.col("rarity_score").desc(), F.col("mint").asc()]
        return Page(paging.page(rows, order, n, o), n, o)


@dataclass(frozen=True)
class ShardLocks:
    table: DataFrame

    def locations(self, merkle_root: str) -> DataFrame:
        return state.shard_locations(self.table, merkle_root)


@dataclass(frozen=True)
class Indexed:
    """Logs of cataloged programs, addressed by program id or by description name."""

    log: DataFrame
    catalog: DataFrame

    def _of(self, program: str) -> DataFrame:
        return self.catalog.filter(
            (F.col("program_id") == program) | (F.col("idl_name") == program)
        )

    def program(self, program: str) -> DataFrame:
        return aggregates.program_discovery(self._of(program))

    def data(
        self, program: str, instruction: str, limit: object = None, offset: object = None, **filters: object
    ) -> Page | None:
        """Newest page of one instruction, or None when no document declares it.

        Filters name columns of the log or, where the catalog has the table's ``ddl``, argument columns.
        """
        known = self._of(program).filter(F.col("instruction") == instruction.lower())
        found = known.select("program_id", *[c for c in ("ddl",) if c in known.columns]).limit(1).collect()
        if not found:
            return None
        rows = self.log.filter(F.col("instruction") == instruction.lower()).join(
            known.select("program_id").distinct(), "program_id", "left_semi"
        )
        if "ddl" in found[0] and found[0]["ddl"]:
            rows = typed_table(rows, found[0]["ddl"])
        return paging.page_by_slot(paging.equality_filters(rows, filters), limit, offset)

    def stats(self, program: str, since: Column | None = None) -> DataFrame:
        known = self._of(program)
        log = self.log.join(known.select("program_id").distinct(), "program_id", "left_semi")
        return aggregates.program_stats(log, known, since)


@dataclass(frozen=True)
class Client:
    """The stored tables, each with the queries asked of it."""

    lending: Lending
    narratives: Narratives
    proofs: Proofs
    assets: Assets
    shard_locks: ShardLocks
    indexed: Indexed
