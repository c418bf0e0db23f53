"""Catalog hot reload: new and changed description documents refresh the catalog table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ixlake.operators import idl
from ixlake.streaming.ingest import read_if_written


class CatalogReload:
    """``foreachBatch`` sink of a document stream.

    Each batch writes its instructions under its own ``batch_id``, so a retried batch
    replaces itself. Readers take the last modified document of every program.
    """

    def __init__(self, table: str):
        self.table = table

    def __call__(self, docs: DataFrame, batch_id: int) -> None:
        catalog = idl.layouts(idl.parse_documents(docs))
        catalog.write.mode("overwrite").parquet(f"{self.table}/batch_id={batch_id}")

    def start(self, docs: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            docs.writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def current_catalog(spark, table: str) -> DataFrame | None:
    """Instructions of the newest document of every program; re-read it per micro-batch."""
    written = read_if_written(spark, table)
    if written is None:
        return None
    newest = written.groupBy("program_id").agg(F.max("modified").alias("modified"))
    return (
        written.join(newest, ["program_id", "modified"], "left_semi")
        .dropDuplicates(["program_id", "instruction"])
        .drop("batch_id", "modified")
    )
