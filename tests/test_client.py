"""Named queries over tables made by the registered queries."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from ixlake.client import Assets, Client, Indexed, Lending, Narratives, Proofs, ShardLocks
from ixlake.plans.views import v_catalog, v_ix, v_log, v_log_catalog


def test_named_queries(spark, sf_dir):
    tables = {
        name: entry.queries()[name](spark, sf_dir).cache()
        for name in ("liquidations", "narratives", "proof_log", "rarity_score", "shard_lock_state")
    }
    log = v_log(spark, sf_dir)
    catalog = v_log_catalog(spark, sf_dir).withColumn("idl_name", F.concat(F.lit("idl-"), "program_id"))
    client = Client(
        Lending(tables["liquidations"]),
        Narratives(tables["narratives"]),
        Proofs(tables["proof_log"]),
        Assets(tables["rarity_score"]),
        ShardLocks(tables["shard_lock_state"]),
        Indexed(log, catalog),
    )
    page = client.lending.liquidations(limit=10**6).envelope()
    assert page["limit"] == 500 and page["count"] == min(500, tables["liquidations"].count())
    protocol = page["data"][0]["protocol"]
    assert {r["protocol"] for r in client.lending.protocol(protocol, 20).envelope()["data"]} == {protocol}
    newest = client.narratives.newest(5).envelope()["data"]
    assert [r["timestamp"] for r in newest] == sorted((r["timestamp"] for r in newest), reverse=True)
    assert client.proofs.newest().data.count() == min(100, tables["proof_log"].count())
    assert client.assets.rarity("M7").first().mint == "M7" and client.assets.rarity("M").count() == 0
    brand = client.assets.rarity("M7").first().collection
    scores = [r.rarity_score for r in client.assets.collection(brand).data.collect()]
    assert scores == sorted(scores, reverse=True)
    root = tables["shard_lock_state"].filter("status = 'ONLINE'").first().merkle_root
    assert {r.status for r in client.shard_locks.locations(root).collect()} == {"ONLINE"}

    by_id = client.indexed.data("P1", "CLICK", 7, signer="U7", nonsense="x").data.collect()
    by_name = client.indexed.data("idl-P1", "click", 7, signer="U7").data.collect()
    assert by_id == by_name and {(r.program_id, r.signer) for r in by_id} <= {("P1", "U7")}
    stats = {r.instruction: r.calls for r in client.indexed.stats("P1").collect()}
    assert stats["refund"] == 0 and stats[None] == log.filter("program_id = 'P1'").count()
    assert client.indexed.program("P2").count() == 6


def test_unknown_program_has_no_rows(spark, sf_dir):
    indexed = Indexed(v_ix(spark, sf_dir).withColumn("instruction", F.lower("name")), v_catalog(spark, sf_dir))
    assert indexed.program("nobody").count() == 0
    assert indexed.data("nobody", "deposit") is None
    program = indexed.catalog.first().program_id
    assert indexed.data(program, "nothing") is None


def test_argument_columns_filter_by_type(spark):
    log = spark.createDataFrame(
        [("a", 1, "P", "swap", '{"amount":"5"}'), ("b", 2, "P", "swap", '{"amount":"6"}')],
        "signature string, slot long, program_id string, instruction string, args string",
    )
    catalog = spark.createDataFrame([("P", "p", "swap", "ix_swap", "amount DECIMAL(20,0)")], "program_id string, idl_name string, instruction string, table_name string, ddl string")
    indexed = Indexed(log, catalog)
    assert [r.signature for r in indexed.data("P", "swap", amount="5").data.collect()] == ["a"]
    assert [r.signature for r in indexed.data("p", "SWAP", amount="x").data.collect()] == []
    assert indexed.data("P", "swap", bogus="5").data.count() == 2
