"""Input and output schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# ``data`` may arrive as a string or as an object; read as STRING, an object keeps its
# JSON text. ``args`` is free-form and stays JSON text until a schema is applied.
INSTRUCTION = T.StructType(
    [
        T.StructField("programId", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("accounts", T.ArrayType(T.StringType())),
    ]
)

TRANSACTION = T.StructType(
    [
        T.StructField("signature", T.StringType()),
        T.StructField("slot", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("feePayer", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("instructions", T.ArrayType(INSTRUCTION)),
    ]
)

_FIELD = "struct<name:string,type:string>"

# Interface description. Every ``type`` is read as text: a scalar keeps its name, an
# object keeps its JSON, so one pass over the document covers the recursive grammar. Fields of
# a named type or account are texts too, since a tuple struct lists bare types.
IDL = (
    "struct<name:string,address:string,"
    f"instructions:array<struct<name:string,discriminator:array<int>,args:array<{_FIELD}>>>,"
    f"accounts:array<struct<name:string,type:struct<fields:array<string>>>>,"
    "types:array<struct<name:string,type:struct<kind:string,fields:array<string>,"
    "variants:array<struct<name:string,fields:array<string>>>>>>,"
    f"events:array<struct<name:string,fields:array<{_FIELD}>>>>"
)

HEARTBEATS = (
    "signature string, ix_index int, timestamp timestamp_ntz, merkle_root string, node_pubkey string, "
    "shard_count bigint, status string, slot bigint"
)
NARRATIVES = "signature string, narrative string, semantic_cluster string, slot bigint, timestamp timestamp_ntz"
PROOF_LOGS = "signature string, slot bigint, state_root string, verification_status string, timestamp timestamp_ntz"
LIQUIDATIONS = (
    "signature string, protocol string, liquidator string, repaid_amount string, "
    "slot bigint, timestamp timestamp_ntz"
)
