"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ixlake.llm.common import saved, shared_root
from ixlake.llm.lines import dedup_lines
from ixlake.llm.minhash import without_duplicates
from ixlake.llm.mixing import mix_documents
from ixlake.llm.packing import pack_documents
from ixlake.llm.quality import clean_documents
from ixlake.session import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others."""
    prepare(spark)
    return clean_documents(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents of which nothing else was left."""
    prepare(spark)
    left = dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return left.where(~F.coalesce(emptied, F.lit(False))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    prepare(spark)
    return without_duplicates(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one taken three times stands in three rows.

    Rows go by two hashes of all their columns, so no text is written before it meets its copies. Rows that agree in
    all columns are one row with the copies drawn for each of them.
    """
    prepare(spark)
    # A null adds nothing to a hash, so the nulls are hashed as well.
    nulls = [F.col(c).isNull() for c in COLUMNS]
    marks = [F.xxhash64(F.lit(seed), *COLUMNS, *nulls).cast("string") for seed in (1, 2)]
    rows = docs.select(*COLUMNS, F.concat_ws("/", *marks).alias("row"))
    taken = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    copies = saved(
        mix_documents(rows, row="row")
        .groupBy("row")
        .agg(F.sum(taken).cast("int").alias("copies"), F.count("*").alias("equal"))
        .where("copies > 0"),
        "copies",
    )
    joined = rows.join(copies, "row")
    once = joined.where("equal = 1").unionByName(joined.where("equal > 1").dropDuplicates(["row"]))
    return once.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packed", packed),
]

# Near copies, edit distances and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
