"""Directories of interface descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _columns():
    return (
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("text"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, modified, text)`` of every ``*.json`` file; documents are read in the tasks."""
    return (
        spark.read.option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select(*_columns())
    )


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """New and changed documents as a stream."""
    return (
        spark.readStream.option("pathGlobFilter", "*.json")
        .option("wholetext", "true")
        .text(path)
        .select(*_columns())
    )
