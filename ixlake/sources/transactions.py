"""Transaction feeds: JSON files, text batches, streams and the parquet archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ixlake.schema import TRANSACTION


def normalise(raw: DataFrame) -> DataFrame:
    """Engine columns from the wire fields. ``timestamp`` is epoch milliseconds."""
    return raw.select(
        "signature",
        "slot",
        F.timestamp_millis("timestamp").cast("timestamp_ntz").alias("ts"),
        F.col("feePayer").alias("fee_payer"),
        "description",
        "instructions",
        *[c for c in ("feed_partition", "feed_offset", "file", "text", "reason") if c in raw.columns],
    )


def _files(reader, path: str, lines: bool) -> DataFrame:
    """``value`` and arrival of every file, or of every line as a batch of one."""
    text = reader.text(path, wholetext=not lines)
    # A file arrives at its modification time; files of one time go by name.
    named = text.select(
        F.unix_micros("_metadata.file_modification_time").alias("feed_partition"),
        F.col("_metadata.file_path").alias("file"),
        "value",
    )
    if not lines:
        return named
    return named.filter(F.trim("value") != "").withColumn("value", F.concat(F.lit("["), "value", F.lit("]")))


def _feed(files: DataFrame, lines: bool) -> DataFrame:
    """Engine columns of every transaction in arrival order, and every rejected text with its reason.

    ``feed_offset`` orders the transactions of a file time: first by file, then by place in the array. Lines of one
    file are read in parallel and have no number; they go by a hash of the line.
    """
    judged = judge_batches(files)
    place = F.xxhash64("text") if lines else F.coalesce("position", F.lit(0)).cast("bigint")
    # 31 bits of the file's name, then the place in the file.
    offset = F.shiftleft(F.pmod(F.xxhash64("file"), F.lit(1 << 31)), 32) + F.pmod(place, F.lit(1 << 32))
    return normalise(judged.withColumn("feed_offset", offset))


def read_feed(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Transactions of files, and what could not be read as (feed_partition, feed_offset, file, text, reason).

    A file holds a JSON array; with ``lines`` an object per line, and then files are split. Reasons
    are those of :func:`judge_batches`.
    """
    feed = _feed(_files(spark.read, path, lines), lines)
    kept = feed.filter("reason IS NULL").drop("file", "text", "reason")
    return kept, feed.filter("reason IS NOT NULL").select("feed_partition", "feed_offset", "file", "text", "reason")


def stream_feed(spark: SparkSession, path: str, files_per_trigger: int = 100, lines: bool = False) -> DataFrame:
    """The same as one stream: rejected texts are rows with a ``reason``, for ``BatchIngest`` to store."""
    return _feed(_files(spark.readStream.option("maxFilesPerTrigger", files_per_trigger), path, lines), lines)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The transactions of :func:`read_feed`."""
    return read_feed(spark, path, lines)[0]


def stream_json(spark: SparkSession, path: str, files_per_trigger: int = 100, lines: bool = False) -> DataFrame:
    """The transactions of :func:`stream_feed`."""
    feed = stream_feed(spark, path, files_per_trigger, lines)
    return feed.filter("reason IS NULL").drop("file", "text", "reason")


def parse_batches(df: DataFrame, value: str = "value") -> DataFrame:
    """A text column of pushed batches (such as a Kafka value) to transactions.

    What :func:`split_batches` keeps. Works on batch and stream input. Other columns, such as
    the source's partition and offset, are kept.
    """
    return split_batches(df, value)[0]


def judge_batches(df: DataFrame, value: str = "value") -> DataFrame:
    """Every transaction of pushed batches, with ``position``, ``text`` and ``reason``.

    A batch that is not a JSON array (``not_an_array``) or doesn't parse (``broken_json``) is
    rejected as a whole. A transaction whose ``slot`` or ``timestamp`` is no whole number is
    rejected alone (``bad_slot``, ``bad_timestamp``); a missing or null one is none. An element that is
    no object is rejected (``no_object``). The reason is NULL for the others, whose fields are columns.
    """
    others = [c for c in df.columns if c != value]
    text = F.col(value)
    # Elements as they are written, so that a value is seen before it is converted.
    listed = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    judged = df.withColumn("_items", F.when(F.ltrim(text).startswith("["), listed))
    whole = F.when(~F.coalesce(F.ltrim(text).startswith("["), F.lit(False)), F.lit("not_an_array")).when(
        F.col("_items").isNull(), F.lit("broken_json")
    )
    judged = judged.withColumn("_whole", whole)
    items = judged.select(*others, text.alias("_batch"), "_whole", F.posexplode_outer("_items").alias("position", "_item"))
    # An empty array gives no transaction; a rejected batch gives one row.
    items = items.filter("_whole IS NOT NULL OR position IS NOT NULL")
    # A transaction is parsed and judged once: one-element explodes keep both from being copied into the filters
    # on the reason.
    is_object = F.coalesce(F.ltrim("_item").startswith("{"), F.lit(False))
    items = items.withColumn("_tx", F.explode(F.array(F.when(is_object, F.from_json("_item", TRANSACTION)))))
    checks = [F.when(_no_whole_number(name), F.lit(f"bad_{name}")) for name in _NUMBERS]
    reason = F.coalesce(F.col("_whole"), F.when(~is_object, F.lit("no_object")), *checks)
    return items.withColumn("reason", F.explode(F.array(reason))).select(
        *others,
        "position",
        F.coalesce("_item", "_batch").alias("text"),
        "reason",
        F.when(F.col("reason").isNull(), F.col("_tx")).alias("_tx"),
    ).select(*others, "position", "text", "reason", "_tx.*")


_NUMBERS = ("slot", "timestamp")


def _no_whole_number(name: str) -> Column:
    """Whether the transaction ``_item``, parsed as ``_tx``, has a value in a number's place that is none.

    A parsed number is one. The text is searched again only where there is none though the name occurs (or an
    escape that may spell it), or where the name occurs twice.
    """
    item, quoted = F.col("_item"), f'"{name}"'
    named = item.contains(quoted)
    around = F.octet_length(F.substring_index(item, quoted, 1)) + F.octet_length(F.substring_index(item, quoted, -1))
    twice = named & (around + len(quoted) != F.octet_length(item))
    missing = F.col("_tx").getField(name).isNull() & (named | item.contains("\\u"))
    found = F.get_json_object(item, f"$.{name}")
    # A branch and not a conjunction, whose common parts Spark would compute for every row.
    return F.when(missing | twice, found.isNotNull() & found.try_cast("bigint").isNull())


def split_batches(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Transactions of pushed batches, and what cannot be read, as ``text`` with its ``reason``."""
    others = [c for c in df.columns if c != value]
    judged = judge_batches(df, value)
    kept = judged.filter("reason IS NULL").drop("position", "text", "reason")
    return kept, judged.filter("reason IS NOT NULL").select(*others, "text", "reason")
