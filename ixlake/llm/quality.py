"""Quality rules: frequency of lines across the documents of a host.

Lines are normalised and hashed. A line that many distinct documents of one host hold is
boilerplate there and is removed; a document of which too little remains is rejected. Rules
on single documents (length, repeated words) come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ixlake.llm.common import mixed, hashed, saved, slices, split_words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# A line is boilerplate of a host when more than so many of its distinct documents hold
# it, and more than this percentage of them.
MIN_DOCUMENTS = 10
MAX_SHARE_PERCENT = 1.0
# A document is depleted when fewer than this percentage of its words remain.
MIN_LEFT_PERCENT = 30

_MEASURES = (
    "doc_id long, source string, text_key long, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
)


def _repeated(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of words found twice or more in it."""
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(counts), np.int64)
    total = np.zeros(n, np.uint64)
    for step in range(WINDOW):
        total = mixed(total + hashes[step : step + n] + np.uint64(step + 1))
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    keys = mixed(total[inside] + owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = inside[twice]
    edges[at] += 1
    edges[at + WINDOW] -= 1
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(counts)).astype(np.int64)


def normal_lines(text: str) -> Iterator[tuple[int, int, int]]:
    """Position, hash and number of words of each line with a word.

    Lines are compared without case and with single blanks between words.
    """
    for at, line in enumerate(text.encode().lower().split(b"\n")):
        words = line.split()
        if words:
            yield at, xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63), len(words)


def _lines(texts: list[str | None]) -> tuple[list, list, list]:
    lines, words, duplicates = [], [], []
    for text in texts:
        own: dict[int, int] = {}
        for _, key, n in normal_lines(text or ""):
            own[key] = own.get(key, 0) + n
        raw = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        lines.append(list(own))
        words.append(list(own.values()))
        duplicates.append(len(raw) - len(set(raw)))
    return lines, words, duplicates


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = pc.fill_null(part.column("text"), "")
            starts, flat = split_words(texts)
            lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=ends[1:])
            listed = texts.to_pylist()
            lines, line_words, duplicates = _lines(listed)
            plain = pc.utf8_length(pc.replace_substring_regex(texts, pattern=r"[#*$%&|<>]", replacement=""))
            symbols = pc.subtract(pc.utf8_length(texts), plain)
            keys = [xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in listed]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("source"),
                    pa.array(keys, pa.int64()),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array(ends[starts[1:]] - ends[starts[:-1]], pa.int64()),
                    symbols.cast(pa.int64()),
                    pa.array(duplicates, pa.int64()),
                    pa.array(_repeated(hashed(flat), starts), pa.int64()),
                    pa.array(lines, pa.list_(pa.int64())),
                    pa.array(line_words, pa.list_(pa.int32())),
                ],
                ["doc_id", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 "n_repeat_words", "lines", "line_words"],
            )


def measure(docs: DataFrame) -> DataFrame:
    """Counts and distinct line hashes of every row of (doc_id, text, source).

    A null text counts as an empty one. Repeated rows are measured each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return rows.mapInArrow(_measured, _MEASURES)


def boilerplate(
    measured: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share_percent: float = MAX_SHARE_PERCENT
) -> DataFrame:
    """(source, frequent): the hashes of the lines above the limits, for each host.

    Equal texts of a host are one document, so copies do not make their own lines
    frequent. A line above the share limit is one of at most 100 / share times the mean
    number of lines of a document, so a host's array stays short.
    """
    distinct = measured.groupBy("source", "text_key").agg(F.first("lines").alias("lines"))
    hosts = distinct.groupBy("source").agg(F.count("*").alias("documents"))
    counts = (
        distinct.select("source", F.explode("lines").alias("line"))
        .groupBy("source", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > min_documents)
    )
    return (
        counts.alias("c")
        .join(hosts.alias("h"), F.col("c.source").eqNullSafe(F.col("h.source")))
        .where(F.col("c.n") * 100.0 > F.col("h.documents") * F.lit(max_share_percent))
        .groupBy("c.source")
        .agg(F.collect_list("c.line").alias("frequent"))
        .select("source", "frequent")
    )


def judge_documents(docs: DataFrame, frequent: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """The verdict on every row of (doc_id, text, source).

    Returns doc_id, source, text_key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_boilerplate_words and kept. A null or empty text has no
    words and fails the base rules. A null source is a host of its own. Empty input gives
    an empty result.
    """
    measured = saved(measure(docs), "measures") if measured is None else measured
    frequent = boilerplate(measured) if frequent is None else frequent
    at = F.arrays_zip(F.col("m.lines").alias("line"), F.col("m.line_words").alias("words"))
    removed = F.aggregate(
        F.filter(at, lambda x: F.array_contains(F.col("f.frequent"), x["line"])),
        F.lit(0).cast("long"),
        lambda total, x: total + x["words"],
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    depleted = (left < MIN_WORDS) | (left * 100 < F.col("n_words") * MIN_LEFT_PERCENT)
    return (
        measured.alias("m")
        .join(frequent.alias("f"), F.col("m.source").eqNullSafe(F.col("f.source")), "left")
        .select(
            "m.doc_id", "m.source", "m.text_key", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines",
            "m.n_repeat_words",
            F.when(F.col("f.frequent").isNull(), F.lit(0).cast("long")).otherwise(removed).alias("n_boilerplate_words"),
        )
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )


def _without(text: str, frequent: frozenset[int]) -> str:
    gone = {at for at, key, _ in normal_lines(text) if key in frequent}
    return "\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone) if gone else text


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, all columns, without the lines above the limits.

    ``text`` and, where present, ``n_chars`` are those of the cleaned text.
    """
    measured = saved(measure(docs), "measures")
    frequent = saved(boilerplate(measured), "boilerplate")
    names = docs.columns
    # The same rules as in judge_documents, on the rows themselves: a join of verdicts
    # by id would move all texts.
    joined = docs.alias("d").join(frequent.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    schema = docs.schema
    rows = joined.select(*[F.col(f"d.`{n}`") for n in names], F.col("f.frequent").alias("__frequent"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, frozenset[int]] = {}
        for batch in batches:
            for part in slices(batch):
                counts = next(_measured(iter([part.select(["doc_id", "text", "source"])])))
                n_words = counts.column("n_words").to_numpy()
                repeats = counts.column("n_repeat_words").to_numpy()
                passed = (n_words >= MIN_WORDS) & (100 * repeats <= MAX_REPEAT_PERCENT * n_words)
                texts, kept = part.column("text").to_pylist(), []
                frequents = part.column("__frequent")
                for i in np.flatnonzero(passed).tolist():
                    text, removed = texts[i], 0
                    cell = frequents[i]
                    if cell.is_valid and len(cell):
                        numbers = cell.values.to_numpy()
                        key = xxhash.xxh3_64_intdigest(numbers.tobytes())
                        if key not in held:
                            held.clear()
                            held[key] = frozenset(numbers.tolist())
                        removed = sum(n for _, line, n in normal_lines(text) if line in held[key])
                        if removed:
                            texts[i] = _without(text, held[key])
                    left = int(n_words[i]) - removed
                    if left >= MIN_WORDS and left * 100 >= int(n_words[i]) * MIN_LEFT_PERCENT:
                        kept.append(i)
                columns = {n: part.column(n) for n in names}
                columns["text"] = pa.array(texts, part.schema.field("text").type)
                if "n_chars" in columns:
                    columns["n_chars"] = pc.utf8_length(columns["text"]).cast(part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names).take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(cleaned, schema)
