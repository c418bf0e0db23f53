"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound by multiplying its letters'
vectors, each permuted (rotated) by its place. A text is the bundle (sum) of its n-grams, a language the bundle
of its training texts, and the prediction is the language of the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ixlake.llm.common import slices

DIMENSIONS = 512
GRAM = 3
SYMBOLS = 64  # a-z, the gap between words, and classes that other letters hash into
SEED = 20240607
UNKNOWN = "und"
GROUP = 512  # texts worked on at once
SLICE_BYTES = 2 << 20


def _symbol_table() -> np.ndarray:
    """The symbol of every code point: 0 for what is no letter, 1 to 26 for a to z.

    Other letters share the classes from 27 on by their number. They are random vectors, so
    letters of one class only add some noise to each other.
    """
    table = np.zeros(0x110000, np.int8)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low * 7 % (SYMBOLS - 27)
    return table


class Profiles:
    """Vectors of n-grams and texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions = dimensions
        self.table = _symbol_table()
        random = np.random.default_rng(seed)
        self.letters = (random.integers(0, 2, (SYMBOLS, dimensions), np.int8) * 2 - 1).astype(np.int8)

    def grams(self, keys: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams, given as numbers in base SYMBOLS."""
        out = np.ones((len(keys), self.dimensions), np.int8)
        for place in range(GRAM):
            letter = keys // SYMBOLS**place % SYMBOLS
            out *= np.roll(self.letters, place, axis=1)[letter]
        return out.astype(np.float32)

    def texts(
        self, texts: list[str], rows: np.ndarray | None = None, n_rows: int = 0
    ) -> tuple[np.ndarray, np.ndarray]:
        """Bundles of whole texts, and whether each text has a letter.

        White space, digits and signs are gaps; a run of gaps counts as one, and
        every text begins and ends with one. With ``rows``, texts of one row number share a bundle.
        """
        points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        symbols = self.table[np.concatenate([p for x in points for p in (x, _GAP)])].astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        gap = symbols == 0
        keep = np.ones(len(symbols), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        keep[0] = not gap[0]
        symbols, owner = symbols[keep], owner[keep]
        lettered = np.bincount(owner[symbols > 0], minlength=len(texts)) > 0
        rows, n_rows = (np.arange(len(texts)), len(texts)) if rows is None else (rows, n_rows)
        bundles = np.zeros((n_rows, self.dimensions), np.float32)
        if len(symbols) < GRAM:
            return bundles, lettered
        # A gap goes before the first letter of each text by sharing the gap behind the one before.
        padded = np.concatenate([[0], symbols])
        keys = padded[:-2] * SYMBOLS**2 + padded[1:-1] * SYMBOLS + padded[2:]
        own = owner[1:]  # the text of an n-gram's last symbol
        same = owner[np.maximum(np.arange(len(keys)) - 1, 0)] == own
        same |= padded[:-2] == 0
        keys, own = keys[same], own[same]
        own = rows[own]
        seen = np.zeros(SYMBOLS**GRAM, bool)
        seen[keys] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(SYMBOLS**GRAM, np.int32)
        place[distinct] = np.arange(len(distinct))
        at = place[keys]
        # Counts of a group of texts, times the vectors of their n-grams, in steps of bounded size.
        for begin in range(0, len(distinct), 4096):
            end = min(begin + 4096, len(distinct))
            if len(distinct) > 4096:
                inside = (at >= begin) & (at < end)
                flat = own[inside] * (end - begin) + (at[inside] - begin)
            else:
                flat = own * (end - begin) + at
            counts = np.bincount(flat, minlength=n_rows * (end - begin)).reshape(n_rows, -1)
            bundles += counts.astype(np.float32) @ self.grams(distinct[begin:end])
        return bundles, lettered


_GAP = np.array([32], "<u4")
_HELD: dict[tuple[int, int], Profiles] = {}


def profiles(dimensions: int, seed: int) -> Profiles:
    """This worker's vectors, made from the seed, so they are the same on all workers."""
    if (dimensions, seed) not in _HELD:
        _HELD[dimensions, seed] = Profiles(dimensions, seed)
    return _HELD[dimensions, seed]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            for start in range(0, part.num_rows, GROUP):
                yield part.slice(start, GROUP)


def _summed(dimensions: int, seed: int):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flushed() -> pa.RecordBatch:
            rows = list(held.items())
            out = pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.string()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float64()))],
                ["lang", "bundle"],
            )
            held.clear()
            return out

        for part in _groups(batches):
            coded = part.column("lang").dictionary_encode()
            names, rows = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            bundles, lettered = profiles(dimensions, seed).texts(part.column("text").to_pylist(), rows, len(names))
            for i in np.unique(rows[lettered]).tolist():
                held[names[i]] = held.get(names[i], 0.0) + bundles[i].astype(float)
            if len(held) > 1000:
                yield flushed()
        if held:
            yield flushed()

    return summed


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes from rows of (text, lang): one vector a language.

    Bundles are summed in tasks first, so tasks send one row a language. The result has as
    many vectors as there are languages. Rows without text, letter or language teach nothing.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    parts = rows.mapInArrow(_summed(dimensions, seed), "lang string, bundle array<double>")
    sums = (
        parts.select("lang", F.posexplode("bundle").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("bundle"))
    )
    return {row["lang"]: np.array(row["bundle"]) for row in sums.collect()}


def _predicted(prototypes: dict[str, np.ndarray], dimensions: int, seed: int):
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names]) if names else None
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches):
            texts = pc.fill_null(part.column("text"), "").to_pylist()
            bundles, lettered = profiles(dimensions, seed).texts(texts)
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if matrix is not None:
                bundles = bundles.astype(float)
                norms = np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)
                cosine = (bundles / norms) @ matrix.T
                best = cosine.argmax(1)
                for i in np.flatnonzero(lettered).tolist():
                    langs[i] = names[best[i]]
                    scores[i] = min(1.0, max(0.0, cosine[i, best[i]]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return predicted


def identify_documents(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """The language of every row of (doc_id, text, lang), learned from two thirds of them.

    Rows with crc32(doc_id) mod 3 = 1 are held out; rows without an id teach nothing and
    aren't held out. Returns doc_id, held_out, lang_pred and score. A text that is null
    or without a letter is ``und`` with score 0, and so is every text when nothing could be
    learned. Ties go to the first language by name. Repeated rows get equal predictions.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.coalesce(remainder == 1, F.lit(False)).alias("held_out")
    )
    prototypes = learn(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()), dimensions, seed)
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        _predicted(prototypes, dimensions, seed), "doc_id long, held_out boolean, lang_pred string, score double"
    )
