"""Line dedup by a segment-partition edit join.

Lines of any length are compared as a whole. Longer ones are also matched when they are a few edits
apart, one from 8 characters on and two from 32 on; of two lines the shorter one decides. Two
lines within edit distance ``limit`` share one of any limit + 1 segments of the shorter
one, at a position that is off by few places. Each distinct line is indexed by its segments and
probed with its substrings at those places, for every length it may be matched with.
Candidates are verified by a banded bit-parallel edit distance, many pairs at a time.

Of a group of equal or near lines the first occurrence stays (by doc_id, then place in the
document) and all others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ixlake.llm.common import discard, mixed, saved, slices, with_least
from ixlake.llm.links import Side, connect, shared_postings

LIMIT = 2
# (edits, characters) from which a line may be so many edits from another one that is not shorter. Below
# the first of them an edit changes a good part of a line, and only equal lines are repeats.
ALLOWED = ((1, 8), (2, 32))
SEEN = 500_000  # distinct lines a task remembers so as not to post them again
_FACTOR = 0x9E3779B97F4A7C15


def normal_line(line: str) -> str:
    """Lines are compared with single blanks between words and none around them."""
    return " ".join(line.split())


def line_key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def considered(text: str | None, least: int = 1) -> Iterator[tuple[int, str]]:
    """Place and normal form of the lines of a text with a word and at least so many characters."""
    for at, line in enumerate((text or "").split("\n")):
        line = normal_line(line)
        if len(line) >= least:
            yield at, line


def classes(limit: int) -> list[tuple[int, int, int]]:
    """(edits, least characters, most characters) of the lines that allow any edits."""
    steps = [(edits, chars) for edits, chars in ALLOWED if edits <= limit]
    ends = [chars - 1 for _, chars in steps[1:]] + [1 << 31]
    return [(edits, chars, end) for (edits, chars), end in zip(steps, ends, strict=True)]


def allowed(sizes: np.ndarray, limit: int) -> np.ndarray:
    """The edits that lines of these lengths allow."""
    out = np.zeros(len(sizes), np.int64)
    for edits, least, _ in classes(limit):
        out[sizes >= least] = edits
    return out


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lines, and the line of each."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return points, np.repeat(np.arange(len(lines)), np.fromiter(map(len, lines), np.int64, len(lines)))


def letter_marks(lines: list[str]) -> np.ndarray:
    """For each line, how often letters of 16 classes occur, four bits a class.

    An edit changes two of the numbers by one at most, so lines whose numbers differ by more
    in sum than twice the limit are farther apart than the limit.
    """
    return _marks(*_points(lines), len(lines))


def neighbour_marks(lines: list[str]) -> np.ndarray:
    """As :func:`letter_marks`, of pairs of neighbouring letters.

    An edit takes two of these pairs away at most and adds two, so lines whose numbers differ by
    more in sum than four times the limit are farther apart than the limit.
    """
    points, owner = _points(lines)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    return _marks(mixed(points[inside]) + points[inside + 1], owner[inside], len(lines))


def _marks(points: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    kind = (mixed(points + np.uint64(7)) >> np.uint64(60)).astype(np.int64)
    counts = np.bincount(owner * 16 + kind, minlength=16 * n).reshape(-1, 16) & 15
    return (counts.astype(np.uint64) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def marks_allow(one: Column, other: Column, most: int) -> Column:
    """Whether the numbers of two marks differ by ``most`` in sum or less; they wrap at 16."""
    total = F.lit(0)
    for place in range(0, 64, 4):
        part = lambda x: F.shiftright(x, place).bitwiseAND(F.lit(15))  # noqa: B023, E731
        apart = F.abs(part(one) - part(other))
        total = total + F.least(apart, F.lit(16) - apart)
    return total <= most


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            row, place, key = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                for at, line in considered(text):
                    row.append(i)
                    place.append(at)
                    key.append(line_key(line))
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(rows),
                    part.column("text_key").take(rows),
                    pa.array(place, pa.int32()),
                    pa.array(key, pa.int64()),
                ],
                ["doc_id", "text_key", "place", "line"],
            )


class Segments:
    """Hashes of the segments and probed substrings of many lines at once.

    Only lines of ``low`` to ``high`` characters are indexed, and probed for.
    """

    def __init__(self, lines: list[str], limit: int, low: int = 0, high: int = 1 << 31):
        self.limit = limit
        self.low = low
        self.high = high
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        self.begin = np.cumsum(self.sizes) - self.sizes
        factor, inverse = np.uint64(_FACTOR), np.uint64(pow(_FACTOR, -1, 1 << 64))
        n = len(points)
        up = np.full(n + 1, factor)
        up[0] = 1
        self.down = np.full(n + 1, inverse)
        self.down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(points + np.uint64(1)) * up[:n], out=self.sums[1:])

    def _hash(self, line: np.ndarray, at: np.ndarray, size: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Hash of a part of each line, with its segment number and line length mixed in."""
        begin = self.begin[line] + at
        part = (self.sums[begin + size] - self.sums[begin]) * self.down[begin]
        return mixed(mixed(part) + tag.astype(np.uint64) * np.uint64(_FACTOR)).view(np.int64)

    def _segment(self, length: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of a segment of lines of these lengths; later ones may be one longer."""
        k = self.limit + 1
        base, more = length // k, length % k
        longer = np.maximum(0, number - (k - more))
        return number * base + longer, base + (number >= k - more)

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and line numbers of all segments."""
        every = np.flatnonzero((self.sizes >= self.low) & (self.sizes <= self.high))
        sizes = self.sizes[every]
        keys = []
        for number in range(self.limit + 1):
            at, size = self._segment(sizes, number)
            keys.append(self._hash(every, at, size, sizes * (self.limit + 1) + number))
        return np.concatenate(keys), np.tile(every, self.limit + 1)

    def probes(self, own: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Keys and line numbers of the substrings that may equal a segment of another line.

        For a line of length s and an indexed one of length s - d, segment ``number``
        can begin ``number`` places off from the left, and as many off the right, with the
        difference d, as there are segments after it. Without ``own`` a line's own segments, which are in the index, are left out.
        """
        keys, lines = [], []
        for d in range(self.limit + 1):
            length = self.sizes - d
            meant = (length >= self.low) & (length <= self.high)
            for number in range(self.limit + 1):
                at, size = self._segment(length, number)
                after = self.limit - number
                low = np.maximum(np.maximum(0, at - number), at + d - after)
                high = np.minimum(np.minimum(self.sizes - size, at + number), at + d + after)
                for shift in range(-self.limit, 2 * self.limit + 1):
                    if not (own or d or shift):
                        continue
                    inside = np.flatnonzero(meant & (at + shift >= low) & (at + shift <= high))
                    if len(inside):
                        keys.append(
                            self._hash(
                                inside, at[inside] + shift, size[inside], length[inside] * (self.limit + 1) + number
                            )
                        )
                        lines.append(inside)
        return (np.concatenate(keys), np.concatenate(lines)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _posted(limit: int, least: int):
    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                own: dict[int, str] = {}
                for text in part.column("text").to_pylist():
                    for _, line in considered(text, least):
                        key = line_key(line)
                        if key not in seen:
                            own[key] = line
                if not own:
                    continue
                if len(seen) < SEEN:
                    seen.update(own)
                ids = np.fromiter(own, np.int64, len(own))
                lines = list(own.values())
                sizes = np.fromiter(map(len, lines), np.int64, len(lines))
                for edits, low, high in classes(limit):
                    # Lines of the class are indexed; they and somewhat longer ones are probed with.
                    near = np.flatnonzero((sizes >= low) & (sizes <= high + edits))
                    segments = Segments([lines[i] for i in near.tolist()], edits, low, high)
                    for (keys, at), post in ((segments.index(), True), (segments.probes(own=False), False)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys), pa.array(ids[near[at]]), pa.array(np.full(len(keys), post))], ["key", "id", "post"]
                        )

    return posted


def banded_distances(first: list[str], second: list[str], limit: int) -> np.ndarray:
    """Edit distances of the pairs, exact up to ``limit`` and above it otherwise.

    A column of the distance matrix is held as its vertical steps, one bit a row, for the
    2 * limit + 1 rows around the diagonal only. The band moves down a row with each
    letter, for all pairs at once; pairs are told apart by their place in the arrays.
    """
    pairs = len(first)
    m = np.fromiter(map(len, first), np.int64, pairs)
    n = np.fromiter(map(len, second), np.int64, pairs)
    band = 2 * limit + 1
    far = (np.abs(m - n) > limit) | (np.minimum(m, n) <= limit)
    out = np.where(far, limit + 1, 0)
    for i in np.flatnonzero((np.minimum(m, n) <= limit) & (np.abs(m - n) <= limit)).tolist():
        out[i] = _plain_distance(first[i], second[i])
    live = np.flatnonzero(~far)
    if not len(live):
        return out
    m, n = m[live], n[live]
    width = int(m.max()) + 4 * limit + 2
    rows = np.zeros((len(live), width), np.int64) - 1
    columns = np.zeros((len(live), int(n.max())), np.int64) - 2
    for k, i in enumerate(live.tolist()):
        rows[k, limit : limit + m[k]] = np.frombuffer(first[i].encode("utf-32-le", "surrogatepass"), "<u4")
        columns[k, : n[k]] = np.frombuffer(second[i].encode("utf-32-le", "surrogatepass"), "<u4")
    full = np.int64((1 << band) - 1)
    weights = (1 << np.arange(band)).astype(np.int64)
    # Bit b of column j stands for row j + b - limit. Rows up to 0 have no step down.
    plus = np.full(len(live), full & ~((1 << limit) - 1), np.int64)
    minus = np.zeros(len(live), np.int64)
    distance = np.full(len(live), limit, np.int64)
    for j in range(1, int(n.max()) + 1):
        active = j <= n
        equal = (rows[:, j - 1 : j - 1 + band] == columns[:, j - 1 : j]) @ weights
        same = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        across_plus = (minus | ~(same | plus)) & full
        across_minus = same & plus
        # Down the lower edge of the band first, then along the last row.
        diagonal = j <= m - limit
        bit = np.where(diagonal, band - 1, np.clip(m - j + limit, 0, band - 1))
        step = np.where(diagonal, 1 - (same >> bit & 1), (across_plus >> bit & 1) - (across_minus >> bit & 1))
        distance += np.where(active, step, 0)
        below = same >> 1
        plus, minus = (across_minus | ~(below | across_plus)) & full, below & across_plus
    out[live] = np.minimum(distance, limit + 1)
    return out


def _plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _verified(limit: int):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "one", 1 << 20):
                first, second = part.column("one").to_pylist(), part.column("other").to_pylist()
                # Pairs of like length together, so none waits for a much longer one.
                order = np.argsort([len(x) for x in first], kind="stable")
                near = np.zeros(len(first), bool)
                shorter = np.fromiter(map(min, map(len, first), map(len, second)), np.int64, len(first))
                may = allowed(shorter, limit)
                for start in range(0, len(order), 1024):
                    some = order[start : start + 1024].tolist()
                    distances = banded_distances([first[i] for i in some], [second[i] for i in some], limit)
                    near[some] = distances <= may[some]
                yield part.select(["a", "b"]).filter(pa.array(near))

    return verified


def _texts_of_lines(least: int):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = {line_key(x): x for text in part.column("text").to_pylist() for _, x in considered(text, least)}
                lines = list(found.values())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(found), pa.int64()),
                        pa.array(lines, pa.string()),
                        pa.array(letter_marks(lines), pa.int64()),
                        pa.array(neighbour_marks(lines), pa.int64()),
                    ],
                    ["line", "string", "letters", "neighbours"],
                )

    return texts


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")
    )


def repeated_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text_key, places): the lines to remove from each document that has any.

    Lines without a word are left alone; all others are compared for equality, and those of 8 characters or more
    for few edits (``ALLOWED``). Rows with equal doc_id and text are one document here: both
    keep the same lines. A null doc_id comes before all others.
    """
    rows = _keyed(docs)
    lines = saved(
        rows.mapInArrow(_occurrences, "doc_id long, text_key long, place int, line long"), "lines"
    )
    where = F.struct("doc_id", "text_key", "place")
    distinct = saved(
        lines.groupBy("line").agg(F.min(where).alias("first"), F.count("*").alias("n")), "distinct-lines"
    )
    least = classes(limit)[0][1] if classes(limit) else 1 << 31
    posted = rows.select("text").mapInArrow(_posted(limit, least), "key long, id long, post boolean")
    posted = saved(posted, "segments")
    index = posted.where("post")
    # A line's own segments are probes as well, so an indexed key that probes of
    # another line hit shows up here; all other postings go no further.
    owners = index.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    met = (
        posted.select("key", "id").join(owners, "key")
        .where((F.col("id") != F.col("least")) | (F.col("id") != F.col("most")))
        .select("key", "id", F.lit(False).alias("post"), "least", "most")
    )
    met = saved(met, "met")
    hit = met.select("key").distinct()
    postings = met.select("key", "id", "post").unionByName(index.join(hit, "key", "left_semi"))
    # The line that others were made from shares most of its keys, and so is a pivot first.
    weights = postings.groupBy("id").agg(F.count_distinct("key").cast("double").alias("weight"))
    sharing = shared_postings(postings.join(weights, "id"))
    discard(posted, met)
    # The lines that share a key, taken from the documents of their first occurrence.
    needed = saved(sharing.select(F.col("id").alias("line")).distinct(), "needed")
    owning = distinct.join(needed, "line", "left_semi").select(
        F.col("first.doc_id").alias("doc"), F.col("first.text_key").alias("key")
    ).distinct()
    strings = saved(
        rows.join(owning, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_key") == F.col("key")), "left_semi")
        .select("text")
        .mapInArrow(_texts_of_lines(least), "line long, string string, letters long, neighbours long")
        .join(needed, "line", "left_semi")
        .dropDuplicates(["line"]),
        "strings",
    )
    marks = strings.select(F.col("line").alias("id"), "letters", "neighbours")
    postings = saved(sharing.join(marks, "id"), "postings")
    discard(sharing)

    def alike(one: Side, other: Side) -> Column:
        letters = marks_allow(one("letters"), other("letters"), 2 * limit)
        return letters & marks_allow(one("neighbours"), other("neighbours"), 4 * limit)

    def verify(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(strings.select(F.col("line").alias("a"), F.col("string").alias("one")), "a")
            .join(strings.select(F.col("line").alias("b"), F.col("string").alias("other")), "b")
            .where(F.abs(F.length("one") - F.length("other")) <= limit)
            .mapInArrow(_verified(limit), "a long, b long")
        )

    labels = connect(postings, verify, alike, sharp=True, few_keys=True)
    discard(postings, needed, strings)
    labelled = distinct.join(labels.withColumnRenamed("node", "line"), "line", "left").select(
        "line", "first", "n", "component"
    )
    repeated = labelled.where((F.col("n") > 1) | F.col("component").isNotNull())
    kept = with_least(repeated, "component", "line", "first", "kept").select("line", F.coalesce("kept", "first").alias("kept"))
    return (
        lines.join(kept, "line")
        .where(~F.struct("doc_id", "text_key", "place").eqNullSafe(F.col("kept")))
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set("place")).alias("places"))
    )


def _remaining(text: Column, places: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(places, i))
    return F.when(places.isNull(), text).otherwise(F.array_join(lines, "\n"))


def dedup_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs``, all rows and columns, without repeated lines, and n_lines and n_removed.

    ``text`` and, where present, ``n_chars`` are those of what remains. A null text stays
    null; an empty one has one empty line. Input columns named n_lines or n_removed give way to these.
    Empty input gives an empty result.
    """
    removed = saved(repeated_lines(docs, limit), "removed")
    text = F.coalesce(F.col("d.text"), F.lit(""))
    names = [n for n in docs.columns if n not in ("n_lines", "n_removed")]
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64(text) == F.col("r.text_key"))
    left = _remaining(F.col("d.text"), F.col("r.places"))
    changed = {"text": left}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("r.places").isNull(), F.col("d.n_chars")).otherwise(
            F.length(left).cast(docs.schema["n_chars"].dataType)
        )
    return docs.alias("d").join(removed.alias("r"), same, "left").select(
        *[changed.get(n, F.col(f"d.`{n}`")).alias(n) for n in names],
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.when(F.col("r.places").isNull(), 0).otherwise(F.size("r.places")).cast("long").alias("n_removed"),
    )
