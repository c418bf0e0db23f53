"""Mixing sources to target weights by subset-sum budget fitting.

A source's budget of words is filled by whole copies of the source first. The rest is fitted
with the histogram of exact document lengths: an even share of every length, and a bounded
knapsack over what is left. Which documents of a length are taken is drawn by a seeded
hash, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ixlake.llm.common import saved

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3  # times a source or document is taken at most
KNAPSACK = 1 << 16  # words of budget the dynamic program fits
CELLS = 256  # hash ranges a length is divided into before its documents are ranked


def word_count(text: str = "text") -> Column:
    """Runs of characters other than the six ASCII white space ones; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(per_source: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target of every row of (source, source_size).

    Sources are numbered by code point, null last, and weighed in turn. Targets sum to the
    sizes' total; one that passes ``most`` times its source is set there, and what it
    leaves is shared among the others by weight until none passes.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = saved(
        per_source.select(
            "source",
            "source_size",
            F.element_at(listed, (place % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(float(most))).alias("cap"),
        ),
        "sources",
    )
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"])
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        now = rows.agg(
            F.count(F.when(full, 1)).alias("capped"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if now["capped"] == capped or not now["weights"]:
            break
        capped, level = now["capped"], (total - now["taken"]) / now["weights"]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", target.alias("target"))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length sum up to what is nearest to the budget.

    Bounded knapsack by dynamic programming: reachable sums are the bits of an integer, and
    a count is split into powers of two. Sums are traced back over the stored steps.
    """
    chosen = np.zeros(len(lengths), np.int64)
    usable = lengths[(lengths > 0) & (counts > 0)]
    if not len(usable):
        return chosen
    top = budget + min(budget, int(usable.min()))  # the nearest sum above may be nearer
    mask = (1 << (top + 1)) - 1
    reach, steps = 1, []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if length <= 0 or length > top:
            continue
        left, size = min(count, top // length), 1
        while left > 0:
            take = min(size, left)
            new = (reach | (reach << (take * length))) & mask
            if new != reach:
                steps.append((i, take, reach))
                reach = new
            left -= take
            size *= 2
        if reach >> budget & 1 or len(steps) >= 4096:
            break
    total = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    if above:
        next_up = budget + 1 + (above & -above).bit_length() - 1
        if next_up - budget < budget - total:
            total = next_up
    for i, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[i] += take
            total -= take * int(lengths[i])
    return chosen


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents of each length whose sizes sum up to what is near ``budget``."""
    order = np.argsort(-lengths, kind="stable")
    size, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    everything = int((size * count).sum())
    if not everything or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    chosen = np.floor(count * min(1.0, budget / everything)).astype(np.int64)
    left = budget - int((size * chosen).sum())
    if left > KNAPSACK:
        # Long documents first, down to what the dynamic program can fit exactly.
        for i in range(len(size)):
            if size[i] > 0:
                more = min(int(count[i] - chosen[i]), max(0, left - KNAPSACK // 2) // int(size[i]))
                chosen[i] += more
                left -= more * int(size[i])
    if left > 0:
        chosen += _knapsack(size, count - chosen, min(left, KNAPSACK))
    out = np.empty(len(lengths), np.int64)
    out[order] = chosen
    return out


def _fit(histogram: pd.DataFrame) -> pd.DataFrame:
    target, total = float(histogram["target"].iloc[0]), float(histogram["source_size"].iloc[0])
    lengths, counts = histogram["size"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    whole = int(min(MOST, target // total)) if total > 0 else 0
    best = None
    # Whole copies and one more of some documents; only where that stays off the target
    # (few documents), fewer whole copies and up to three of some documents.
    for copies, extra in ((whole, 1), (whole, MOST - whole), (whole - 1, MOST - whole + 1), (0, MOST)):
        if copies < 0 or extra < 0:
            continue
        rest = int(round(target - copies * total))
        chosen = fit_counts(lengths, counts * min(extra, MOST - copies), rest)
        miss = abs(rest - int((lengths * chosen).sum()))
        if best is None or miss < best[0]:
            best = (miss, copies, chosen)
        if miss * 1000 <= target:
            break
    out = histogram[["source", "source_size", "target", "size", "n"]].copy()
    # The first ``chosen % n`` documents of a length by the draw get one copy more.
    out["copies"] = best[1] + best[2] // counts
    out["chosen"] = best[2] % counts
    return out.drop(columns="n")


def mix_documents(
    docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, row: str | None = None
) -> DataFrame:
    """How many words of every row of (doc_id, text, source) the mix takes.

    Returns doc_id, size, source, source_size, target and taken (size times the number of
    copies, 0 to 3). A null source is a source of its own. Null and empty texts have size 0
    and take nothing. Repeated rows are documents of their own; which of them is taken
    does not matter, since they are equal. Empty input gives an empty result.

    ``row`` names a column that tells all rows apart. It is returned as well, and rows without
    an id are then drawn by their texts.
    """
    key = [] if row is None else [F.col(row).alias("row"), F.xxhash64("text").alias("text_hash")]
    rows = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("size"), "source", *key), "sizes"
    )
    histogram = saved(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(per_source, weights)
    fitted = saved(
        histogram.alias("h")
        .join(targets.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")))
        .select("h.source", "h.size", "h.n", "t.source_size", "t.target")
        .groupBy("source")
        .applyInPandas(
            _fit, "source string, source_size long, target double, size long, copies int, chosen long"
        ),
        "fitted",
    )
    # A null adds nothing to the hash: the draw of a row with an id is the same either way.
    by_text = [] if row is None else [F.when(F.col("doc_id").isNull(), F.col("text_hash"))]
    drawn = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), *by_text)).withColumn(
        "cell", F.shiftrightunsigned(F.col("draw"), 56).cast("int")
    )
    # A length's documents are ranked inside hash ranges, so a length that a third of all
    # documents share is spread over many tasks.
    cells = drawn.groupBy("source", "size", "cell").agg(F.count("*").alias("in_cell"))
    below = F.sum("in_cell").over(Window.partitionBy("source", "size").orderBy("cell")) - F.col("in_cell")
    quota = (
        cells.select("source", "size", "cell", below.alias("below"))
        .alias("c")
        .join(
            fitted.alias("f"),
            F.col("c.source").eqNullSafe(F.col("f.source")) & (F.col("c.size") == F.col("f.size")),
        )
        .select(
            "c.source", "c.size", "c.cell", "f.source_size", "f.target", "f.copies",
            (F.col("f.chosen") - F.col("c.below")).alias("quota"),
        )
    )
    order = ["draw", "doc_id", *([] if row is None else ["text_hash", "row"])]
    ranked = drawn.withColumn(
        "rank", F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy(*order))
    )
    same = (
        F.col("r.source").eqNullSafe(F.col("q.source"))
        & (F.col("r.size") == F.col("q.size"))
        & (F.col("r.cell") == F.col("q.cell"))
    )
    times = F.col("q.copies") + F.when(F.col("r.rank") <= F.col("q.quota"), 1).otherwise(0)
    return (
        ranked.alias("r")
        .join(quota.alias("q"), same)
        .select(
            "r.doc_id", "r.size", "r.source", "q.source_size", "q.target",
            (F.col("r.size") * times).cast("long").alias("taken"),
            *([] if row is None else [F.col("r.row").alias(row)]),
        )
    )
