"""Embedding near-dedup by dual traversal of a cover tree.

Unit vectors of one label form a tree of balls. Its upper levels are DataFrames: a node with
many vectors is split around centres that lie far apart, until they cover the node with half its
radius or reach the fan-out. Pairs of nodes are expanded level by level and dropped when
their balls lie too far apart for any link. What remains are pairs of leaves of bounded
size; a task goes on with both leaves' own small trees: it drops pairs of nodes that are too far apart, takes
pairs that are near enough as linked in whole, and compares vectors only in between.

Equal vectors of a label are one point with a weight. No pairs are stored: a task gives the
number of links of each of its points, and one edge to the least point it reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ixlake.llm.common import saved
from ixlake.llm.links import components

COSINE = 0.93
LEAF = 2048  # points of a leaf
SAMPLE = 256  # points of a node that centres are chosen from; all points are assigned
FANOUT = 64
DEALT = 8192  # points assigned to centres in one group
INNER_LEAF = 48
INNER_FANOUT = 16
MARGIN = 1e-9  # bounds are widened by this, so that rounding never decides a pair

_POINT = "pid long, label int, raw binary, weight long, node long"


def units(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision from stored components."""
    rows = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    # Scaled first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pids, raws = [], []
        for vector, label in zip(batch.column("embedding"), batch.column("label").to_pylist(), strict=True):
            raw = None
            if label is not None and vector.is_valid and len(vector) and not vector.values.null_count:
                numbers = vector.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(numbers).all() and numbers.any():
                    raw = (numbers + 0.0).tobytes()  # -0.0 is 0.0
            raws.append(raw)
            pids.append(None if raw is None else xxhash.xxh3_64_intdigest(raw, seed=label & 0xFFFFFFFF) - (1 << 63))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(pids, pa.int64()), pa.array(raws, pa.binary())],
            ["vec_id", "label", "pid", "raw"],
        )


def spread_centres(points: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Points, each the farthest from those before it, until all lie within ``radius`` of one
    or there are ``most``."""
    chosen = [0]
    far = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < most:
        next_one = int(far.argmax())
        if far[next_one] <= radius:
            break
        chosen.append(next_one)
        far = np.minimum(far, np.linalg.norm(points - points[next_one], axis=1))
    return np.array(chosen)


def _centres(sample: pd.DataFrame) -> pd.DataFrame:
    points, radius, size = units(sample["raw"].tolist()), float(sample["radius"].iloc[0]), int(sample["n"].iloc[0])
    most = max(2, min(FANOUT, -(-2 * size // LEAF)))
    chosen = spread_centres(points, most, max(radius / 2, MARGIN))
    centres = points[chosen]
    if len(chosen) < 2:
        # All points of the sample are one place: parts of equal bounds, dealt by id.
        centres = np.repeat(centres, most, axis=0)
    return pd.DataFrame({"node": sample["node"].iloc[:1], "centres": [centres.tobytes()], "k": [len(centres)]})


def _child(node: int, k: int) -> int:
    return xxhash.xxh3_64_intdigest(int(node).to_bytes(8, "little", signed=True), seed=k + 1) - (1 << 63)


def _assign(points: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
    out = points[["pid", "label", "raw", "weight"]].copy()
    if not len(points):
        return out.assign(node=pd.Series(dtype="int64"), parent=pd.Series(dtype="int64"), distance=pd.Series(dtype=float))
    k = int(centre["k"].iloc[0])
    centres = np.frombuffer(centre["centres"].iloc[0], "<f8").reshape(k, -1)
    rows = units(points["raw"].tolist())
    near = (rows @ centres.T).argmax(axis=1)
    if (centres == centres[0]).all():
        near = points["pid"].to_numpy() % k
    node = int(points["node"].iloc[0])
    names = np.array([_child(node, i) for i in range(k)], np.int64)
    return out.assign(node=names[near], parent=node, distance=np.linalg.norm(rows - centres[near], axis=1))


def _far_apart(reach: float):
    """Drops pairs of nodes whose balls are farther apart than ``reach``."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("centre_a"), batch.column("centre_b"), strict=True):
                x, y = (np.frombuffer(c.as_buffer(), "<f8") if len(c.as_py() or b"") else 0.0 for c in (x, y))
                keep.append(float(np.sqrt(np.sum((x - y) ** 2))))
            bound = np.array(keep) - batch.column("radius_a").to_numpy() - batch.column("radius_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(bound <= reach + MARGIN))

    return kept


def _block(points: pd.DataFrame) -> pd.DataFrame:
    points = points.sort_values("pid")
    return pd.DataFrame(
        {
            "node": points["node"].iloc[:1].to_numpy(),
            "ids": [points["pid"].to_numpy(np.int64).tobytes()],
            "weights": [points["weight"].to_numpy(np.int64).tobytes()],
            "raw": [b"".join(points["raw"])],
        }
    )


class Ball:
    """A node of a small tree: a centre, the covering radius, its points and its children."""

    __slots__ = ("centre", "children", "own", "radius")

    def __init__(self, points: np.ndarray, own: np.ndarray, centre: np.ndarray, radius: float):
        self.own, self.centre, self.radius = own, centre, radius
        self.children: list[Ball] = []
        if len(own) <= INNER_LEAF or radius <= MARGIN:
            return
        mine = points[own]
        chosen = mine[spread_centres(mine, INNER_FANOUT, radius / 2)]
        near = (mine @ chosen.T).argmax(axis=1)
        away = np.linalg.norm(mine - chosen[near], axis=1)
        for k in range(len(chosen)):
            inside = near == k
            if inside.any() and not inside.all():
                self.children.append(Ball(points, own[inside], chosen[k], float(away[inside].max())))


def small_tree(points: np.ndarray) -> Ball:
    centre = points.mean(axis=0)
    return Ball(points, np.arange(len(points)), centre, float(np.linalg.norm(points - centre, axis=1).max()))


class Found:
    """Links between two sets of points: their number for each point, and least reachable points."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None, weights: list[np.ndarray], cosine: float):
        self.points = [first, first if second is None else second]
        self.alone = second is None
        self.weights = weights
        self.cosine, self.reach = cosine, float(np.sqrt(2 - 2 * cosine))
        n = len(first) + (0 if self.alone else len(second))
        self.shift = 0 if self.alone else len(first)
        self.links = np.zeros(n, np.int64)
        self.parent = np.arange(n)
        self.compared = 0

    def _root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def _join(self, members: np.ndarray) -> None:
        roots = {self._root(i) for i in members.tolist()}
        least = min(roots)
        for r in roots:
            self.parent[r] = least

    def walk(self, a: Ball, b: Ball) -> None:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            same = self.alone and x is y
            apart = float(np.linalg.norm(x.centre - y.centre))
            if apart > x.radius + y.radius + self.reach + MARGIN:
                continue
            if apart + x.radius + y.radius <= self.reach - MARGIN:
                self._whole(x.own, y.own, same)
            elif not x.children and not y.children or len(x.own) * len(y.own) <= 4096:
                self._compare(x.own, y.own, same)
            elif same:
                stack += [(c, d) for i, c in enumerate(x.children) for d in x.children[i:]]
            elif x.children and (x.radius >= y.radius or not y.children):
                stack += [(c, y) for c in x.children]
            else:
                stack += [(x, c) for c in y.children]

    def _whole(self, one: np.ndarray, other: np.ndarray, same: bool) -> None:
        w, v = self.weights
        if same:
            self.links[one] += w[one].sum() - w[one]
            self._join(one)
        else:
            self.links[one] += v[other].sum()
            self.links[other + self.shift] += w[one].sum()
            self._join(np.concatenate([one, other + self.shift]))

    def _compare(self, one: np.ndarray, other: np.ndarray, same: bool) -> None:
        near = self.points[0][one] @ self.points[1][other].T >= self.cosine
        self.compared += near.size
        if same:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        w, v = self.weights
        self.links[one] += near @ v[other]
        if not same:
            self.links[other + self.shift] += w[one] @ near
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            self._join(np.concatenate([one[i : i + 1], other[near[i]] + self.shift]))


def _compared(cosine: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids = [np.frombuffer(row[f"ids_{s}"], "<i8") for s in "ab"]
                weights = [np.frombuffer(row[f"weights_{s}"], "<i8") for s in "ab"]
                blocks = [
                    units([row[f"raw_{s}"][k : k + len(row[f"raw_{s}"]) // len(x)]
                           for k in range(0, len(row[f"raw_{s}"]), len(row[f"raw_{s}"]) // len(x))])
                    for s, x in zip("ab", ids, strict=True)
                ]
                alone = row["a"] == row["b"]
                found = Found(blocks[0], None if alone else blocks[1], weights, cosine)
                first = small_tree(blocks[0])
                found.walk(first, first if alone else small_tree(blocks[1]))
                every = ids[0] if alone else np.concatenate(ids)
                hit = np.flatnonzero(found.links)
                roots = [found._root(k) for k in hit.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[hit]), pa.array(found.links[hit]), pa.array(every[roots])], ["pid", "links", "least"]
                )

    return compared


def _tree(points: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their leaf as node, and the nodes of each level.

    A level has node, parent, centre and radius. A node that isn't split is its own parent in
    the next level. Level 0 has one node a label: the ball around the origin.
    """
    nodes = saved(
        points.select("node").distinct().select(
            "node", F.col("node").alias("parent"), F.lit(None).cast("binary").alias("centre"), F.lit(1.0).alias("radius")
        ),
        "nodes",
    )
    levels = [nodes]
    while True:
        sizes = points.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > LEAF)
        big = saved(sizes.join(nodes.select("node", "radius"), "node"), "big")
        if big.isEmpty():
            return points, levels
        inside = points.join(big, "node")
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("pid"), "pid"))
        centres = saved(
            inside.withColumn("place", place)
            .where(F.col("place") <= SAMPLE)
            .groupBy("node")
            .applyInPandas(_centres, "node long, centres binary, k int"),
            "centres",
        )
        parts = F.ceil(F.col("n") / F.lit(DEALT)).cast("int")
        dealt = inside.withColumn("part", F.pmod(F.xxhash64("pid"), parts).cast("int"))
        copies = centres.join(big, "node").select(
            "node", "centres", "k", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
        )
        moved = saved(
            dealt.select("pid", "label", "raw", "weight", "node", "part")
            .groupBy("node", "part")
            .cogroup(copies.groupBy("node", "part"))
            .applyInPandas(_assign, "pid long, label int, raw binary, weight long, node long, parent long, distance double"),
            "moved",
        )

        def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    size = len(row["centres"]) // row["k"]
                    k = range(row["k"])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([_child(row["node"], i) for i in k], pa.int64()),
                            pa.array([row["centres"][i * size : (i + 1) * size] for i in k], pa.binary()),
                        ],
                        ["node", "centre"],
                    )

        radii = moved.groupBy("node").agg(F.first("parent").alias("parent"), F.max("distance").alias("radius"))
        born = centres.mapInArrow(children, "node long, centre binary").join(radii, "node")
        rest = nodes.join(big.select("node"), "node", "left_anti")
        nodes = saved(
            born.select("node", "parent", "centre", "radius").unionByName(
                rest.select("node", F.col("node").alias("parent"), "centre", "radius")
            ),
            "nodes",
        )
        levels.append(nodes)
        points = saved(
            points.join(big.select("node"), "node", "left_anti")
            .select("pid", "label", "raw", "weight", "node")
            .unionByName(moved.select("pid", "label", "raw", "weight", "node")),
            "points",
        )


def _leaf_pairs(levels: list[DataFrame], reach: float) -> DataFrame:
    pairs = levels[0].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for nodes in levels[1:]:
        side = lambda s: nodes.select(
            *[F.col(n).alias(f"{n}_{s}") for n in ("node", "parent", "centre", "radius")]  # noqa: B023
        )
        met = (
            pairs.join(side("a"), F.col("a") == F.col("parent_a"))
            .join(side("b"), F.col("b") == F.col("parent_b"))
            .where((F.col("a") != F.col("b")) | (F.col("node_a") <= F.col("node_b")))
        )
        columns = [F.col("node_a").alias("a"), F.col("node_b").alias("b"), "centre_a", "centre_b", "radius_a", "radius_b"]
        pairs = saved(met.select(columns).mapInArrow(_far_apart(reach), "a long, b long"), "node-pairs")
    return pairs


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links by cosine >= ``cosine`` among the rows of (vec_id, embedding, label) of one label.

    Returns vec_id, n_links (other rows linked directly), component_id (the least vec_id
    reachable by links, itself included) and kept (vec_id = component_id).

    A null label, and a vector that is null, empty, zero or holds null or non-finite components, has no
    links. Vectors of different lengths are never linked. Rows with one vec_id are rows of their own and
    count each. A null id is never the least; where no row reachable has an id,
    component_id is null and kept is true. Empty input gives an empty result.
    """
    rows = saved(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.col("label").cast("int").alias("label"),
        ).mapInArrow(_read, "vec_id long, label int, pid long, raw binary"),
        "vectors",
    )
    root = F.xxhash64("label", F.length("raw")).alias("node")
    points = saved(
        rows.where(F.col("pid").isNotNull())
        .groupBy("pid", "label", "raw")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"))
        .select("pid", "label", "raw", "weight", root, "vec_id"),
        "points",
    )
    leaves, levels = _tree(points.select("pid", "label", "raw", "weight", "node"))
    pairs = _leaf_pairs(levels, float(np.sqrt(2 - 2 * cosine)))
    blocks = saved(
        leaves.groupBy("node").applyInPandas(_block, "node long, ids binary, weights binary, raw binary"), "blocks"
    )
    side = lambda s: blocks.select(
        F.col("node").alias(s), *[F.col(n).alias(f"{n}_{s}") for n in ("ids", "weights", "raw")]
    )
    found = saved(
        pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_compared(cosine), "pid long, links long, least long"),
        "links",
    )
    links = found.groupBy("pid").agg(F.sum("links").alias("links"))
    labels = saved(components(found.select(F.col("pid").alias("a"), F.col("least").alias("b"))), "labels")
    named = (
        points.select("pid", "weight", "vec_id")
        .join(labels, F.col("pid") == F.col("node"), "left")
        .select("pid", "weight", "vec_id", F.coalesce("component", "pid").alias("component"))
    )
    firsts = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    of_point = (
        named.join(firsts, "component")
        .join(links, "pid", "left")
        .select("pid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    component = F.when(F.col("pid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return (
        rows.select("vec_id", "pid")
        .join(of_point, "pid", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
