"""Centroid clustering by Lloyd's rounds over pairs of tree nodes, exact in integers.

Vectors are read once into blocks of bounded size; each block carries a cover tree over its
vectors: nodes with a centre, the radius that covers all below, their count and their sum. In
every round a tree is built over the centroids, and each block's tree meets it from the roots
down: a pair of nodes goes when the least distance between them is above the greatest distance
to some other centroid; a node left with one centroid gives its whole sum to it; where leaves
meet, distances are compared exactly. A task gives one row a centroid, with integer sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import discard, settle

#: Vectors of a block, and of a leaf, at most.
BLOCK_ROWS, LEAF_ROWS = 4_096, 24
#: Children of a node, at most. Vectors without neighbourhoods would need one for nearly every vector to halve the radius.
FAN = 24
#: Integers of greater magnitude would make squared distances that fit no long.
MOST = 1 << 27
#: Up to this magnitude times the dimensions, doubles multiply integers exactly.
EXACT = 1 << 53
#: Bounds of distances are widened by this share and amount, so that rounding never prunes a nearest centroid.
SLACK, LEAST_SLACK = 1e-9, 1e-6


@dataclass
class Tree:
    """Nodes in the order of a walk by levels; a node's vectors are ``first`` to ``last``, its children ``child`` to ``child + children``."""

    centre: np.ndarray  # (nodes, dim) vectors of the block
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    children: np.ndarray
    sums: np.ndarray  # (nodes, dim)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between all rows of ``x`` and of ``y``, both integers."""
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)), 1)
    if big * big * 4 * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in y], axis=1)


class _Measure:
    """Exact squared distances from rows of a block to one of them."""

    def __init__(self, x: np.ndarray):
        big = int(np.abs(x).max(initial=0))
        self.x = x.astype(np.float64) if big * big * 4 * x.shape[1] < EXACT else x
        self.norm = (self.x * self.x).sum(axis=1)

    def to(self, rows: np.ndarray, one: int) -> np.ndarray:
        if self.x.dtype == np.float64:
            return self.norm[rows] - 2 * (self.x[rows] @ self.x[one]) + self.norm[one]
        return ((self.x[rows] - self.x[one]) ** 2).sum(axis=1)


def cover_tree(x: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree over the rows of ``x``, and the order of the rows in it.

    A node's rows are covered by children of half its radius: the row furthest from the centres
    so far becomes the next centre, the first being the node's own, until all rows lie within
    half the radius of one, or there are ``FAN`` children, which then have the radius they need.
    """
    order = np.arange(len(x))
    measure = _Measure(x)
    centre, radius, first, last, child, children = [], [], [], [], [], []
    waiting = [(0, len(x), 0)]
    at = 0
    while at < len(waiting):
        a, b, middle = waiting[at]
        at += 1
        mine = order[a:b]
        near = measure.to(mine, middle)
        centre.append(middle)
        radius.append(float(np.sqrt(near.max(initial=0))))
        first.append(a)
        last.append(b)
        child.append(len(waiting))
        if b - a <= LEAF_ROWS or radius[-1] == 0:
            children.append(0)
            continue
        heads, owner = [middle], np.zeros(b - a, np.int64)
        while len(heads) < FAN and near.max() > (radius[-1] / 2) ** 2:
            head = int(mine[int(near.argmax())])
            new = measure.to(mine, head)
            owner[new < near] = len(heads)
            near = np.minimum(near, new)
            heads.append(head)
        by_owner = np.argsort(owner, kind="stable")
        order[a:b] = mine[by_owner]
        edges = a + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(heads)))])
        waiting.extend(zip(edges[:-1].tolist(), edges[1:].tolist(), heads, strict=True))
        children.append(len(heads))
    summed = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[order], axis=0)])
    first_, last_ = np.array(first), np.array(last)
    return Tree(x[np.array(centre)], np.array(radius), first_, last_, np.array(child), np.array(children), summed[last_] - summed[first_]), order


@dataclass
class CentroidTree:
    """The tree of a round: one centroid in a leaf; an inner node halves its centroids along the line between the two furthest apart."""

    centre: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centroid: np.ndarray  # of a leaf, else -1
    least: np.ndarray  # the smallest centroid number below


def centroid_tree(c: np.ndarray) -> CentroidTree:
    nodes: list[list] = []

    def add(mine: np.ndarray) -> int:
        here = len(nodes)
        middle = c[mine].astype(np.float64).mean(axis=0)
        far = np.sqrt(((c[mine] - middle) ** 2).sum(axis=1))
        nodes.append([middle, float(far.max()), -1, -1, int(mine[0]) if len(mine) == 1 else -1, int(mine.min())])
        if len(mine) > 1:
            one = c[mine[int(far.argmax())]].astype(np.float64)
            other = c[mine[int(((c[mine] - one) ** 2).sum(axis=1).argmax())]]
            along = (c[mine] - one) @ (other - one)
            ranked = mine[np.argsort(along, kind="stable")]
            nodes[here][2], nodes[here][3] = add(np.sort(ranked[: len(mine) // 2])), add(np.sort(ranked[len(mine) // 2 :]))
        return here

    add(np.arange(len(c)))
    return CentroidTree(*(np.array(v) for v in zip(*nodes, strict=True)))


def _meet(tree: Tree, over: CentroidTree) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs ``(nodes, centroids, whole)``: nodes that belong whole to one centroid, then leaves with every centroid that may be some row's nearest.

    All pairs of a level are looked at together.
    """
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        middle = tree.centre[v] - over.centre[c]
        apart = np.sqrt((middle * middle).sum(axis=1))
        reach = tree.radius[v] + over.radius[c]
        slack = SLACK * (apart + reach) + LEAST_SLACK
        low, high = apart - reach - slack, apart + reach + slack
        nodes, place = np.unique(v, return_inverse=True)
        limit = np.full(len(nodes), np.inf)
        np.minimum.at(limit, place, high)
        keep = low <= limit[place]
        v, c, place = v[keep], c[keep], place[keep]
        alone = np.bincount(place, minlength=len(nodes))[place] == 1
        bottom = over.centroid[c] >= 0
        done = alone & bottom
        if done.any():
            yield v[done], over.centroid[c[done]], True
        # centroid nodes are opened while they are wider than the node they meet, or where that is a leaf
        opened = ~bottom & ((over.radius[c] >= tree.radius[v]) | (tree.children[v] == 0))
        busy = np.zeros(len(nodes), bool)
        busy[place[opened]] = True
        ready = ~done & ~busy[place]
        leaf = ready & (tree.children[v] == 0)
        if leaf.any():
            yield v[leaf], over.centroid[c[leaf]], False
        stay = ~done & busy[place] & ~opened
        inner = ready & (tree.children[v] > 0)
        fan = tree.children[v[inner]]
        down = np.repeat(tree.child[v[inner]], fan) + np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
        v = np.concatenate([v[opened], v[opened], v[stay], down])
        c = np.concatenate([over.left[c[opened]], over.right[c[opened]], c[stay], np.repeat(c[inner], fan)])


def _leaves(tree: Tree, x: np.ndarray, centroids: np.ndarray, v: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, cluster, distance)`` of the leaves ``v`` that met the centroids ``c``: exact, ties to the smaller number."""
    order = np.lexsort((c, v))
    v, c = v[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    same: dict[tuple[int, ...], list[int]] = {}
    for a, b in zip(head.tolist(), np.append(head[1:], len(v)).tolist(), strict=True):
        same.setdefault(tuple(c[a:b].tolist()), []).append(int(v[a]))
    for some, leaves in same.items():
        rows = np.concatenate([np.arange(tree.first[i], tree.last[i]) for i in leaves])
        apart = _distances(x[rows], centroids[list(some)])
        best = apart.argmin(axis=1)
        yield rows, np.array(some)[best], apart[np.arange(len(rows)), best]


def nearest(tree: Tree, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and squared distance of every row of a block (in the tree's order)."""
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for v, c, whole in _meet(tree, centroid_tree(centroids)):
        if whole:
            for i, j in zip(v.tolist(), c.tolist(), strict=True):
                rows = slice(int(tree.first[i]), int(tree.last[i]))
                cluster[rows], distance[rows] = j, _distances(x[rows], centroids[j : j + 1])[:, 0]
        else:
            for rows, j, d in _leaves(tree, x, centroids, v, c):
                cluster[rows], distance[rows] = j, d
    return cluster, distance


def totals(tree: Tree, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the rows nearest to each centroid; a node that belongs to one whole is not opened."""
    count, summed = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for v, c, whole in _meet(tree, centroid_tree(centroids)):
        if whole:
            np.add.at(count, c, (tree.last - tree.first)[v])
            np.add.at(summed, c, tree.sums[v])
        else:
            for rows, j, _ in _leaves(tree, x, centroids, v, c):
                np.add.at(count, j, 1)
                np.add.at(summed, j, x[rows])
    return count, summed


_PARTS = {"x": np.int64, "centre": np.int64, "radius": np.float64, "first": np.int64, "last": np.int64, "child": np.int64, "children": np.int64, "sums": np.int64}


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows(vec_id, v)`` in blocks with their trees, as they are read: no shuffle, and no block is larger because a vector or an id repeats."""
    def pack(ids: list[pa.Array], flat: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(flat)
        tree, order = cover_tree(x)
        parts = {"x": x[order], **{n: getattr(tree, n) for n in list(_PARTS)[1:]}}
        listed = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(ids).take(pa.array(order)))
        return pa.RecordBatch.from_arrays([listed, *(pa.array([np.ascontiguousarray(v, _PARTS[n]).tobytes()], pa.binary()) for n, v in parts.items())], ["ids", *parts])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flat, held = [], [], 0
        for batch in batches:
            got = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = batch.column("vec_id")
            at = 0
            while at < batch.num_rows:
                some = min(BLOCK_ROWS - held, batch.num_rows - at)
                ids.append(own.slice(at, some))
                flat.append(got[at : at + some])
                at, held = at + some, held + some
                if held == BLOCK_ROWS:
                    yield pack(ids, flat)
                    ids, flat, held = [], [], 0
        if held:
            yield pack(ids, flat)

    return rows.select("vec_id", "v").mapInArrow(run, "ids array<long>, " + ", ".join(f"`{n}` binary" for n in _PARTS))


def _opened(batch: pa.RecordBatch, i: int, dim: int) -> tuple[pa.Array, np.ndarray, Tree]:
    part = {n: np.frombuffer(batch.column(n)[i].as_buffer(), kind) for n, kind in _PARTS.items()}
    for n in ("x", "centre", "sums"):
        part[n] = part[n].reshape(-1, dim)
    return batch.column("ids")[i].values, part.pop("x"), Tree(**part)


def _round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; a centroid without vectors stays."""
    k, dim = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task reads under 2**33 vectors, so its sums fit
        count, summed = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, x, tree = _opened(batch, i, dim)
                n, s = totals(tree, x, centroids)
                count += n
                summed += s
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k), dim), pa.int32()), pa.array(np.tile(np.arange(dim), k), pa.int32()), pa.array(np.repeat(count, dim)), pa.array(summed.ravel())], ["cluster", "i", "n", "s"])

    partial = blocks.mapInArrow(run, "cluster int, i int, n long, s long")
    got = partial.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k times the dimensions
    out = centroids.copy()
    for r in got:
        if r["n"]:
            out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def scaled(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """``vec_id, v``: the vectors of exactly ``dim`` components, all finite, as the integers ``floor(scale * x)``."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    kept = vectors.filter((F.size("embedding") == dim) & F.forall("embedding", fine)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return kept.filter(F.forall("embedding", lambda x: F.abs(x.cast("double") * F.lit(float(scale))) < MOST)).select("vec_id", whole.alias("v"))


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1_024, salt: str = "3") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part, after ``rounds`` of Lloyd's algorithm.

    Components are the integers ``floor(scale * x)``. The first centroids are the ``k`` vectors
    of the smallest sha256 of ``salt:vec_id``, in that order (rows that repeat an id: the least
    vector first); of fewer vectors there are as many centroids. A vector belongs to the nearest
    centroid by squared distance, ties to the smaller number; centroids become floors of means.
    Every row counts, whether its id or vector repeats; a null id has no hash and starts no
    centroid (without any id the result is empty). Vectors of another length, null ones, and ones with null or non-finite components
    take no part, nor do those with integers from 2**27 on, whose distances fit no long. Without
    vectors the result is empty.
    """
    rows = scaled(vectors, dim, scale)
    start = rows.filter("vec_id is not null").withColumn("mark", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)).orderBy("mark", "v").limit(k).select("v").collect()
    if not start:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")).limit(0)
    centroids = np.array([r["v"] for r in start], np.int64)
    blocks = settle(_blocks(rows))
    for _ in range(rounds):
        moved = _round(blocks, centroids)
        if (moved == centroids).all():
            break  # no further round changes anything
        centroids = moved

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, tree = _opened(batch, i, dim)
                cluster, distance = nearest(tree, x, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = settle(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"))
    discard(blocks)
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    said = placed.sparkSession.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), mark) for i, mark in enumerate(marks)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row a centroid
    return placed.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
