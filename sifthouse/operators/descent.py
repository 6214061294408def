"""A graph of nearest neighbours by descent: neighbours of neighbours are likely neighbours.

Every vector begins with some others of its own cells under a few random cuts of the space. In
rounds each one meets the neighbours of its neighbours, in both directions, and keeps the best;
only pairs with a neighbour that is new since the last round are met again. Work is in proportion
to the vectors and their neighbours, not to all pairs.

Vectors meet where they are neighbours of one and the same vector. Those are dealt into parts of
bounded size, and a part gets each vector that is near to any of its own once, in half precision,
with the score that a neighbour must beat. So no pair is ever shuffled before it is better than
what one of its sides holds; the neighbours that are left at the end are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..session import default_parallelism, discard, settle

#: Cuts of the space, and vectors of a cell that are compared with each other.
CUTS, CELL = 4, 64
#: Neighbours a vector holds while it looks, for each one asked.
WIDER = 2
#: Vectors of a part, whose neighbours meet in one task; neighbours that a vector takes from one meeting at most.
PART, TAKEN = 1 << 15, 6
#: Neighbours beyond those asked that are scored exactly, as half precision may order them otherwise.
SPARE = 4


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * raw.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _rows(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return raw.reshape(len(column), -1).view(kind)


def _narrow(x: np.ndarray) -> pa.Array:
    """Vectors in half precision behind their scale."""
    scale = np.nan_to_num(np.abs(x).max(axis=1, initial=0), nan=1.0, posinf=1.0)
    scale[scale == 0] = 1
    return _packed(np.concatenate([scale.astype("<f8")[:, None].view("<f2"), (x / scale[:, None]).astype("<f2")], axis=1))


def _wide(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scales and scaled vectors in single precision."""
    rows = _rows(column, "<f2")
    return np.ascontiguousarray(rows[:, :4]).view("<f8").ravel(), rows[:, 4:].astype(np.float32)


def _first(held: DataFrame, keep: int, dim: int, count: int, seed: int) -> DataFrame:
    """``src, dst, score``: the best of each vector among those of its cells.

    A cut gives a vector the signs of its products with random directions; vectors in the order
    of their signs are dealt into cells of ``CELL``, whatever signs are frequent.
    """
    rng = np.random.default_rng(seed)
    bits = max(1, min(40, int(np.ceil(np.log2(max(count, 2))))))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's rows in order, cell after cell
        rest = None
        for batch in batches:
            some = pa.Table.from_batches([batch])
            rest = some if rest is None else pa.concat_tables([rest, some])
            whole = len(rest) // CELL * CELL
            yield from cells(rest.slice(0, whole))
            rest = rest.slice(whole)
        if rest is not None:
            yield from cells(rest)

    def cells(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        ids, (scale, x) = table.column("id").to_numpy(), _wide(table.column("f"))
        for at in range(0, len(ids), CELL):
            own, y, by = ids[at : at + CELL], x[at : at + CELL], scale[at : at + CELL]
            s = np.nan_to_num((y @ y.T) * by[:, None] * by[None, :], nan=-np.inf)
            np.fill_diagonal(s, -np.inf)
            k = min(keep, len(own) - 1)
            near = np.argpartition(-s, max(k - 1, 0), axis=1)[:, :k]
            score = np.take_along_axis(s, near, axis=1).ravel()
            fit = score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[fit]), pa.array(own[near].ravel()[fit]), pa.array(score[fit])], ["src", "dst", "score"])

    out = None
    for _ in range(CUTS):
        planes = rng.normal(size=(dim, bits)).astype(np.float32)

        def sign(batches, planes=planes):
            for batch in batches:
                if batch.num_rows:
                    marks = ((_wide(batch.column("f"))[1] @ planes) > 0) @ (1 << np.arange(planes.shape[1])[::-1])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks.astype(np.int64))], ["id", "f", "mark"])

        signed = held.select("id", "f").mapInArrow(sign, "id long, f binary, mark long")
        some = signed.repartitionByRange("mark", "id").sortWithinPartitions("mark", "id").mapInArrow(best, "src long, dst long, score double")
        out = some if out is None else out.unionByName(some)
    return out


def _best(pairs: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).drop("rank")


def _some(pairs: DataFrame, by: str, most: int, turn: int) -> DataFrame:
    """At most ``most`` pairs of each ``by``, drawn by a hash: what very many are near to meets only some of them in a round, others in the next."""
    order = Window.partitionBy(by).orderBy(F.xxhash64("src", "dst", F.lit(turn)))
    return pairs.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= most).drop("_at")


def _print(id_: Column) -> Column:
    """Sixteen bits of an id's hash."""
    return (F.pmod(F.xxhash64(id_), F.lit(1 << 16)) - (1 << 15)).cast("short")


def _met(nodes: DataFrame, around: DataFrame) -> DataFrame:
    """``src, dst, score``: what the vectors around each ``via`` of a part gain from each other.

    A vector takes at most ``TAKEN`` from one meeting, none that it holds and none that is worse
    than all it holds. Of the former hashes of sixteen bits are compared, so of some 2,700
    meetings of two vectors that don't know each other one is missed.
    """
    def run(nodes: pa.Table, around: pa.Table) -> pa.Table:
        empty = pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(nodes) or not len(around):
            return empty
        order = np.argsort(nodes.column("b").to_numpy())
        nodes = nodes.take(pa.array(order))
        ids, (scale, x) = nodes.column("b").to_numpy(), _wide(nodes.column("f"))
        least = nodes.column("least").to_numpy()
        known = nodes.column("known").combine_chunks()
        size = known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        holds = np.full((len(ids), int(size.max(initial=1))), 1 << 20, np.int32)
        holds[np.repeat(np.arange(len(ids)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = known.flatten().to_numpy(zero_copy_only=False)
        name = nodes.column("name").to_numpy().astype(np.int32)
        via, at, new = around.column("via").to_numpy(), np.searchsorted(ids, around.column("a").to_numpy()), around.column("new").to_numpy(zero_copy_only=False)
        by_via = np.argsort(via, kind="stable")
        via, at, new = via[by_via], at[by_via], new[by_via]
        starts = np.flatnonzero(np.r_[True, via[1:] != via[:-1]])
        counts = np.diff(np.append(starts, len(via)))
        out = []
        for some in np.array_split(np.arange(len(starts)), max(1, len(starts) // 256)):
            wide = int(counts[some].max())
            place = np.minimum(starts[some][:, None] + np.arange(wide), len(via) - 1)
            there = np.arange(wide) < counts[some][:, None]
            m, fresh = at[place], new[place] & there
            y = x[m]
            s = np.matmul(y, y.transpose(0, 2, 1)) * scale[m][:, :, None] * scale[m][:, None, :]
            ok = (fresh[:, :, None] | fresh[:, None, :]) & there[:, :, None] & there[:, None, :] & (s > least[m][:, :, None])
            ok[:, np.arange(wide), np.arange(wide)] = False
            v, i, j = np.nonzero(ok)
            held = (holds[m[v, i]] == name[m[v, j]][:, None]).any(axis=1)
            s[~ok] = -np.inf
            s[v[held], i[held], j[held]] = -np.inf
            take = min(TAKEN, wide)
            best = np.argpartition(-s, take - 1, axis=2)[:, :, :take]
            score = np.take_along_axis(s, best, axis=2)
            v, i, r = np.nonzero(score > -np.inf)
            out.append((m[v, i], m[v, best[v, i, r]], score[v, i, r]))
        src, dst, score = (np.concatenate(c) for c in zip(*out, strict=True))
        _, first = np.unique(src * len(ids) + dst, return_index=True)
        return pa.table({"src": ids[src[first]], "dst": ids[dst[first]], "score": score[first]})

    return nodes.groupBy("share").cogroup(around.groupBy("part")).applyInArrow(run, "src long, dst long, score double")


def _exact(pairs: DataFrame, held: DataFrame, kind: str, parts: int) -> DataFrame:
    """``src, dst, score`` of ``pairs(src, dst)`` in double precision."""
    pairs = pairs.select(F.pmod(F.xxhash64("src"), F.lit(parts)).alias("part"), "src", "dst")
    wanted = pairs.select(F.col("part").alias("share"), F.explode(F.array("src", "dst")).alias("id")).repartition("id").distinct()

    def run(nodes: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(nodes.column("id").to_numpy())
        ids, x = nodes.column("id").to_numpy()[order], _rows(nodes.column("x"), kind)[order] if len(nodes) else np.zeros((0, 1))
        src, dst = (pairs.column(c).to_numpy() for c in ("src", "dst"))
        a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        score = np.zeros(len(src))
        for i in range(0, len(src), 1 << 15):
            score[i : i + (1 << 15)] = (x[a[i : i + (1 << 15)]].astype(np.float64) * x[b[i : i + (1 << 15)]]).sum(axis=1)
        return pa.table({"src": src, "dst": dst, "score": score})

    nodes = wanted.join(held.select("id", "x"), "id")
    return nodes.groupBy("share").cogroup(pairs.groupBy("part")).applyInArrow(run, "src long, dst long, score double")


def nearest(vectors: DataFrame, k: int = 12, floor: float | None = None, rounds: int = 8, still: float = 0.002, seed: int = 3) -> DataFrame:
    """``src, dst, score``: about the ``k`` nearest of ``vectors(id, v)`` to each by inner product, at ``floor`` or more, without itself.

    Ids are unique, vectors of one length. Rounds end when under a share ``still`` of the
    neighbours is new. Which neighbours meet is drawn where a vector is near to more than it
    holds; all of those it holds itself are kept.
    """
    v = vectors.schema["v"].dataType
    kind = "<f4" if isinstance(v, ArrayType) and isinstance(v.elementType, FloatType) else "<f8"

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(x), _narrow(x)], ["id", "x", "f"])

    numbers = F.col("v").cast("array<float>" if kind == "<f4" else "array<double>")
    held = settle(vectors.filter("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), numbers.alias("v")).mapInArrow(pack, "id long, x binary, f binary"))
    one = held.agg(F.count("*").alias("n"), F.max(F.length("x")).alias("bytes")).first()
    if one["n"] < 2:
        return held.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("score")).limit(0)
    keep, n = WIDER * k, one["n"]
    parts = max(-(-n // PART), min(default_parallelism(held.sparkSession), -(-n // 1_024)))
    first = _first(held, keep, one["bytes"] // int(kind[2:]), n, seed).repartition("src")
    graph = settle(_best(first.groupBy("src", "dst").agg(F.max("score").alias("score")), keep).withColumn("new", F.lit(True)))
    for turn in range(rounds):
        # each vector's own neighbours, and some that hold it; where none is new nothing is met
        own = graph.select("src", "dst", "new")
        back = _some(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "new"), "src", keep, turn)
        both = own.union(back).repartition("src").groupBy(F.col("src").alias("via"), F.col("dst").alias("a")).agg(F.max("new").alias("new"))
        open_ = both.withColumn("open", F.max("new").over(Window.partitionBy("via"))).filter("open").drop("open")
        around = settle(open_.withColumn("part", F.pmod(F.xxhash64("via"), F.lit(parts))))
        holds = graph.groupBy(F.col("src").alias("id")).agg(
            F.collect_list(_print(F.col("dst"))).alias("known"), F.when(F.count("*") >= keep, F.min("score")).otherwise(float("-inf")).alias("least"))
        state = held.select("id", "f").join(holds, "id", "left").select(
            F.col("id").alias("b"), "f", _print(F.col("id")).alias("name"), "known", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        nodes = around.select(F.col("part").alias("share"), F.col("a").alias("b")).repartition("b").distinct().join(state, "b")
        fresh = _met(nodes, around).withColumn("new", F.lit(True))
        known = graph.withColumn("new", F.lit(False)).unionByName(fresh).repartition("src")
        after = settle(_best(known.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("new").alias("new")), keep))
        changed = after.filter("new").count()
        discard(graph, around)
        graph = after
        if changed <= still * n * keep:
            break
    found = _best(_exact(_best(graph, k + SPARE), held, kind, parts), k)
    return found if floor is None else found.filter(F.col("score") >= floor)
