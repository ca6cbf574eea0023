"""Approximate nearest neighbours by a forest of random-projection trees.

``TREES`` trees are grown on a bounded sample, deep enough for about ``LEAF``
distinct vectors a leaf; every distinct vector is then indexed, once in each tree.  A query descends
all trees through one priority queue: a node's priority falls by the square of each
margin by which the query misses it, and the leaves of highest priority over the whole forest are
read, ``SHARE`` of all leaves and ``FLOOR`` for each tree at least.  (Priorities never
rise on the way down, so these are the leaves that the queue would give first.)
Candidates of these leaves are reranked by exact distances.  Rows and queries meet by
subtree, of about ``BLOCK`` rows, so work is dealt out evenly and a query is sent
once for each subtree that holds leaves for it.  Equal vectors are one entry with their smallest ids, as
many as a result can hold, so a vector that fills a third of the table costs one entry.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.llm._spark import Scratch, ship_package

TREES = 24
#: Bound of the sample that trees are grown on.
SAMPLE = 32_768
#: Distinct vectors of a leaf, and the greatest depth, which the sample allows.
LEAF, MOST_DEPTH = 16, 12
#: Share of the forest's leaves that a query reads, and leaves for each tree that it reads at least.
SHARE, FLOOR = 0.013, 4
#: Rows of a subtree that one task compares at once, and pairs that are compared together.
BLOCK, PAIRS = 4096, 20_000


def grow(sample: np.ndarray, trees: int, depth: int, seed: int = 0) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Trees as levels of (directions, cuts); a direction joins two random members and is refined to the means of its halves."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        levels, groups = [], [np.arange(len(sample))]
        for _ in range(depth):
            directions, cuts, below = [], [], []
            for g in groups:
                x = sample[g]
                w = rng.normal(size=sample.shape[1])
                if len(g) > 1:
                    i, j = rng.choice(len(g), 2, replace=False)
                    w = x[i] - x[j] if (x[i] != x[j]).any() else w
                    for _ in range(3):
                        p = x @ w
                        high = p > np.median(p)
                        if high.any() and not high.all():
                            step = x[high].mean(0) - x[~high].mean(0)
                            w = step if (step != 0).any() else w
                w = w / np.linalg.norm(w)
                p = x @ w
                cut = float(np.median(p)) if len(g) else 0.0
                directions.append(w)
                cuts.append(cut)
                below += [g[p <= cut], g[p > cut]]
            levels.append((np.array(directions), np.array(cuts)))
            groups = below
        out.append(levels)
    return out


def priorities(tree, x: np.ndarray) -> np.ndarray:
    """Priority of each leaf for each vector: less the squares of the margins by which it misses the way there."""
    best = np.zeros((len(x), 1))
    for directions, cuts in tree:
        margin = x @ directions.T - cuts
        best = np.stack([best - np.maximum(margin, 0) ** 2, best - np.minimum(margin, 0) ** 2], 2).reshape(len(x), -1)
    return best


def leaves(tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for directions, cuts in tree:
        node = 2 * node + ((x * directions[node]).sum(1) > cuts[node])
    return node


def _vectors(batch: pa.RecordBatch, names: tuple[str, str], size: int | None):
    """Ids and vectors of a batch that take part: finite throughout, not zero, of the given size."""
    ids, column = batch.column(names[0]), batch.column(names[1])
    for i, v in zip(ids.to_pylist(), column, strict=True):
        if i is None or not v.is_valid or v.values.null_count or (size is not None and len(v.values) != size):
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
        if len(x) and np.isfinite(x).all() and (x != 0).any():
            yield i, x


def _entries(batches: Iterator[pa.RecordBatch], names, size: int, most: int) -> Iterator[pa.RecordBatch]:
    """This task's distinct vectors, each with its smallest ids."""
    held: dict[bytes, list[int]] = {}
    for batch in batches:
        for i, x in _vectors(batch, names, size):
            ids = held.setdefault((x + 0.0).tobytes(), [])
            if -i in ids:
                continue
            if len(ids) < most:
                heapq.heappush(ids, -i)
            else:
                heapq.heappushpop(ids, -i)
    items = list(held.items())
    for a in range(0, len(items), 2000):
        part = items[a : a + 2000]
        yield pa.record_batch({"vec": pa.array([k for k, _ in part], pa.binary()), "ids": pa.array([sorted(-i for i in v) for _, v in part], pa.list_(pa.int64()))})


def _packed(x: np.ndarray) -> bytes:
    """A vector in single precision where that loses nothing."""
    y = x.astype("<f4")
    return y.tobytes() if (y == x).all() else x.tobytes()


def _unpacked(column, size: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * size else "<f8").astype(np.float64) for v in column.to_pylist()]) if len(column) else np.zeros((0, size))


def _assign(batches: Iterator[pa.RecordBatch], forest, sub: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([np.frombuffer(v, "<f8") for v in batch.column("vec").to_pylist()])
        vec = pa.array([_packed(v) for v in x], pa.binary())
        for t, tree in enumerate(forest.value):
            leaf = leaves(tree, x)
            yield pa.record_batch({"tree": np.full(len(x), t, np.int32), "sub": (leaf >> len(tree) - sub).astype(np.int32), "leaf": leaf.astype(np.int32), "vec": vec, "ids": batch.column("ids")})


def chosen_leaves(trees, x: np.ndarray, share: float) -> np.ndarray:
    """The leaves that each vector reads, numbered over the whole forest."""
    count = len(trees) * 2 ** len(trees[0])
    reads = min(count, max(FLOOR * len(trees), math.ceil(share * count)))
    rank = np.concatenate([priorities(tree, x) for tree in trees], 1)
    return np.argpartition(-rank, reads - 1, 1)[:, :reads] if reads < count else np.tile(np.arange(count), (len(x), 1))


def _route(batches: Iterator[pa.RecordBatch], names, size: int, forest, sub: int, share: float) -> Iterator[pa.RecordBatch]:
    trees = forest.value
    depth = len(trees[0])
    for batch in batches:
        found = list(_vectors(batch, names, size))
        for a in range(0, len(found), 64):
            part = found[a : a + 64]
            for (i, v), leaf in zip(part, chosen_leaves(trees, np.stack([v for _, v in part]), share), strict=True):
                leaf = np.sort(leaf)
                # subtrees of all trees are numbered on
                group, first = np.unique(leaf >> depth - sub, return_index=True)
                each = [x.astype(np.int32) for x in np.split(leaf & 2**depth - 1, first[1:])]
                yield pa.record_batch({
                    "tree": (group >> sub).astype(np.int32), "sub": (group & 2**sub - 1).astype(np.int32), "query_id": np.full(len(group), i, np.int64),
                    "q": pa.array([_packed(v)] * len(group), pa.binary()), "leaves": pa.array(each, pa.list_(pa.int32())),
                })


def _rerank(rows: pa.Table, queries: pa.Table, k: int, size: int) -> pa.Table:
    """The k nearest of one subtree for each of its queries, among the leaves it reads: exact distances, ties to smaller ids."""
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not rows.num_rows or not queries.num_rows:
        return none
    order = np.argsort(rows.column("leaf").to_numpy(), kind="stable")
    leaf = rows.column("leaf").to_numpy()[order]
    x, q = _unpacked(rows.column("vec"), size)[order], _unpacked(queries.column("q"), size)
    ids = rows.column("ids").to_pylist()
    ids = [ids[i] for i in order.tolist()]
    query_id = queries.column("query_id").to_pylist()
    out: list[tuple[int, int, float]] = []
    for j, own in enumerate(queries.column("leaves").to_pylist()):
        low, high = np.searchsorted(leaf, own), np.searchsorted(leaf, own, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
        if not len(at):
            continue
        d = np.concatenate([np.sqrt(((x[at[a : a + PAIRS]] - q[j]) ** 2).sum(1)) for a in range(0, len(at), PAIRS)])
        # one more than k: the query itself may be among them
        near = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
        best = heapq.nsmallest(k, ((float(d[n]), v) for n in near.tolist() for v in ids[at[n]] if v != query_id[j]))
        out += [(query_id[j], v, s) for s, v in best]
    if not out:
        return none
    a, b, c = zip(*out, strict=True)
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_name: str = "vec_id", vec_name: str = "embedding", share: float = SHARE) -> DataFrame:
    """For each row of ``queries`` its k nearest rows of ``vectors`` found: query_id, rank, vec_id, score (Euclidean distance).

    A row is no candidate for a query of its own id.  Null ids and vectors that
    are null, empty, zero, or hold null or non-finite components take no part, nor do
    those whose length is not the most frequent one.  Repeated rows of one id and
    vector count once; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "neighbours")
    names = (id_name, vec_name)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = vectors.where(F.col(vec_name).isNotNull() & (F.size(vec_name) > 0)).groupBy(F.size(vec_name).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return empty
    size, most = sizes["n"], k + 1
    parts = vectors.select(*names).mapInArrow(lambda it: _entries(it, names, size, most), "vec binary, ids array<long>")
    entries = scratch.keep("entries", parts.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")))
    n = entries.count()
    if not n:
        return empty
    sample = entries.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow().column("vec").to_pylist()
    depth = min(MOST_DEPTH, max(1, math.ceil(math.log2(max(2, n / LEAF)))))
    sub = min(depth, max(0, math.ceil(math.log2(n / BLOCK))))
    forest = spark.sparkContext.broadcast(grow(np.stack([np.frombuffer(v, "<f8") for v in sample]), TREES, depth))
    rows = entries.mapInArrow(lambda it: _assign(it, forest, sub), "tree int, sub int, leaf int, vec binary, ids array<long>")
    routed = queries.select(*names).mapInArrow(lambda it: _route(it, names, size, forest, sub, share), "tree int, sub int, query_id long, q binary, leaves array<int>")
    keys = ["tree", "sub"]
    found = rows.groupBy(keys).cogroup(routed.groupBy(keys)).applyInArrow(lambda a, b: _rerank(a, b, k, size), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
