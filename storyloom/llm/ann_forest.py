"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on a sample: a node parts its vectors at the median of their projections on the difference of two of
them. The sample is that of the identifiers whose hash divides by a number, about one vector in SAMPLE_SHARE, SAMPLE_LEAST
to SAMPLE_MOST of them. Every vector is sorted into a leaf of each tree; leaves have about LEAF_ROWS vectors, so there are
more the more vectors there are. A query walks all trees through one priority queue, nearest margin first, and takes leaves
until they cover a share of the sample; the share is the smallest with which sampled vectors find TARGET of their neighbours
in the sample, so it follows the data: small where vectors cluster, more than half where they are as good as random.

A leaf is split into tiles of about GROUP_ROWS vectors and QUERY_ROWS queries, by what the sample tells of its size, so a
leaf of a third of all vectors is many tasks. A vector travels to its leaf in each tree, with its leaves in the others; a
query travels with all its leaves: so a candidate that several trees give is looked at once, in the first of them. Within a
tile, vectors are sorted into the leaves of a tree of their own, calibrated in the same way, unless the share is so large
that this spares nothing. Candidates are ranked by the exact distance in double precision; a matrix product, with a margin
for its rounding, tells which can be among the k nearest.

Edge cases: see vectors.usable(); zero vectors take no part; a query's own identifier isn't among its results; with fewer
than k candidates found all are returned (and on few vectors, the forest is one leaf and the search exact); ties go to the
smaller identifier; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.vectors import best_of, matrix, usable

SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 256, 8192, 262_144
TREES, LEAF_ROWS, TARGET = 4, 8192, 0.97
#: Vectors of the sample in a leaf at least.
_LEAST_LEAF = 32
GROUP_ROWS, QUERY_ROWS = 16_384, 16_384
#: Vectors in a leaf of a tile's own tree; a share that is so large spares nothing.
LOCAL_ROWS, LARGE_SHARE = 256, 0.5
_PROBES, _QUERIES_AT_ONCE = 64, 128
#: Bits of a leaf's number in what a query is told to visit.
_LEAF_BITS = 20


@dataclass
class Tree:
    """Inner nodes: normal, offset, children; a child below 0 is leaf -child - 1."""

    normal: np.ndarray
    offset: np.ndarray
    left: list[int]
    right: list[int]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(0 if self.left else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                below = x[rows] @ self.normal[node] <= self.offset[node]
                todo += [(self.left[node], rows[below]), (self.right[node], rows[~below])]
        return out


def grow(x: np.ndarray, rng: np.random.Generator, leaf_rows: int) -> Tree:
    normal, offset, left, right, leaves = [], [], [], [], 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        for _ in range(3 if len(rows) > leaf_rows else 0):
            a, b = x[rng.choice(rows, 2, replace=False)]
            direction = a - b
            size = np.linalg.norm(direction)
            if not size:
                continue
            along = x[rows] @ (direction / size)
            middle = float(np.median(along))
            below = along <= middle
            if below.all():
                middle = float(np.nextafter(along.max(), -np.inf))
                below = along <= middle
            if below.any() and not below.all():
                at = len(left)
                normal.append(direction / size)
                offset.append(middle)
                left.append(0)
                right.append(0)
                left[at], right[at] = node(rows[below]), node(rows[~below])
                return at
        leaves += 1
        return -leaves

    node(np.arange(len(x)))
    return Tree(np.array(normal).reshape(-1, x.shape[1]), np.array(offset), left, right)


class Forest:
    """Trees, and which of the sample's vectors each leaf holds."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, trees: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = [grow(sample, rng, leaf_rows) for _ in range(trees if len(sample) > leaf_rows else 1)]
        self.n = len(sample)
        self.held = []
        for tree in self.trees:
            at = tree.leaves(sample)
            by = np.argsort(at, kind="stable")
            self.held.append(np.split(by, np.searchsorted(at[by], np.arange(1, len(tree.left) + 1))))
        self.share = 1.0

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """Leaves (tree, leaf) in the order of the shared queue."""
        queue = [(-np.inf, t, 0 if tree.left else -1) for t, tree in enumerate(self.trees)]
        while queue:
            worst, t, node = heapq.heappop(queue)
            if node < 0:
                yield t, -node - 1
                continue
            tree = self.trees[t]
            margin = float(tree.normal[node] @ query - tree.offset[node])
            heapq.heappush(queue, (max(worst, margin), t, tree.left[node]))
            heapq.heappush(queue, (max(worst, -margin), t, tree.right[node]))

    def probe(self, query: np.ndarray) -> list[tuple[int, int]]:
        """The leaves to search: as many as cover `share` of the sample."""
        seen, covered, out = np.zeros(self.n, bool), 0, []
        for t, leaf in self.walk(query):
            out.append((t, leaf))
            rows = self.held[t][leaf]
            covered += int((~seen[rows]).sum())
            seen[rows] = True
            if covered >= self.share * self.n:
                break
        return out

    def calibrate(self, sample: np.ndarray, k: int, target: float, rng: np.random.Generator) -> None:
        """Sets share: the least that finds `target` of the k neighbours of sampled vectors in the sample."""
        if not any(tree.left for tree in self.trees):
            return
        needed = []
        for q in rng.choice(self.n, min(_PROBES, self.n), replace=False):
            far = np.square(sample - sample[q]).sum(axis=1)
            far[q] = np.inf
            seen, covered = np.full(self.n, np.inf), 0
            for t, leaf in self.walk(sample[q]):
                rows = self.held[t][leaf]
                new = rows[np.isinf(seen[rows])]
                covered += len(new)
                seen[new] = covered
                if covered == self.n:
                    break
            needed += (seen[np.argsort(far, kind="stable")[:k]] / self.n).tolist()
        self.share = float(np.quantile(needed, target))

    def load(self, sample: np.ndarray, rng: np.random.Generator) -> tuple[dict, dict]:
        """By (tree, leaf): the share of the sample that it holds, and the share of sampled vectors that would visit it."""
        visits: dict[tuple[int, int], float] = {}
        some = rng.choice(self.n, min(4 * _PROBES, self.n), replace=False)
        for q in some:
            for at in self.probe(sample[q]):
                visits[at] = visits.get(at, 0) + 1 / len(some)
        holds = {(t, i): len(rows) / self.n for t, held in enumerate(self.held) for i, rows in enumerate(held)}
        return holds, visits


def fit(rows: DataFrame, k: int, target: float = TARGET) -> tuple[Forest, np.ndarray, int] | None:
    """A forest grown on a sample of rows (vec_id, vector), the sample, and the number of rows; None without rows."""
    n = rows.count()
    if not n:
        return None
    wanted = min(max(n // SAMPLE_SHARE, SAMPLE_LEAST), SAMPLE_MOST)
    some = rows if n <= wanted else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n // wanted)) == 0)
    got = some.toArrow()  # about `wanted` rows
    if not got.num_rows:
        got = rows.limit(wanted).toArrow()
    x = matrix(got["vector"])[np.argsort(got["vec_id"].to_numpy())]
    leaf_rows = len(x) if n <= LEAF_ROWS else max(_LEAST_LEAF, len(x) * LEAF_ROWS // n)
    forest = Forest(x, leaf_rows, TREES)
    forest.calibrate(x, k, target, np.random.default_rng(11))
    return forest, x, n


def _leaf_rows(forest) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                leaves = np.stack([tree.leaves(x) for tree in forest.value.trees], axis=1).astype(np.int32)
                at = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * leaves.shape[1]), pa.array(leaves.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at], names=["vec_id", "vector", "leaves"])

    return run


def _probe_rows(forest) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t << _LEAF_BITS | leaf for t, leaf in forest.value.probe(row)] for row in matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["vec_id", "vector", "leaves"])

    return run


def _first_trees(leaves: np.ndarray, visits: list[list[int]], tree: int) -> np.ndarray:
    """For each query and row: whether no tree before gives the row to the query. leaves: a column a tree."""
    out = np.ones((len(visits), len(leaves)), bool)
    for q, found in enumerate(visits):
        found = np.asarray(found, np.int64)
        for t in range(tree):
            mine = found[found >> _LEAF_BITS == t] & ((1 << _LEAF_BITS) - 1)
            if len(mine):
                at = np.zeros(max(int(mine.max()), int(leaves[:, t].max(initial=0))) + 1, bool)
                at[mine] = True
                out[q] &= ~at[leaves[:, t]]
    return out


def rank_tile(ids: np.ndarray, x: np.ndarray, names: np.ndarray, queries: np.ndarray, free: Callable[[int, int], np.ndarray], k: int, local: bool, target: float) -> tuple[list, list, list]:
    """The k nearest of each query among a tile's rows that free(from, to) gives its queries."""
    out: tuple[list, list, list] = ([], [], [])
    norms, own = np.square(x).sum(axis=1), None
    if local and len(x) > 4 * LOCAL_ROWS:
        own = Forest(x, LOCAL_ROWS, 1)
        own.calibrate(x, k, target, np.random.default_rng(11))
        own = own if own.share < LARGE_SHARE else None
    for a in range(0, len(names), _QUERIES_AT_ONCE):
        some = queries[a : a + _QUERIES_AT_ONCE]
        open_rows = free(a, a + len(some))
        dense = None if own else norms[None] - 2 * some @ x.T
        for i, row in enumerate(some):
            at = np.sort(np.concatenate([own.held[t][leaf] for t, leaf in own.probe(row)])) if own else np.arange(len(ids))
            at = at[open_rows[i][at] & (ids[at] != names[a + i])]
            if len(at) > k:
                square = float(row @ row)
                near = (dense[i][at] if own is None else norms[at] - 2 * x[at] @ row) + square
                room = 1e-9 * (square + float(norms[at].max()))  # more than the products are rounded by
                at = at[near <= np.partition(near, k - 1)[k - 1] + room]
            far = np.sqrt(np.square(x[at] - row).sum(axis=1))
            best = np.lexsort((ids[at], far))[:k]
            out[0].extend([names[a + i]] * len(best))
            out[1].extend(ids[at][best].tolist())
            out[2].extend(far[best].tolist())
    return out


def _rank_rows(k: int, local: bool, target: float) -> Callable:
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if candidates.num_rows and queries.num_rows:
            ids, x, tree = candidates["vec_id"].to_numpy(), matrix(candidates["vector"]), candidates["tree"][0].as_py()
            leaves = matrix(candidates["leaves"]).astype(np.int64)
            visits = queries["leaves"].to_pylist()
            free = lambda a, b: _first_trees(leaves, visits[a:b], tree)
            found = rank_tile(ids, x, queries["vec_id"].to_numpy(), matrix(queries["vector"]), free, k, local, target)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors nearest by Euclidean distance that the forest finds for each query.

    is_query: a condition on column vec_id.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, zero=False)
    fitted = fit(rows, k, target)
    if fitted is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    forest, sample, n = fitted
    n_queries = rows.filter(is_query).count()
    holds, visits = forest.load(sample, np.random.default_rng(13))
    parts = [(t, i, max(1, round(share * n / GROUP_ROWS + 0.25)), max(1, round(visits.get((t, i), 0) * n_queries / QUERY_ROWS + 0.25))) for (t, i), share in holds.items()]
    split = F.broadcast(spark.createDataFrame(parts, "tree int, leaf int, groups int, blocks int"))  # a row a leaf: SAMPLE_MOST / _LEAST_LEAF a tree at most
    shared = spark.sparkContext.broadcast(forest)  # as many nodes and places
    typed = f"vec_id bigint, vector {rows.schema['vector'].dataType.simpleString()}, leaves array<int>"
    part = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    told = ["vec_id", "vector", "leaves", "tree", "leaf"]
    left = rows.mapInArrow(_leaf_rows(shared), typed).select("vec_id", "vector", "leaves", F.posexplode("leaves").alias("tree", "leaf"))
    left = left.join(split, ["tree", "leaf"]).select(*told, part("groups").alias("group"), every("blocks").alias("block"))
    right = rows.filter(is_query).mapInArrow(_probe_rows(shared), typed).select("vec_id", "vector", "leaves", F.explode("leaves").alias("at"))
    right = right.withColumn("tree", F.shiftright("at", _LEAF_BITS)).withColumn("leaf", F.col("at").bitwiseAND(F.lit((1 << _LEAF_BITS) - 1)))
    right = right.join(split, ["tree", "leaf"]).select(*told, every("groups").alias("group"), part("blocks").alias("block"))
    keys = ["tree", "leaf", "group", "block"]
    local = forest.share < LARGE_SHARE
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_rank_rows(k, local, target), "query_id bigint, vec_id bigint, score double")
    return best_of(found, k, F.asc("score"))
