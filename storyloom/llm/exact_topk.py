"""Exact top-k by inner product, by branch and bound over dimension blocks in vertical layout.

In a tile, candidates lie column by column. A query adds up its products a block of dimensions at a time; what the rest can
add to a sum is at most the product of the two remaining norms (and can take away as much), so candidates whose sum and
remaining mass stay below the k-th best lower bound are dropped, and the survivors are moved together before the next
block. A query takes its k best so far from one part of a tile to the next, which sharpens the bound. Scores are integers:
components are floor(scale * x), and sums are exact in doubles below 2**53, beyond that in Python's integers.

Edge cases: see vectors.usable(); zero vectors take part; scores beyond 64 bits are ranked by their exact value and given as
the nearest long; a query's own identifier isn't among its results; with fewer than
k candidates all are returned; ties go to the smaller identifier; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.vectors import GROUP_ROWS, QUERY_ROWS, best_of, matrix, tiles, usable

SCALE, DIMENSIONS, PART_ROWS = 256, 16, 4096


def _remaining(x: np.ndarray) -> np.ndarray:
    """For each block of dimensions: the norm of each row behind it. Rounded up a little, so that bounds stay bounds."""
    squares = np.array([np.square(x[:, i : i + DIMENSIONS]).sum(axis=1) for i in range(0, x.shape[1], DIMENSIONS)])
    behind = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(np.concatenate([behind[1:], np.zeros((1, len(x)))])) * (1 + 1e-9)


def search_tile(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, scale: float = 1) -> tuple[list, list, list]:
    """The k best candidates of each query among a tile's; components count as floor(scale * x)."""
    largest = max(np.abs(x).max(initial=0), np.abs(queries).max(initial=0)) * abs(scale) + 1
    if largest > 1 << 26 or largest * largest * x.shape[1] >= 1 << 53:
        whole = np.vectorize(lambda v: math.floor(Fraction(v) * Fraction(scale)), otypes=[object])
        return _plain(ids, whole(x), query_ids, whole(queries), k)
    x, queries = np.floor(x * scale), np.floor(queries * scale)
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in query_ids]
    query_rest = _remaining(queries)
    blocks = range(0, x.shape[1], DIMENSIONS)
    for a in range(0, len(ids), PART_ROWS):
        part, names = x[a : a + PART_ROWS], ids[a : a + PART_ROWS]
        rest = _remaining(part)
        columns = [np.ascontiguousarray(part[:, i : i + DIMENSIONS].T) for i in blocks]
        first = queries[:, :DIMENSIONS] @ columns[0]
        for q in range(len(query_ids)):
            at = np.flatnonzero(names != query_ids[q])
            sums = first[q][at]
            held, held_ids = best[q]
            for b in range(len(columns)):
                if b:
                    sums = sums + queries[q, blocks[b] : blocks[b] + DIMENSIONS] @ columns[b][:, at]
                mass = rest[b][at] * query_rest[b][q]
                floor = -np.inf
                if len(sums) > k:
                    low = sums - mass
                    floor = np.partition(low, len(low) - k)[len(low) - k]
                if len(held) == k:
                    floor = max(floor, held.min())
                alive = sums + mass >= floor - 1e-6
                if not alive.all():
                    at, sums = at[alive], sums[alive]
            scores, found = np.concatenate([held, sums]), np.concatenate([held_ids, names[at]])
            by = np.lexsort((found, -scores))[:k]
            best[q] = scores[by], found[by]
    sizes = [len(s) for s, _ in best]
    names = np.repeat(query_ids, sizes).tolist()
    return names, [i for _, f in best for i in f.tolist()], [int(v) for s, _ in best for v in s.tolist()]


def _plain(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """Sums beyond 2**53, in Python's integers."""
    out: tuple[list, list, list] = ([], [], [])
    for name, row in zip(query_ids.tolist(), queries, strict=True):
        scored = sorted((-int(s), i) for s, i in zip(x @ row, ids.tolist(), strict=True) if i != name)[:k]
        for s, i in scored:
            out[0].append(name)
            out[1].append(i)
            out[2].append(-s)
    return out


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _beyond(score: int) -> bytes | None:
    """Bytes that sort as scores beyond 64 bits do; none for others."""
    if _LEAST < score <= _MOST:
        return None
    size = (score.bit_length() + 7) // 8
    if score > 0:
        return size.to_bytes(4, "big") + score.to_bytes(size, "big")
    return ((1 << 32) - 1 - size).to_bytes(4, "big") + ((1 << 8 * size) + score).to_bytes(size, "big")


def _tile_rows(k: int, scale: float) -> Callable:
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score", "beyond"]
        if not candidates.num_rows or not queries.num_rows:
            return pa.table([*[pa.array([], pa.int64())] * 3, pa.array([], pa.binary())], names=names)
        query_ids, ids, scores = search_tile(candidates["vec_id"].to_numpy(), matrix(candidates["vector"]), queries["vec_id"].to_numpy(), matrix(queries["vector"]), k, scale)
        longs = pa.array([min(max(s, _LEAST), _MOST) for s in scores], pa.int64())
        return pa.table([pa.array(query_ids, pa.int64()), pa.array(ids, pa.int64()), longs, pa.array([_beyond(s) for s in scores], pa.binary())], names=names)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with the other vectors.

    is_query: a condition on column vec_id.
    """
    whole = usable(vectors, id_col, vector_col, zero=True)
    queries = whole.filter(is_query)
    groups, blocks = tiles(whole.count(), GROUP_ROWS), tiles(queries.count(), QUERY_ROWS)
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = whole.select("vec_id", "vector", part(groups).alias("group"), every(blocks).alias("block"))
    right = queries.select("vec_id", "vector", every(groups).alias("group"), part(blocks).alias("block"))
    keys = ["group", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile_rows(k, scale), "query_id bigint, vec_id bigint, score bigint, beyond binary")
    return best_of(found, k, F.desc("score"), F.desc_nulls_last("beyond"))
