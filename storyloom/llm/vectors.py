"""What the two vector searches share: which vectors take part, and tiles of bounded size.

A search never holds more than one tile: GROUP_ROWS candidates and QUERY_ROWS queries. Candidates are dealt into groups by
a hash, so equal vectors spread; each is copied once for each block of queries, and each query once for each group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import forget, written

GROUP_ROWS, QUERY_ROWS = 16_384, 1024


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """vec_id, vector of the rows that take part, as a written table; vectors of floats stay floats, others are doubles.

    Left out: null identifiers, vectors that are null or empty or hold null or non-finite components, those of another
    length than most (of lengths as frequent the smaller), and zero vectors unless `zero`. An identifier counts once, with
    the smallest of its vectors.
    """
    kind = vectors.select(vector_col).schema[0].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)) & (F.size("vector") > 0))
    if not zero:
        rows = rows.filter(F.exists("vector", lambda x: x != 0))
    rows = written(rows, "vectors")
    if rows.count() != rows.select("vec_id").distinct().count():
        every, rows = rows, written(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
        forget(every)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (sizes[0] if sizes else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def tiles(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def best_of(found: DataFrame, k: int, *score: Column) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of (query_id, vec_id, score) in this order, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(*score, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
