"""Hashed bags of words and dense vectors.

A word's bucket is its MD5 as a number modulo the width, folded from four 32-bit parts so that it stays in longs. With a
width divisible by 4 a word's sign depends on its bucket alone, so cosines are those of plain counts: whole numbers with
one division at the end, the same on any engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import text as tx

#: Of a hashed bag, and of a graph's node, which is filled up with zeros.
WIDTH, NODE_WIDTH = 300, 384


def bucket(word: Column, width: int = WIDTH) -> Column:
    digest = F.md5(word.cast("binary"))
    part = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    out = part(0) % width
    for i in (1, 2, 3):
        out = (out * 4294967296 + part(i)) % width
    return out.cast("int")


def bucket_counts(rows: DataFrame, id_cols: list[str], text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id_cols, bucket, cnt: the sparse hashed bag of words of each text."""
    words = rows.select(*id_cols, F.explode(tx.words(text_col)).alias("_w"))
    return words.select(*id_cols, bucket(F.col("_w"), width).alias("bucket")).groupBy(*id_cols, "bucket").agg(F.count("*").alias("cnt"))


def squared_norms(counts: DataFrame, id_cols: list[str]) -> DataFrame:
    return counts.groupBy(*id_cols).agg(F.sum(F.col("cnt") * F.col("cnt")).alias("sq"))


def pair_cosines(pairs: DataFrame, counts: DataFrame, id_col: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """pairs with cosine: of the bags of columns a and b; 0 where either is empty or they share no bucket."""
    norms = squared_norms(counts, [id_col])
    left = counts.select(F.col(id_col).alias(a), F.col("bucket").alias("_bucket"), F.col("cnt").alias("_x"))
    right = counts.select(F.col(id_col).alias(b), F.col("bucket").alias("_bucket"), F.col("cnt").alias("_y"))
    dots = pairs.select(a, b).distinct().join(left, a).join(right, [b, "_bucket"]).groupBy(a, b).agg(F.sum(F.col("_x") * F.col("_y")).alias("_dot"))
    out = pairs.join(dots, [a, b], "left")
    out = out.join(norms.select(F.col(id_col).alias(a), F.col("sq").alias("_na")), a, "left").join(norms.select(F.col(id_col).alias(b), F.col("sq").alias("_nb")), b, "left")
    value = F.coalesce(F.col("_dot") / F.sqrt((F.col("_na") * F.col("_nb")).cast("double")), F.lit(0.0))
    return out.withColumn("cosine", value).drop("_dot", "_na", "_nb")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def pad(v: Column, width: int) -> Column:
    """v with zeros behind it, or cut, to a width."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width)


def centroid(rows: DataFrame, keys: list[str], vector_col: str) -> DataFrame:
    """keys, centroid: the mean vector by keys."""
    cells = rows.select(*keys, F.posexplode(vector_col).alias("_i", "_x"))
    means = cells.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    whole = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))  # as long as the vectors are wide
    return whole


def hashed_dense(rows: DataFrame, id_cols: list[str], text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id_cols, vec: signed hashed bags as unit vectors; an empty text's is zero."""
    counts = bucket_counts(rows, id_cols, text_col, width)
    sign = F.when(F.col("bucket") % 4 >= 2, F.col("cnt")).otherwise(-F.col("cnt")) if width % 4 == 0 else F.col("cnt")
    signed = counts.withColumn("v", sign.cast("double"))
    maps = signed.groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))  # `width` entries at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("n"))
    out = rows.select(*id_cols).distinct().join(maps, id_cols, "left")
    return out.select(*id_cols, F.coalesce(dense, F.array_repeat(F.lit(0.0), width)).alias("vec"))


def embed(rows: DataFrame, id_cols: list[str], load: Callable[[], Callable[[list[str]], list]] | None = None, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id_cols, vec: by a model that each worker loads once, else hashed bags.

    load: returns a function from texts to vectors. Texts that the model gives no vector for get their hashed bag.
    """
    if load is None:
        return hashed_dense(rows, id_cols, text_col, width)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    made = rows.select(*id_cols, run(text_col).alias("_v"))
    hashed = hashed_dense(rows, id_cols, text_col, width)
    out = made.join(hashed, id_cols)
    return out.select(*id_cols, F.coalesce(F.col("_v").cast("array<double>"), F.col("vec")).alias("vec"))
